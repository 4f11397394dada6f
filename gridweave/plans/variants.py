"""From a file's features to ranked variants: ingest, plans over the whole scene, output tables, features and the rules' report.

Variants differ in how many parts the new network has. The first may use every tie-in point; the next ones keep, of the tie-in points that
the last one used, the half whose trees carry most flow, down to one. Where that gives fewer variants than wanted, further ones
do without all tie-in points used so far. Each is planned anew over the whole scene, written before the next begins, and dropped
if its edges are those of an earlier one. A deadline is looked at between plans, so that what is done stays whole.

Edge cases: features of unknown types, null geometries and flows are ingest's; a scene without terminals or network has variants
without edges, where all terminals are listed as unconnected; without any position there is no zone and ValueError is raised;
equal scores are ranked by variant number; extra columns aren't read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.functions import geodesy
from gridweave.operators import compliance, ingest, outlines, topology
from gridweave.operators import obstacles as O
from gridweave.operators.storage import Workspace, temporary_tables
from gridweave.plans import planning
from gridweave.sources import dimensions as D
from gridweave.sources import geojson, results

#: Ends of lines within this (m) are one node; chambers stand on the network within it.
TOLERANCE = 0.5
#: Tie-in points along the existing network (m).
STEP = 25.0


@dataclass
class Site:
    """A scene in metres. terminals: id, node, x, y, flow. ties: node, x, y, room, chamber, host_dn, slots."""

    terminals: DataFrame
    ties: DataFrame
    forbidden: DataFrame
    zone: int
    work: Workspace


def zone_of(features: DataFrame) -> int:
    """The zone of the first source, without one that of the westernmost position."""
    at = ingest.source(features).select("x").first()
    if at is None:
        lon = F.array_min(F.transform(F.flatten("geom.parts"), lambda p: p[0]))
        at = features.where("geom IS NOT NULL").agg(F.min(lon)).first()
    if at is None or at[0] is None:
        raise ValueError("no feature has a position, so there is no zone to plan in")
    return features.sparkSession.range(1).select(geodesy.zone(F.lit(float(at[0])))).first()[0]


def in_metres(features: DataFrame, zone: int) -> DataFrame:
    """features with their positions in metres of the zone."""

    def moved(p: Column) -> Column:
        x, y = geodesy.project(p[0], p[1], zone)
        return F.array(x, y)

    parts = F.transform("geom.parts", lambda part: F.transform(part, moved))
    return features.withColumn("geom", F.when(F.col("geom").isNotNull(), F.struct(F.col("geom.type").alias("type"), parts.alias("parts"))))


def forbidden(features: DataFrame, work: Workspace) -> DataFrame:
    """(obstacle, rings, closed, clearance) of all forbidden restrictions, numbered, their outlines simplified."""
    r = ingest.restrictions(features).where("rule = 'FORBIDDEN'")
    closed = F.col("geom.type").isin("Polygon", "MultiPolygon")
    open_ring = lambda ring: F.when(closed & (F.size(ring) > 1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    rings = F.transform("geom.parts", lambda ring: F.transform(open_ring(ring), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    rows = r.select(rings.alias("rings"), closed.alias("closed"), C.least_distance(F.col("kind"), F.lit(planning.DESIGN_DN)).alias("clearance"))
    return work.write(outlines.simplify(rows.withColumn("obstacle", F.monotonically_increasing_id())), "forbidden")


def tie_ins(features: DataFrame) -> DataFrame:
    """(node, x, y, room, chamber, host_dn, slots): existing chambers with room, and points along the lines away from chambers.

    A point on a line takes two of a chamber's connections, where lines meet as many as lines end there.
    """
    lines = ingest.segments(features)
    pits = ingest.chambers_with_network(ingest.chambers(features), lines, TOLERANCE).where("degree > 0")
    pits = pits.select("x", "y", F.lit(True).alias("chamber"), F.col("dn").alias("host_dn"), F.col("degree").cast("int").alias("slots"))
    links = topology.links(lines).join(lines.select("id", "dn"), "id")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.ceil(F.hypot(dx, dy) / STEP), F.lit(1))
    at = links.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    t = F.col("i") / F.col("n")
    ends = F.when((F.col("i") == 0) | (F.col("i") == F.col("n")), 1).otherwise(2)
    spots = at.select((F.col("x0") + dx * t).alias("x"), (F.col("y0") + dy * t).alias("y"), F.col("dn").alias("host_dn"), ends.alias("slots"))
    mm = {"mx": F.floor(F.col("x") * 1000 + 0.5), "my": F.floor(F.col("y") * 1000 + 0.5)}
    spots = spots.withColumns(mm).groupBy("mx", "my").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("host_dn").alias("host_dn"), F.sum("slots").cast("int").alias("slots"))
    cell = float(D.SNAP_RADIUS)
    around = {"x0": F.col("x") - cell, "y0": F.col("y") - cell, "x1": F.col("x") + cell, "y1": F.col("y") + cell}
    near = O.dealt(pits.withColumns(around), cell).select("cx", "cy", F.col("x").alias("_x"), F.col("y").alias("_y"))
    close = O.spot(spots, cell).join(near, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= cell).select("mx", "my").distinct()
    free = spots.join(close, ["mx", "my"], "left_anti").withColumn("chamber", F.lit(False))
    pits = pits.withColumns(mm).groupBy("mx", "my").agg(*[F.max(c).alias(c) for c in ("x", "y", "chamber", "host_dn", "slots")])
    every = free.unionByName(pits).withColumn("room", F.lit(D.MAX_DEGREE) - F.col("slots")).where("room > 0")
    return every.select(F.concat_ws(":", F.lit("tie"), "mx", "my").alias("node"), "x", "y", "room", "chamber", "host_dn", "slots")


def site(features: DataFrame) -> Site:
    """The scene of features in degrees, each part written once."""
    work = Workspace(features.sparkSession, "site")
    zone = zone_of(features)
    metres = work.write(in_metres(features, zone), "metres")
    # Names hold no separator, so that runs and nodes can be put together.
    ends = ingest.terminals(metres).select("id", F.concat(F.lit("terminal:"), F.url_encode("id")).alias("node"), "x", "y", "flow")
    return Site(work.write(ends, "terminals"), work.write(tie_ins(metres), "ties"), forbidden(metres, work), zone, work)


def _planned(s: Site, ties: DataFrame) -> DataFrame:
    """The sized edges of the plan with these tie-in points, written to the site's tables by the caller."""
    work = Workspace(s.terminals.sparkSession, "variant")
    nodes, parts = planning.free_nodes(s.terminals.select("node", "x", "y", "flow"), ties.select("node", "x", "y", "room"), s.forbidden, work)
    runs = nodes.where("kind = 'terminal'").select(F.lit(0).cast("long").alias("run"), "node")
    return planning.plan(planning.Planned(nodes, parts, work), runs)


def build(s: Site, wanted: int = 3, seconds: float | None = None) -> DataFrame:
    """(variant, root, node, parent, x, y, px, py, length, flow, dn, cost): the edges of at most `wanted` different variants, from 1.

    After `seconds` no further plan is begun; the first is always made.
    """
    began, out, prints = time.monotonic(), None, set()
    ties, used, least = s.ties, None, None
    for k in range(1, wanted + 1):
        if out is not None and seconds is not None and time.monotonic() - began > seconds:
            break
        with temporary_tables():
            edges = s.work.write(_planned(s, ties).withColumn("variant", F.lit(k).cast("long")).drop("run"), f"edges-{k}")
        place = F.xxhash64(*[F.floor(F.col(c) * 100 + 0.5) for c in ("x", "y", "px", "py")])
        # The sum and the number of the places: a variant that equals an earlier one isn't kept.
        seen = edges.agg(F.count(F.lit(1)), F.sum(place.cast("decimal(38,0)")), F.countDistinct("root")).first()
        roots = edges.where(F.col("parent") == F.col("root")).groupBy("root").agg(F.sum("flow").alias("flow"))
        used = roots.select(F.col("root").alias("node")) if used is None else used.unionByName(roots.select(F.col("root").alias("node")))
        if seen[:2] not in prints:
            prints.add(seen[:2])
            out = edges if out is None else out.unionByName(edges)
        least = seen[2] if least is None else min(least, seen[2])
        if not seen[2]:
            break
        if least > 1:
            most = roots.orderBy(F.desc("flow"), "root").limit(-(-least // 2)).select(F.col("root").alias("node"))
            ties = s.ties.join(most, "node", "left_semi")
            least = -(-least // 2)
        else:
            ties = s.ties.join(used.distinct(), "node", "left_anti")
        ties = s.work.write(ties, f"ties-{k + 1}")
        if ties.isEmpty():
            break
    return out


def tables(s: Site, edges: DataFrame, variants: DataFrame | None = None) -> compliance.Result:
    """The result's tables, as the rules take them: centimetres, hundredths of t/h, nodes numbered from 1 in each variant.

    variants: (variant) of those that have no edges as well. Each edge is a segment; nodes where it branches and tie-in points on lines are
    chambers, other nodes technical ones. A tie-in at an existing chamber costs TIE_IN_COST, one on a line its chamber.
    """
    work = s.work
    every = edges.select("variant").distinct() if variants is None else variants
    named = edges.select("variant", "node").union(edges.select("variant", F.col("parent").alias("node"))).union(every.crossJoin(s.terminals.select("node"))).distinct()
    # Numbers by ranges of names: a first pass counts, so no task holds a variant.
    share = F.pmod(F.xxhash64("node"), F.lit(64))
    named = named.withColumn("_s", share)
    sizes = named.groupBy("variant", "_s").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_b", F.sum("n").over(Window.partitionBy("variant").orderBy("_s")) - F.col("n")).drop("n")
    ids = named.withColumn("_r", F.row_number().over(Window.partitionBy("variant", "_s").orderBy("node"))).join(before, ["variant", "_s"])
    ids = work.write(ids.select("variant", "node", (F.col("_b") + F.col("_r")).cast("long").alias("n")), "numbers")
    of = lambda c, n: ids.select("variant", F.col("node").alias(c), F.col("n").alias(n))
    cm = lambda c: F.col(c) * 100
    geom = F.col("length") * 100
    seg = edges.join(of("node", "b"), ["variant", "node"]).join(of("parent", "a"), ["variant", "parent"])
    seg = seg.select("variant", F.col("b").alias("i"), "a", "b", cm("px").alias("xa"), cm("py").alias("ya"), ((cm("x") + cm("px")) / 2).alias("xm"), ((cm("y") + cm("py")) / 2).alias("ym"), cm("x").alias("xb"), cm("y").alias("yb"), geom.alias("geom"), F.floor(geom + 0.5).alias("length"), F.floor(F.col("flow") * 100 + 0.5).alias("flow"), F.col("dn").cast("long").alias("dn"), F.lit("base").alias("method"), F.col("cost").cast("long").alias("cost"), "parent")
    seg = work.write(seg, "segments")
    roots = seg.where("parent LIKE 'tie:%'").groupBy("variant", F.col("parent").alias("node")).agg(F.first("a").alias("n"), F.max("dn").alias("widest"), F.first("xa").alias("x"), F.first("ya").alias("y"))
    roots = work.write(roots.join(s.ties.select("node", "chamber", F.col("host_dn").cast("long").alias("host_dn"), F.col("slots").cast("long").alias("slots")), "node"), "roots")
    seg = seg.drop("parent")
    branch = seg.groupBy("variant", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.max("dn").alias("below")).where("k >= 2")
    branch = branch.join(seg.select("variant", F.col("b").alias("node"), F.col("dn").alias("above"), F.col("xb").alias("x"), F.col("yb").alias("y")), ["variant", "node"])
    pits = branch.select("variant", "node", F.greatest("below", "above").alias("dn"), F.lit(0).cast("long").alias("host_dn"), F.lit(0).cast("long").alias("slots"), "x", "y")
    pits = pits.unionByName(roots.where("NOT chamber").select("variant", F.col("n").alias("node"), F.greatest("widest", "host_dn").alias("dn"), "host_dn", "slots", "x", "y"))
    pits = work.write(pits.withColumn("cost", C.chamber_cost(F.col("dn")).cast("long")), "chambers")
    listed = every.crossJoin(s.terminals.select("id", "node", F.floor(F.col("flow") * 100 + 0.5).alias("flow")))
    got = edges.select("variant", "node", F.lit(False).alias("_left"))
    points = listed.join(got, ["variant", "node"], "left").join(of("node", "n"), ["variant", "node"])
    points = work.write(points.select("variant", F.col("n").alias("node"), "flow", F.coalesce("_left", F.lit(True)).alias("listed"), "id"), "points")
    sums = every.join(seg.groupBy("variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length")), "variant", "left")
    sums = sums.join(pits.groupBy("variant").agg(F.sum("cost").alias("chamber_cost")), "variant", "left")
    sums = sums.join(roots.where("chamber").groupBy("variant").agg(F.count(F.lit(1)).alias("tie_count")), "variant", "left")
    fine = F.sum(D.PENALTY + D.PENALTY_PER_FLOW // 100 * F.col("flow"))
    sums = sums.join(points.where("listed").groupBy("variant").agg(fine.alias("penalty")), "variant", "left").na.fill(0)
    sums = sums.withColumn("tie_cost", F.col("tie_count") * D.TIE_IN_COST).withColumn("construction", F.col("pipes") + F.col("chamber_cost") + F.col("tie_cost")).withColumn("total", F.col("construction") + F.col("penalty"))
    sums = sums.withColumn("score", C.half_up(C.score(F.col("total"), F.col("length") / 100.0), 3))
    first = Window.partitionBy("job").orderBy("score", "variant")  # a job has few variants
    sums = sums.withColumn("job", F.lit(0).cast("long")).withColumn("rank", F.row_number().over(first).cast("long"))
    sums = work.write(sums.select("job", "variant", F.lit(1).alias("copy"), "rank", "chamber_cost", "tie_count", "tie_cost", "construction", "penalty", "total", "length", "score"), "summaries")
    done = compliance.Result(seg, pits, points, sums, None, results.ATTRIBUTES, results.GEOMETRIES, roots.select("variant", F.col("n").alias("node")))
    texts = work.write(_texts(s, done, roots), "features")
    f = geojson.decode(texts.select("ordinal", "text")).join(texts.select("ordinal", "variant"), "ordinal")
    done.features = f.select(F.coalesce("id", F.col("ordinal").cast("string")).alias("id"), "variant", "object_type", F.map_keys("props").alias("keys"), F.col("geom.type").alias("geometry"), F.coalesce(F.array_max(F.transform(F.flatten("geom.parts"), lambda p: F.size(p))), F.lit(0)).cast("long").alias("dims"))
    return done


def _texts(s: Site, r: compliance.Result, roots: DataFrame) -> DataFrame:
    """(ordinal, variant, text): the output's features by rank: summary, segments, chambers, technical nodes."""
    at = lambda x, y: geojson.degrees(*geodesy.unproject(F.col(x) / 100, F.col(y) / 100, s.zone))
    name = lambda kind, c: F.concat_ws("_", F.lit(kind), F.col("variant").cast("string"), F.col(c).cast("string"))
    own = r.chambers.select("variant", "node", name("ch", "node").alias("label"))
    old = roots.where("chamber").select("variant", F.col("n").alias("node"), name("tie", "n").alias("label"))
    ends = r.points.select("variant", "node", F.col("id").alias("label"))
    known = own.unionByName(old).unionByName(ends)
    spots = r.segments.select("variant", F.col("b").alias("node"), F.col("xb").alias("x"), F.col("yb").alias("y")).unionByName(roots.where("chamber").select("variant", F.col("n").alias("node"), "x", "y"))
    plain = spots.join(own.unionByName(ends).select("variant", "node"), ["variant", "node"], "left_anti").join(old, ["variant", "node"], "left").withColumn("label", F.coalesce("label", name("tn", "node")))
    labels = known.unionByName(plain.where("label LIKE 'tn_%'").select("variant", "node", "label"))
    of = lambda c, n: labels.select("variant", F.col("node").alias(c), F.col("label").alias(n))
    whole = lambda c: F.col(c).cast("long")

    def made(df: DataFrame, kind: str, order: int, values: list[Column], shape: str, at: Column) -> DataFrame:
        props = F.struct(*[v.alias(k) for k, v in zip(results.ATTRIBUTES[kind], values, strict=True)])
        return df.select("variant", F.lit(order).cast("long").alias("part"), F.col("node").alias("n"), geojson.to_feature(props, F.lit(shape), at).alias("text"))

    lines = r.segments.withColumn("node", F.col("b")).join(of("a", "start"), ["variant", "a"]).join(of("b", "end"), ["variant", "b"])
    depth = F.lit(D.USUAL_DEPTH)
    kind, variant = F.lit, F.col("variant")
    way = F.concat(F.lit("["), at("xa", "ya"), F.lit(","), at("xb", "yb"), F.lit("]"))
    out = made(lines, "heat_network", 1, [name("new", "b"), kind("heat_network"), variant, F.col("start"), F.col("end"), F.col("flow") / 100.0, whole("dn"), F.col("length") / 100.0, F.col("method"), depth, depth, whole("cost")], "LineString", way)
    met = r.segments.select("variant", F.explode(F.array("a", "b")).alias("node")).groupBy("variant", "node").count()
    pits = r.chambers.join(met, ["variant", "node"])
    out = out.unionByName(made(pits, "heat_chamber", 2, [name("ch", "node"), kind("heat_chamber"), variant, whole("dn"), F.col("count") + F.col("slots"), whole("cost")], "Point", at("x", "y")))
    out = out.unionByName(made(plain, "technical_node", 3, [F.col("label"), kind("technical_node"), variant], "Point", at("x", "y")))
    # The list of what isn't connected is one feature's attribute, so it is as long as the output asks for.
    left = r.points.where("listed").groupBy("variant").agg(F.array_sort(F.collect_list("id")).alias("left"))
    sums = r.summaries.join(left, "variant", "left").withColumn("node", F.lit(0).cast("long"))
    values = [name("summary", "rank"), kind("variant_summary"), variant, *[F.col(c) for c in ("rank", "construction", "chamber_cost", "tie_count", "tie_cost", "penalty", "total")], F.col("length") / 100.0, F.col("score"), F.coalesce("left", F.array().cast("array<string>"))]
    out = out.unionByName(made(sums, "variant_summary", 0, values, "Point", F.lit(None).cast("string")))
    ranked = out.join(r.summaries.select("variant", "rank"), "variant").withColumn("k", F.concat_ws(":", F.col("rank"), F.col("part")))
    # Ordinals leave room for a variant's nodes, so that no pass over all features is needed.
    return ranked.select((F.col("rank") * 4 * compliance.NODES + F.col("part") * compliance.NODES + F.col("n")).alias("ordinal"), "variant", "text")


def plan_features(features: DataFrame, wanted: int = 3, seconds: float | None = None) -> tuple[compliance.Result, DataFrame]:
    """The ranked variants of a file's features as tables, and their output features (ordinal, text) for geojson's writers."""
    s = site(features)
    edges = build(s, wanted, seconds)
    first = features.sparkSession.range(1, 2).select(F.col("id").alias("variant"))
    done = tables(s, edges, edges.select("variant").union(first).distinct())
    return done, features.sparkSession.read.parquet(s.work.path("features")).select("ordinal", "text")
