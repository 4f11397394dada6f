"""From decoded features to a scene. Gaps are filled where a rule says how, and every such step leaves a diagnostic.

All functions take features as gridweave.sources.geojson decodes them; coordinates keep the unit they came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import geometry as G
from gridweave.operators import spatial, topology
from gridweave.sources import dimensions as D
from gridweave.sources import geojson

# The input's types.
TYPES = ["source", "heat_network", "heat_chamber", "oks_future", "oks_connection_point", "oks_existing", "restriction"]


def _number(name: str):
    return geojson.number(F.col("props")[name])


def with_ids(features: DataFrame) -> DataFrame:
    """Features without an id get one from their type and ordinal."""
    return features.withColumn("id", F.coalesce("id", F.concat_ws(":auto:", F.coalesce("object_type", F.lit("unknown")), F.col("ordinal").cast("string"))))


def source(features: DataFrame) -> DataFrame:
    """(id, x, y) of the first source that is a point, in the file's order; no row where there's none."""
    s = with_ids(features).where("object_type = 'source' AND geom.type = 'Point'")
    first = s.orderBy("ordinal").limit(1)
    return first.select("id", F.col("geom.parts")[0][0][0].alias("x"), F.col("geom.parts")[0][0][1].alias("y"))


def segments(features: DataFrame) -> DataFrame:
    """(id, dn, stated, flow, points): one row a line, parts of a multi-line as id#1, id#2. No diameter stated: the smallest."""
    s = with_ids(features).where("object_type = 'heat_network' AND geom.type IN ('LineString', 'MultiLineString')")
    parts = s.select("id", "props", F.size("geom.parts").alias("n"), F.posexplode("geom.parts").alias("at", "points"))
    stated = F.floor(_number("diameter") + 0.5).cast("int")
    return parts.where(F.size("points") >= 2).select(
        F.when(F.col("n") > 1, F.concat("id", F.lit("#"), (F.col("at") + 1).cast("string"))).otherwise(F.col("id")).alias("id"),
        F.coalesce(stated, F.lit(D.DIAMETERS[0][0])).alias("dn"), stated.alias("stated"), _number("flow_tph").alias("flow"), "points",
    )


def chambers(features: DataFrame) -> DataFrame:
    """(id, dn, x, y): a geometry that isn't a point stands for its first position; without one the chamber is left out."""
    c = with_ids(features).where("object_type = 'heat_chamber' AND geom IS NOT NULL")
    first = F.col("geom.parts")[0][0]
    return c.select("id", F.coalesce(F.floor(_number("diameter") + 0.5).cast("int"), F.lit(0)).alias("dn"), first[0].alias("x"), first[1].alias("y"))


def chambers_with_network(chambers: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """chambers with degree and dn, taken from the segments that end within the tolerance; a stated dn stays.

    A chamber where nothing ends, but on a line's way, has two connections: the line comes in and goes on.
    """
    ends = segments.select("dn", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("p")).select(F.col("dn").alias("line_dn"), F.col("p")[0].alias("ex"), F.col("p")[1].alias("ey"))
    cell = lambda v: F.floor(F.col(v) / tolerance)
    ends = ends.withColumn("cx", cell("ex")).withColumn("cy", cell("ey"))
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = chambers.withColumn("c", F.explode(around)).select("id", "x", "y", "c.cx", "c.cy")
    near = c.join(ends, ["cx", "cy"]).where(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) <= tolerance)
    met = near.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.max("line_dn").alias("line_dn"))
    spot = chambers.join(met, "id", "left_anti").select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    passed = topology.nearest_links(spot, topology.links(segments), "id", tolerance).select("id", F.lit(2).alias("passed"))
    out = chambers.join(met, "id", "left").join(passed, "id", "left")
    inferred = (F.col("dn") == 0) & F.col("line_dn").isNotNull()
    return out.select("id", F.when(inferred, F.col("line_dn")).otherwise(F.col("dn")).alias("dn"), inferred.alias("inferred"), F.coalesce("degree", "passed", F.lit(0)).alias("degree"), "x", "y")


def terminals(features: DataFrame) -> DataFrame:
    """(id, id_is_text, x, y, flow, origin): a building's point, of several the one nearest to the network, then the smallest id;
    the building's flow, 0 without one.

    Points without a building stand alone with their own flow. A building without a point gets the place of its outline that is
    nearest to the network, its first corner where there's no network.
    """
    f = with_ids(features)
    points = f.where("object_type = 'oks_connection_point' AND geom IS NOT NULL").select(
        F.col("id").alias("point"), F.col("id_is_text").alias("point_is_text"), F.col("props")["oks_id"].alias("oks"), F.col("geom.parts")[0][0][0].alias("px"), F.col("geom.parts")[0][0][1].alias("py"), _number("flow_tph").alias("point_flow")
    )
    network = topology.links(segments(features))
    buildings = f.where("object_type = 'oks_future' AND geom IS NOT NULL").select(F.col("id").alias("oks"), "id_is_text", F.col("geom.parts").alias("parts"), F.col("geom.parts")[0][0][0].alias("bx"), F.col("geom.parts")[0][0][1].alias("by"), _number("flow_tph").alias("flow"))
    owned = points.where("oks IS NOT NULL")
    several = owned.join(owned.groupBy("oks").count().where("count > 1"), "oks", "left_semi")
    spot = several.select("point", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"))
    far = topology.nearest_links(spot, network, "point").select("point", "d")
    one = owned.join(far, "point", "left").groupBy("oks").agg(F.min(F.struct(F.coalesce("d", F.lit(float("inf"))), "point", "px", "py")).alias("p")).select("oks", "p.point", "p.px", "p.py")
    bare = buildings.join(owned, "oks", "left_anti").select("oks", F.explode("parts").alias("points"))
    edge = topology.nearest_links(topology.links(bare, "oks"), network, "oks").select("oks", F.col("x").alias("ex"), F.col("y").alias("ey"))
    linked = buildings.join(one, "oks", "left").join(edge, "oks", "left").select(
        F.col("oks").alias("id"), "id_is_text", F.coalesce("px", "ex", "bx").alias("x"), F.coalesce("py", "ey", "by").alias("y"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.when(F.col("point").isNull(), "outline").otherwise("building").alias("origin")
    )
    alone = points.join(buildings.select("oks"), "oks", "left_anti")
    return linked.unionByName(alone.select(F.col("point").alias("id"), F.col("point_is_text").alias("id_is_text"), F.col("px").alias("x"), F.col("py").alias("y"), F.coalesce("point_flow", F.lit(0.0)).alias("flow"), F.lit("point").alias("origin")))


def restrictions(features: DataFrame) -> DataFrame:
    """(id, kind, rule, unknown, geom): restrictions, existing buildings and the existing network as one."""
    f = with_ids(features).where("geom IS NOT NULL")
    raw = F.col("props")["restriction_type"]
    kind = C.canonical_type(C.normal_type(F.coalesce(raw, F.lit(""))))
    own = f.where("object_type = 'restriction'").select("id", kind.alias("kind"), "geom")
    built = f.where("object_type = 'oks_existing'").select("id", F.lit("oks_existing").alias("kind"), "geom")
    net = f.where("object_type = 'heat_network'").select(F.concat(F.lit("existing-net:"), F.col("id")).alias("id"), F.lit("heat_network").alias("kind"), "geom")
    known = [r[0] for r in D.RESTRICTIONS]
    return own.unionByName(built).unionByName(net).select("id", "kind", C.rule_of(F.col("kind")).alias("rule"), (~F.col("kind").isin(known)).alias("unknown"), "geom")


def diagnostics(features: DataFrame, samples: int = 50) -> DataFrame:
    """(severity, code, n, ids): what was missing, inferred or left out, with the first ids in order."""
    f = with_ids(features)
    kind, dn, flow = F.col("object_type"), _number("diameter"), _number("flow_tph")
    table = [r[0] for r in D.DIAMETERS]
    network, chamber, point = kind == "heat_network", kind == "heat_chamber", kind == "oks_connection_point"
    line = F.coalesce(F.col("geom.type").isin("LineString", "MultiLineString"), F.lit(False))
    restriction = C.canonical_type(C.normal_type(F.coalesce(F.col("props")["restriction_type"], F.lit(""))))
    found = [
        ("WARNING", "input.unknownType", ~F.coalesce(kind.isin(TYPES), F.lit(False))),
        ("ERROR", "source.geometry", (kind == "source") & ~F.coalesce(F.col("geom.type") == "Point", F.lit(False))),
        ("WARNING", "segment.geometry", network & ~line),
        ("WARNING", "segment.noDiameter", network & dn.isNull()),
        ("WARNING", "segment.nonTableDiameter", network & ~F.floor(dn + 0.5).isin(table)),
        ("ASSUMPTION", "segment.noFlow", network & flow.isNull()),
        ("WARNING", "chamber.geometry", chamber & ~F.coalesce(F.col("geom.type") == "Point", F.lit(False))),
        ("WARNING", "connectionPoint.geometry", point & F.col("geom").isNull()),
        ("WARNING", "restriction.geometry", (kind == "restriction") & F.col("geom").isNull()),
        ("WARNING", "restriction.unknownType", (kind == "restriction") & ~restriction.isin([r[0] for r in D.RESTRICTIONS])),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, test in found]))
    hits = f.select("ordinal", "id", F.explode(codes).alias("d")).select("ordinal", "id", "d.*")
    counted = hits.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
    first = hits.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("ordinal", "id"))).where(F.col("r") <= samples)
    ids = first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda v: v.id).alias("ids"))
    whole = counted.join(ids, "code").select("severity", "code", "n", "ids")
    # What is wrong with the scene as a whole.
    has = lambda t: F.max(F.coalesce(F.col("object_type") == t, F.lit(False)).cast("int"))
    seen = f.agg(*[F.coalesce(has(t), F.lit(0)).alias(t) for t in ("source", "heat_network")], F.coalesce(F.greatest(has("oks_future"), has("oks_connection_point")), F.lit(0)).alias("ends"), F.count_if(kind == "source").alias("sources"))
    row = lambda s, c, n: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), n.cast("long").alias("n"))
    one = F.lit(1)
    scene = [F.when(F.col("source") == 0, row("ERROR", "scene.noSource", one)), F.when(F.col("heat_network") == 0, row("ERROR", "scene.noNetwork", one)), F.when(F.col("ends") == 0, row("ERROR", "scene.noFutureOks", one)), F.when(F.col("sources") > 1, row("WARNING", "source.multiple", F.col("sources")))]
    overall = seen.select(F.explode(F.array_compact(F.array(*scene))).alias("d")).select("d.*", F.array().cast("array<string>").alias("ids"))
    return whole.unionByName(overall)


def own_footprints(terminals: DataFrame, restrictions: DataFrame, cell: float) -> DataFrame:
    """(terminal, restriction): the forbidden polygon that holds a terminal without a building of its own; the smallest of several,
    then the smallest id. Its border counts as held; a polygon may have several terminals, and one with holes holds none there.

    Polygons meet terminals in the grid cells that their boxes touch, cells being no wider than a third of a polygon and than the limit; those
    larger than one that fills the cell are left out there, so a terminal meets few, however many hold it. The area is that of all rings as
    they turn.
    """
    rings = F.transform("geom.parts", lambda ring: F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    shapes = restrictions.where("rule = 'FORBIDDEN' AND geom.type IN ('Polygon', 'MultiPolygon')").select(F.col("id").alias("restriction"), rings.alias("rings"))
    every = F.flatten("rings")
    box = [f(every.getField(n)) for f in (F.array_min, F.array_max) for n in ("x", "y")]
    turned = lambda ring: F.aggregate(F.transform(ring, lambda p, i: p.x * ring[(i + 1) % F.size(ring)].y - ring[(i + 1) % F.size(ring)].x * p.y), F.lit(0.0), lambda a, v: a + v)
    area = F.abs(F.aggregate(F.transform("rings", turned), F.lit(0.0), lambda a, v: a + v))
    after = lambda ring, i: ring[(i + 1) % F.size(ring)]
    edges = F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p, i: F.struct(p.x.alias("ax"), p.y.alias("ay"), after(ring, i).x.alias("bx"), after(ring, i).y.alias("by")))))
    # Dealt before anything is worked out: many polygons may be one small file.
    shapes = G.spread(shapes, "restriction").select("restriction", "rings", edges.alias("edges"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)], area.alias("area"))
    narrow = shapes.agg(F.avg(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    cell = min(cell, narrow / 3) if narrow else cell
    # A polygon fills a cell if no edge's box meets the cell, seen a little wider than it is, and its middle is held.
    (lx, ly), (hx, hy) = ([(F.col(n) + o) * cell for n in ("cx", "cy")] for o in (-1e-6, 1 + 1e-6))
    mx, my = ((F.col(n) + 0.5) * cell for n in ("cx", "cy"))
    clear = F.forall("edges", lambda e: (F.greatest(e.ax, e.bx) < lx) | (F.least(e.ax, e.bx) > hx) | (F.greatest(e.ay, e.by) < ly) | (F.least(e.ay, e.by) > hy))
    over = F.size(F.filter("edges", lambda e: ((e.ay <= my) != (e.by <= my)) & (mx < e.ax + (my - e.ay) / (e.by - e.ay) * (e.bx - e.ax)))) % 2 == 1
    within = (F.col("x0") < lx) & (F.col("x1") > hx) & (F.col("y0") < ly) & (F.col("y1") > hy)
    shapes = G.with_cells(shapes, tuple(F.col(n) for n in ("x0", "y0", "x1", "y1")), cell)
    shapes = spatial.without_hidden(shapes.withColumn("_fills", F.when(within, clear & over).otherwise(False)).drop("edges"), F.col("_fills"), "area")
    inside = F.aggregate(F.transform("rings", lambda ring: G.covers(ring, F.col("x"), F.col("y")).cast("int")), F.lit(0), lambda a, v: a + v) % 2 == 1
    spots = terminals.where("origin = 'point'").select(F.col("id").alias("terminal"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    held = G.spread(spots, "cx", "cy").join(shapes.hint("merge"), ["cx", "cy"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").where(inside)
    return held.groupBy("terminal").agg(F.min(F.struct("area", "restriction"))["restriction"].alias("restriction"))


def network(features: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, x, y), edges (id, a, b) and (id, kind, upstream, inferred) of the existing network.

    The next object towards the source is the input's upstream_object_id where every line and chamber states one; else all are
    worked out anew from the network. Chambers that stand on no node have none.
    """
    lines, pits = segments(features), chambers(features)
    nodes, edges = topology.stitch(lines, tolerance)
    at = topology.at_nodes(pits, nodes, "id", tolerance).select("id", "node")
    stated = with_ids(features).where("object_type IN ('heat_network', 'heat_chamber')").select(F.col("id").alias("whole"), F.col("props")["upstream_object_id"].alias("stated"))
    every = lines.select("id", F.lit("segment").alias("kind")).unionByName(pits.select("id", F.lit("chamber").alias("kind"))).withColumn("whole", F.regexp_replace("id", r"#\d+$", ""))
    every = every.join(stated, "whole", "left").drop("whole")
    if not every.where("stated IS NULL").isEmpty():
        found = topology.next_to_source(edges, at, topology.source_node(source(features), nodes))
        every = every.drop("stated").join(found, ["id", "kind"], "left").withColumn("inferred", F.col("upstream").isNotNull())
        return nodes, edges, every.select("id", "kind", "upstream", "inferred")
    return nodes, edges, every.select("id", "kind", F.col("stated").alias("upstream"), F.lit(False).alias("inferred"))


upstream = topology.upstream
