"""The engine's queries and their SQL. Names carry the family of the operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import sequences, spatial, trees
from gridweave.plans.base import QUERIES, SQL, query
from gridweave.sources import dimensions as D
from gridweave.sources import scene

BANDS = D.values(D.CHAMBER_COSTS)
KEY = ["line", "part", "supplier", "shipped"]

# Projections


@query("SELECT terminal, flow / 100.0 AS flow_tph, CAST((SELECT min(dn) FROM dims WHERE capacity >= t.flow / 100.0) AS BIGINT) AS dn FROM terminals t")
def prj_select_dn(spark, sf):
    return scene.terminals(spark, sf).select("terminal", (F.col("flow") / 100.0).alias("flow_tph"), C.diameter_for_flow(F.col("flow") / 100.0).cast("long").alias("dn"))


@query(
    "SELECT box, box * 29 % 1500 AS dn, CAST(coalesce((SELECT min(dn) FROM dims WHERE dn >= b.box * 29 % 1500), 1400) AS BIGINT) AS row_dn FROM boxes b"
)
def prj_dn_or_next_up(spark, sf):
    dn = F.col("box") * 29 % 1500
    up = F.array_min(F.filter(F.array(*[F.lit(r[0]) for r in D.DIAMETERS]), lambda d: d >= dn))
    return scene.restrictions(spark, sf).select("box", dn.alias("dn"), F.coalesce(up, F.lit(1400)).cast("long").alias("row_dn"))


@query(
    f"""SELECT box, dn, CAST(CASE WHEN dn < 50 THEN 3000000 ELSE coalesce((SELECT cost FROM ({BANDS}) c(lo, hi, cost) WHERE dn BETWEEN lo AND hi), 12000000) END AS BIGINT) AS cost
FROM (SELECT box, box * 29 % 1500 AS dn FROM boxes)"""
)
def prj_chamber_cost(spark, sf):
    b = scene.restrictions(spark, sf).select("box", (F.col("box") * 29 % 1500).alias("dn"))
    return b.select("box", "dn", C.chamber_cost(F.col("dn")).cast("long").alias("cost"))


TYPED = f"""typed AS (SELECT b.*, coalesce(a.kind, replace(replace(lower(trim(raw)), '-', '_'), ' ', '_')) AS kind
  FROM boxes b LEFT JOIN ({D.values(D.ALIASES)}) a(alias, kind) ON a.alias = replace(replace(lower(trim(raw)), '-', '_'), ' ', '_'))"""
RULES = f"({D.values(D.RESTRICTIONS)}) r(kind, rule, dist, k)"


def _typed(spark, sf):
    return scene.restrictions(spark, sf).withColumn("kind", C.canonical_type(C.normal_type(F.col("raw"))))


@query(f", {TYPED} SELECT box, t.kind, coalesce(r.rule, 'FORBIDDEN') AS rule FROM typed t LEFT JOIN {RULES} ON r.kind = t.kind")
def prj_normalize_rule(spark, sf):
    return _typed(spark, sf).select("box", "kind", C.rule_of(F.col("kind")).alias("rule"))


@query(
    f""", {TYPED} SELECT box, CAST(d.dn AS BIGINT) AS dn, floor((CASE WHEN t.kind = 'oks_existing' THEN CASE WHEN d.dn <= 400 THEN 5.0 WHEN d.dn <= 800 THEN 7.0 ELSE 9.0 END
  ELSE coalesce(r.dist, 1.0) END + d.width / 2)::DOUBLE * 1000 + 0.5) / 1000 AS clearance
FROM typed t CROSS JOIN (SELECT * FROM dims WHERE dn IN (100, 500, 1400)) d LEFT JOIN {RULES} ON r.kind = t.kind"""
)
def prj_clearance(spark, sf):
    b = _typed(spark, sf).withColumn("dn", F.explode(F.array(*[F.lit(x) for x in (100, 500, 1400)])))
    dn = F.col("dn")
    return b.select("box", dn.cast("long").alias("dn"), C.half_up(C.least_distance(F.col("kind"), dn) + C.of_diameter(dn, 4) / 2, 3).alias("clearance"))


@query("SELECT box, floor((CASE WHEN box % 70 <= 30 THEN 1.0 ELSE 1.0 + 0.1 * ((box % 70) / 10.0 - 3.0) END)::DOUBLE * 1000 + 0.5) / 1000 AS factor FROM boxes")
def prj_depth_factor(spark, sf):
    return scene.restrictions(spark, sf).select("box", C.half_up(C.depth_factor(F.col("box") % 70 / 10.0), 3).alias("factor"))


@query("SELECT terminal, CAST(100000000 + 5000 * flow AS BIGINT) AS penalty, floor((0.7 * (flow * 1000) / 25000000 + 0.3 * x / 10000)::DOUBLE * 100000 + 0.5) / 100000 AS score FROM terminals")
def prj_penalty_score(spark, sf):
    t = scene.terminals(spark, sf)
    return t.select("terminal", C.penalty(F.col("flow") / 100).cast("long").alias("penalty"), C.half_up(C.score(F.col("flow") * 1000, F.col("x") / 100), 5).alias("score"))


@query("SELECT terminal, CAST(floor((x / 3500.0 - 180) / 6 + 0.0) + 31 AS BIGINT) AS zone FROM terminals")
def prj_utm_zone(spark, sf):
    lon = F.col("x") / 3500.0 - 180
    return scene.terminals(spark, sf).select("terminal", (F.floor((lon + 180) / 6 - 30) + 31).cast("long").alias("zone"))


@query("SELECT terminal, floor((degrees(acos(least(1.0, abs(x * 1000.0 + y * 500.0) / (sqrt(x * x + y * y + 0.0) * sqrt(1250000.0)))))) * 10000 + 0.5) / 10000 AS angle FROM terminals WHERE x * x + y * y > 0")
def prj_acute_angle(spark, sf):
    x, y = F.col("x"), F.col("y")
    cosine = F.least(F.lit(1.0), F.abs(x * 1000.0 + y * 500.0) / (F.sqrt(x * x + y * y + 0.0) * F.sqrt(F.lit(1250000.0))))
    return scene.terminals(spark, sf).where(x * x + y * y > 0).select("terminal", C.half_up(F.degrees(F.acos(cosine)), 4).alias("angle"))


# Joins


@query("SELECT s.variant, s.line, s.part, s.supplier, s.flow, CAST(s.dn AS BIGINT) AS dn, CAST(d.per_m AS BIGINT) AS per_m, s.cost FROM segments s LEFT JOIN dims d USING (dn)")
def join_asof_capacity(spark, sf):
    return scene.segments(spark, sf).select("variant", "line", "part", "supplier", "flow", F.col("dn").cast("long").alias("dn"), C.of_diameter(F.col("dn"), 3).cast("long").alias("per_m"), "cost")


NEAR = """near AS (SELECT terminal, arg_min(chamber, d2 * 1000000 + chamber) AS chamber, min(d2) AS d2
  FROM (SELECT t.terminal, c.chamber, CAST((t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) AS BIGINT) AS d2 FROM terminals t CROSS JOIN chambers c) GROUP BY terminal)"""


@query(f", {NEAR} SELECT terminal, chamber, d2 FROM near")
def join_nearest_chamber(spark, sf):
    return spatial.nearest(scene.terminals(spark, sf), scene.chambers(spark, sf), "terminal", "chamber", 300000)


@query(f", {NEAR} SELECT terminal, chamber, d2 FROM near WHERE d2 <= 9000000")
def join_snap_radius(spark, sf):
    return spatial.nearest(scene.terminals(spark, sf), scene.chambers(spark, sf), "terminal", "chamber", 3000)


@query(
    """SELECT terminal, arg_min(box, area * 10000000 + box) AS box FROM (SELECT terminal, box, (x1 - x0) * (y1 - y0) AS area FROM terminals JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) GROUP BY terminal"""
)
def join_point_in_box(spark, sf):
    return spatial.covering_box(scene.terminals(spark, sf), scene.restrictions(spark, sf), "terminal", "box", 500)


@query("SELECT DISTINCT s.supplier FROM segments s WHERE s.supplier NOT IN (SELECT chamber FROM chambers WHERE dn > 100)")
def join_anti_nodes(spark, sf):
    return scene.segments(spark, sf).select("supplier").distinct().join(scene.chambers(spark, sf).where("dn > 100").select(F.col("chamber").alias("supplier")), "supplier", "left_anti")


@query("SELECT a.chamber AS a, b.chamber AS b FROM chambers a JOIN chambers b ON a.parent = b.parent AND a.chamber < b.chamber")
def join_siblings(spark, sf):
    c = scene.chambers(spark, sf)
    a, b = c.select(F.col("chamber").alias("a"), "parent"), c.select(F.col("chamber").alias("b"), "parent")
    return a.join(b, "parent").where("a < b").select("a", "b")


# Aggregations


@query("SELECT count(*) AS terminals, CAST(sum(flow) AS BIGINT) AS flow, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM terminals")
def agg_scene_summary(spark, sf):
    return scene.terminals(spark, sf).agg(F.count(F.lit(1)).alias("terminals"), F.sum("flow").alias("flow"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f", {TYPED} SELECT kind, count(*) AS n, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM typed GROUP BY kind")
def agg_by_type(spark, sf):
    return _typed(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query("SELECT CAST(dn AS BIGINT) AS dn, count(*) AS n, CAST(sum(length) AS BIGINT) AS length, CAST(sum(cost) AS BIGINT) AS cost FROM segments GROUP BY dn")
def agg_dn_summary(spark, sf):
    return scene.segments(spark, sf).groupBy(F.col("dn").cast("long").alias("dn")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("cost").alias("cost"))


@query("SELECT special, CAST(dn AS BIGINT) AS dn, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM segments GROUP BY ROLLUP (special, dn)")
def agg_statement_rollup(spark, sf):
    return scene.segments(spark, sf).rollup("special", F.col("dn").cast("long").alias("dn")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query(
    """/*RECURSION*/, up AS (SELECT terminal AS node, terminal AS ancestor, flow FROM terminals UNION ALL SELECT node, (ancestor - 1) // 2, flow FROM up WHERE ancestor >= 1)
SELECT ancestor AS node, CAST(sum(flow) AS BIGINT) AS total FROM up GROUP BY ancestor"""
)
def agg_subtree_flow(spark, sf):
    t = scene.terminals(spark, sf).select(F.col("terminal").alias("node"), F.when(F.col("terminal") >= 1, F.floor((F.col("terminal") - 1) / 2)).alias("parent"), "flow")
    return trees.subtree_sums(t, "flow")


@query("SELECT node, count(*) AS degree, CAST(max(dn) AS BIGINT) AS dn FROM (SELECT chamber AS node, dn FROM chambers WHERE parent IS NOT NULL UNION ALL SELECT parent, dn FROM chambers WHERE parent IS NOT NULL) GROUP BY node")
def agg_chamber_degree(spark, sf):
    c = scene.chambers(spark, sf).where("parent IS NOT NULL")
    ends = c.select(F.col("chamber").alias("node"), "dn").union(c.select("parent", "dn"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("dn").cast("long").alias("dn"))


COST = """costs AS (SELECT variant, CAST(sum(cost) AS BIGINT) AS pipes, CAST(sum(length) AS BIGINT) AS length, count(DISTINCT supplier) AS ties, CAST(count(DISTINCT supplier) * 5000000 + sum(cost) AS BIGINT) AS total FROM segments GROUP BY variant)"""


def _costs(spark, sf):
    s = scene.segments(spark, sf).groupBy("variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length"), F.countDistinct("supplier").alias("ties"))
    return s.withColumn("total", F.col("ties") * D.TIE_IN_COST + F.col("pipes"))


@query(f", {COST} SELECT variant, pipes, length, ties, total, floor((0.7 * total / 25000000 + 0.3 * (length / 100.0) / 100)::DOUBLE * 1000 + 0.5) / 1000 AS score FROM costs")
def agg_variant_cost(spark, sf):
    return _costs(spark, sf).withColumn("score", C.half_up(C.score(F.col("total"), F.col("length") / 100.0), 3))


@query(f", {TYPED} SELECT kind, median(x1 - x0) AS middle, min(x1 - x0) AS least, max(x1 - x0) AS most FROM typed GROUP BY kind")
def agg_width_stats(spark, sf):
    w = F.col("x1") - F.col("x0")
    return _typed(spark, sf).groupBy("kind").agg(F.percentile(w, 0.5).alias("middle"), F.min(w).alias("least"), F.max(w).alias("most"))


# Windows


@query(f", {COST} SELECT variant, total, length, rank FROM (SELECT variant, ties, total, length, row_number() OVER (PARTITION BY ties ORDER BY total, length, variant) AS rank FROM costs) WHERE rank <= 3")
def win_rank_top3(spark, sf):
    w = Window.partitionBy("ties").orderBy("total", "length", "variant")
    return _costs(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("variant", "total", "length", "rank")


ORDER = "PARTITION BY variant ORDER BY line, part, supplier, shipped"


@query(
    f""", marked AS (SELECT *, CASE WHEN lag(dn) OVER ({ORDER}) IS NOT DISTINCT FROM dn AND row_number() OVER ({ORDER}) > 1 THEN 0 ELSE 1 END AS c FROM segments),
numbered AS (SELECT *, sum(c) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM marked),
total AS (SELECT variant, run, dn, sum(length) AS total FROM numbered GROUP BY variant, run, dn)
SELECT variant, CAST(max(total) AS BIGINT) AS longest, count(*) AS runs FROM total GROUP BY variant"""
)
def win_run_length(spark, sf):
    s = scene.segments(spark, sf).withColumn("dn", F.coalesce("dn", F.lit(-1)))
    r = sequences.runs(s, ["variant"], KEY, "dn", "length")
    return r.groupBy("variant").agg(F.max("total").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query(f"SELECT variant, count(*) AS breaks FROM (SELECT variant, dn, lag(dn) OVER ({ORDER}) AS before FROM segments) WHERE before > dn GROUP BY variant")
def win_monotone(spark, sf):
    before = F.lag("dn").over(Window.partitionBy("variant").orderBy(*KEY))
    return scene.segments(spark, sf).withColumn("before", before).where("before > dn").groupBy("variant").agg(F.count(F.lit(1)).alias("breaks"))


@query(
    """, spans AS (SELECT supplier, part % 1000 AS lo, part % 1000 + line * 2 AS hi, line AS k FROM segments),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY supplier ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS c FROM spans),
n AS (SELECT *, sum(c) OVER (PARTITION BY supplier ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT supplier, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, max(k) AS k FROM n GROUP BY supplier, island"""
)
def win_interval_merge(spark, sf):
    s = scene.segments(spark, sf).select("supplier", (F.col("part") % 1000).alias("lo"), (F.col("part") % 1000 + F.col("line") * 2).alias("hi"), F.col("line").alias("k"))
    return sequences.merge_intervals(s, ["supplier"], "lo", "hi", "k")


@query(f"SELECT variant, line, part, supplier, shipped, CAST(coalesce(sum(length) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS station FROM segments")
def win_station(spark, sf):
    return sequences.stations(scene.segments(spark, sf), ["variant"], KEY, "length").select("variant", "line", "part", "supplier", "shipped", "station")


# Graphs


@query(
    """/*RECURSION*/, walk AS (SELECT chamber AS node, 0::BIGINT AS depth FROM chambers WHERE parent IS NULL UNION ALL SELECT c.chamber, w.depth + 1 FROM walk w JOIN chambers c ON c.parent = w.node)
SELECT node, depth FROM walk"""
)
def graph_bfs_depth(spark, sf):
    t = scene.chambers(spark, sf).select(F.col("chamber").alias("node"), "parent")
    return trees.roots(t).select("node", "depth")


@query(
    """/*RECURSION*/, up AS (SELECT chamber AS node, chamber AS ancestor, 0::BIGINT AS steps FROM chambers UNION ALL SELECT u.node, c.parent, u.steps + 1 FROM up u JOIN chambers c ON c.chamber = u.ancestor WHERE c.parent IS NOT NULL)
SELECT node, ancestor, steps FROM up"""
)
def flow_path_chain(spark, sf):
    t = scene.chambers(spark, sf).select(F.col("chamber").alias("node"), "parent")
    return trees.ancestors(t)


# Sets


@query(
    """, u AS (SELECT 0 AS source, chamber AS id, x, y FROM chambers UNION ALL SELECT 1, terminal, x, y FROM terminals)
SELECT cell, source, id FROM (SELECT x // 1000 * 1000 + y // 1000 AS cell, CAST(source AS BIGINT) AS source, id, row_number() OVER (PARTITION BY x // 1000, y // 1000 ORDER BY source, id) AS r FROM u) WHERE r = 1"""
)
def set_candidate_dedupe(spark, sf):
    c = scene.chambers(spark, sf).select(F.lit(0).cast("long").alias("source"), F.col("chamber").alias("id"), "x", "y")
    u = c.union(scene.terminals(spark, sf).select(F.lit(1).cast("long"), "terminal", "x", "y"))
    gx, gy = F.floor(F.col("x") / 1000), F.floor(F.col("y") / 1000)
    first = u.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.min(F.struct("source", "id")).alias("m"))
    return first.select((F.col("gx") * 1000 + F.col("gy")).cast("long").alias("cell"), "m.source", "m.id")


# Rules


@query("SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT chamber AS node FROM chambers WHERE parent IS NOT NULL UNION ALL SELECT parent FROM chambers WHERE parent IS NOT NULL UNION ALL SELECT supplier FROM segments WHERE line = 7 AND special) GROUP BY node) WHERE degree > 4")
def rule_chamber_degree(spark, sf):
    c = scene.chambers(spark, sf).where("parent IS NOT NULL")
    ends = c.select(F.col("chamber").alias("node")).union(c.select("parent")).union(scene.segments(spark, sf).where("line = 7 AND special").select("supplier"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > D.MAX_DEGREE)


@query("SELECT s.variant, s.line, s.part, s.supplier, s.flow FROM segments s LEFT JOIN dims d USING (dn) WHERE coalesce(d.run * 100 < s.length, true) OR d.capacity < s.flow")
def rule_capacity_and_run(spark, sf):
    s = scene.segments(spark, sf)
    run, capacity = C.of_diameter(F.col("dn"), 2), C.of_diameter(F.col("dn"), 1)
    return s.where(F.coalesce(run * 100 < F.col("length"), F.lit(True)) | F.coalesce(capacity < F.col("flow"), F.lit(False))).select("variant", "line", "part", "supplier", "flow")


@query("SELECT variant, count(*) AS lines FROM segments GROUP BY variant HAVING list_sort(list(line)) <> range(1, count(*) + 1)")
def rule_ranks_sequential(spark, sf):
    """Variants whose lines, sorted, aren't 1 to n: repeats and gaps."""
    lines = scene.segments(spark, sf).groupBy("variant").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("line").alias("k"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    return lines.where("lines <> k OR lo <> 1 OR hi <> lines").select("variant", "lines")


@query("SELECT s.variant, s.line, s.part, s.supplier, s.cost, CAST(s.dn AS BIGINT) AS dn FROM segments s JOIN dims d USING (dn) WHERE special AND cost <= 1.62::DOUBLE * (s.length / 100.0::DOUBLE * d.per_m) - 10000")
def rule_special_dearer(spark, sf):
    """Special crossings that cost less than 1.62 times what their own diameter costs, by 10000 or more."""
    due = F.col("length") / 100.0 * C.of_diameter(F.col("dn"), 3)
    return scene.segments(spark, sf).where(F.col("special") & (F.col("cost") <= 1.62 * due - 10000)).select("variant", "line", "part", "supplier", "cost", F.col("dn").cast("long").alias("dn"))


# Sensitivity


@query(f", {COST}, rest AS (SELECT s.variant, s.supplier, c.total - sum(s.cost) - 5000000 AS without FROM segments s JOIN costs c USING (variant) GROUP BY s.variant, s.supplier, c.total) SELECT variant, supplier, CAST(without AS BIGINT) AS without FROM rest")
def sens_leave_one_out(spark, sf):
    own = scene.segments(spark, sf).groupBy("variant", "supplier").agg(F.sum("cost").alias("own"))
    return own.join(_costs(spark, sf).select("variant", "total"), "variant").select("variant", "supplier", (F.col("total") - F.col("own") - D.TIE_IN_COST).alias("without"))


FLAGSHIP = agg_variant_cost

# These modules register their queries when imported.
from gridweave.plans import compliance_queries, depth_queries, geometry_queries, ingest_queries, network_queries, order_queries, result_queries, route_queries, rule_queries  # noqa: E402, F401
