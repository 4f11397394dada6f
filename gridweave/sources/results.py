"""A generated result: variants of new networks over the line items, with planted faults, and the same as SQL.

A variant is an order; its line items, numbered 1, 2, ... in order, are segments that run from node i // 2 to node i, so node
0 is the tie-in point. Lengths are whole centimetres, costs whole roubles, flows hundredths of t/h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators.storage import Workspace, shared_result
from gridweave.sources import dimensions as D
from gridweave.sources import scene


def _at(variant: Column, node: Column, axis: str) -> Column:
    return ((variant * 7919 + node * 4001) % 100000) if axis == "x" else ((variant * 104729 + node * node * 977) % 80000)


#: Line items a task numbers at most, about, unless variants are larger: what a task holds doesn't grow with the table.
PER_TASK = 250_000


def _by_variant(rows: DataFrame) -> DataFrame:
    """Rows with all of a variant in one partition, in as many as their number asks for where the session's don't suffice."""
    n = rows.count() // PER_TASK
    return rows.repartition(n, "variant") if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, i, a, b, xa, ya, xm, ym, xb, yb, geom, length, flow, dn, method, cost): from node a by a bend m to node b.

    They lie by variant, so that windows and groups within variants need no further shuffle."""
    v, i = F.col("variant"), F.col("i")
    w = Window.partitionBy("variant").orderBy("line", "part", "supplier", "shipped")
    raw = scene.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("variant"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("shipped")
    )
    s = _by_variant(raw).select("variant", F.row_number().over(w).cast("long").alias("i"))
    s = s.withColumn("p", F.floor(i / 2)).withColumn("a", F.when((v % 79 == 10) & (i == 2), 500).otherwise(F.col("p")).cast("long")).withColumn("b", i)
    s = s.select("variant", "i", "a", "b", *[_at(v, F.col(n), k).alias(k + e) for n, e in (("p", "a"), ("b", "b")) for k in ("x", "y")])
    back = (v % 19 == 3) & (i == 2)
    s = s.withColumn("xm", F.when(back, 2 * F.col("xb") - F.col("xa")).otherwise(F.floor((F.col("xa") + F.col("xb")) / 2) + v % 5 * 300))
    s = s.withColumn("ym", F.when(back, 2 * F.col("yb") - F.col("ya")).otherwise(F.floor((F.col("ya") + F.col("yb")) / 2) - i % 3 * 200))
    link = lambda p, q: F.sqrt((F.col("x" + p) - F.col("x" + q)) * (F.col("x" + p) - F.col("x" + q)) + (F.col("y" + p) - F.col("y" + q)) * (F.col("y" + p) - F.col("y" + q)))
    s = s.withColumn("geom", link("a", "m") + link("m", "b"))
    s = s.withColumn("length", F.when((v % 11 == 2) & (i == 1), F.floor(F.col("geom") * 1.05) + 100).otherwise(F.floor(F.col("geom") + 0.5)))
    s = s.withColumn("flow", F.floor((40000 + v % 7 * 100) / i))
    dn = C.diameter_for_flow(F.col("flow") / 100.0)
    s = s.withColumn("dn", F.when((v % 13 == 4) & (i == 3), 1000).when((v % 17 == 5) & (i == 1), 150).when((v % 23 == 7) & (i == 2), 123).otherwise(dn).cast("long"))
    s = s.withColumn("method", F.when((v % 29 == 11) & (i == 1), "other").when((v + i) % 4 == 0, "special").otherwise("base"))
    share = F.when(F.col("method") == "base", F.when((v % 31 == 8) & (i == 1), 1.01).otherwise(1.0)).otherwise(F.when(v % 37 == 9, 0.99).otherwise(1.25))
    return s.withColumn("cost", F.coalesce(F.floor(F.col("geom") / 100 * C.of_diameter(F.col("dn"), 3) * share + 0.5), F.lit(0)))


def chambers(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """(variant, node, dn, cost, host_dn, slots): nodes where the network branches; host lines they stand on take slots."""
    v = F.col("variant")
    below = s.where("a BETWEEN 1 AND 499").groupBy("variant", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.max("dn").alias("below")).where("k >= 2")
    c = below.join(s.select("variant", F.col("b").alias("node"), F.col("dn").alias("above")), ["variant", "node"])
    c = c.withColumn("host_dn", F.when(v % 7 == 3, 400).otherwise(0).cast("long")).withColumn("slots", F.when(v % 7 == 3, 2).otherwise(0).cast("long"))
    c = c.withColumn("dn", F.when(v % 33 == 4, 50).otherwise(F.greatest("below", "above", "host_dn")).cast("long"))
    return c.select("variant", "node", "dn", (C.chamber_cost(F.col("dn")) + F.when(v % 39 == 5, 2).otherwise(0)).cast("long").alias("cost"), "host_dn", "slots")


def points(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """(variant, node, flow, listed): what wants connection: the ends of the network, and node 1000, which nothing reaches."""
    v = F.col("variant")
    ends = s.select("variant", F.col("b").alias("node")).join(s.select("variant", F.col("a").alias("node")).distinct(), ["variant", "node"], "left_anti")
    last = F.max("node").over(Window.partitionBy("variant"))
    ends = ends.withColumn("listed", (v % 59 == 5) & (F.col("node") == last))
    lone = s.select("variant").distinct().select("variant", F.lit(1000).cast("long").alias("node"), (v % 53 != 4).alias("listed"))
    return ends.unionByName(lone).select("variant", "node", (500 + (v * 31 + F.col("node")) % 4000).alias("flow"), "listed")


def summaries(spark: SparkSession, sf_dir: str, s: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """(job, variant, copy, rank, chamber_cost, tie_count, tie_cost, construction, penalty, total, length, score), one a variant but for faults."""
    v = F.col("variant")
    s = s.groupBy("variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("metres"))
    c = c.groupBy("variant").agg(F.sum("cost").alias("chamber_cost"))
    fine = p.where("listed").groupBy("variant").agg(F.sum(D.PENALTY + D.PENALTY_PER_FLOW // 100 * F.col("flow")).alias("fine"))
    t = s.join(c, "variant", "left").join(fine, "variant", "left").na.fill(0, ["chamber_cost", "fine"])
    t = t.withColumn("copy", F.explode(F.when(v % 43 == 2, F.array().cast("array<int>")).when(v % 41 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).withColumn("job", F.floor(v / 8))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy("variant", "copy")).cast("long"))
    t = t.withColumn("rank", F.col("rank") + F.when((F.col("job") % 7 == 3) & (F.col("rank") > 1), 1).when((F.col("job") % 7 == 5) & (F.col("rank") == 2), -1).otherwise(0))
    t = t.withColumn("tie_count", F.lit(1).cast("long")).withColumn("tie_cost", (D.TIE_IN_COST + F.when(v % 47 == 6, 100000).otherwise(0)).cast("long"))
    t = t.withColumn("construction", F.col("pipes") + F.col("chamber_cost") + F.col("tie_cost") + F.when(v % 5 == 0, 4).otherwise(v % 3))
    t = t.withColumn("penalty", F.col("fine") + F.when(v % 61 == 6, 2).otherwise(0)).withColumn("total", F.col("construction") + F.col("penalty") - F.when(v % 67 == 7, 10).otherwise(0))
    t = t.withColumn("length", F.when(v % 71 == 8, F.floor(F.col("metres") * 1.01) + 60).otherwise(F.col("metres")))
    t = t.withColumn("score", C.half_up(C.score(F.col("total"), F.col("length") / 100.0), 3) + F.when(v % 73 == 9, 0.003).otherwise(0.0))
    return t.withColumn("chamber_cost", F.col("chamber_cost") + F.when(v % 83 == 3, 5).otherwise(0)).select("job", "variant", "copy", "rank", "chamber_cost", "tie_count", "tie_cost", "construction", "penalty", "total", "length", "score")


# Types of the output in their order, and the attributes of each in theirs.
ATTRIBUTES = {
    "heat_network": ["id", "object_type", "variant_id", "start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "depth_start", "depth_end", "cost"],
    "heat_chamber": ["id", "object_type", "variant_id", "diameter", "degree", "cost"],
    "technical_node": ["id", "object_type", "variant_id"],
    "variant_summary": ["id", "object_type", "variant_id", "rank", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_count", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score", "unconnected_oks_ids"],
}
# The geometry of each type.
GEOMETRIES = {"heat_network": "LineString", "heat_chamber": "Point", "technical_node": "Point", "variant_summary": None}
TYPES = [*ATTRIBUTES, "depth_crossing"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, variant, object_type, keys, geometry, dims): output features of five types in turn, with wrong ones among them."""
    k = F.col("p_partkey").cast("long")
    f = scene.table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 10).alias("variant"), (k % 5).cast("int").alias("t"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("t") + 1)
    keys = F.element_at(F.array(*[F.array(*[F.lit(a) for a in ATTRIBUTES.get(t, ["id", "object_type"])]) for t in TYPES]), F.col("t") + 1)
    right = F.element_at(F.array(*[F.lit(GEOMETRIES.get(t, "Point")) for t in TYPES]), F.col("t") + 1)
    key = F.col("id")
    cut = F.filter(keys, lambda a, i: i != F.when(key % 17 == 4, F.size(keys) - 1).otherwise(-1))
    return f.select("id", "variant", kind.alias("object_type"), cut.alias("keys"), F.when(key % 29 == 3, "Polygon").otherwise(right).alias("geometry"), F.when(key % 23 == 6, 3).otherwise(2).cast("long").alias("dims"))


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """segments, chambers, points, summaries or features as a written table, with those it is made of, as long as their input is the same.

    Each is written when it is first asked for, so a query of one pays for no other."""
    at = lambda n: stored(spark, sf_dir, n)
    makes = {
        "segments": lambda: segments(spark, sf_dir), "chambers": lambda: chambers(spark, sf_dir, at("segments")), "points": lambda: points(spark, sf_dir, at("segments")),
        "summaries": lambda: summaries(spark, sf_dir, at("segments"), at("chambers"), at("points")), "features": lambda: features(spark, sf_dir),
    }
    inputs = [scene.table(spark, sf_dir, "part" if name == "features" else "lineitem")]
    return shared_result(spark, f"{sf_dir}/result-{name}", inputs, lambda work: work.write(makes[name](), name))


_DN = "(SELECT min(dn) FROM dims WHERE capacity >= flow / 100.0)"
_BAND = f"coalesce((SELECT cost FROM ({D.values(D.CHAMBER_COSTS)}) c(lo, hi, cost) WHERE dn BETWEEN lo AND hi), 12000000)"
_LIST = lambda rows: "[" + ", ".join("NULL" if r is None else f"'{r}'" if isinstance(r, str) else _LIST(r) for r in rows) + "]"

#: The same for the oracle, as common table expressions after those of the scene.
RESULT_SQL = f"""
numbered AS (SELECT l_orderkey AS variant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS i FROM lineitem),
placed AS (SELECT variant, i, CASE WHEN variant % 79 = 10 AND i = 2 THEN 500 ELSE i // 2 END AS a, i AS b, (variant * 7919 + i // 2 * 4001) % 100000 AS xa, (variant * 104729 + (i // 2) * (i // 2) * 977) % 80000 AS ya,
  (variant * 7919 + i * 4001) % 100000 AS xb, (variant * 104729 + i * i * 977) % 80000 AS yb FROM numbered),
bent AS (SELECT *, CASE WHEN variant % 19 = 3 AND i = 2 THEN 2 * xb - xa ELSE (xa + xb) // 2 + variant % 5 * 300 END AS xm, CASE WHEN variant % 19 = 3 AND i = 2 THEN 2 * yb - ya ELSE (ya + yb) // 2 - i % 3 * 200 END AS ym FROM placed),
measured AS (SELECT *, sqrt((xa - xm) * (xa - xm) + (ya - ym) * (ya - ym)) + sqrt((xm - xb) * (xm - xb) + (ym - yb) * (ym - yb)) AS geom, (40000 + variant % 7 * 100) // i AS flow FROM bent),
drawn AS (SELECT *, CAST(CASE WHEN variant % 11 = 2 AND i = 1 THEN floor(geom * 1.05::DOUBLE) + 100 ELSE floor(geom + 0.5) END AS BIGINT) AS length,
  CASE WHEN variant % 13 = 4 AND i = 3 THEN 1000 WHEN variant % 17 = 5 AND i = 1 THEN 150 WHEN variant % 23 = 7 AND i = 2 THEN 123 ELSE {_DN} END AS dn,
  CASE WHEN variant % 29 = 11 AND i = 1 THEN 'other' WHEN (variant + i) % 4 = 0 THEN 'special' ELSE 'base' END AS method FROM measured),
news AS (SELECT w.*, d.capacity, d.run, d.per_m, CAST(coalesce(floor(geom / 100 * d.per_m * CASE WHEN method = 'base' THEN CASE WHEN variant % 31 = 8 AND i = 1 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END
  ELSE CASE WHEN variant % 37 = 9 THEN 0.99::DOUBLE ELSE 1.25::DOUBLE END END + 0.5), 0) AS BIGINT) AS cost FROM drawn w LEFT JOIN dims d USING (dn)),
branches AS (SELECT variant, node, CASE WHEN variant % 33 = 4 THEN 50 ELSE greatest(max(dn), host_dn) END AS dn, host_dn, slots FROM
  (SELECT variant, a AS node, dn, 1 AS k FROM news WHERE a BETWEEN 1 AND 499 UNION ALL SELECT variant, b, dn, 0 FROM news), (SELECT 0)
  , LATERAL (SELECT CASE WHEN variant % 7 = 3 THEN 400 ELSE 0 END AS host_dn, CASE WHEN variant % 7 = 3 THEN 2 ELSE 0 END AS slots) GROUP BY variant, node, host_dn, slots HAVING sum(k) >= 2 AND count(*) > sum(k)),
newch AS (SELECT *, {_BAND} + CASE WHEN variant % 39 = 5 THEN 2 ELSE 0 END AS cost FROM branches),
wanted AS (SELECT variant, node, 500 + (variant * 31 + node) % 4000 AS flow, listed FROM (
  SELECT variant, b AS node, variant % 59 = 5 AND b = max(b) OVER (PARTITION BY variant) AS listed FROM (SELECT DISTINCT variant, b FROM news WHERE (variant, b) NOT IN (SELECT variant, a FROM news))
  UNION ALL SELECT DISTINCT variant, 1000, variant % 53 <> 4 FROM news)),
totals AS (SELECT s.variant, pipes, metres, coalesce(chambers, 0) AS chambers, coalesce(fine, 0) AS fine FROM (SELECT variant, sum(cost) AS pipes, sum(length) AS metres FROM news GROUP BY variant) s
  LEFT JOIN (SELECT variant, sum(cost) AS chambers FROM newch GROUP BY variant) USING (variant) LEFT JOIN (SELECT variant, sum(100000000 + 5000 * flow) AS fine FROM wanted WHERE listed GROUP BY variant) USING (variant)),
copies AS (SELECT *, variant // 8 AS job, row_number() OVER (PARTITION BY variant // 8 ORDER BY variant, copy) AS r FROM (SELECT *, 1 AS copy FROM totals WHERE variant % 43 <> 2 UNION ALL SELECT *, 2 FROM totals WHERE variant % 43 <> 2 AND variant % 41 = 1)),
stated1 AS (SELECT job, variant, copy, CASE WHEN job % 7 = 3 AND r > 1 THEN r + 1 WHEN job % 7 = 5 AND r = 2 THEN 1 ELSE r END AS rank, pipes, metres, chambers, 1 AS tie_count, 5000000 + CASE WHEN variant % 47 = 6 THEN 100000 ELSE 0 END AS tie_cost,
  fine + CASE WHEN variant % 61 = 6 THEN 2 ELSE 0 END AS penalty, CAST(CASE WHEN variant % 71 = 8 THEN floor(metres * 1.01::DOUBLE) + 60 ELSE metres END AS BIGINT) AS length FROM copies),
stated2 AS (SELECT *, pipes + chambers + tie_cost + CASE WHEN variant % 5 = 0 THEN 4 ELSE variant % 3 END AS construction FROM stated1),
sums AS (SELECT job, variant, copy, rank, chambers + CASE WHEN variant % 83 = 3 THEN 5 ELSE 0 END AS chamber_cost, tie_count, tie_cost, construction, penalty, construction + penalty - CASE WHEN variant % 67 = 7 THEN 10 ELSE 0 END AS total, length FROM stated2),
summary AS (SELECT *, floor((0.7::DOUBLE * CAST(total AS DOUBLE) / 25000000 + 0.3::DOUBLE * (length / 100.0::DOUBLE) / 100) * 1000 + 0.5) / 1000 + CASE WHEN variant % 73 = 9 THEN 0.003::DOUBLE ELSE 0 END AS score FROM sums),
whole AS (SELECT variant FROM summary GROUP BY variant HAVING count(*) = 1),
feature AS (SELECT p_partkey AS id, p_partkey // 10 AS variant, list_extract({_LIST(TYPES)}, p_partkey % 5 + 1) AS object_type,
  list_filter(list_extract({_LIST([ATTRIBUTES.get(t, ["id", "object_type"]) for t in TYPES])}, p_partkey % 5 + 1), lambda x: NOT (p_partkey % 17 = 4 AND x = list_extract(list_extract({_LIST([ATTRIBUTES.get(t, ["id", "object_type"]) for t in TYPES])}, p_partkey % 5 + 1), -1))) AS keys,
  CASE WHEN p_partkey % 29 = 3 THEN 'Polygon' ELSE list_extract({_LIST([GEOMETRIES.get(t, "Point") for t in TYPES])}, p_partkey % 5 + 1) END AS geometry, CASE WHEN p_partkey % 23 = 6 THEN 3 ELSE 2 END AS dims FROM part)
"""
