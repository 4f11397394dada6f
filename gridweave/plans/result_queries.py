"""Queries over results: rules, sets, orders, identifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import trees
from gridweave.plans.base import query
from gridweave.plans.geometry_queries import LINES, lines
from gridweave.sources import dimensions as D
from gridweave.sources import scene

# Rules


@query(f"SELECT chamber, CAST(dn AS BIGINT) AS dn FROM (SELECT chamber, dn, chamber % 4 AS stated FROM chambers) WHERE (stated + 1) * 3000000 <> (SELECT cost FROM ({D.values(D.CHAMBER_COSTS)}) c(lo, hi, cost) WHERE dn BETWEEN lo AND hi)")
def rule_chamber_cost(spark, sf):
    """Chambers whose stated cost (here made from the key) isn't that of their diameter."""
    stated = (F.col("chamber") % 4 + 1) * 3000000
    return scene.chambers(spark, sf).where(F.abs(stated - C.chamber_cost(F.col("dn"))) > 1).select("chamber", F.col("dn").cast("long").alias("dn"))


@query(f", {LINES} SELECT chamber, CAST(max(l.dn) AS BIGINT) AS required FROM chambers c JOIN (SELECT line AS node, dn FROM lines UNION ALL SELECT up, dn FROM lines) l ON l.node = c.chamber GROUP BY chamber, c.dn HAVING max(l.dn) <> c.dn")
def rule_chamber_diameter(spark, sf):
    l = lines(spark, sf)
    ends = l.select(F.col("line").alias("chamber"), F.col("dn").alias("d")).union(l.select("up", "dn")).groupBy("chamber").agg(F.max("d").cast("long").alias("required"))
    return ends.join(scene.chambers(spark, sf), "chamber").where("required <> dn").select("chamber", "required")


@query("SELECT DISTINCT c.chamber FROM chambers c WHERE c.parent * 3 NOT IN (SELECT chamber FROM chambers)")
def rule_node_references(spark, sf):
    """Chambers that name a node which isn't there (here three times the parent)."""
    c = scene.chambers(spark, sf)
    named = c.where("parent IS NOT NULL").select("chamber", (F.col("parent") * 3).alias("node"))
    return named.join(c.select(F.col("chamber").alias("node")), "node", "left_anti").select("chamber")


CUT = "forest AS (SELECT chamber AS node, CASE WHEN chamber % 7 = 3 THEN NULL ELSE parent END AS parent FROM chambers)"


def _forest(spark, sf):
    return scene.chambers(spark, sf).select(F.col("chamber").alias("node"), F.when(F.col("chamber") % 7 != 3, F.col("parent")).alias("parent"))


@query(f"/*RECURSION*/, {CUT}, reach AS (SELECT node, node AS root FROM forest WHERE parent IS NULL UNION ALL SELECT f.node, r.root FROM reach r JOIN forest f ON f.parent = r.node) SELECT node, root FROM reach WHERE root <> (SELECT min(node) FROM forest)")
def rule_network_connected(spark, sf):
    """Nodes that no path leads to from the source, with the root they hang from."""
    f = _forest(spark, sf)
    up = trees.roots(f)
    first = f.agg(F.min("node").alias("source"))
    return up.join(F.broadcast(first), F.col("root") != F.col("source")).select("node", "root")


@query(f"/*RECURSION*/, {CUT}, reach AS (SELECT node, node AS root FROM forest WHERE parent IS NULL UNION ALL SELECT f.node, r.root FROM reach r JOIN forest f ON f.parent = r.node) SELECT root, count(*) AS nodes FROM reach GROUP BY root")
def graph_components(spark, sf):
    return trees.roots(_forest(spark, sf)).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


@query("/*RECURSION*/, need AS (SELECT DISTINCT chamber FROM chambers WHERE chamber % 11 = 5 UNION ALL SELECT c.parent FROM need n JOIN chambers c ON c.chamber = n.chamber WHERE c.parent IS NOT NULL) SELECT DISTINCT chamber AS node FROM need")
def graph_prune(spark, sf):
    """Nodes with a consumer at or below them."""
    t = scene.chambers(spark, sf).select(F.col("chamber").alias("node"), "parent", F.when(F.col("chamber") % 11 == 5, 1).otherwise(0).alias("needs"))
    return trees.subtree_sums(t, "needs").where("total > 0").select("node")


@query("SELECT c.chamber AS node FROM chambers c LEFT JOIN (SELECT parent, count(*) AS below FROM chambers GROUP BY parent) k ON k.parent = c.chamber WHERE coalesce(below, 0) <> 1 OR c.parent IS NULL")
def graph_stretch_ends(spark, sf):
    """Branches, ends and the source: where the flow changes."""
    c = scene.chambers(spark, sf)
    below = c.groupBy(F.col("parent").alias("chamber")).agg(F.count(F.lit(1)).alias("below"))
    return c.join(below, "chamber", "left").where("coalesce(below, 0) <> 1 OR parent IS NULL").select(F.col("chamber").alias("node"))


PLAN = """sums AS (SELECT variant, CAST(sum(cost) AS BIGINT) AS pipes, CAST(sum(length) AS BIGINT) AS length, count(*) AS n FROM segments GROUP BY variant),
stated AS (SELECT variant, pipes + CASE WHEN variant % 5 = 0 THEN 4 ELSE variant % 3 END AS pipes, length, n FROM sums)"""


def _sums(spark, sf):
    return scene.segments(spark, sf).groupBy("variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"))


@query(f", {PLAN} SELECT s.variant, s.pipes - t.pipes AS off FROM stated s JOIN sums t USING (variant) WHERE abs(s.pipes - t.pipes) > 3")
def rule_summary_sums(spark, sf):
    """Summaries (here the sums with a fault) that differ by more than three from the sums of their rows."""
    stated = F.col("pipes") + F.when(F.col("variant") % 5 == 0, 4).otherwise(F.col("variant") % 3)
    return _sums(spark, sf).withColumn("off", (stated - F.col("pipes")).cast("long")).where(F.abs("off") > 3).select("variant", "off")


@query(f", {PLAN} SELECT variant, floor((0.7 * pipes / 25000000 + 0.3 * (length / 100.0) / 100)::DOUBLE * 1000 + 0.5) / 1000 AS score FROM sums WHERE variant % 4 = 0 AND pipes IS NOT NULL")
def rule_score_formula(spark, sf):
    """Variants whose stated score (here the right one, off by 0.003 for every fourth) is more than 0.002 from the formula."""
    right = C.half_up(C.score(F.col("pipes"), F.col("length") / 100.0), 3)
    s = _sums(spark, sf).select("variant", right.alias("score"), (right + F.when(F.col("variant") % 4 == 0, 0.003).otherwise(0.0)).alias("stated"))
    return s.where(F.abs(F.col("stated") - F.col("score")) > 0.002).select("variant", "score")


@query("SELECT terminal, listed, reached FROM (SELECT terminal, terminal % 6 = 0 AS listed, terminal % 4 = 0 AS reached FROM terminals) WHERE listed = reached")
def rule_unconnected_consistent(spark, sf):
    """Terminals that are both listed as unconnected and reached, or neither."""
    t = scene.terminals(spark, sf).select("terminal", (F.col("terminal") % 6 == 0).alias("listed"), (F.col("terminal") % 4 == 0).alias("reached"))
    return t.where("listed = reached")


# Aggregates over properties


@query("SELECT event_type AS kind, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type, key")
def agg_attribute_presence(spark, sf):
    """How often each attribute is there, by type."""
    e = scene.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT variant, floor((sum(length * CASE WHEN special THEN 0.6::DOUBLE ELSE 0::DOUBLE END) + sum(length)) / sum(length) * 100000 + 0.5) / 100000 AS factor FROM segments GROUP BY variant")
def agg_special_factor(spark, sf):
    extra = F.sum(F.col("length") * F.when(F.col("special"), 0.6).otherwise(0.0))
    return scene.segments(spark, sf).groupBy("variant").agg(C.half_up((extra + F.sum("length")) / F.sum("length"), 5).alias("factor"))


# Orders


@query("SELECT terminal, flow FROM terminals ORDER BY flow DESC, terminal LIMIT 20")
def srt_heaviest(spark, sf):
    return scene.terminals(spark, sf).orderBy(F.desc("flow"), "terminal").limit(20).select("terminal", "flow")


@query("SELECT terminal FROM terminals ORDER BY terminal DESC LIMIT 10 OFFSET 20")
def srt_page(spark, sf):
    return scene.terminals(spark, sf).orderBy(F.desc("terminal")).offset(20).limit(10).select("terminal")


@query("SELECT supplier, variant, cost FROM (SELECT supplier, variant, cost, row_number() OVER (PARTITION BY supplier ORDER BY special, cost, variant, line) AS r FROM segments WHERE cost IS NOT NULL) WHERE r = 1")
def srt_arg_min(spark, sf):
    """The best segment of each supplier in lexicographic preference."""
    s = scene.segments(spark, sf).where("cost IS NOT NULL")
    return s.groupBy("supplier").agg(F.min(F.struct("special", "cost", "variant", "line")).alias("m")).select("supplier", "m.variant", "m.cost")


@query("SELECT kind, string_agg(CAST(terminal AS VARCHAR), ',' ORDER BY terminal) AS ids FROM (SELECT flow % 3 AS kind, terminal, row_number() OVER (PARTITION BY flow % 3 ORDER BY terminal) AS r FROM terminals) WHERE r <= 50 GROUP BY kind")
def srt_sample_ids(spark, sf):
    """The first 50 ids of each diagnostic: the group is cut before it is gathered."""
    t = scene.terminals(spark, sf).select((F.col("flow") % 3).alias("kind"), "terminal")
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("terminal"))).where("r <= 50")
    return first.groupBy("kind").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("terminal")), lambda v: v.cast("string"))).alias("ids"))


# Sets


@query(f", {LINES} SELECT 'box:' || box AS id, 'restriction' AS origin FROM boxes UNION ALL SELECT 'existing-net:' || line, 'network' FROM lines")
def set_restrictions(spark, sf):
    b = scene.restrictions(spark, sf).select(F.concat(F.lit("box:"), F.col("box")).alias("id"), F.lit("restriction").alias("origin"))
    return b.unionByName(lines(spark, sf).select(F.concat(F.lit("existing-net:"), F.col("line")).alias("id"), F.lit("network").alias("origin")))


@query("SELECT chamber AS node FROM chambers EXCEPT SELECT parent FROM chambers")
def set_unvisited(spark, sf):
    c = scene.chambers(spark, sf)
    return c.select(F.col("chamber").alias("node")).subtract(c.where("parent IS NOT NULL").select("parent"))


@query("SELECT event_id, 'unit' AS missing FROM events WHERE NOT list_contains(json_keys(props), 'unit')")
def set_required_missing(spark, sf):
    """Rows that lack required attributes, with their names."""
    e = scene.table(spark, sf, "events")
    lacking = F.array_except(F.array(F.lit("k"), F.lit("unit")), F.json_object_keys("props"))
    return e.where(F.size(lacking) > 0).select("event_id", F.array_join(lacking, ",").alias("missing"))


# Identifiers


@query("SELECT variant, sha256(string_agg(least(part, supplier) || '-' || greatest(part, supplier), ';' ORDER BY least(part, supplier) || '-' || greatest(part, supplier))) AS signature FROM segments GROUP BY variant")
def prj_signature(spark, sf):
    """A hash of the set of end pairs, whatever their order."""
    pair = F.concat_ws("-", F.least("part", "supplier").cast("string"), F.greatest("part", "supplier").cast("string"))
    return scene.segments(spark, sf).groupBy("variant").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ";"), 256).alias("signature"))


@query("SELECT variant, line, part, supplier, 'new_v' || variant || '_' || row_number() OVER (PARTITION BY variant ORDER BY line, part, supplier, shipped) AS id FROM segments")
def prj_result_ids(spark, sf):
    n = F.row_number().over(Window.partitionBy("variant").orderBy("line", "part", "supplier", "shipped"))
    return scene.segments(spark, sf).select("variant", "line", "part", "supplier", F.concat(F.lit("new_v"), F.col("variant"), F.lit("_"), n).alias("id"))


@query("SELECT terminal, CAST(floor(-flow / 8.0 + 0.5) AS BIGINT) AS up, floor(-flow / 8.0::DOUBLE * 10 + 0.5) / 10 AS tenth FROM terminals")
def prj_round_half_up(spark, sf):
    return scene.terminals(spark, sf).select("terminal", F.floor(-F.col("flow") / 8 + 0.5).cast("long").alias("up"), C.half_up(-F.col("flow") / 8, 1).alias("tenth"))
