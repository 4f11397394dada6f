"""Queries of depth planning and of ordered sequences. Depths are whole centimetres."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import sequences
from gridweave.plans.base import query
from gridweave.sources import scene

# Fixed values, in centimetres: least depth, greatest depth, depth without surcharge.
LEAST, GREATEST, FREE = 70, 600, 300
ORDER = "PARTITION BY variant ORDER BY line, part, supplier, shipped"
KEY = ["line", "part", "supplier", "shipped"]

UTILITY = "utility AS (SELECT box, box % 400 + 50 AS top, box % 9 * 10 + 10 AS tall, box % 3 * 10 + 20 AS clear, box % 7 * 15 + 40 AS own FROM boxes)"


def _utilities(spark, sf):
    k = F.col("box")
    return scene.restrictions(spark, sf).select("box", (k % 400 + 50).alias("top"), (k % 9 * 10 + 10).alias("tall"), (k % 3 * 10 + 20).alias("clear"), (k % 7 * 15 + 40).alias("own"))


def _surcharge(depth):
    return F.greatest(depth - FREE, F.lit(0))


@query(
    f""", {UTILITY}, ways AS (SELECT box, CASE WHEN top - clear - own >= {LEAST} THEN top - clear - own END AS above, CASE WHEN top + tall + clear <= {GREATEST} THEN top + tall + clear END AS below FROM utility)
SELECT box, CASE WHEN above IS NULL AND below IS NULL THEN 'NONE' WHEN below IS NULL OR greatest(above - {FREE}, 0) <= greatest(below - {FREE}, 0) AND above IS NOT NULL THEN 'ABOVE' ELSE 'BELOW' END AS passage,
  CAST(CASE WHEN below IS NULL OR greatest(above - {FREE}, 0) <= greatest(below - {FREE}, 0) AND above IS NOT NULL THEN above ELSE below END AS BIGINT) AS depth FROM ways"""
)
def dep_passage(spark, sf):
    """Above or below a utility, whichever costs less; above where both cost the same."""
    top, tall, clear, own = (F.col(n) for n in ("top", "tall", "clear", "own"))
    above = F.when(top - clear - own >= LEAST, top - clear - own)
    below = F.when(top + tall + clear <= GREATEST, top + tall + clear)
    w = _utilities(spark, sf).select("box", above.alias("above"), below.alias("below"))
    upper = F.col("above").isNotNull() & (F.col("below").isNull() | (_surcharge(F.col("above")) <= _surcharge(F.col("below"))))
    passage = F.when(upper, "ABOVE").when(F.col("below").isNotNull(), "BELOW").otherwise("NONE")
    return w.select("box", passage.alias("passage"), F.when(upper, F.col("above")).otherwise(F.col("below")).cast("long").alias("depth"))


@query(
    f""", {UTILITY}, ways AS (SELECT box % 13 AS kind, top - clear - own >= {LEAST} AS above, top + tall + clear <= {GREATEST} AS below FROM utility)
SELECT kind, count(*) AS crossings, count(*) FILTER (WHERE NOT above AND NOT below) AS unmet, count(*) FILTER (WHERE above) AS above FROM ways GROUP BY kind"""
)
def dep_crossing_counts(spark, sf):
    top, tall, clear, own = (F.col(n) for n in ("top", "tall", "clear", "own"))
    w = _utilities(spark, sf).select((F.col("box") % 13).alias("kind"), (top - clear - own >= LEAST).alias("above"), (top + tall + clear <= GREATEST).alias("below"))
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("crossings"), F.count_if(~F.col("above") & ~F.col("below")).alias("unmet"), F.count_if(F.col("above")).alias("above"))


PROFILE = f"""profile AS (SELECT variant, line, part, supplier, shipped, length, coalesce(sum(length) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS station, part % 500 + 70 AS depth FROM segments)"""


def _profile(spark, sf):
    s = scene.segments(spark, sf).select("variant", *KEY, "length", (F.col("part") % 500 + 70).alias("depth"))
    return sequences.stations(s, ["variant"], KEY, "length")


def _spans(spark, sf):
    """Stretches of the profile between neighbouring points (from, to, depth at both ends)."""
    w = Window.partitionBy("variant").orderBy(*KEY)
    p = _profile(spark, sf)
    return p.select("variant", F.col("station").alias("a"), F.lead("station").over(w).alias("b"), F.col("depth").alias("da"), F.lead("depth").over(w).alias("db")).where("b > a")


SPANS = f"""{PROFILE}, spans AS (SELECT * FROM (SELECT variant, station AS a, lead(station) OVER ({ORDER}) AS b, depth AS da, lead(depth) OVER ({ORDER}) AS db FROM profile) WHERE b > a)"""


@query(f", {SPANS}, ask AS (SELECT variant, max(b) // 2 AS q FROM spans GROUP BY variant) SELECT variant, CAST(q AS BIGINT) AS station, floor((da + (db - da)::DOUBLE * (q - a) / (b - a)) * 100 + 0.5) / 100 AS depth FROM spans JOIN ask USING (variant) WHERE q >= a AND q < b")
def win_depth_at(spark, sf):
    """The depth in the middle of each profile, between the points around it."""
    s = _spans(spark, sf).withColumn("q", F.floor(F.max("b").over(Window.partitionBy("variant")) / 2))
    depth = F.col("da") + (F.col("db") - F.col("da")).cast("double") * (F.col("q") - F.col("a")) / (F.col("b") - F.col("a"))
    return s.where("q >= a AND q < b").select("variant", F.col("q").alias("station"), C.half_up(depth, 2).alias("depth"))


@query(
    f""", {SPANS}, cut AS (SELECT *, CASE WHEN (da < {FREE} AND db > {FREE}) OR (da > {FREE} AND db < {FREE}) THEN a + ({FREE} - da)::DOUBLE * (b - a) / (db - da) END AS m FROM spans),
pieces AS (SELECT variant, a, 0 AS piece, a::DOUBLE AS f, coalesce(m, b) AS t, da AS df, CASE WHEN m IS NULL THEN db ELSE {FREE} END AS dt FROM cut UNION ALL SELECT variant, a, 1, m, b, {FREE}, db FROM cut WHERE m IS NOT NULL)
SELECT variant, CAST(a AS BIGINT) AS span, CAST(piece AS BIGINT) AS piece, CAST(floor(t - f + 0.5) AS BIGINT) AS length, floor((1 + 0.001::DOUBLE * (greatest(df - {FREE}, 0) + greatest(dt - {FREE}, 0)) / 2) * 10000 + 0.5) / 10000 AS factor FROM pieces"""
)
def dep_split_threshold(spark, sf):
    """Spans cut where they pass the depth without surcharge, with each piece's mean cost factor."""
    a, b, da, db = (F.col(n) for n in ("a", "b", "da", "db"))
    m = F.when(((da < FREE) & (db > FREE)) | ((da > FREE) & (db < FREE)), a + (FREE - da).cast("double") * (b - a) / (db - da))
    s = _spans(spark, sf).withColumn("m", m)
    piece = lambda n, f, t, x, y: F.struct(F.lit(n).cast("long").alias("piece"), f.cast("double").alias("f"), t.cast("double").alias("t"), x.alias("df"), y.alias("dt"))
    free = F.lit(FREE).cast("long")
    whole, halves = F.array(piece(0, a, b, da, db)), F.array(piece(0, a, F.col("m"), da, free), piece(1, F.col("m"), b, free, db))
    p = s.select("variant", a.alias("span"), F.explode(F.when(F.col("m").isNull(), whole).otherwise(halves)).alias("p")).select("variant", "span", "p.*")
    factor = 1 + 0.001 * (_surcharge(F.col("df")) + _surcharge(F.col("dt"))) / 2
    return p.select("variant", "span", "piece", F.floor(F.col("t") - F.col("f") + 0.5).alias("length"), C.half_up(factor, 4).alias("factor"))


@query(
    f"""/*RECURSION*/, {PROFILE}, kept AS (SELECT variant, min(station) AS station FROM profile GROUP BY variant UNION ALL
  SELECT k.variant, min(p.station) FROM kept k JOIN profile p ON p.variant = k.variant AND p.station >= k.station + 60000 GROUP BY k.variant, k.station)
SELECT variant, CAST(station AS BIGINT) AS station FROM kept"""
)
def win_dedupe_near(spark, sf):
    """Stations at least 600 m from the last one kept, from the first on: a fold over each ordered list of stations."""
    lists = _profile(spark, sf).groupBy("variant").agg(F.array_sort(F.collect_list("station")).alias("s"))
    far = lambda kept, v: (F.size(kept) == 0) | (v >= F.element_at(kept, -1) + 60000)
    kept = F.aggregate("s", F.array().cast("array<bigint>"), lambda kept, v: F.when(far(kept, v), F.concat(kept, F.array(v))).otherwise(kept))
    return lists.select("variant", F.explode(kept).alias("station"))
