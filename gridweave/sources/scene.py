"""A deterministic planning scene over the star-schema tables. Coordinates are whole centimetres, so joins are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.sources import dimensions as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xy(k: Column, a: int, b: int) -> list[Column]:
    return [(k * a % 201400).cast("long").alias("x"), (k * b % 162900).cast("long").alias("y")]


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection points (terminal, x, y, flow in hundredths of t/h)."""
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.alias("terminal"), *_xy(k, 7919, 104729), (50 + k * 37 % 7600).alias("flow"))


def chambers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing chambers (chamber, x, y, parent, dn); chamber 0 is the source."""
    k = F.col("s_suppkey").cast("long")
    dn = F.element_at(F.array(*[F.lit(r[0]) for r in D.DIAMETERS]), (k % 18 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("chamber"), *_xy(k, 6101, 15013), F.when(k >= 1, F.floor((k - 1) / 2)).alias("parent"), dn.alias("dn"))


#: Thirteen raw type names: the canonical ones, an alias and an unknown one.
RAW_TYPES = [*[r[0] for r in D.RESTRICTIONS], "Heating-Network", "quarry"]


#: No side of a restriction is longer, in centimetres: 500 and at most 19 times 100.
WIDEST = 2400


def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes (box, x0, y0, x1, y1, raw type)."""
    k = F.col("p_partkey").cast("long")
    x, y = k * 4799 % 201400, k * 8161 % 162900
    raw = F.element_at(F.array(*[F.lit(t) for t in RAW_TYPES]), (k % 13 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("box"), x.alias("x0"), y.alias("y0"), (x + 500 + F.col("p_size") % 20 * 100).cast("long").alias("x1"), (y + 500 + k % 15 * 100).alias("y1"), raw.alias("raw"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New segments (variant, line, part, supplier, flow, cents of length, special, dn, cost)."""
    line = F.col("l_linenumber").cast("long")
    flow = F.col("l_quantity").cast("long") * line * line * line
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("variant"), line.alias("line"), F.col("l_partkey").cast("long").alias("part"), F.col("l_suppkey").cast("long").alias("supplier"),
        flow.alias("flow"), F.floor(F.col("l_extendedprice") + 0.5).cast("long").alias("length"), (F.col("l_returnflag") == "R").alias("special"), F.col("l_shipdate").alias("shipped"),
    )
    s = s.withColumn("dn", C.diameter_for_flow(F.col("flow")))
    return s.withColumn("cost", F.floor(C.of_diameter(F.col("dn"), 3) * F.col("length") / 100 * F.when(F.col("special"), 1.6).otherwise(1.0) + 0.5).cast("long"))


_DIAMETERS = f"(SELECT * FROM ({D.values(D.DIAMETERS)}) AS d(dn, capacity, run, per_m, width))"

#: The same scene for the oracle, as common table expressions.
SCENE_SQL = f"""
dims AS {_DIAMETERS},
terminals AS (SELECT c_custkey AS terminal, c_custkey * 7919 % 201400 AS x, c_custkey * 104729 % 162900 AS y, 50 + c_custkey * 37 % 7600 AS flow FROM customer),
chambers AS (SELECT s_suppkey AS chamber, s_suppkey * 6101 % 201400 AS x, s_suppkey * 15013 % 162900 AS y,
  CASE WHEN s_suppkey >= 1 THEN (s_suppkey - 1) // 2 END AS parent, list_extract({[r[0] for r in D.DIAMETERS]}, CAST(s_suppkey % 18 + 1 AS BIGINT)) AS dn FROM supplier),
boxes AS (SELECT p_partkey AS box, p_partkey * 4799 % 201400 AS x0, p_partkey * 8161 % 162900 AS y0,
  p_partkey * 4799 % 201400 + 500 + p_size % 20 * 100 AS x1, p_partkey * 8161 % 162900 + 500 + p_partkey % 15 * 100 AS y1,
  list_extract({RAW_TYPES}, CAST(p_partkey % 13 + 1 AS BIGINT)) AS raw FROM part),
flows AS (SELECT l_orderkey AS variant, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supplier,
  CAST(l_quantity AS BIGINT) * l_linenumber * l_linenumber * l_linenumber AS flow, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS length, l_returnflag = 'R' AS special, l_shipdate AS shipped FROM lineitem),
sized AS (SELECT f.*, (SELECT min(dn) FROM dims WHERE capacity >= f.flow) AS dn FROM flows f),
segments AS (SELECT s.*, CAST(floor(d.per_m * CAST(s.length AS DOUBLE) / 100 * CASE WHEN special THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS BIGINT) AS cost FROM sized s LEFT JOIN dims d USING (dn))
"""
