"""What the operators share: written tables, text normal forms, distributed ranks, look-ups that spread large classes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.operators.storage import Workspace, temporary_tables  # noqa: F401

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of maximal runs of characters other than the six white-space characters; 0 for null."""
    inner = F.regexp_replace(text_of(column), f"^{SPACE_RUN}|{SPACE_RUN}\\z", "")  # $ would also match before a last line end
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN, -1))).cast("long")


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo; an id of null has remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def bucket_count(rows: int, per_bucket: int, most: int = 4096, widest: int = 100_000) -> int:
    """How many hash buckets hold about per_bucket rows each, or, beyond `most` buckets, about `widest`."""
    return max(1, min(most, -(-rows // per_bucket)), -(-rows // widest))


def look_up(rows: DataFrame, classes: DataFrame, key: list[str], size: str, most: int = 4096, least: int = 1000) -> DataFrame:
    """rows left-joined with classes by key, no matter how many rows one class has. classes: written, a row per key.

    size: the column of classes that says how many rows bear the key. Classes with more than 1 / most of all those rows, and
    more than `least`, are dealt to parts of that many. They are fewer than `most`, whatever the data, so that their keys
    can be broadcast, and all parts together add fewer than `most` rows to classes. Rows with a null key are spread.
    """
    share = max(least, -(-int(classes.agg(F.sum(size)).first()[0] or 0) // most))
    parts = F.ceil(F.col(size) / share).cast("int")
    wide = classes.where(F.col(size) > share).select(*key, parts.alias("_parts"))
    none = F.array_contains(F.array(*[F.col(k).isNull() for k in key]), True)
    dealt = F.when(none, F.lit(most)).otherwise(F.coalesce("_parts", F.lit(1)))
    rows = rows.join(F.broadcast(wide), key, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), dealt).cast("int")).drop("_parts")
    return rows.join(classes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))), [*key, "_part"], "left").drop("_part")


def gapless_rank(df: DataFrame, group: list[str], order: list[Column], buckets: int, out: str) -> DataFrame:
    """Number the rows of every group from 0 without gaps, with no group in one task.

    Rows are dealt to hash buckets of the order columns, numbered within (group, bucket), and shifted by the counts of
    the buckets before. The window and the join with the shifts use one shuffle of df. group: columns without nulls.
    """
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = salted.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(shifts, [*group, "_bucket"]).withColumn(out, (F.col("_shift") + F.col("_place")).cast("long")).drop("_bucket", "_shift", "_place")


def bounded(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with about `most` bytes of the column each."""
    total = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
    rows = max(1, int(batch.num_rows * most / max(total, most)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in each Arrow batch of the actions within, so that batches of long texts stay small in workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_key(column: str = "text") -> Column:
    """A hash that, with the doc_id, tells rows apart without moving their texts."""
    return F.xxhash64(F.col(column))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs named by kept (doc_id, text_key, once); where `once`, repeated rows come back as one.

    Texts move once, to meet their names. Only rows marked `once` are aggregated, with partial results per task, so that
    a row that is repeated very often stays spread.
    """
    names = docs.columns
    named = kept.groupBy("doc_id", "text_key").agg(F.max("once").alias("_once")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = docs.withColumn("_k", text_key())
    rows = rows.join(named.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")))
    many = rows.where("NOT _once").select(*names)
    one = rows.where("_once").groupBy("_id", "_key").agg(F.first(F.struct(*[F.col(n) for n in names])).alias("_r")).select(*[F.col("_r")[n].alias(n) for n in names])
    return many.unionByName(one)
