"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each node every child draws -ln(u) / weight, u a hash of key and
child, and the smallest draw wins; a node weighs as much as the shards below it. A change of a shard's weight changes
draws only on its path, so rows move only into or out of subtrees whose weights change. A new shard that opens a region
of its own takes rows only into itself, and none move between the others.

Only DataFrame functions run here. Edge cases: a null key hashes as a fixed value; null and empty texts have size 1;
repeated rows get slots of their own; an empty table gives no rows; extra columns pass through untouched unless they
bear the name of an output, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import bucket_count, documents, gapless_rank, text_of


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int = 8, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Shards 0.. filled rack by rack and region by region; with 8 shards two regions of two racks of two."""
    return [Shard(i // (racks * per_rack), i // per_rack, i) for i in range(shards)]


def _draw(key: list[Column], level: str, node: int, weight: float, seed: int) -> Column:
    # 52 bits of the hash give u in (0, 1); the level's name keeps nodes of different levels apart.
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.lit(node), *key), 12)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _choose(key: list[Column], level: str, weights: dict[int, float], seed: int) -> Column:
    live = sorted((n, w) for n, w in weights.items() if w > 0)
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.least(*[F.struct(_draw(key, level, n, w, seed).alias("d"), F.lit(n).alias("n")) for n, w in live])["n"]


def place(df: DataFrame, key: list[str], shards: list[Shard], out: str = "shard", seed: int = 7) -> DataFrame:
    """Add the shard of every row. Shards of weight 0 take nothing; at least one weight must be above 0.

    The tree's expressions grow with its nodes; each level is a projection of its own, so a row evaluates one child
    group per level.
    """
    if not any(s.weight > 0 for s in shards):
        raise ValueError("no shard has a weight above 0")
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for s in shards:
        regions[s.region] = regions.get(s.region, 0) + s.weight
        racks.setdefault(s.region, {})[s.rack] = racks.get(s.region, {}).get(s.rack, 0) + s.weight
        leaves.setdefault(s.rack, {})[s.shard] = s.weight
    keys = [F.col(k) for k in key]

    def below(level: str, parent: str, groups: dict[int, dict[int, float]]) -> Column:
        found = F.lit(None).cast("int")
        for p, children in groups.items():
            if any(w > 0 for w in children.values()):
                found = F.when(F.col(parent) == p, _choose(keys, level, children, seed)).otherwise(found)
        return found

    df = df.withColumn("_region", _choose(keys, "region", regions, seed))
    df = df.withColumn("_rack", below("rack", "_region", racks))
    return df.withColumn(out, below("shard", "_rack", leaves).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard], seed: int = 7) -> DataFrame:
    """Shard, gapless slot in the shard, and the shard after growth, of every document."""
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = place(rows, ["doc_id"], shards, "shard", seed)
    rows = place(rows, ["doc_id"], grown, "grown_shard", seed)
    buckets = bucket_count(docs.count(), 200)
    slots = gapless_rank(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], buckets, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = topology(8)
    return shard_documents(documents(spark, sf_dir), base, [*base, Shard(2, 4, 8)])
