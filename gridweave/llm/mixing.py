"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources share the wanted total by weight; a target stops at cap times its source's size and the excess is
shared again by weight until none is above. Blocks: every source's documents, in seeded order, lie end to end in each
of a number of shards, and each such line is cut into blocks of equal tokens. Sainte-Lague apportionment (highest
quotients w / (2k + 1)) gives every source a whole number of blocks, and each source's blocks to its shards. Within a
shard, whole passes take all blocks and a seeded choice takes the rest once more.

Whole documents: groups of about GROUP documents of a source take their blocks' words as whole documents. The longest
come first; each rounds its words and the remainder so far up or down by a seeded draw and carries the rest on, so a
group ends within about its shortest document of its quota, and length alone decides nothing. Where a few documents
hold most of a group's words, no whole numbers may come nearer than a share of one of them.

The driver holds one row per (source, shard), at most LINES; sources are a configured list, not a key that grows with the
rows, and more than SOURCES of them raise ValueError. Documents are never gathered: positions are running sums in (source, shard), and groups
hold numbers, not texts. Texts move once, to meet their numbers by a 64-bit hash of id and text.

Edge cases: null and empty texts have size 0 and take nothing; a null source is a source of its own, last in order;
sources without words have target 0; repeated rows count each by itself; an empty table gives no rows; extra columns
pass through in apportion_documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Workspace, bucket_count, documents, word_count

#: Words in a block.
BLOCK = 64
#: Most sources; most lines, of a source in a shard, that the driver plans.
SOURCES, LINES = 10_000, 1 << 20
#: Documents in a group that takes whole documents, on average.
GROUP = 4096


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Target of each source: share of all sizes by weight, at most cap times its size, excess shared again."""
    total, held, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(out[i] for i in held)
        weight = sum(w for i, w in enumerate(weights) if i not in held)
        for i, w in enumerate(weights):
            if i not in held:
                out[i] = left * w / weight
        over = {i for i in range(len(sizes)) if i not in held and out[i] > cap * sizes[i]}
        if not over:
            return out
        for i in over:
            out[i] = float(cap * sizes[i])
        held |= over
        if len(held) == len(sizes):
            return out


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2k + 1); ties go to the earlier party; no party gets above its cap.

    Quotients above a common divisor are given at once, by rounding weight / divisor; only the last few seats are
    given one by one, so the cost follows the parties, not the seats.
    """
    w = np.asarray(weights, dtype=float)
    top = np.full(len(w), np.iinfo(np.int64).max // 4) if caps is None else np.asarray(caps, dtype=np.int64)
    top = np.where(w > 0, top, 0)
    seats = int(min(seats, top.sum()))
    if seats <= 0 or not len(w):
        return [0] * len(w)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(w / divisor + 0.5).astype(np.int64), top)

    low, high = w[w > 0].min() / (4.0 * (seats + 1)), w.max() * 4  # many seats, none
    while given(low).sum() < seats:
        low /= 16
    for _ in range(200):
        mid = (low * high) ** 0.5
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = given(high)
    while got.sum() < seats:
        quotient = np.where(got < top, w / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return [int(x) for x in got]


def _covered(start: Column, size: Column, words: Column, blocks: Column, passes: Column, extra: Column, a: Column, b: Column) -> Column:
    """Words of [start, start + size) that are taken: passes times all, and the blocks of the seeded choice once more.

    Block j covers [j * words / blocks, (j + 1) * words / blocks). It is of the choice if (a * j + b) mod blocks < extra;
    as a has no factor in common with blocks, exactly `extra` blocks are.
    """

    def edge(j: Column) -> Column:
        return F.floor(j * words / blocks)

    first = F.floor(start * blocks / words)
    last = F.floor((start + size - 1) * blocks / words)
    steps = F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, blocks - 1))
    part = F.aggregate(
        steps,
        F.lit(0).cast("long"),
        lambda acc, j: acc + F.when((a * j + b) % blocks < extra, F.greatest(F.least(edge(j + 1), start + size) - F.greatest(edge(j), start), F.lit(0))).otherwise(F.lit(0)).cast("long"),
    )
    return F.when(size > 0, passes * size + F.when(extra > 0, part).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")


def whole_times(sizes: np.ndarray, taken: np.ndarray, draws: np.ndarray, most: int) -> np.ndarray:
    """How often each document comes whole, 0 to most, so that all together have the words taken. Longest first is nearest.

    A draw in [0, 1) decides between the whole numbers around a document's words and the remainder carried to it, unless
    what would be left is more than the later documents can take, or less than nothing.
    """
    out = np.zeros(len(sizes), np.int64)
    left, rest, carried = int(taken.sum()), int(sizes.sum()), 0
    for i, (s, q, u) in enumerate(zip(sizes.tolist(), taken.tolist(), draws.tolist(), strict=True)):
        if not s:
            continue
        rest -= s
        low, high = -((most * rest - left) // s), left // s
        if low <= high:
            t = min(max(math.floor((q + carried) / s + u), low), high)
        else:  # none leaves what the later ones can take; the nearer one
            t = low if low * s - left < left - high * s - most * rest else high
        out[i] = t = min(max(t, 0), most)
        left -= t * s
        carried += q - t * s
    return out


def apportion_documents(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 11, keep: list[str] | None = None, whole: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken. weights repeat over the sources by code point, null last.

    keep: the columns of docs to carry along (all where None); a long text that nobody needs is then not moved.
    whole: whether documents are taken whole; else taken counts the words of the blocks that are.
    """
    keep = docs.columns if keep is None else keep
    docs = docs.drop("size", "source_size", "target", "taken")
    carried = [x for x in dict.fromkeys([*keep, "doc_id"]) if x in docs.columns]
    identity = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.withColumn("size", word_count()).withColumn("_h", identity)
    numbers = ["size", "source_size", "target", "taken"]
    work = Workspace(docs.sparkSession, "mixing")
    if not whole:  # counted once, what is carried along with it
        counted = work.write(rows.select(*dict.fromkeys([*carried, "source"]), "size", "_h"), "sizes")
        return _placed(counted, carried, weights, share, cap, block, seed).select(*carried, *numbers)
    slim = work.write(rows.select("doc_id", "source", "size", "_h"), "sizes")
    placed = _placed(slim, ["doc_id"], weights, share, cap, block, seed)
    most = int(cap)

    def run(rows: pa.Table) -> pa.Table:
        size, h = rows.column("size").to_numpy(), rows.column("_h").to_numpy()
        order = np.lexsort((h, -size))
        draws = rows.column("_draw").to_numpy()[order]
        times = whole_times(size[order], rows.column("taken").to_numpy()[order], draws, most)
        return rows.select(["_h", "size", "source_size", "target"]).take(pa.array(order)).append_column("times", pa.array(times))

    group = F.pmod(F.xxhash64("_h", F.lit(seed + 2)), F.col("_groups")).alias("_group")
    draw = (F.pmod(F.xxhash64("_h", F.lit(seed + 3)), F.lit(1 << 30)) / (1 << 30)).alias("_draw")
    chosen = placed.select("_s", group, "_h", draw, *numbers).groupBy("_s", "_group").applyInArrow(run, "_h long, size long, source_size long, target double, times long")
    # Repeated rows share their times evenly.
    each = chosen.groupBy("_h").agg(*[F.first(x).alias(x) for x in numbers[:3]], F.sum("times").alias("_t"), F.count(F.lit(1)).alias("_k"))
    numbered = docs.select(*carried, identity.alias("_h")).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(1))))
    taken = F.col("size") * (F.floor(F.col("_t") / F.col("_k")) + (F.col("_n") <= F.col("_t") % F.col("_k")).cast("long"))
    return numbered.join(each, "_h").withColumn("taken", taken.cast("long")).select(*carried, *numbers)


def _placed(rows: DataFrame, carried: list[str], weights: list[float], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """The carried columns of rows (source, size, _h) with source_size, target, the words taken by blocks, and how many groups the source has."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: weights are meant for a configured list")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in found]
    per = [float(weights[i % len(weights)]) for i in range(len(found))]
    wanted = targets(sizes, per, share, cap) if found else []
    shards = min(bucket_count(sum(r["rows"] for r in found), 200), LINES // max(1, len(found)))
    names = spark.createDataFrame([(r["source"], i, sizes[i], wanted[i], -(-r["rows"] // GROUP)) for i, r in enumerate(found)], "source string, _s int, source_size long, target double, _groups long")
    rows = rows.join(F.broadcast(names.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_h", F.lit(seed + 1)), F.lit(shards)).cast("int"))

    lines = rows.groupBy("_s", "_shard").agg(F.sum("size").alias("words")).where("words > 0").orderBy("_s", "_shard").collect()
    blocks = [max(1, round(r["words"] / block)) for r in lines]
    quotas = _quotas(lines, blocks, wanted, sizes, cap)
    rng = np.random.default_rng(seed)
    plan = []
    for r, n, q in zip(lines, blocks, quotas, strict=True):
        a, b = int(rng.integers(1, n + 1)), int(rng.integers(0, n))
        while np.gcd(a, n) != 1:
            a = a % n + 1
        plan.append((r["_s"], r["_shard"], int(r["words"]), n, q // n, q % n, a, b))
    table = spark.createDataFrame(plan, "_s int, _shard int, _words long, _blocks long, _passes long, _extra long, _a long, _b long")

    line = Window.partitionBy("_s", "_shard").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*carried, "size", "source_size", "target", "_s", "_shard", "_h", "_groups").withColumn("_start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(table, ["_s", "_shard"], "left")
    c = F.col
    taken = _covered(c("_start"), c("size"), c("_words"), c("_blocks"), c("_passes"), c("_extra"), c("_a"), c("_b"))
    placed = placed.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
    return placed.drop("_shard", "_start", "_words", "_blocks", "_passes", "_extra", "_a", "_b")


def _quotas(lines: list, blocks: list[int], wanted: list[float], sizes: list[int], cap: float) -> list[int]:
    """Blocks for each (source, shard): first to sources, then from a source to its shards."""
    members: dict[int, list[int]] = {}
    for i, r in enumerate(lines):
        members.setdefault(r["_s"], []).append(i)
    sources = sorted(members)
    # Blocks differ a little in words, so a source's seats are counted in blocks of its own mean width.
    seats = {s: wanted[s] / sizes[s] * sum(blocks[i] for i in members[s]) for s in sources}
    most = {s: int(cap) * sum(blocks[i] for i in members[s]) for s in sources}
    per_source = sainte_lague([seats[s] for s in sources], round(sum(seats.values())), [most[s] for s in sources])
    out = [0] * len(lines)
    for s, n in zip(sources, per_source, strict=True):
        own = members[s]
        shares = sainte_lague([float(lines[i]["words"]) for i in own], n, [int(cap) * blocks[i] for i in own])
        for i, q in zip(own, shares, strict=True):
            out[i] = q
    return out


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix as rows of docs: each document as often as it is taken whole."""
    rows = apportion_documents(docs.drop("size", "source_size", "target", "taken"), weights, share, cap)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = apportion_documents(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"], whole=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
