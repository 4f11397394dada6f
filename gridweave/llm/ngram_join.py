"""Exact Jaccard self-join on word shingles by filters under several global token orders.

A document's set is its distinct shingles, as 64-bit hashes. Documents with equal sets are one node, named by 64 bits of
a hash of the set; the names are checked against 64 further bits, and names that different sets share are drawn anew, so
nodes are told apart by 128 bits. Any two nodes that link (Jaccard similarity at the threshold or above) share a token among their first n - ceil(t n) + 1 tokens under every
global order. All orders put tokens that many documents share last (by powers of two of a corpus count), and differ by
hash within a count. Order 1 finds candidates through an index of prefix tokens; the other orders and the sizes are
checked on a candidate before its sets are compared.

The index isn't turned into all pairs. Buckets are counted, and those of many nodes dealt to parts of about PART, whatever
the token. Small buckets (the nodes under one token) give pairs, a bounded number per row.
Large buckets pair their nodes with a few of them; verified links are joined into components, and further rounds pair
what is left with other partners. Large buckets that still hold several components are compared in blocks inside
tasks, first by prefixes, which leaves few nodes, then by sets; tasks return only links that join components. Pairs of
one component are never compared, which loses no link that could change one.

Before any set is moved, pairs must share enough prefix tokens for the threshold. Sets come from the documents
themselves, read again: a bit array of bounded size tells the tasks which ones to send.

Edge cases: null and empty texts and texts without words have an empty set and link with nothing; shorter texts than a
shingle are one token; repeated rows and copies are one node; a null doc_id links like any other but names no component
(component_id is null if all ids of a component are null); an empty table gives no rows; extra columns are not read.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Workspace, bounded, documents, keep_rows, look_up, small_batches, text_key
from gridweave.llm.components import components

#: Tokens counted at once by a task, and how often one must occur among them to be reported.
COUNTED, REPORTED = 1_000_000, 3
#: The most frequent tokens that the orders know of, a table of at most 12 bytes each.
KNOWN = 1 << 18
#: Nodes for one part of a large bucket.
PART = 256
#: Global orders a candidate must pass, the index's among them.
ORDERS = 3
#: Large buckets, those with so many nodes in a part or several parts, are paired with a few of their nodes at a time, for
#: so many rounds at most, while a round links a share of its pairs.
LARGE, PARTNERS, ROUNDS, GAIN = 64, 8, 4, 0.6
#: Nodes and tokens in a block of a large bucket.
BLOCK_NODES, BLOCK_TOKENS = 1024, 1_000_000
#: Least and most bits of the array that tells which sets to move.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Nodes that a task remembers to give each once.
REMEMBERED = 300_000
#: Most names that may be drawn anew: of 10^11 sets about 300 share their 64 bits with another.
ANEW = 100_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles as 64-bit tokens; a text shorter than a shingle is one token."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = words.flatten().dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    h = each[coded.indices.to_numpy()]
    ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
    some = (pc.binary_length(texts).fill_null(0).to_numpy() > 0).tolist()
    size = len(h) - width + 1
    full = _mix(sum(h[k : k + size] * np.uint64(_ODD[k % 4] + 2 * k) for k in range(width))) if size > 0 else h[:0]
    begin = 0
    empty = xxhash.xxh3_64_intdigest("")
    for end, any_text in zip(ends.tolist(), some, strict=True):
        n = end - begin
        if n >= width:
            yield np.unique(full[begin : end - width + 1])
        elif not any_text or (n == 1 and int(h[begin]) == empty):
            yield h[:0]  # no text, or white space only
        else:
            yield _mix(sum(h[begin + k : begin + k + 1] * np.uint64(_ODD[k % 4] + 2 * k) for k in range(n)) + np.uint64(n))
        begin = end


def need(n, percent: int):
    """Least overlap of a set of n with any set that links with it: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def prefix_length(n, percent: int):
    return n - need(n, percent) + 1


class Levels:
    """How common a token is, as a power of two; 0 for tokens outside the table."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens = tokens
        self.levels = np.log2(np.maximum(counts, 1)).astype(np.uint8) + np.uint8(1)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint8)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.levels[at], np.uint8(0))


def prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The positions of the first tokens under a global order: by level, then by the order's hash. tokens: sorted."""
    p = int(prefix_length(len(tokens), percent))
    if order == 0:
        return np.argsort(level, kind="stable")[:p]
    return np.lexsort((tokens * np.uint64(_ODD[order]), level))[:p]


def overlap_needed(a, b, percent: int):
    """Least common tokens of linked sets of sizes a and b: ceil(percent (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def linked(x: np.ndarray, y: np.ndarray, levels: Levels, percent: int) -> bool:
    """Whether two sets link, by sizes, then the filters of the further orders, then the sets themselves."""
    want = overlap_needed(len(x), len(y), percent)
    if want > min(len(x), len(y)):
        return False
    lx, ly = levels.of(x), levels.of(y)
    for order in range(1, ORDERS):
        if not len(np.intersect1d(x[prefix(x, lx, order, percent)], y[prefix(y, ly, order, percent)], assume_unique=True)):
            return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= want


def frequent_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The KNOWN most frequent tokens, ascending, and their counts. Tasks report tokens that occur several times among those they count at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= REPORTED
            return pa.record_batch([pa.array(tokens[some].view(np.int64)), pa.array(counts[some])], names=["token", "count"])

        for batch in batches:
            for part in bounded(batch, "text"):
                for tokens in shingles(part.column("text"), width):
                    held.append(tokens)
                    n += len(tokens)
                    if n > COUNTED:
                        yield report()
                        held, n = [], 0
        if n:
            yield report()

    rows = docs.select("text").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    top = rows.orderBy(F.desc("count"), "token").limit(KNOWN).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("count").to_numpy()[order]


BASE = "doc_id long, text_key long, node long, further long, n int, prefix array<long>"


class Names:
    """Names sets: 64 bits of a hash, others of its bits for a name in `anew`, and 64 further bits."""

    def __init__(self, anew: frozenset[int] = frozenset(), width: int = 8):
        self.anew, self.width = anew, width

    def __call__(self, tokens: np.ndarray) -> tuple[int, int]:
        h = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
        node, further = int.from_bytes(h[: self.width], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)
        while node in self.anew:
            h = hashlib.blake2b(h, digest_size=16).digest()
            node = int.from_bytes(h[:8], "big", signed=True)
        return node, further


def base_table(docs: DataFrame, width: int, percent: int, levels, names: Names) -> DataFrame:
    """A row per document: its node (null for an empty set), size, and prefix in order 1, which a task gives of a node once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = set(), Levels(*levels.value)
        for batch in batches:
            for part in bounded(batch, "text"):
                named, sizes, lengths, tokens = [], [], [], []
                for x in shingles(part.column("text"), width):
                    node, further = names(x) if len(x) else (None, None)
                    named.append((node, further))
                    sizes.append(len(x))
                    if node is None or (node, further) in seen:
                        lengths.append(0)
                        continue
                    seen.add((node, further))
                    first = prefix(x, table.of(x), 0, percent)
                    lengths.append(len(first))
                    tokens.append(x[first])
                if len(seen) > REMEMBERED:
                    seen.clear()
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                values = pa.array(np.concatenate(tokens).view(np.int64) if tokens else [], pa.int64())
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), *[pa.array([x[i] for x in named], pa.int64()) for i in (0, 1)], pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "text_key", "node", "further", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(run, BASE)


def told_apart(docs: DataFrame, width: int, percent: int, levels, work: Workspace, bytes_of_name: int = 8) -> tuple[DataFrame, Names]:
    """The written base table, and names that no two different sets in it share."""
    names = Names(width=bytes_of_name)
    while True:
        base = work.write(base_table(docs, width, percent, levels, names), "base")
        shared = base.where("node IS NOT NULL").groupBy("node").agg(F.min("further").alias("lo"), F.max("further").alias("hi")).where("lo != hi").select("node").limit(ANEW + 1).collect()
        if not shared:
            return base, names
        names = Names(names.anew | {r["node"] for r in shared}, bytes_of_name)
        if len(names.anew) > ANEW:
            raise RuntimeError("too many sets share their names")


def _bit(node: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(node.view(np.uint64) * np.uint64(_ODD[1]) + _mix(doc.view(np.uint64) + np.uint64(_ODD[2]))) % np.uint64(bits)).astype(np.int64)


def bit_array(owners: DataFrame, bits: int) -> np.ndarray:
    """A bit for every (node, doc_id): bits / 8 bytes on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bit(b.column("node").to_numpy(), b.column("doc_id").to_numpy(), bits)
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], names=["word", "mask"])

    words = owners.select("node", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def moved_sets(docs: DataFrame, owners: DataFrame, width: int, names: Names) -> DataFrame:
    """(node, tokens) of the owners (node, doc_id): from the documents, only rows whose bit is set."""
    n = owners.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * n).bit_length()))
    array = docs.sparkSession.sparkContext.broadcast(bit_array(owners, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = array.value
        for batch in batches:
            for part in bounded(batch, "text"):
                sets = list(shingles(part.column("text"), width))
                nodes = np.array([names(x)[0] for x in sets], np.int64)
                bit = _bit(nodes, part.column("doc_id").to_numpy(), bits)
                hit = [i for i in np.flatnonzero(marks[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)) if len(sets[i])]
                yield pa.record_batch([pa.array(nodes[hit]), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["node", "tokens"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text").mapInArrow(run, "node long, tokens binary")
    return rows.dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, levels, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Levels(*levels.value)
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), table, percent) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "tokens": "x"}), "a")
    both = with_a.join(sets.withColumnsRenamed({"node": "b", "tokens": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, label: str) -> DataFrame:
    """rows with the root of a node's component, itself if it has no links."""
    if labels is None:
        return rows.withColumn(label, F.col(node))
    found = rows.join(labels.withColumnsRenamed({"node": node, "root": "_root"}), node, "left")
    return found.withColumn(label, F.coalesce("_root", node)).drop("_root")


def index_table(base: DataFrame, work: Workspace) -> DataFrame:
    """(token, part, node, n, large): nodes by prefix token, where the token has another node."""
    rows = base.where(F.size("prefix") > 0).select("node", "n", F.explode("prefix").alias("token"))
    # Most tokens have one node; their rows end here, by counts that are partial in each task.
    size = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo != hi")
    rows = look_up(rows, work.write(size.select("token", "k"), "buckets"), ["token"], "k").where("k IS NOT NULL")
    part = F.when(F.col("k") > PART, F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / PART))).otherwise(0).cast("int")
    return rows.select("token", part.alias("part"), "node", "n", (F.col("k") >= LARGE).alias("large")).distinct()


def _may_link(a: str, b: str, shared: Column, percent: int) -> Column:
    """Whether sets of sizes a and b that share so many prefix tokens, or fewer, can link.

    Two prefixes hold every common token up to where the first of them ends; the other common tokens lie in that set's
    rest. So a linked pair shares at least overlap_needed - max(rest) tokens of both prefixes.
    """
    a, b = F.col(a), F.col(b)
    return (a * percent <= b * 100) & (b * percent <= a * 100) & (shared >= _fewest(a, b, percent))


def _fewest(a: Column, b: Column, percent: int) -> Column:
    """Fewest tokens that prefixes of linked sets of sizes a and b share."""
    rest = F.floor((F.greatest(a, b) * percent + 99) / 100) - 1
    return F.floor((percent * (a + b) + (99 + percent)) / (100 + percent)) - rest


def _above(a: Column, b: Column, percent: int) -> Column:
    """A bound that _fewest is above: the same without rounding. In b it rises up to a, then falls; _fewest needn't."""
    return (percent * (100 * (a + b) - (100 + percent) * F.greatest(a, b))) / (100 * (100 + percent))


def small_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes that meet in a small bucket and may link by sizes and shared prefix tokens.

    Tokens in large buckets aren't counted pair by pair; as many as both have at most count as shared.
    """
    has = shared.groupBy("node").agg(F.count(F.lit(1)).alias("all"), F.count_if("large").alias("wide"))
    rows = shared.where("NOT large").select("token", "node", "n").join(has, "node")
    x = rows.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("all").alias("alla"), F.col("wide").alias("wa"))
    y = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("all").alias("allb"), F.col("wide").alias("wb"))
    met = x.join(y, "token").where("a < b").where(_may_link("na", "nb", F.least("alla", "allb"), percent))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.first(k).alias(k) for k in ("na", "nb", "wa", "wb")])
    return counted.where(_may_link("na", "nb", F.col("c") + F.least("wa", "wb"), percent)).select("a", "b")


def star_pairs(large: DataFrame, labels: DataFrame | None, turns: range, percent: int, work: Workspace) -> DataFrame:
    """(a, b): for each turn, each node with the bucket partner that it meets in most buckets, of those in another component.

    The partner of a bucket's part is the node of least hash in that turn; parts of one token meet by their partners.
    """
    rows = work.write(mixed_buckets(large, labels, percent, work), "mixed")
    who = [F.min(F.struct(F.xxhash64(F.lit(t), "node").alias("d"), "node", "n", "all", "label")).alias(f"w{t}") for t in turns]
    partner = work.write(rows.groupBy("token", "part").agg(*who), "partners")
    over = work.write(partner.groupBy("token").agg(*[F.min(f"w{t}").alias(f"t{t}") for t in turns], F.count(F.lit(1)).alias("parts")).where("parts > 1"), "over")
    each = lambda own: F.inline(F.array(*[F.struct(F.lit(t).alias("turn"), *own(t)) for t in turns]))
    inside = rows.join(partner, ["token", "part"]).select("node", "n", "all", "label", each(lambda t: [F.col(f"w{t}").alias("with")]))
    across = look_up(partner, over, ["token"], "parts").where("parts IS NOT NULL").select(each(lambda t: [F.col(f"w{t}").alias("one"), F.col(f"t{t}").alias("with")])).select("one.node", "one.n", "one.all", "one.label", "turn", "with")
    met = inside.unionByName(across).where(F.col("label") != F.col("with.label"))
    met = met.select("turn", "node", "n", "all", F.col("with.node").alias("other"), F.col("with.n").alias("m"), F.col("with.all").alias("all2"))
    counted = met.where(_may_link("n", "m", F.least("all", "all2"), percent)).groupBy("turn", "node", "other").agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy("turn", "node").agg(F.max(F.struct("c", "other"))["other"].alias("b"))
    return best.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def prefixes(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, first, n): the prefixes of some nodes."""
    rows = base.where(F.size("prefix") > 0).select("node", "n", F.col("prefix").alias("first"))
    return rows.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.first("first").alias("first"), F.first("n").alias("n"))


def sharing_pairs(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough tokens."""
    first = prefixes(base, ends(pairs))
    x = pairs.join(first.select(F.col("node").alias("a"), F.col("first").alias("fa"), F.col("n").alias("na")), "a")
    y = x.join(first.select(F.col("node").alias("b"), F.col("first").alias("fb"), F.col("n").alias("nb")), "b")
    return y.where(_may_link("na", "nb", F.size(F.array_intersect("fa", "fb")), percent)).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def mixed_buckets(large: DataFrame, labels: DataFrame | None, percent: int, work: Workspace) -> DataFrame:
    """The rows of large buckets that may have a partner of another component there, with each node's component.

    Sizes fall into classes whose bounds differ by the least ratio of linked sets, so partners are in the same class or
    the next. A row needs another component in a class it can meet, and enough shared tokens for some size found there.
    """
    rows = _labelled(large, labels, "node", "label")
    own = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9)
    near = rows.withColumn("class", F.explode(F.array(own, own + 1)))
    near = near.groupBy("token", "class").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("members")).where("lo != hi")
    near = work.write(near, "near")
    rows = look_up(rows.withColumn("class", F.explode(F.array(own, own + 1))), near, ["token", "class"], "members").where("members IS NOT NULL")
    n = F.col("n")
    most = F.least("most", F.floor(n * 100 / percent))
    least = F.greatest("least", F.ceil(n * percent / 100))
    fewest = F.floor(F.least(_above(n, most, percent), _above(n, least, percent))) + 1
    return rows.where(F.col("all") >= fewest).select("token", "part", "node", "n", "all", "label").distinct()


def dealt(rows: DataFrame, size: str, work: Workspace) -> DataFrame:
    """Rows of buckets (token, node, n, label) with how many blocks their bucket has and which is theirs, by node.

    size: what of a row counts towards BLOCK_TOKENS.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.expr(size)) / BLOCK_TOKENS)).cast("int")
    count = work.write(rows.groupBy("token").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("members")), "blocks")
    return look_up(rows, count, ["token"], "members").drop("members").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def meetings(rows: DataFrame) -> DataFrame:
    """Dealt rows, once for each pair of blocks (p, q) that theirs is in."""
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q")))).alias("meet")
    return rows.select(*[c for c in rows.columns if c != "blocks"], meets).select("*", "meet.p", "meet.q").drop("meet")


def live_rows(mixed: DataFrame, base: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The rows (token, node, n, label) of mixed buckets whose node has a partner there that may link by prefixes."""
    rows = meetings(dealt(mixed, f"n * {100 - percent} DIV 100 + 1", work).join(prefixes(base, mixed.select("node")).drop("n"), "node"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        first = [np.asarray(t.values).view(np.uint64) for t in rows.column("first").chunk(0)]
        label, side, n = (rows.column(c).to_numpy() for c in ("label", "i", "n"))
        keep = np.zeros(len(first), bool)
        for a, partners, _, _ in promising(np.uint64(rows.column("token")[0].as_py() & 0xFFFFFFFFFFFFFFFF), label, side, n.astype(np.int64), first, percent):
            keep[a] = True
            keep[partners] = True
        return rows.select(["token", "node", "n", "label"]).filter(pa.array(keep))

    return rows.groupBy("token", "p", "q").applyInArrow(run, "token long, node long, n int, label long").distinct()


def promising(token: np.uint64, label: np.ndarray, side: np.ndarray, n: np.ndarray, first: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place: the later places that may link by sizes and prefixes, how much they share, and what they need.

    Pairs are of different labels, on different sides (any, if all are on one), and have `token` as first common token.
    """
    every, order1 = np.unique(np.concatenate(first), return_inverse=True)
    lengths = np.array([len(f) for f in first])
    stops = np.cumsum(lengths)
    begins = stops - lengths
    ids = [order1[b:e] for b, e in zip(begins, stops, strict=True)]
    here = int(np.searchsorted(every, token))
    one_side = len(set(side.tolist())) == 1
    rest = need(n, percent) - 1
    rank = np.full(len(every), len(every), np.int64)
    for a in range(len(first) - 1):
        rank[ids[a]] = np.arange(len(ids[a]))
        met = rank[order1[begins[a + 1] :]]
        at = begins[a + 1 :] - begins[a + 1]
        shared = np.add.reduceat((met < len(every)).astype(np.int64), at)
        want = overlap_needed(n[a], n[a + 1 :], percent)
        ok = (np.minimum.reduceat(met, at) == rank[here]) & (shared >= want - np.maximum(rest[a], rest[a + 1 :])) & (want <= np.minimum(n[a], n[a + 1 :])) & (label[a + 1 :] != label[a])
        if not one_side:
            ok &= side[a + 1 :] != side[a]
        rank[ids[a]] = len(every)
        if ok.any():
            yield a, np.flatnonzero(ok) + a + 1, shared[ok], want[ok]


def block_links(live: DataFrame, sets: DataFrame, levels, percent: int, work: Workspace) -> DataFrame:
    """(a, b): links across components among live rows, enough of them to join what they join."""
    rows = meetings(dealt(live, "n", work).join(sets, "node"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        token = np.uint64(rows.column("token")[0].as_py() & 0xFFFFFFFFFFFFFFFF)
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in rows.column("tokens").chunk(0)]
        found = compare_block(token, rows.column("label").to_numpy(), rows.column("i").to_numpy(), sets, Levels(*levels.value), percent)
        nodes = rows.column("node").to_numpy()
        return pa.table({"a": pa.array(nodes[[a for a, _ in found]], pa.int64()), "b": pa.array(nodes[[b for _, b in found]], pa.int64())})

    return rows.groupBy("token", "p", "q").applyInArrow(run, "a long, b long")


def compare_block(token: np.uint64, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], levels: Levels, percent: int) -> list[tuple[int, int]]:
    """Pairs of places that link and join components, for pairs on different sides (any, if all are on one)."""
    level = [levels.of(x) for x in sets]
    first = [x[prefix(x, v, 0, percent)] for x, v in zip(sets, level, strict=True)]
    further = [[x[prefix(x, v, k, percent)] for x, v in zip(sets, level, strict=True)] for k in range(1, ORDERS)]
    n = np.array([len(x) for x in sets])
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, partners, shared, want in promising(token, label, side, n, first, percent):
        for k in np.argsort(-shared, kind="stable"):
            b = int(partners[k])
            if root(int(label[b])) == root(int(label[a])):
                continue
            if all(np.intersect1d(f[a], f[b], assume_unique=True).size for f in further) and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= want[k]:
                out.append((a, b))
                parent[root(int(label[b]))] = root(int(label[a]))
    return out


def join_classes(docs: DataFrame, width: int = 5, percent: int = 80, note: Callable[[str, object], None] | None = None, bytes_of_name: int = 8) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), text_key,
    and root, which rows of one class share (null for a row that has no copies and no links).

    note: is told the rows of each step, for tests and tuning. bytes_of_name: fewer make sets share names, for tests.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        return _join_classes(docs, width, percent, note or (lambda *_: None), bytes_of_name)


def _join_classes(docs: DataFrame, width: int, percent: int, note: Callable[[str, object], None], bytes_of_name: int) -> DataFrame:
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    levels = spark.sparkContext.broadcast(frequent_tokens(docs, width))
    base, names = told_apart(docs, width, percent, levels, work, bytes_of_name)
    shared = work.write(index_table(base, work), "shared")
    labels: DataFrame | None = None

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        owners = base.select("node", "doc_id").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        return work.write(moved_sets(docs, work.write(owners, f"owners-{name}"), width, names), f"sets-{name}")

    def merge(links: DataFrame, name: str) -> int:
        """Join links into the components; how many there were."""
        nonlocal labels
        links = work.write(links, f"links-{name}")
        m = links.count()
        if m:
            labelled = _labelled(_labelled(links, labels, "a", "ra"), labels, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            roots = components(labelled, work, f"roots-{name}")
            if labels is None:
                labels = roots
            else:
                moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
                labels = work.write(moved.union(roots), f"labels-{name}")
        return m

    def settle(pairs: DataFrame, name: str) -> float:
        """Verify pairs and join the links into the components; the share of pairs that link."""
        pairs = work.write(pairs, f"pairs-{name}")
        n = pairs.count()
        if not n:
            return 0.0
        m = merge(verify(pairs, sets_of(ends(pairs), name), levels, percent), name)
        note(name, (n, m))
        work.drop(f"sets-{name}", f"owners-{name}", f"links-{name}", f"pairs-{name}")
        return m / n

    has = shared.groupBy("node").agg(F.count(F.lit(1)).alias("all"))
    large = work.write(shared.where("large").select("token", "part", "node", "n").join(has, "node"), "large")
    for at in range(ROUNDS):
        stars = work.write(star_pairs(large, labels, range(at * PARTNERS, (at + 1) * PARTNERS), percent, work), f"stars-{at}")
        pairs = sharing_pairs(stars, base, percent)
        if not at:
            pairs = pairs.union(small_pairs(shared, percent)).distinct()
        if settle(pairs, str(at)) < GAIN:
            break
    mixed = work.write(mixed_buckets(large, labels, percent, work).select("token", "node", "n", "label").distinct(), "mixed")
    live = work.write(live_rows(mixed, base, percent, work), "live")
    if not live.isEmpty():
        m = merge(block_links(live, sets_of(live.select("node").distinct(), "live"), levels, percent, work), "blocks-live")
        note("blocks", (live.count(), m))

    nodes = base.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    found = work.write(_labelled(nodes, labels, "node", "root"), "found")
    classes = found.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("members")).where("rows > 1")
    named = look_up(found.select("node", "root", "copies"), work.write(classes, "classes"), ["root"], "members").where("members IS NOT NULL")
    named = work.write(named.select("node", "root", "copies", "component_id"), "named")
    work.keep("base", "named")
    rows = look_up(base.select("doc_id", "text_key", "node", F.col("n").cast("long").alias("n_shingles")), named, ["node"], "copies")
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component, "text_key", "root")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each class the row with the smallest doc_id stays (null last)."""
    rows = join_classes(docs, width, percent)
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    chosen = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(first).alias("k")).select("k.doc_id", "k.text_key", F.lit(True).alias("once"))
    return keep_rows(docs, rows.where("root IS NULL").select("doc_id", "text_key", F.lit(False).alias("once")).union(chosen))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")
