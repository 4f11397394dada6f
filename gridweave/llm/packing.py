"""Packing token sequences by non-negative least squares over a histogram of lengths.

A document's tokens are cut into whole windows and a remainder. The histogram of piece lengths (at most one row per
length up to the window) goes to the driver, which enumerates shallow combinations of lengths that fill a window, solves
for how often to repeat each so that together they use up the histogram (least squares, no negative repeats), rounds
the repeats to what is there, and packs the residual greedily: first pairs that fill a window, then the rest end to end,
longest first, cut where a window is full. Only the last sequence of all can be short.

Every piece gets its rank among pieces of its length; the plan says, per length and range of ranks, which sequence and
offset follow. Ranks are numbered in hash buckets, so a length that a third of all pieces share is spread. The tokens
are written once to the shared folder and joined once with the plan.

Edge cases: null and empty texts hold the end id alone; repeated rows are packed each by itself; an empty table gives no
rows; extra columns are not read; very long texts have one row of pieces each, of at most length / window + 2 pieces.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import Workspace, bounded, bucket_count, documents, gapless_rank, text_of

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers, about 200 bytes each; the memory is emptied when it is full.
CACHE = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to token ids (little-endian 16-bit bytes), each distinct word encoded once as long as it is remembered.

    No token of this vocabulary spans a space or line feed, so texts are split there. Words that are letters followed by
    punctuation are normalised and cut here and go to the tokenizer's model alone; all others go through all of the
    tokenizer. That holds for tokenizers that lower-case, drop white space and split words into runs of letters and runs
    of punctuation. An apostrophe may start a contraction, and a capital sigma's lower case depends on its place.
    """

    TAIL = "".join(c for c in string.punctuation if c != "'")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        parts = json.loads(self.whole.to_str())
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.letters = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": split}))
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.whole.get_vocab().items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}

    def _spelled(self, cores: list[str]) -> list[bytes]:
        """Ids of each word of letters; many go to the model in one text, and a word's last token is marked as such."""
        texts = [" ".join(cores[i : i + 1000]) for i in range(0, len(cores), 1000)]
        ids = np.concatenate([np.array(e.ids, "<u2") for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)]) if cores else np.zeros(0, "<u2")
        ends = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(cores):
            raise ValueError("the tokenizer doesn't mark the ends of words")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def _learn(self, words: list[str]) -> None:
        known, cores = self.known, self.cores
        trimmed = pc.ascii_rtrim(pa.array(words, pa.string()), characters=self.TAIL)
        low = pc.ascii_lower(trimmed).to_numpy(zero_copy_only=False).tolist()
        plain = pc.and_(pc.string_is_ascii(trimmed), pc.utf8_is_alpha(trimmed)).to_numpy(zero_copy_only=False).tolist()
        core: list[str | None] = []
        for c, lower, ok in zip(trimmed.to_numpy(zero_copy_only=False).tolist(), low, plain, strict=True):
            if ok:
                core.append(lower)
            else:
                fine = not c.isascii() and c.isalpha() and "\u03a3" not in c and is_normalized("NFC", c) and (lower := c.lower()).isalpha()
                core.append(lower if fine else None)
        tails = ["" if c is None else w[len(c) :] for w, c in zip(words, core, strict=True)]
        odd = [w for w, c in zip(words, core, strict=True) if c is None]
        odd += set(tails).difference(known)
        known.update(zip(odd, [array("H", e.ids).tobytes() for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)], strict=True))
        new = list(set(core).difference(cores, [None]))
        cores.update(zip(new, self._spelled(new), strict=True))
        known.update([(w, cores[c] + known[t]) for w, c, t in zip(words, core, tails, strict=True) if c is not None])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, each text's followed by the end id, and the number of ids of each text."""
        if len(self.known) > CACHE:
            self.known, self.cores = {"": b""}, {}
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in here if w not in self.known])
        spelled = list(map(self.known.__getitem__, here))
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 2
        flat, begin = np.frombuffer(b"".join(spelled), "<u2"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        sizes = size[which]
        at = np.cumsum(sizes)
        ids = flat[np.repeat(begin[which] - at + sizes, sizes) + np.arange(at[-1] if len(at) else 0)]
        ends = np.concatenate([[0], at])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


def tokenize(path: str, end_id: int):
    """A function for mapInArrow: (doc_id, text) to (doc_id, n, ids); ids are little-endian 16-bit, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers

        # A worker process serves many tasks; what it remembers of a tokenizer stays with the library's module.
        kept = tokenizers.__dict__.setdefault("_gridweave_encoders", {})
        encode = kept.get(path) or kept.setdefault(path, Encoder(path))
        for batch in batches:
            for part in bounded(batch, "text"):
                ids, n = encode(part.column("text"), end_id)
                offsets = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), column], names=["doc_id", "n", "ids"])

    return run


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that sum to the window: pairs and triples of lengths in the histogram."""
    have = np.flatnonzero(histogram)
    have = have[(have > 0) & (have < window)]
    present = np.zeros(window + 1, bool)
    present[have] = True
    rows = [np.stack([have, window - have, np.zeros_like(have)], 1)[present[window - have] & (2 * have <= window)]]
    for a in have[3 * have <= window]:
        b = have[(have >= a) & (2 * have <= window - a)]
        b = b[present[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows).astype(np.int64)


def non_negative_least_squares(rows: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that brings near the histogram how often the combinations use each length (accelerated projected gradient).

    Each combination's column has a 1 per use of a length. A step is scaled per combination by how many others share
    its lengths, which bounds the curvature along it.
    """
    n = len(histogram)
    use = rows > 0

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), weights=(x[:, None] * use).ravel(), minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[rows] * use).sum(1)

    x = np.zeros(len(rows))
    if not len(rows):
        return x
    scale = 1.0 / np.maximum(back(forward(np.ones(len(rows)))), 1.0)
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y + scale * back(histogram - forward(y)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def plan(histogram: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: (length, first rank) ascending, with the sequence and offset of the first rank.

    step: sequences per rank (0 in ranges that lie end to end, where offsets count over all windows from `sequence`).
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in lengths:
            out.append((n, int(taken[n]), sequence, offset, 1))
            taken[n] += times
            left[n] -= times
            offset += n
        sequence += times

    if left[window]:
        use([window], int(left[window]))
    rows = combinations(histogram, window)
    repeats = non_negative_least_squares(rows, histogram[: window + 1].astype(float))
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 0.5:
            break
        lengths = [int(n) for n in rows[i] if n]
        times = min(round(float(repeats[i])), *[int(left[n]) // lengths.count(n) for n in lengths])
        if times:
            use(lengths, times)
    for n in range(window // 2, 0, -1):
        m = window - n
        times = int(left[n]) // 2 if n == m else int(min(left[n], left[m]))
        if times:
            use([n, m], times)
    place = 0
    for n in range(window, 0, -1):
        if left[n]:
            out.append((n, int(taken[n]), sequence, place, 0))
            place += int(left[n]) * n
    out.sort()
    return {k: np.array([r[i] for r in out], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset", "step"))}


def assign(ranges: dict[str, np.ndarray], window: int):
    """A function for mapInArrow: pieces with their rank to pieces in sequences; some are cut in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranges["length"] << 48) + ranges["rank"]
        for b in batches:
            rid, start, length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "start", "length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            beyond = rank - ranges["rank"][at]
            step = ranges["step"][at]
            place = ranges["offset"][at] + np.where(step == 1, 0, beyond * length)
            sequence = ranges["sequence"][at] + np.where(step == 1, beyond, place // window)
            offset = np.where(step == 1, place, place % window)
            first = np.minimum(length, window - offset)
            cut = first < length
            cols = [np.concatenate(x) for x in ((rid, rid[cut]), (start, (start + first)[cut]), (first, (length - first)[cut]), (sequence, sequence[cut] + 1), (offset, np.zeros(cut.sum(), np.int64)))]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["rid", "start", "length", "sequence_id", "offset"])

    return run


PLACED = "rid long, start long, length long, sequence_id long, offset long"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, ids, pieces) to one row per piece with its own ids, little-endian 32-bit."""
    for batch in batches:
        for part in bounded(batch, "ids"):
            pieces = part.column("pieces")
            which = np.repeat(np.arange(part.num_rows), pc.list_value_length(pieces).to_numpy())
            flat = {k: c.to_numpy() for k, c in zip(("start", "length", "sequence_id", "offset"), pieces.flatten().flatten(), strict=True)}
            ids = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4") for x in part.column("ids")]
            own = [ids[r][s : s + n].tobytes() for r, s, n in zip(which.tolist(), flat["start"].tolist(), flat["length"].tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(which)), pa.array(flat["start"]), pa.array(flat["length"]), pa.array(own, pa.binary()), part.column("n").take(pa.array(which)), pa.array(flat["sequence_id"]), pa.array(flat["offset"])], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(tokenize(tokenizer, end_id), "doc_id long, n long, ids binary")
    tokens = work.write(tokens.withColumn("rid", F.monotonically_increasing_id()), "tokens")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window))
    pieces = tokens.select("rid", "n", F.explode(starts).alias("w")).select("rid", (F.col("w") * window).alias("start"), F.least(F.col("n") - F.col("w") * window, F.lit(window)).cast("long").alias("length"))
    counts = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row per length, window + 1 at most
        counts[r["length"]] = r["count"]
    ranked = gapless_rank(pieces, ["length"], [F.col("rid"), F.col("start")], bucket_count(int(counts.sum()), 200, 1024), "rank")
    placed = ranked.mapInArrow(assign(plan(counts, window), window), PLACED)
    piece = F.struct("start", "length", "sequence_id", "offset")
    by_doc = placed.groupBy("rid").agg(F.collect_list(piece).alias("pieces"))
    return tokens.join(by_doc.hint("shuffle_merge"), "rid").select("doc_id", "n", "ids", "pieces").mapInArrow(slices, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), tokenizer_path()))
