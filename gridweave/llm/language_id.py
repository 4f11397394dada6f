"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit a binary logistic classifier over hashed byte n-grams learns to tell the
languages with a 1 there from the others. A text's margins are decoded to the codeword of least weighted loss: each
bit's logistic loss counts by how well its classifier did on that language in training. Texts whose two best codewords
lie close together are flagged.

Up to 4 languages get every useful split (exhaustive code), as do up to 7; beyond, random dense codewords. The classifiers
are fitted on at most PER_LANGUAGE different texts of each language, and TEXTS of all, drawn by a hash over all labelled
rows, whole texts; copies of a text count as one, however many they are. More than LANGUAGES languages raise ValueError. Texts are read whole, in slices of bounded size that
overlap, so that the cuts add and lose no n-gram.

Edge cases: null texts and texts without letters (Unicode category L) are `und` with score 0; no labelled rows at all makes everything
`und`; one learned language is predicted with score 1; repeated rows and ties are predicted alike (ties go to the language first by
code point); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.common import documents, id_remainder

BUCKETS = 4096
PER_LANGUAGE, TEXTS, LANGUAGES = 500, 4000, 256
#: Bytes of text looked up at once.
SLICE = 1 << 18
#: Texts whose best codeword is less likely than this are flagged.
SURE = 0.9


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def n_grams(data: bytes, begins: int) -> np.ndarray:
    """Buckets of the byte pairs and triples that begin at one of the first so many places."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = b[:-2] * np.uint32(0xC2B2AE35) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)
    return np.concatenate([two[:begins], three[:begins]]) >> np.uint32(20)


def pieces(text: str, width: int = SLICE) -> Iterator[np.ndarray]:
    """The n-grams of the lower-cased text, put between spaces, by slices of where they begin."""
    data = b" " + text.lower().encode() + b" "
    for at in range(0, len(data) - 1, width):
        yield n_grams(data[at : at + width + 2], width)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 per language. Exhaustive for up to 7 languages, else random, all rows and columns distinct."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        bits = (1 << languages - 1) - 1
        # Column c has language 0 at 1 and language k at bit k-1 of c; all ones is of no use and left out.
        return np.array([[1 if k == 0 or c >> k - 1 & 1 else -1 for c in range(bits)] for k in range(languages)], float)
    rng, bits = np.random.default_rng(seed), 15 * (languages - 1).bit_length()
    tries = (rng.choice([-1.0, 1.0], (languages, bits)) for _ in range(200))
    return max(tries, key=lambda m: min((m[a] != m[b]).sum() for a in range(languages) for b in range(a)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Weights of one classifier per column of y (-1, 1), accelerated gradient; the last row of the result is the bias.

    Weights stay sums of rows of x, so steps are taken on the rows' shares in them, by the products of rows: rows are fewer
    than features.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    products = x @ x.T
    top, v0 = 1.0, np.ones(len(x), x.dtype)
    for _ in range(30):
        v0 = products @ v0
        top = float(np.linalg.norm(v0))
        v0 /= top
    rate = 4 * len(x) / top
    w = np.zeros((len(x), y.shape[1]), x.dtype)
    v, t = w, 1.0
    for _ in range(steps):
        slope = -(y / (1 + np.exp(np.clip(y * (products @ v), -30, 30)))) / len(x) + decay * v
        new = v - rate * slope
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return x.T @ w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits: share of training texts of the language that the bit's classifier gets right

    def likelihoods(self, margins: np.ndarray) -> np.ndarray:
        """Of each language for rows of margins, from its codeword's weighted loss."""
        z = self.code[None] * margins[:, None]
        loss = (self.trust[None] * np.logaddexp(0, -z)).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for index in pieces(text):
            total += self.weights.take(index, axis=0).sum(0, dtype=np.float64)
            n += len(index)
        return total / n + self.bias


def frequencies(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for index in pieces(text):
        counts += np.bincount(index, minlength=BUCKETS)
    return counts / counts.sum()


#: Frequencies are near 1 / BUCKETS; scaled so that weights are near 1.
SCALE = 256.0


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on (doc_id, text, lang) rows, lang not null; at most per_language different texts of each language, drawn by hash."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64(F.lit(3), "text").alias("_o"))
    # Copies of a text are one: a text counts once, and of its copies one is drawn.
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang", "_o").agg(F.lit(1)).groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    per_language = min(per_language, max(1, TEXTS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.25 * per_language / n))])
    thin = labelled.where(F.pmod("_o", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    drawn = thin.groupBy("lang", "_o").agg(F.min("text").alias("text"))
    drawn = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_o"))).where(F.col("_r") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [frequencies(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("lang"), b.column("_o"), pa.array([(f * SCALE).astype(np.float16).tobytes() for f in found], pa.binary())], names=["lang", "_o", "x"])

    kept = drawn.select("lang", "_o", "text").mapInArrow(run, "lang string, _o long, x binary").collect()
    kept.sort(key=lambda r: (r["lang"], r["_o"]))
    languages = sorted({r["lang"] for r in kept})
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in kept]).astype(np.float32)
    at = np.array([languages.index(r["lang"]) for r in kept])
    code = codewords(len(languages))
    w = logistic(x, code[at].astype(np.float32))
    margins = x @ w[:-1] + w[-1]
    right = np.stack([((margins * code[k]) > 0)[at == k].mean(0) for k in range(len(languages))])
    return Model(languages, code, (w[:-1] * SCALE).astype(np.float32), w[-1].astype(float), right / np.maximum(right.mean(1, keepdims=True), 1e-9))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, flags = [], [], []
            for t in b.column("text").to_pylist():
                if model is None or t is None or not has_letter(t):
                    names.append("und")
                    scores.append(0.0)
                    flags.append(True)
                    continue
                p = model.likelihoods(model.margins(t)[None])[0]
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
                flags.append(bool(p[best] < SURE))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.where(id_remainder(3) != 1)))
