"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees, boosted on the logistic loss, are grown on statistics of labelled texts; every path from a root to a node
is a conjunctive rule. A lasso logistic regression keeps the rules that matter, and these are compiled into one Spark
column: a sum of weights over conjunctions of comparisons. Scoring runs in the JVM without Python.

The ensemble is fitted on at most TRAIN labelled texts, drawn by a hash over all labels. Statistics cover whole texts.

Edge cases: null and empty texts have all statistics 0 and get a score like any other; without labelled rows, or with
one class only, the score is the mean label (0.5 without any); a label of null is no label, and of several labels of a
document the lowest counts; of rows with one id, the one with the least statistics is fitted; repeated rows are scored alike; an empty table gives no rows; extra columns pass through
score_documents unless they bear the name of an output, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import SPACE_RUN, documents, id_remainder, text_of

TRAIN = 12_000
TREES, DEPTH, THRESHOLDS = 24, 3, 32
STATISTICS = ["chars", "words", "word_length", "distinct", "repeats", "upper", "digits", "exclaims", "symbols", "bars", "stops", "lines"]


def statistics(df: DataFrame) -> DataFrame:
    """df with a column _s: a struct of the statistics of `text`, all doubles, 0 for a null or empty text."""
    t = F.col("_t")
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    df = df.withColumn("_t", text_of())
    df = df.withColumn("_w", F.filter(F.split(t, SPACE_RUN), lambda w: w != ""))
    words, chars = F.size("_w").cast("double"), F.length(t).cast("double")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    values = {
        "chars": chars,
        "words": words,
        "word_length": per(chars, words),
        "distinct": per(F.size(F.array_distinct("_w")).cast("double"), words),
        "repeats": per(F.size(F.regexp_extract_all(t, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))"), F.lit(1))).cast("double"), words),
        "upper": per(count(r"\P{Lu}+"), chars),
        "digits": per(count("[^0-9]+"), chars),
        "exclaims": per(count("[^!?]+"), words),
        "symbols": per(count(r"[^#$%&*+<=>@^~\\{}\[\]]+"), words),
        "bars": per(count("[^|]+"), words),
        "stops": per(count("[^.,;:]+"), words),
        "lines": count("[^\n]+"),
    }
    return df.withColumn("_s", F.struct(*[values[k].alias(k) for k in STATISTICS])).drop("_t", "_w")


#: A rule: comparisons (statistic, above, threshold); above means >, else <=.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, rule: Rule, rules: list[Rule], least: int = 20) -> np.ndarray:
    """Fit a tree to slope / weight; appends the path to each node below the root; returns the fitted step of each row."""
    def gain(s: float, w: float) -> float:
        return s * s / (w + 1.0)

    flat = np.full(len(x), slope.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return flat
    best = (1e-6 + gain(slope.sum(), weight.sum()), -1, 0.0)
    for k, points in enumerate(cuts):
        place = np.searchsorted(points, x[:, k], "left")  # rows in places 0..j are <= points[j]
        s, w, n = (np.cumsum(np.bincount(place, v, len(points) + 1))[:-1] for v in (slope, weight, np.ones(len(x))))
        ok = (n >= least) & (len(x) - n >= least)
        if ok.any():
            g = np.where(ok, s**2 / (w + 1) + (slope.sum() - s) ** 2 / (weight.sum() - w + 1), -1)
            if g.max() > best[0]:
                best = (float(g.max()), k, float(points[int(g.argmax())]))
    _, k, cut = best
    if k < 0:
        return flat
    out = np.empty(len(x))
    for above in (False, True):
        rows = (x[:, k] > cut) == above
        path = (*rule, (k, above, cut))
        rules.append(path)
        out[rows] = grow(x[rows], slope[rows], weight[rows], cuts, depth - 1, path, rules, least)
    return out


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights and bias with an absolute-value penalty on the weights (accelerated proximal gradient)."""
    mean = z.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 1e-3)
    a = np.hstack([(z - mean) / spread, np.ones((len(z), 1))])
    v = np.ones(a.shape[1])
    for _ in range(50):
        v = a.T @ (a @ v)
        top = np.linalg.norm(v)
        v /= top
    rate = 4 * len(a) / top
    w = np.zeros(a.shape[1])
    u, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
        new = u - rate * (a.T @ (p - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in self.rules:
            total += w * holds(x, rule)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score as a Spark column over the struct _s."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                value = F.col("_s")[STATISTICS[k]]
                test = test & ((value > cut) if above else (value <= cut))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> Ensemble:
    """x: rows of STATISTICS; y: labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Ensemble([], float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS + 1)[1:-1])) for k in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        total += 0.5 * grow(x, y - p, p * (1 - p), cuts, DEPTH, (), found)
    rules: dict[bytes, Rule] = {}
    for r in sorted(set(found), key=lambda r: (len(r), r)):
        rules.setdefault(np.packbits(holds(x, r)).tobytes(), r)  # of rules that say the same of all rows, the shortest
    kept = list(rules.values())
    if not kept:
        return Ensemble([], float(total[0]))
    w, bias = lasso(np.stack([holds(x, r) for r in kept], 1).astype(float), y, strength)
    return Ensemble([(r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-9], bias)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Ensemble:
    """Fit on labelled documents, at most `most` of them. docs: doc_id, text; labels: doc_id, quality."""
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = labels.count()
    order = F.xxhash64(F.lit(17), F.col("doc_id"))
    # 8 standard deviations above the wanted number; the driver cuts to it, so what is broadcast has a bound.
    share = min(1.0, (most + 8 * most**0.5) / max(n, 1))
    drawn = labels.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order).limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # Of the rows that bear one id, the one with the least statistics counts, so the driver gets a row per label.
    one = statistics(rows).groupBy(order.alias("o"), "quality").agg(F.min("_s").alias("_s"))
    got = one.select("o", "quality", *[F.col("_s")[k].alias(k) for k in STATISTICS]).toPandas().sort_values(["o", "quality"])
    return fit(got[STATISTICS].to_numpy(float), got["quality"].to_numpy(float))


def score_documents(docs: DataFrame, ensemble: Ensemble, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 at the threshold or above)."""
    # Nothing is added, but a term that isn't deterministic keeps filters on the score above the statistics, which would
    # else be worked out for every rule.
    scored = statistics(docs).withColumn("score", ensemble.column() + F.monotonically_increasing_id() * F.lit(0.0)).drop("_s")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = train(docs, labels.where(id_remainder(4) != 2))
    return score_documents(docs.select("doc_id", "text"), ensemble).select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", "predicted")
