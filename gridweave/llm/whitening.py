"""Whitening of embeddings by a bidiagonal singular value solver.

Rows are centred exactly, in integers, and reduced by QR: every task keeps one triangle of its rows, and rounds of FAN
triangles a group are stacked and reduced again until one is left. On that triangle, which is as wide as the vectors, the driver
works: Householder reflections make it bidiagonal, the differential quotient-difference transform with shifts (dqds) finds
its singular values from the least up with high relative accuracy, and for the greatest ones a twisted factorisation of the
shifted bidiagonal's square, joined where its pivot is least, gives the vector; the reflections carry it back. Nothing on the
driver grows with the rows.

Edge cases: null, empty and non-finite vectors, and those with a component of 2**60 or more after scaling, are dropped, as
are vectors of another length than the commonest (of equally common ones the longest counts). Components whose variance is
nothing but rounding (constant or dependent dimensions, a single row) have no whitened values and are left out; if none is
left there are no rows. Equal eigenvalues have no vectors of their own: any orthogonal ones come out, the same for all rows. A
deviation that doesn't fit a long is null. Repeated rows count each and come out each; an id of null stays null; an empty
table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import vectors
from gridweave.llm.common import Workspace

SCALE, PLUS, COMPONENTS = 1024.0, 100_000, 8
#: Triangles that one task stacks in a round.
FAN = 16
EPS = float(np.finfo(float).eps)
#: Singular values below this share of the greatest are rounding.
ROUNDING = 1e-11


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of an upper bidiagonal B = U' r V, and the reflections that make up V."""
    a, right = np.array(r, float), []
    m = len(a)

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    for k in range(m):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < m - 2:
            w = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def carried_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z: the vector of the bidiagonal matrix as one of the triangle."""
    z = z.copy()
    for w in reversed(right):
        z[-len(w) :] -= 2 * w * (w @ z[-len(w) :])
    return z


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One dqds transform; None if the shift was above the least eigenvalue."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] == 0:
            return None
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    if not d >= 0:
        return None
    qq[-1] = d
    return qq, ee, least


def _bottom(q: np.ndarray, e: np.ndarray) -> float:
    """The lower eigenvalue of the last 2 x 2 block of the tridiagonal product L U."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half = (a - c) / 2
    root = abs(half) + np.hypot(half, np.sqrt(b))
    return float(c - b / root) if half > 0 and root > 0 else float((a + c) / 2 - np.hypot(half, np.sqrt(b)))


def squares_of_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds with deflation from the bottom."""
    found: list[float] = []
    work = [(np.asarray(diagonal, float) ** 2, np.asarray(above, float) ** 2, 0.0)]
    while work:
        q, e, shifted = work.pop()
        least, turns = 0.0, 0
        while len(q):
            if len(q) == 1:
                found.append(shifted + q[0])
                break
            # A row whose coupling is below rounding stands for itself, and a matrix falls apart where one vanishes.
            if e[-1] <= EPS * EPS * (shifted + q[-1]):
                found.append(shifted + q[-1])
                q, e, least = q[:-1], e[:-1], 0.0
                continue
            cut = np.flatnonzero(e <= EPS * EPS * (shifted + np.minimum(q[:-1], q[1:])))
            if len(cut):
                at = int(cut[-1]) + 1
                work.append((q[:at], e[: at - 1], shifted))
                q, e, least = q[at:], e[at:], 0.0
                continue
            if not q[-1] > 0 and not shifted > 0 and turns > 4 * len(q):
                e = e.copy()
                e[-1] = 0.0  # an eigenvalue of 0: zero shifts have carried it to the end
                continue
            turned = q[0] < q[-1] / 4  # graded the wrong way: shifts find the least value faster from the other end
            if turned and turns == 0:
                # The reversed product has the same eigenvalues; its qd array follows from one pass over the tridiagonal.
                diag, off = q + np.append(0.0, e), q[:-1] * e
                diag, off = diag[::-1], off[::-1]
                qr, er = np.empty_like(q), np.empty_like(e)
                qr[0] = diag[0]
                for i in range(len(e)):
                    er[i] = off[i] / qr[i]
                    qr[i + 1] = diag[i + 1] - er[i]
                if (qr > 1e-3 * diag).all():
                    q, e = qr, er
            turns += 1
            low = _bottom(q, e)
            tries = [low - abs(e[-1]) * 1e-3, low * (1 - 1e-4) - e[-1], least * 0.75, least * 0.25, 0.0]
            for shift in tries:
                if shift < 0 or not np.isfinite(shift):
                    continue
                stepped = _step(q, e, shift if shift > EPS * shifted else 0.0)
                if stepped is not None:
                    q, e, least = stepped
                    shifted += shift if shift > EPS * shifted else 0.0
                    break
            else:
                q, e = np.maximum(q, 0), np.maximum(e, 0)
                stuck = int(np.argmin(q))
                q[stuck] = max(q[stuck], EPS * EPS * max(float(q.max()), 1e-300))
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, join: int | None = None) -> np.ndarray:
    """A unit eigenvector of B'B to the eigenvalue.

    The factorisation from the top (stationary) and the one from the bottom (progressive) of B'B - value meet at the place
    where the pivot is least, unless `join` names another.
    """
    n, q, e = len(diagonal), diagonal**2, above**2
    tiny = EPS * max(float(q.max()), float(e.max()) if n > 1 else 0.0, 1e-300) * 1e-3
    lower = above / diagonal[:-1]  # L of B'B = L D L'
    down, s = np.empty(n), np.empty(n)
    factor = np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n):
        down[i] = q[i] + s[i]
        if abs(down[i]) < tiny:
            down[i] = -tiny
        if i < n - 1:
            factor[i] = q[i] * lower[i] / down[i]
            s[i + 1] = factor[i] * lower[i] * s[i] - value
    up, p = np.empty(max(n - 1, 0)), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        r = q[i] * lower[i] ** 2 + p[i + 1]
        if abs(r) < tiny:
            r = -tiny
        t = q[i] / r
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value))) if join is None else join
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -factor[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def greatest(diagonal: np.ndarray, above: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest eigenvalues of B'B that aren't rounding, falling, their vectors as columns, and the trace."""
    values = squares_of_singular_values(diagonal, above)
    total = float(values.sum())
    q, e = diagonal**2, above**2
    scale = float(values[0]) if len(values) else 0.0
    least = EPS * 1e-3 * scale**0.5
    steady = np.where(np.abs(diagonal) < least, least, diagonal)  # a vanishing entry would divide by 0
    # Blocks that a vanishing coupling parts have vectors of their own.
    apart = np.flatnonzero(e <= (EPS * EPS) * scale)
    edges = [0, *(int(i) + 1 for i in apart), len(q)]
    of_block = [(v, a, b) for a, b in zip(edges, edges[1:], strict=False) for v in squares_of_singular_values(diagonal[a:b], above[a : b - 1])]
    of_block.sort(key=lambda x: -x[0])
    kept_values: list[float] = []
    kept: list[np.ndarray] = []
    square = lambda z: diagonal * _times(diagonal, above, z) + np.append(0.0, above * _times(diagonal, above, z)[:-1])
    for value, a, b in of_block[:most]:
        if not value > ROUNDING**2 * scale:
            break
        best = None
        for join in [None, *range(a, b)]:
            z = np.zeros(len(q))
            z[a:b] = twisted(steady[a:b], above[a : b - 1], value, None if join is None else join - a) if b - a > 1 else 1.0
            length = 1.0
            for _ in range(2):  # vectors of near eigenvalues come out close: what lies along earlier ones is taken off
                for w in kept:
                    z -= (w @ z) * w
                length *= np.linalg.norm(z)
                if length < 1e-8:
                    break
                z /= np.linalg.norm(z)
            if length < 1e-8:
                continue
            off = float(np.linalg.norm(square(z) - value * z))
            if best is None or off < best[0]:
                best = (off, z)
            if off <= 1e-10 * scale and length > 1e-3:
                break
        if best is None:
            break
        kept_values.append(float(value))
        kept.append(best[1])
    return np.array(kept_values), np.array(kept).T.reshape(len(q), len(kept)), total


def _times(diagonal: np.ndarray, above: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = diagonal * z
    out[:-1] += above * z[1:]
    return out


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # per dimension, Python integers where they are large
    values: np.ndarray  # eigenvalues, falling
    directions: np.ndarray  # a unit column per eigenvalue
    trace: float

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        wide = vectors.exact(x, (1 << 61) // max(self.n, 1))
        sums = self.sums if wide.dtype == object else vectors.exact(self.sums, 1 << 61)
        return wide * self.n - sums

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        return (moved.astype(float) / self.n) @ self.directions / np.sqrt(self.values)


def _x(b: pa.RecordBatch, width: int) -> np.ndarray:
    return vectors.integers(b.column("v"), width, SCALE, PLUS)


def sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """How many rows, and the sum of every dimension; a task gives a row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            n += b.num_rows
            total += vectors.exact(_x(b, width), (1 << 62) // max(b.num_rows, 1)).sum(0)
        if n:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([int(v) for v in total], pa.decimal128(38, 0))], names=["at", "n", "s"])

    found = rows.mapInArrow(run, "at int, n long, s decimal(38, 0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    total = np.zeros(width, object)
    for r in found:
        total[r["at"]] = int(r["s"])
    return found[0]["n"] if found else 0, total


def triangle(rows: DataFrame, width: int, centre: Whitening) -> np.ndarray:
    """R of the centred rows' QR: one triangle a task, then FAN to a group, until one is left."""

    def pack(r: np.ndarray) -> bytes:
        full = np.zeros((width, width))
        full[: len(r)] = r
        return full.tobytes()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            moved = centre.moved(_x(b, width)).astype(float) / centre.n
            for at in range(0, len(moved), 8 * width):
                r = np.linalg.qr(np.vstack([r, moved[at : at + 8 * width]]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([pack(r)], pa.binary())], names=["r"])

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, width))
        for raw in frame["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(raw).reshape(width, width)]), mode="r")
        return pd.DataFrame({"slot": [key[0] // FAN], "r": [pack(r)]})

    made = rows.mapInArrow(reduce, "r binary").withColumn("part", F.spark_partition_id())
    made = Workspace(rows.sparkSession, "triangles").write(made, "made")
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    level = made.select((F.col("part") / FAN).cast("int").alias("slot"), "r")
    while parts > 1:
        level = level.groupBy("slot").applyInPandas(join, "slot int, r binary")
        parts = -(-parts // FAN)
    r = np.zeros((width, width))
    for row in level.select("r").collect():  # one triangle
        r = np.frombuffer(row["r"]).reshape(width, width)
    return r


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Of rows with the one column v, as vectors.kept gives them."""
    n, total = sums(rows, width)
    centre = Whitening(n, total, np.empty(0), np.empty((width, 0)), 0.0)
    diagonal, above, right = bidiagonal(triangle(rows, width, centre))
    values, found, squares = greatest(diagonal, above, components)
    directions = np.array([carried_back(z, right) for z in found.T]).T.reshape(width, len(values))
    return Whitening(n, total, values / n, directions, squares / n)


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """Greatest absolute entry of the whitened rows' covariance minus the identity; a task gives a row per entry."""
    k = len(model.values)
    a, b = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(model.moved(_x(batch, width)))
            first += w.sum(0)
            second += w.T @ w
        at, to = np.append(np.arange(k), a), np.append(np.full(k, -1), b)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(np.append(first, second[a, b]), pa.float64())], names=["a", "b", "s"])

    found = {(r["a"], r["b"]): r["s"] / model.n for r in rows.mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()}
    # Rows were centred before they were projected; what is left of a mean is rounding, and is taken off as well.
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in zip(a, b, strict=True))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per kept vector and component."""
    spark = embeddings.sparkSession
    rows, width = vectors.kept(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")), "v", SCALE)
    if not width:
        return spark.createDataFrame([], OUT)
    model = fit(rows.select("v"), width, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], OUT)
    error, share = identity_error(rows.select("v"), width, model), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                moved = model.moved(_x(b, width))
                deviation = (vectors.exact(moved, int((1 << 62) / width) ** 0.5 // 1) ** 2).sum(1)
                ids = pa.array(np.repeat(np.arange(b.num_rows), k))
                n = b.num_rows
                yield pa.record_batch(
                    [
                        b.column("vec_id").take(ids),
                        pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                        pa.array(np.full(n * k, model.n), pa.int64()),
                        vectors.longs(deviation).take(ids),
                        pa.array(model.whitened(moved).reshape(-1), pa.float64()),
                        pa.array(np.tile(share, n), pa.float64()),
                        pa.array(np.full(n * k, error), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
