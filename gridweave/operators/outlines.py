"""Fewer points for outlines and lines, without new crossings: no dropped point lies farther than the tolerance from what replaces it.

Lines are split at their farthest point until all are near enough; a ring starts as two halves, from its first point to the one farthest from
it. Where straight parts of one obstacle then cross or touch, those that stand for several original parts are split further,
until none does: at worst the original comes back. A ring keeps at least three points. An obstacle is one row's work, so what a task holds is
bounded by the largest outline.

Edge cases: null or empty rings stay; rings of up to three points and lines of up to two stay; repeated points are dropped in rows; an outline that
crosses itself from the start keeps those crossings; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: tolerance (m) for obstacles' outlines.
OUTLINE = 0.25
SHAPES = "obstacle long, rings array<array<struct<x: double, y: double>>>, closed boolean, clearance double"


def _farthest(p: np.ndarray, i: int, j: int) -> tuple[float, int]:
    """How far the points between i and j lie from the straight part between them, and which one lies farthest."""
    if j - i < 2:
        return -1.0, i
    a, d = p[i], p[j] - p[i]
    q = p[i + 1 : j] - a
    t = np.clip(q @ d / (d @ d), 0, 1) if d @ d else np.zeros(len(q))
    far = np.hypot(*(q - t[:, None] * d).T)
    k = int(far.argmax())
    return float(far[k]), i + 1 + k


def _split(p: np.ndarray, i: int, j: int, tolerance: float) -> list[int]:
    """Indexes between i and j that have to stay."""
    keep, stack = [], [(i, j)]
    while stack:
        i, j = stack.pop()
        d, k = _farthest(p, i, j)
        if d > tolerance:
            keep.append(k)
            stack += [(i, k), (k, j)]
    return keep


def _touching(a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """Pairs (i, j), i < j, of straight parts a-b that meet anywhere but in a common end."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    out = []
    for at in range(0, len(a), block):
        i = order[at : at + block]
        # Only parts that begin, from left to right, before the last of these ends.
        j = order[at : np.searchsorted(low[order, 0], high[i, 0].max(), "right")]
        near = (low[i, None] <= high[None, j]).all(-1) & (low[None, j] <= high[i, None]).all(-1)
        u, v = np.nonzero(near)
        u, v = i[u], j[v]
        u, v = np.minimum(u, v), np.maximum(u, v)
        u, v = u[u != v], v[u != v]
        side = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
        s = [side(a[u], b[u], a[v]), side(a[u], b[u], b[v]), side(a[v], b[v], a[u]), side(a[v], b[v], b[u])]
        met = (np.sign(s[0]) * np.sign(s[1]) <= 0) & (np.sign(s[2]) * np.sign(s[3]) <= 0)
        same = lambda p, q: (p == q).all(1)
        shared = same(a[u], a[v]) | same(a[u], b[v]) | same(b[u], a[v]) | same(b[u], b[v])
        # Parts with a common end meet elsewhere as well only if they lie on one line and turn back.
        back = shared & (np.abs(np.stack(s)).max(0) == 0)
        common = np.where((same(a[u], a[v]) | same(a[u], b[v]))[:, None], a[u], b[u])
        other = lambda w: np.where(same(a[w], common)[:, None], b[w], a[w]) - common
        back &= (other(u) * other(v)).sum(1) > 0
        out.append(np.stack([u, v], 1)[(met & ~shared) | back])
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), int)


def thinned(rings: list[np.ndarray], closed: bool, tolerance: float) -> list[np.ndarray]:
    """The rings, or lines, of one obstacle with fewer points."""
    points, chains = [], []
    for ring in rings:
        p = np.asarray(ring, float).reshape(-1, 2)
        p = p[np.r_[True, (p[1:] != p[:-1]).any(1)]] if len(p) else p
        if closed and len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        n = len(p)
        if n <= (3 if closed else 2):
            points.append(p)
            chains.append(list(range(n)) + [n] * (closed and n > 1))
        else:
            start = sorted({0, int(np.hypot(*(p - p[0]).T).argmax()), n if closed else n - 1})
            points.append(p)
            chains.append(start)
    wrapped = [np.concatenate([p, p[:1]]) if closed and len(p) > 1 else p for p in points]
    for c, p, q in zip(chains, points, wrapped, strict=True):
        if len(p) > (3 if closed else 2):
            kept = {k for i, j in zip(c, c[1:], strict=False) for k in _split(q, i, j, tolerance)}
            if closed and len(c) + len(kept) < 4:
                kept.add(max((_farthest(q, i, j) for i, j in zip(c, c[1:], strict=False)))[1])
            c[:] = sorted({*c, *kept})
    while True:
        parts = [(r, i, j) for r, c in enumerate(chains) for i, j in zip(c, c[1:], strict=False)]
        if not parts:
            break
        a, b = (np.stack([wrapped[part[0]][part[k]] for part in parts]) for k in (1, 2))
        crossed = {int(k) for k in _touching(a, b).ravel()}
        again = [parts[k] for k in crossed if parts[k][2] - parts[k][1] > 1]
        if not again:
            break
        for r, i, j in again:
            chains[r].append(_farthest(wrapped[r], i, j)[1])
        for c in chains:
            c.sort()
    return [p[[k for k in c if k < len(p)]] for p, c in zip(points, chains, strict=True)]


def simplify(obstacles: DataFrame, tolerance: float = OUTLINE) -> DataFrame:
    """(obstacle, rings, closed, clearance) with fewer points."""

    def points(ring: pa.ListScalar) -> np.ndarray:
        return np.stack([v.to_numpy(zero_copy_only=False) for v in ring.values.flatten()[:2]], 1) if ring.is_valid else np.empty((0, 2))

    def thin(shape: pa.ListScalar, closed: bool) -> list | None:
        if not shape.is_valid:
            return None
        return [[{"x": float(x), "y": float(y)} for x, y in p.reshape(-1, 2)] for p in thinned([points(ring) for ring in shape.values], closed, tolerance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # An outline is made of numbers only while it's the one at work, and few wait to be handed on.
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                old = part.column("rings")
                rings = [thin(shape, bool(closed.as_py())) for shape, closed in zip(old, part.column("closed"), strict=True)]
                yield part.set_column(part.schema.get_field_index("rings"), "rings", pa.array(rings, old.type))

    return obstacles.selectExpr("CAST(obstacle AS LONG) AS obstacle", "rings", "closed", "CAST(clearance AS DOUBLE) AS clearance").mapInArrow(run, SHAPES)
