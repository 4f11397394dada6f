"""Outlines with fewer points: never farther than the tolerance, no new crossings, against plain geometry."""

import math
import time

import numpy as np
import pytest

from gridweave.operators import outlines


def crossings(rings, closed=True):
    """Pairs of parts that cross inside both, by trying all."""
    parts = []
    for ring in rings:
        p = [tuple(q) for q in ring]
        parts += list(zip(p, p[1:] + p[:1] if closed else p[1:], strict=False))
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return sum(side(*s, t[0]) * side(*s, t[1]) < 0 and side(*t, s[0]) * side(*t, s[1]) < 0 for i, s in enumerate(parts) for t in parts[:i])


def reach(points, ring, closed=True):
    """The largest distance from points to a ring."""
    b = np.roll(ring, -1, 0) if closed else ring[1:]
    a = ring if closed else ring[:-1]
    d = b - a
    t = np.clip(((points[:, None] - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(points[:, None] - a - t[..., None] * d, -1, 0)).min(1).max()


def ring(rng, n, rough):
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = 30 + rough * rng.uniform(-1, 1, n)
    return np.stack([far * np.cos(turn), far * np.sin(turn)], 1)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("tolerance", [0.25, 4.0])
def test_distance_and_crossings(seed, tolerance):
    rng = np.random.default_rng(seed)
    shell, hole = ring(rng, 60, 4.0), ring(rng, 40, 3.0) * 0.85  # the hole comes near the shell
    apart = crossings([shell, hole])
    thin = outlines.thinned([shell, hole], True, tolerance)
    assert crossings(thin) <= apart and all(len(t) >= 3 for t in thin)
    for t, p in zip(thin, (shell, hole), strict=True):
        assert reach(p, t) <= tolerance + 1e-9 and {tuple(q) for q in t} <= {tuple(q) for q in p}
    assert tolerance < 1 or sum(map(len, thin)) < 100


def test_a_spike_into_a_bay_is_kept():
    # The bay alone would close over the line that ends in it.
    line = np.array([(0, 0), (4, 0), (4.5, -3), (5, 0), (9, 0)], float)
    spike = np.array([(4.5, 5), (4.5, -2)], float)
    thin = outlines.thinned([line, spike], False, 3.5)
    assert crossings(thin, False) == 0 and len(thin[0]) > 2
    assert len(outlines.thinned([line], False, 3.5)[0]) == 2


def test_ten_thousand_points():
    rng = np.random.default_rng(7)
    p = ring(rng, 10_000, 0.02)
    began = time.time()
    (t,) = outlines.thinned([p], True, 0.25)
    assert len(t) < 500 and reach(p, t) <= 0.25 + 1e-9 and time.time() - began < 30


def test_odd_shapes(spark):
    at = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [
        (1, [at((0, 0), (1, 0), (2, 0.1), (2, 2), (1, 2), (0, 2))], True, 1.0),
        (2, [at((0, 0), (5, 0.1), (5, 0.1), (10, 0))], False, None),
        (3, [at((1, 1))], False, 2.0),
        (4, [[]], True, 1.0),
        (5, None, True, 1.0),
        (6, [at((0, 0), (0, 0.1), (0.1, 0.1), (0.1, 0))], True, 1.0),
        (7, [at((0, 0), (2, 2), (2, 0), (0, 2))], True, 1.0),
    ]
    got = {r["obstacle"]: r for r in outlines.simplify(spark.createDataFrame([(*r, "extra") for r in rows], outlines.SHAPES + ", more string")).collect()}
    plain = lambda k: [[(q["x"], q["y"]) for q in ring] for ring in got[k]["rings"]]
    assert plain(1) == [at((0, 0), (2, 0.1), (2, 2), (0, 2))] and plain(2) == [at((0, 0), (10, 0))] and got[2]["clearance"] is None
    assert plain(3) == [at((1, 1))] and plain(4) == [[]] and got[5]["rings"] is None
    assert len(plain(6)[0]) == 3 and plain(7) == [rows[6][1][0]]  # crosses itself from the start
    assert outlines.simplify(spark.createDataFrame([], outlines.SHAPES)).count() == 0


def test_query_of_rings(spark):
    from gridweave.plans import geometry_queries as Q

    sf = "/root/testdata/sf0.001"
    rings = {r["obstacle"]: np.array([(p["x"], p["y"]) for p in r["rings"][0]]) for r in Q.supplier_rings(spark, sf).collect()}
    thin = {r["obstacle"]: np.array([(p["x"], p["y"]) for p in r["rings"][0]]) for r in outlines.simplify(Q.supplier_rings(spark, sf)).collect()}
    area = lambda p: abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2
    got = {r["supplier"]: r for r in Q.geo_simplify_outlines(spark, sf).collect()}
    assert set(got) == set(rings) == set(thin)
    for k, p in rings.items():
        r = got[k]
        assert reach(p, thin[k]) <= 0.25 + 1e-9 and crossings([thin[k]]) == 0 and {tuple(q) for q in thin[k]} <= {tuple(q) for q in p}
        assert (r["points"], r["points_left"]) == (len(p), len(thin[k])) and r["points_left"] < r["points"]
        assert r["area"] == pytest.approx(area(p), abs=0.011) and r["area_left"] == pytest.approx(area(thin[k]), abs=0.011)


def test_outlines_of_several_slices(spark):
    import math

    from gridweave.operators import outlines

    ring = lambda n: [(n + math.cos(t / 20 * math.tau), math.sin(t / 20 * math.tau) * (1 + n % 3)) for t in range(20)]
    rows = [(n, None if n % 50 == 7 else [ring(n), None] if n % 50 == 8 else [ring(n)], True, 1.0) for n in range(150)]
    got = {r.obstacle: r.rings for r in outlines.simplify(spark.createDataFrame(rows, outlines.SHAPES).coalesce(1)).collect()}
    for n, rings, *_ in rows:
        want = None if rings is None else [[tuple(p) for p in r] for r in outlines.thinned([q or [] for q in rings], True, outlines.OUTLINE)]
        assert want == (got[n] if got[n] is None else [[(p.x, p.y) for p in r] for r in got[n]])
