"""Whitening and grid codes against plain numpy and plain Python, and the cases their docstrings name."""

import hashlib
import math

import numpy as np
import pytest

from gridweave.llm import grid_codes, vectors, whitening

SCHEMA = "n int, vec_id long, embedding array<float>, label int, code string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """rows: (vec_id, vector, label); with extra columns whose names clash with outputs."""
    return spark.createDataFrame([(7, i, v, lab, "x") for i, v, lab in rows], SCHEMA)


def some(n, width=12, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype(np.float32) * np.linspace(1, 3, width).astype(np.float32) + rng.integers(0, 3, (n, 1)).astype(np.float32)
    return [(n - i if i % 7 else None, v[i].tolist(), None if i % 5 == 0 else i % 3) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * 10, 2), (903, [NAN] + [0.0] * 11, None), (904, [-INF] + [0.0] * 11, 0), (905, [1.0, 2.0], 0), (906, [1e38] + [0.0] * 11, 0)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)
    ints = [[math.floor(4096 * np.float64(c)) for c in v] + [0] * (width * parts - len(v)) for _, v, _ in rows]
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in ints] for p in range(parts)]
    books = [[cut[p][i] for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x, books[p])[1] for x in cut[p]]
            books[p] = [tuple(sum(c) // len(mine) for c in zip(*mine, strict=True)) if (mine := [x for x, a in zip(cut[p], at, strict=True) if a == k]) else e for k, e in enumerate(books[p])]
    found = [[near(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    error = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, sum(x for x, q in zip(error, rows, strict=True) if q[2] == r[2]), sha) for r, f, e in zip(rows, found, error, strict=True)), key=str)


@pytest.mark.parametrize(("n", "width"), [(60, 16), (9, 12), (40, 3), (1, 8)])
def test_codes_equal_plain_python(spark, n, width):
    rows = some(n, width)
    rows += rows[: n // 4]  # repeated rows
    odd = [r for r in ODD if width == 12]
    found = grid_codes.quantise(table(spark, rows + odd).repartition(5))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_codes(rows)


def test_codes_of_large_integers_and_ties(spark):
    big = [(i, [float((i % 3) * 1e9)] * 8, 0) for i in range(20)]  # squares beyond 64 bits in parts, ties among equal entries
    assert sorted((tuple(r) for r in grid_codes.quantise(table(spark, big)).collect()), key=str) == plain_codes(big)


def test_codes_of_nothing(spark):
    assert grid_codes.quantise(table(spark, [])).collect() == []
    assert grid_codes.quantise(table(spark, ODD[:2])).collect() == []


def test_cells_keep_every_nearest_entry():
    rng = np.random.default_rng(8)
    x, entries = rng.integers(-900, 900, (4000, 4)), rng.integers(-900, 900, (16, 4))
    plain = ((x[:, None] - entries[None]) ** 2).sum(2)
    for side, cells in ((1, 1 << 16), (64, 1 << 16), (256, 50), (4096, 1 << 16)):
        near = grid_codes.Nearest(entries, side, cells)
        for at in range(0, len(x), 500):
            index, apart = near(x[at : at + 500])
            assert (index == plain[at : at + 500].argmin(1)).all() and (apart == plain[at : at + 500].min(1)).all()
        assert len(near.hashes) <= max(cells, 500)
    near = grid_codes.Nearest(entries, 64)
    near.weights = np.zeros(4, np.uint64)  # all cells share one hash
    assert (near(x)[0] == plain.argmin(1)).all()


def plain_whitening(rows, k=8):
    x = np.array([[math.floor(1024 * np.float64(c)) + 100_000 for c in v] for _, v, _ in rows], object)
    n, s = len(x), x.sum(0)
    moved = x * n - s
    centred = moved.astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    return n, (moved**2).sum(1), values[:k], centred @ directions[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), values.sum()


def check_whitening(found, rows, k=8):
    n, deviation, values, whitened, trace = plain_whitening(rows, k)
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, mine in by.items():
        assert all(r["n"] == n and r["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-8 for r in mine)
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]), r["whitened"]) for r in mine)
        want = sorted(((i is None, i or 0, d), w) for (i, *_), d, w in zip(rows, deviation.tolist(), whitened[:, c - 1], strict=True))
        assert [a for a, _ in mine] == [a for a, _ in want]
        got, want = np.array([b for _, b in mine]), np.array([b for _, b in want])
        assert np.allclose(got, want, atol=1e-7) or np.allclose(got, -want, atol=1e-7)


def test_whitening_equals_numpy(spark):
    rows = some(300, 12)
    rows += rows[:40]
    found = whitening.whiten(table(spark, rows + ODD).repartition(37))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found.collect(), rows)


def test_whitening_of_large_integers(spark):
    rows = [(i, [c * 3e8 for c in v], lab) for i, v, lab in some(50, 6)]
    found = whitening.whiten(table(spark, rows)).collect()
    wide = plain_whitening(rows, 6)[1]
    assert any(d >= 1 << 63 for d in wide) and all(r["deviation"] is None or r["deviation"] in set(wide.tolist()) for r in found)
    assert {r["component"] for r in found} == set(range(1, 7)) and found[0]["identity_error"] < 1e-8


def test_whitening_without_enough_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, some(1))).collect() == []
    assert whitening.whiten(table(spark, [(i, [0.5] * 4, 0) for i in range(9)])).collect() == []
    rows = [(i, [float(v[0]), float(v[0]), 1.0, float(v[1])], None) for i, v, _ in some(40, 2)]
    found = whitening.whiten(table(spark, rows)).collect()
    check_whitening(found, rows, 2)  # two of four dimensions vary by themselves


@pytest.mark.parametrize("seed", range(40))
def test_solver_equals_svd(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    a = rng.normal(size=(d, d)) * 10.0 ** rng.uniform(-int(rng.integers(0, 6)), 0, d)
    if seed % 4 == 0:  # values of several multiplicities, some nothing
        u, _ = np.linalg.qr(rng.normal(size=(d, d)))
        a = np.diag(rng.choice([0.0, 1.0, 1.0 + 1e-9, 2.0], d)) @ u
    r = np.linalg.qr(a, mode="r")
    diagonal, above, right = whitening.bidiagonal(r)
    s = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(whitening.squares_of_singular_values(diagonal, above) - s).max() <= 1e-12 * max(s[0], 1e-300)
    values, found, trace = whitening.greatest(diagonal, above, 8)
    assert len(values) == min(8, int((s > 1e-22 * s[0]).sum())) and trace == pytest.approx(s.sum())
    v = np.array([whitening.carried_back(z, right) for z in found.T]).T.reshape(d, len(values))
    white = (r @ v).T @ (r @ v) / np.sqrt(np.outer(values, values))
    assert np.abs(v.T @ v - np.eye(len(values))).max(initial=0) < 1e-12 and np.abs(white - np.eye(len(values))).max(initial=0) < 1e-6


def test_usable(spark):
    rows = spark.createDataFrame([(v,) for _, v, _ in ODD] + [([1.0],)], "v array<float>")
    kept, width = vectors.kept(rows, "v", 4096.0)
    assert (sorted(len(r["v"]) for r in kept.collect()), width) in (([2], 2), ([1], 1))
