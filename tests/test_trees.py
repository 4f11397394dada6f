"""Trees of any depth against plain Python."""

import random

import pytest

from gridweave.operators import trees


def table(spark, parents, extra=1):
    return spark.createDataFrame([(n, p, extra) for n, p in parents.items()], "node long, parent long, v long")


def path(parents, n):
    out = [n]
    while parents.get(out[-1]) in parents and parents[out[-1]] is not None:
        out.append(parents[out[-1]])
    return out


def test_random_forest(spark):
    rng = random.Random(4)
    parents = {i: (rng.randrange(max(0, i - 3), i) if i and rng.random() < 0.97 else None) for i in range(300)}
    parents[300] = 999  # not a node
    t = table(spark, parents)
    paths = {n: path(parents, n) for n in parents}
    assert {r.node: (r.root, r.depth) for r in trees.roots(t).collect()} == {n: (p[-1], len(p) - 1) for n, p in paths.items()}
    totals = dict.fromkeys(parents, 0)
    for p in paths.values():
        for n in p:
            totals[n] += 1
    assert {r.node: r.total for r in trees.subtree_sums(t, "v").collect()} == totals
    assert {(r.node, r.ancestor, r.steps) for r in trees.ancestors(t).collect()} == {(n, a, k) for n, p in paths.items() for k, a in enumerate(p)}


@pytest.mark.parametrize("n", [200, 5000])
def test_chain(spark, n):
    t = table(spark, {i: i - 1 if i else None for i in range(n)})
    assert trees.subtree_sums(t, "v").where("node = 0").first().total == n
    assert trees.roots(t).agg({"depth": "max"}).first()[0] == n - 1


def test_cycles_empty_tables_and_nulls(spark):
    loop = table(spark, {1: 2, 2: 3, 3: 1, 4: 1})
    for f in (trees.roots, trees.ancestors, lambda t: trees.subtree_sums(t, "v")):
        with pytest.raises(ValueError):
            f(loop)
    none = loop.where("false")
    assert trees.roots(none).count() == trees.subtree_sums(none, "v").count() == trees.ancestors(none).count() == 0
    t = spark.createDataFrame([(1, None, None), (2, 1, 5), (None, 1, 9)], "node long, parent long, v long")
    assert {r.node: r.total for r in trees.subtree_sums(t, "v").collect()} == {1: 5, 2: 5}
