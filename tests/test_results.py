"""The generated result: a query builds the tables that it reads, and no others; what stays within variants takes one shuffle."""

import datetime
import json
import os

import pytest

from gridweave.operators import storage
from gridweave.plans import order_queries, registry
from gridweave.sources import results

DATA = "/root/testdata/sf0.001"


def folder(tmp_path, *tables):
    for t in tables:
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_features_need_no_segments(spark, tmp_path):
    assert registry.QUERIES["check_geometry_kind"](spark, folder(tmp_path, "part")).count() > 0


def test_chambers_need_no_summaries(spark, tmp_path):
    at = folder(tmp_path, "lineitem")
    assert registry.QUERIES["check_chamber_cost"](spark, at).count() == registry.QUERIES["check_chamber_cost"](spark, DATA).count() > 0
    assert {name.rsplit("/", 1)[-1] for _, name in storage._kept if name.startswith(at)} == {"result-segments", "result-chambers"}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Line items with a variant of 10,100, one whose second segment is cut off, and one of a single segment."""
    at = tmp_path_factory.mktemp("hot")
    rows = [(v, n, n % 97, n % 13, datetime.datetime(1995, 1, 1)) for v, many in ((3, 10_100), (10, 600), (4, 5), (5, 1), (89, 6)) for n in range(many)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz")
    df.write.parquet(f"{at}/lineitem.parquet")
    by = {}
    for r in results.segments(spark, str(at)).collect():
        by.setdefault(r.variant, {})[r.i] = r
    return str(at), by


@pytest.mark.parametrize("name", ["dep_chains", "win_long_profile", "prj_renumber", "snk_feature_properties"])
def test_work_within_variants_takes_one_shuffle(spark, hot, name):
    plan = getattr(order_queries, name)(spark, hot[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_trunks_chains_and_names_of_large_variants(spark, hot):
    at, by = hot
    trunk, chains, names = [], [], []
    for v, s in by.items():
        below, node, station = {}, 0, 0
        for r in s.values():
            below.setdefault(r.a, []).append(r)
        while node in below:
            r = min(below[node], key=lambda r: (-r.flow, r.b))
            node, station = r.b, station + r.length
            trunk.append((v, node, station))
        tops = {}
        for i in sorted(s):
            tops[i] = tops[s[i].a] if 1 <= s[i].a <= 499 and len(below[s[i].a]) == 1 else i
        chains += [(v, t, sum(x == t for x in tops.values()), sum(s[i].length for i in s if tops[i] == t)) for t in set(tops.values())] if len(s) < 1000 else []
        nodes = sorted({n for r in s.values() for n in (r.a, r.b)})
        kind = {n: "tie" if n == 0 else "ch" if len(below.get(n, [])) >= 2 else "tn" for n in nodes}
        label = {n: f"{k}_v{v}_{1 + place}" for k in ("tie", "ch", "tn") for place, n in enumerate(n for n in nodes if kind[n] == k)}
        names += [(v, f"new_v{v}_{i}", label[r.a], label[r.b]) for i, r in s.items()]
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(order_queries.win_long_profile(spark, at)) == sorted(trunk)
    assert got(order_queries.dep_chains(spark, at).where("variant <> 3")) == sorted(chains)
    assert got(order_queries.prj_renumber(spark, at)) == sorted(names)
    props = {(r.variant, r.i): json.loads(r.properties) for r in order_queries.snk_feature_properties(spark, at).collect()}
    assert {(v, p["id"], p["start_node_id"], p["end_node_id"]) for (v, _), p in props.items()} == set(names)
    assert all(p["cost"] == by[k[0]][k[1]].cost and p["flow_tph"] == by[k[0]][k[1]].flow for k, p in props.items())


def test_segments_lie_in_more_tasks_as_the_table_grows(spark, hot, monkeypatch):
    monkeypatch.setattr(results, "PER_TASK", 500)
    assert results.segments(spark, hot[0]).rdd.getNumPartitions() == 10_712 // 500
