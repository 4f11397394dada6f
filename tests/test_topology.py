"""Nodes, nearest links and the way to the source, against plain Python."""

import math
import random

import pytest

from gridweave.operators import ingest, topology
from tests.test_ingest import feature


def at(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    square = d[0] ** 2 + d[1] ** 2
    t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / square)) if square else 0
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def apart(s, l):
    a, b, c, d = s[:2], s[2:], l[:2], l[2:]
    if turn(c, d, a) * turn(c, d, b) < 0 and turn(a, b, c) * turn(a, b, d) < 0:
        return 0.0
    return min(at(a, c, d), at(b, c, d), at(c, a, b), at(d, a, b))


@pytest.mark.parametrize("within", [None, 30.0])
def test_nearest_links(spark, within):
    r = random.Random(5)
    link = lambda size: [x := r.uniform(-500, 500), y := r.uniform(-500, 500), x + r.uniform(-size, size), y + r.uniform(-size, size)]
    shapes = [(n % 40, *link(20)) for n in range(60)] + [(50, 9000.0, 9000.0, 9000.0, 9000.0)]
    net = [link(60) for _ in range(50)] + [[0.0, 0.0, 400.0, 380.0]]
    got = topology.nearest_links(spark.createDataFrame(shapes, "k int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(net, "x0 double, y0 double, x1 double, y1 double"), "k", within).collect()
    want = {}
    for k, *s in shapes:
        want[k] = min([want.get(k, math.inf), *(apart(s, l) for l in net)])
    want = {k: d for k, d in want.items() if within is None or d <= within}
    assert {r.k for r in got} == set(want) and len(got) == len(want)
    for row in got:
        assert row.d == pytest.approx(want[row.k])
        assert min(at((row.x, row.y), l[:2], l[2:]) for l in net) == pytest.approx(row.d, abs=1e-9)
        assert min(at((row.x, row.y), s[:2], s[2:]) for k, *s in shapes if k == row.k) == pytest.approx(0, abs=1e-9)


def test_nearest_links_where_links_lie_densely(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    r = random.Random(8)
    net = [[x := r.uniform(0, 1000), y := r.uniform(0, 1000), x + r.uniform(-150, 150), y + r.uniform(-150, 150)] for _ in range(6000)]
    spots = [(n, x := r.uniform(0, 1000), y := r.uniform(0, 1000), x, y) for n in range(300)]
    pairs, real = spark.sparkContext.accumulator(0), topology._meeting.func

    @F.pandas_udf("d double, x double, y double")
    def counted(*columns: pd.Series) -> pd.DataFrame:
        pairs.add(len(columns[0]))
        return real(*columns)

    monkeypatch.setattr(topology, "_meeting", counted)
    got = {r.k: r.d for r in topology.nearest_links(spark.createDataFrame(spots, "k int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(net, "x0 double, y0 double, x1 double, y1 double"), "k").collect()}
    a, b = np.array(net)[:, :2], np.array(net)[:, 2:]
    for k, x, y, *_ in spots:
        t = np.clip((([x, y] - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)[:, None]
        assert got[k] == pytest.approx(np.hypot(*([x, y] - a - t * (b - a)).T).min())
    assert pairs.value < 60 * len(spots)


def test_nearest_links_of_nothing(spark):
    none = spark.createDataFrame([], "k int, x0 double, y0 double, x1 double, y1 double")
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], none.schema)
    assert topology.nearest_links(some, none, "k").count() == 0 and topology.nearest_links(none, some, "k").count() == 0


def test_components(spark):
    r = random.Random(2)
    pairs = [(99, n) for n in range(30)] + [(n, n + 1) for n in range(40, 70)] + [(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(25)]
    root = {n: n for n in range(150)}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = topology.components(spark.createDataFrame([(n,) for n in range(150)], "node int"), spark.createDataFrame(pairs, "a int, b int"))
    assert {r.node: r.root for r in got.collect()} == root


LINES = {"s1": [[0, 0], [10, 0]], "s2": [[10.3, 0.2], [20, 0]], "s3": [[10.1, 0.4], [10, 30]], "s4": [[20, 0.3], [20, 9]], "far": [[500, 500], [510, 500]], "dot": [[7, 7]]}


def scene(spark, **stated):
    items = [feature("heat_network", "LineString", p, id=k, **stated) for k, p in LINES.items()]
    items += [feature("heat_chamber", "Point", p, id=k, **stated) for k, p in {"c1": [10.2, 0.1], "c2": [20, 0.1], "off": [5, 0], "lost": [300, 0]}.items()]
    return items + [feature("source", "Point", [-3, 0], id="src")]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    import json

    from gridweave.sources import splitting

    def go(items):
        path = tmp_path_factory.mktemp("in") / "f.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": items}))
        return splitting.read(spark, str(path))

    return go


def test_network(spark, read):
    nodes, edges, way = ingest.network(read(scene(spark)), 0.5)
    got = {r.id: (r.a, r.b) for r in edges.collect()}
    assert got == {"s1": ("s1|a", "s1|b"), "s2": ("s1|b", "s2|b"), "s3": ("s1|b", "s3|b"), "s4": ("s2|b", "s4|b"), "far": ("far|a", "far|b")}
    assert {r.node: (r.x, r.y) for r in nodes.collect()}["s1|b"] == (10.0, 0.0)
    next_to = {r.id: (r.upstream, r.inferred) for r in way.collect()}
    assert next_to["s1"] == ("src", True) and next_to["s2"] == next_to["s3"] == ("c1", True) and next_to["c1"] == ("s1", True)
    assert next_to["s4"] == ("c2", True) and next_to["c2"] == ("s2", True)
    assert next_to["far"] == next_to["off"] == next_to["lost"] == (None, False)


def test_stated_way_is_kept(spark, read):
    _, _, way = ingest.network(read(scene(spark, upstream_object_id="z")), 0.5)
    assert {(r.upstream, r.inferred) for r in way.collect()} == {("z", False)}


def test_transit_chamber(spark, read):
    f = read(scene(spark))
    got = {r.id: r.degree for r in ingest.chambers_with_network(ingest.chambers(f), ingest.segments(f), 0.5).collect()}
    assert got == {"c1": 3, "c2": 2, "off": 2, "lost": 0}


def test_terminals_look_at_the_network(spark, read):
    square = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]
    items = [
        feature("oks_future", "Polygon", square(2, 5, 4), id="b1"),
        feature("oks_connection_point", "Point", [3, 9], id="p1", oks_id="b1", flow_tph=9),
        feature("oks_connection_point", "Point", [3, 5], id="p2", oks_id="b1"),
        feature("oks_future", "Polygon", [[[14, 40], [13, 2], [17, 40], [14, 40]]], id="b2", flow_tph=3),
        feature("oks_connection_point", "Point", [101, 101], id="p3", flow_tph=4),
        feature("oks_connection_point", "Point", [110, 101], id="p4"),
        feature("restriction", "Polygon", square(100, 100, 20), id="block", restriction_type="water"),
        feature("restriction", "Polygon", square(100, 100, 3), id="house", restriction_type="water"),
        feature("restriction", "Polygon", [*square(100, 95, 30), square(108, 99, 5)[0]], id="holed", restriction_type="water"),
    ]
    f = read(scene(spark) + items)
    t = ingest.terminals(f)
    assert sorted((r.id, r.x, r.y, r.flow) for r in t.collect()) == [("b1", 3.0, 5.0, 0.0), ("b2", 13.0, 2.0, 3.0), ("p3", 101.0, 101.0, 4.0), ("p4", 110.0, 101.0, 0.0)]
    got = {r.terminal: r.restriction for r in ingest.own_footprints(t, ingest.restrictions(f), 25.0).collect()}
    assert got == {"p3": "house", "p4": "block"}


def test_footprint_among_many_that_hold_a_terminal(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gridweave.operators import spatial

    r = random.Random(3)
    shapes = []
    for n in range(400):
        x, y, w = r.randint(0, 60), r.randint(0, 60), r.randint(60, 120)
        shapes.append((n, [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]))
    # One with a hole, and one whose box is the smallest but which holds a corner of it only.
    shapes += [(900, [[[40, 40], [95, 40], [95, 95], [40, 95], [40, 40]], [[60, 60], [80, 60], [80, 80], [60, 80], [60, 60]]]), (901, [[[50, 50], [90, 50], [50, 90], [50, 50]]])]
    frame = spark.createDataFrame([(n, "FORBIDDEN", ("Polygon", [[[float(v) for v in p] for p in ring] for ring in rings])) for n, rings in shapes], "id long, rule string, geom struct<type: string, parts: array<array<array<double>>>>")
    spots = [(n, r.uniform(0, 180), r.uniform(0, 180), "point") for n in range(300)]
    kept, real = [], spatial.without_hidden
    monkeypatch.setattr(spatial, "without_hidden", lambda *a: kept.append(real(*a)) or kept[-1])
    got = {r.terminal: r.restriction for r in ingest.own_footprints(spark.createDataFrame(spots, "id long, x double, y double, origin string"), frame, 2500.0).collect()}

    def holds(rings, x, y):
        return sum((p[1] <= y) != (q[1] <= y) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for ring in rings for p, q in zip(ring, ring[1:])) % 2 == 1

    area = lambda rings: abs(sum(p[0] * q[1] - q[0] * p[1] for ring in rings for p, q in zip(ring, ring[1:])))
    want = {n: min(held)[1] for n, x, y, _ in spots if (held := [(area(rings), k) for k, rings in shapes if holds(rings, x, y)])}
    assert got == want
    # In the middle, which all but a few hold, hardly any are left to look at.
    assert kept[0].groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] <= 400 / 10


def test_ends_of_crowded_cells_are_stitched_as_all_pairs_say(spark):
    r = random.Random(5)
    rows = [(f"{k}", [[r.uniform(0, 60), r.uniform(0, 60)], [r.choice([100.0, 102.5, 105.0]), r.uniform(0, 9)]]) for k in range(160)]
    ends = [(f"{i}|{n}", *p) for i, ps in rows for n, p in zip("ab", ps, strict=True)]
    root = {e[0]: e[0] for e in ends}
    find = lambda n: n if root[n] == n else find(root[n])
    for a in ends:
        for b in ends:
            if math.hypot(a[1] - b[1], a[2] - b[2]) <= 3 and find(a[0]) != find(b[0]):
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    _, edges = topology.stitch(spark.createDataFrame(rows, "id string, points array<array<double>>"), 3.0)
    assert sorted(map(tuple, edges.select("id", "a", "b").collect())) == sorted((i, find(f"{i}|a"), find(f"{i}|b")) for i, _ in rows)


def test_places_go_only_to_cells_within_reach(spark):
    w = 3.0 / 2**0.5
    places = spark.createDataFrame([(0, 0, 0.1 * w, 0.1 * w), (2, 2, 2.0 * w, 2.0 * w), (1, 0, 1.1 * w, 0.2 * w)], "cx long, cy long, x double, y double")
    assert [tuple(r) for r in topology._close_cells(places, w, 3.0).collect()] == [(1, 0, 0, 0)]


def test_chains_over_tiles_are_one_node_and_nothing_is_broadcast(spark):
    long = 3 * topology.TILE
    rows = [(f"{k:04d}", [[2.0 * k, 0.0], [2.0 * k, 5000.0 + 9.0 * k]]) for k in range(2 * long)]
    _, edges = topology.stitch(spark.createDataFrame(rows, "id string, points array<array<double>>"), 3.0)
    got = {r["id"]: (r["a"], r["b"]) for r in edges.collect()}
    assert len(got) == len(rows) and {a for a, _ in got.values()} == {"0000|a"} and {b for _, b in got.values()} == {f"{i}|b" for i, _ in rows}
    places = spark.range(100).selectExpr("double(id) x", "double(id) y", "id div 2 cx", "id div 2 cy")
    close = topology._close_cells(places, 2.0, 3.0)
    assert "BroadcastHashJoin" not in close._jdf.queryExecution().executedPlan().toString() and close.count() > 0
