"""GeoJSON, the statement, streams and routes on small inputs."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.operators import routing
from gridweave.operators.storage import Workspace
from gridweave.plans import route_queries
from gridweave.sources import dimensions as D
from gridweave.sources import geojson, statement
from gridweave.streaming import features as stream

FEATURES = [
    {"type": "Feature", "properties": {"object_type": "Heat-Network", "id": 126, "diameter": 400, "nested": {"a": 1}, "tags": ["x", "y"]}, "geometry": {"type": "LineString", "coordinates": [[37.64, 55.7], [37.644, 55.7]]}},
    {"type": "Feature", "geometry": {"coordinates": [37.642, 55.7008], "type": "Point"}, "properties": {"object_type": "oks_connection_point", "id": "p-4", "flow_tph": "12,5"}},
    {"type": "Feature", "properties": {"object_type": "restriction", "id": 7.0}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
    {"type": "Feature", "properties": {"object_type": "variant_summary", "id": None}, "geometry": None},
    {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
]


def test_collection(spark, tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"name": "n", "features": FEATURES, "type": "FeatureCollection"}))
    df = geojson.read_collection(spark, str(path))
    assert geojson.check(df) == 5
    rows = df.orderBy("ordinal").collect()
    assert [r.object_type for r in rows] == ["heat_network", "oks_connection_point", "restriction", "variant_summary", None]
    assert [(r.id, r.id_is_text) for r in rows[:3]] == [("126", False), ("p-4", True), ("7", False)]
    assert "nested" not in rows[0].props and rows[0].props["tags"] == '["x","y"]'
    assert rows[2].geom.parts == [[[0, 0], [1, 0], [1, 1], [0, 0]]]  # closed
    assert rows[3].geom is None and len(rows[4].geom.parts) == 2
    assert df.where("ordinal = 1").select(geojson.number(F.col("props.flow_tph"))).first()[0] == 12.5
    assert {r.object_type for r in geojson.unknown_types(df, ["heat_network", "restriction"]).collect()} == {"oks_connection_point", "variant_summary", None}


@pytest.mark.parametrize("text", ['{"type": "FeatureCollection"}', '{"features": 3}', '{"features": [', '{"features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Blob", "coordinates": []}}]}'])
def test_broken_collections(spark, tmp_path, text):
    path = tmp_path / "bad.geojson"
    path.write_text(text)
    with pytest.raises(geojson.FormatError):
        geojson.check(geojson.read_collection(spark, str(path)))


def test_empty_collection(spark, tmp_path):
    path = tmp_path / "none.geojson"
    path.write_text('{"type": "FeatureCollection", "features": []}')
    assert geojson.check(geojson.read_collection(spark, str(path))) == 0


def test_lines_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(json.dumps(f) for f in FEATURES) + "\n\n")
    assert geojson.read_lines(spark, str(tmp_path / "in")).count() == 15
    for _ in range(2):  # the second run finds nothing new
        stream.store(stream.read(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
    q = stream.counts(stream.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.object_type: r.n for r in spark.table("counted").collect()}["restriction"] == 3


def test_written_collection_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 37.64000004, 55.7, None), (1, "b", 0.5, -1.25, 3.0)], "ordinal long, id string, lon double, lat double, depth double")
    text = geojson.to_feature(F.struct("id", "depth"), F.lit("Point"), geojson.degrees(F.col("lon"), F.col("lat")))
    assert geojson.write_collection(df.select("ordinal", text.alias("text")), str(tmp_path / "o.geojson")) == 2
    back = json.loads((tmp_path / "o.geojson").read_text())
    assert [f["geometry"]["coordinates"] for f in back["features"]] == [[37.64, 55.7], [0.5, -1.25]]
    assert back["features"][0]["properties"] == {"id": "a", "depth": None}


def test_statement(spark, tmp_path):
    s = spark.createDataFrame([(200, 100.0, 12e6), (125, 50.0, 5e6)], "dn int, length double, cost double")
    c = spark.createDataFrame([(1, "ch;1", 200, 3, 3e6)], "ordinal long, id string, dn int, degree int, cost double")
    t = spark.createDataFrame([(5e6,)], "cost double")
    path = tmp_path / "s.csv"
    statement.write(str(path), [("Описание", "a; b")], [(*statement.CHAMBERS, statement.chamber_rows(c)), (*statement.BY_DIAMETER, statement.diameter_rows(s)), (*statement.TOTALS, statement.total_rows(s, c, t))])
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    lines = raw.decode("utf-8-sig").split("\r\n")
    for wanted in ['Описание;"a; b"', '1;"ch;1";200;3;3000000', "125;50,0;5000000", "Новые участки сети;2;150,0;17000000", "Новые тепловые камеры;1;;3000000", "Врезки в существующие камеры;1;;5000000", "ВСЕГО;;150,0;25000000"]:
        assert wanted in lines


def brute_shortest(weights, a, b):
    inner = [v for v in range(len(weights)) if v not in (a, b)]
    paths = [[a, *mid, b] for n in range(len(inner) + 1) for mid in itertools.permutations(inner, n)]
    return min(sum(weights[u, v] for u, v in itertools.pairwise(p)) for p in paths)


def test_shortest_paths_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        w = rng.uniform(1, 9, (6, 6))
        w = np.minimum(w, w.T)
        w[rng.uniform(size=(6, 6)) < 0.3] = np.inf
        w = np.maximum(w, w.T)
        distance, _ = routing.shortest(lambda v, w=w: [(u, w[v, u]) for u in range(6) if np.isfinite(w[v, u])], [0], set())
        for v in range(1, 6):
            assert np.isclose(distance.get(v, np.inf), brute_shortest(w, 0, v)) or v not in distance and brute_shortest(w, 0, v) == np.inf


def test_sight_in_circles_is_sight_over_all_boxes():
    rng = np.random.default_rng(7)
    for n, side in ((3, 900), (60, 900), (400, 300)):
        low = rng.integers(0, side, (n, 2)).astype(float)
        boxes = np.concatenate([low, low + rng.integers(5, 25, (n, 2))], axis=1)
        points = np.concatenate([boxes[:, [0, 1]], boxes[:, [2, 3]], boxes[:, [0, 3]], rng.uniform(0, side, (20, 2))])
        for v in rng.integers(0, len(points), 25):
            want = np.flatnonzero(routing.visible(np.broadcast_to(points[v], points.shape), points, boxes))
            assert sorted(routing.sees(points[v], points, boxes).tolist()) == want.tolist()


def test_sight_near_the_rim_stays_near(monkeypatch):
    rng = np.random.default_rng(8)
    low = rng.integers(0, 2000, (900, 2)).astype(float)
    boxes = np.concatenate([[[4.0, 935.0, 6.0, 1065.0], [-2.0, 1060.0, 5.0, 1062.0], [-2.0, 938.0, 5.0, 940.0]], np.concatenate([low + [10, 0], low + [30, 20]], axis=1)])
    points = np.concatenate([[[0.0, 1000.0], [0.0, 1050.0]], rng.uniform(0, 2000, (1500, 2)) + [10, 0]])
    looked, visible = [], routing.visible
    monkeypatch.setattr(routing, "visible", lambda a, b, some: looked.append(len(a)) or visible(a, b, some))
    assert [u for u, _ in routing.Sight(points, boxes)(0)] == [1]
    assert sum(looked) < 100  # all else lies behind three boxes, and beyond the rim there's nothing
    for v in rng.integers(0, len(points), 20):
        want = np.flatnonzero(visible(np.broadcast_to(points[v], points.shape), points, boxes))
        assert sorted(u for u, _ in routing.Sight(points, boxes)(v)) == [u for u in want.tolist() if u != v]


def test_first_searches_serve_every_plan_of_a_district():
    rng = np.random.default_rng(9)
    points = rng.uniform(0, 100, (40, 2))
    w = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    near = lambda v: [(u, w[v, u]) for u in range(40) if u != v and w[v, u] < 35]
    started: dict = {}
    routing.grow(near, [0, 1], list(range(2, 16)), started=started)
    for t in range(2, 16):
        rest = [u for u in range(2, 16) if u != t]
        without = routing.grow(near, [0, 1], rest, started=started, absent=[t])
        assert without == routing.grow(near, [0, 1], rest, absent=[t]) and t not in without and t not in without.values()


def test_growing_keeps_paths_or_seeks_them_anew_alike():
    rng = np.random.default_rng(9)
    points = rng.uniform(0, 100, (40, 2))
    w = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    near = lambda v: [(u, w[v, u]) for u in range(40) if u != v and w[v, u] < 35]
    roots, ends = [0, 1], list(range(2, 16))
    got = routing.grow(near, roots, ends)
    parent, degree, left = {0: -1, 1: -1}, {0: 2, 1: 2}, set(ends)
    while left:  # a fresh search for every terminal
        open_ = [v for v in parent if v not in ends and degree.get(v, 0) < 4]
        distance, back = routing.shortest(near, open_, set(ends) | (set(parent) - set(open_)))
        best = min(left, key=lambda t: (distance.get(t, np.inf), t))
        if best not in distance:
            break
        v = best
        while v not in parent:
            parent[v] = back[v]
            degree[back[v]], degree[v] = degree.get(back[v], 0) + 1, degree.get(v, 0) + 1
            v = back[v]
        left.discard(best)
    assert got == parent and max(degree.values()) <= 4


def test_sight_against_samples():
    rng = np.random.default_rng(5)
    boxes = np.array([[2.0, 2.0, 5.0, 6.0], [7.0, 1.0, 8.0, 9.0]])
    a, b = rng.uniform(0, 10, (300, 2)), rng.uniform(0, 10, (300, 2))
    p = a[:, None] + np.linspace(0, 1, 2001)[None, :, None] * (b - a)[:, None]
    enters = np.zeros(300, bool)
    for x0, y0, x1, y1 in boxes:
        enters |= ((p[..., 0] > x0) & (p[..., 0] < x1) & (p[..., 1] > y0) & (p[..., 1] < y1)).any(axis=1)
    assert (routing.visible(a, b, boxes) <= ~enters).all()
    assert (routing.visible(a, b, boxes) == ~enters).mean() > 0.98  # samples miss the shortest cuts
    assert routing.visible(np.array([[2.0, 0.0]]), np.array([[2.0, 9.0]]), boxes).all()  # along a side


def test_plan(spark):
    rows = [(d, "tie", 1, 0.0, 0.0, None, None, None) for d in (1, 2)]
    rows += [(1, "terminal", 1, 100.0, 0.0, None, None, 12.5), (1, "terminal", 2, 100.0, 60.0, None, None, 30.0), (1, "box", 1, 40.0, -20.0, 60.0, 30.0, None)]
    rows += [(2, "terminal", 9, 50.0, 50.0, None, None, 8.0), (2, "box", 1, 30.0, 30.0, 70.0, 70.0, None)]  # shut in
    df = spark.createDataFrame(rows, "district long, kind string, id long, x double, y double, x1 double, y1 double, flow double")
    routes = routing.plan(df)
    got = routes.toPandas()
    assert set(got.district) == {1}
    assert routing.unconnected(df, routes).collect()[0].penalty == 104_000_000
    price = {r[0]: r[3] for r in D.DIAMETERS}
    for r in got.itertuples():
        assert np.isclose(np.hypot(r.x1 - r.x0, r.y1 - r.y0), r.length, atol=0.01)
        assert {d[0]: d[1] for d in D.DIAMETERS}[r.dn] >= r.flow and abs(r.cost - r.length * price[r.dn]) < 0.006 * price[r.dn]
    assert np.isclose(got[got.from_node == "tie:1"].flow.sum(), 42.5)
    adds = {r.terminal: r.adds_cost for r in routing.sensitivity(df).collect()}
    assert set(adds) == {1, 2, 9} and adds[9] == 0
    for left in (1, 2):
        rest = routing.plan(df.where(f"district = 1 AND NOT (kind = 'terminal' AND id = {left})")).agg(F.sum("cost")).first()[0]
        assert np.isclose(adds[left], got.cost.sum() - rest)


def test_diameters_never_fall_and_runs_keep_limits():
    parent = {0: -1, **{i: i - 1 for i in range(1, 8)}}
    flows, lengths = {7: 3.0, 3: 3.0}, {i: 100.0 for i in range(1, 8)}
    total, dn = routing.sizes(parent, flows, lengths)
    assert total[1] == 6.0
    chain = [dn[i] for i in range(1, 8)]
    assert chain == sorted(chain, reverse=True)
    limit = {r[0]: r[2] for r in D.DIAMETERS}
    for d in set(chain):
        assert sum(100 for c in chain if c == d) <= limit[d]


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_collections_in_parts(spark, tmp_path):
    texts = [(i // 2, f'{{"type":"Feature","geometry":null,"properties":{{"n":{i // 3}}}}}') for i in range(400)] + [(0, '{"type":"Feature","geometry":null,"properties":{"n":0}}')] * 3
    for name, rows in (("many", texts), ("one", texts[:1]), ("none", [])):
        features = spark.createDataFrame(rows, "ordinal long, text string").repartition(7)
        geojson.write_collection_parts(features, str(tmp_path / name))
        found = json.loads(joined(tmp_path / name))
        assert found["type"] == "FeatureCollection" and [f["properties"]["n"] for f in found["features"]] == [json.loads(t)["properties"]["n"] for _, t in sorted(rows)]


def test_statement_in_parts(spark, tmp_path):
    c = spark.createDataFrame([(i, f"ch;{i}", 100, 3, 3e6) for i in range(50, 0, -1)], "ordinal long, id string, dn int, degree int, cost double")
    s = spark.createDataFrame([(80, 10.25, 5.0), (50, 1.0, 7.0), (80, 2.0, 1.0)], "dn int, length double, cost double")
    sections = [(*statement.CHAMBERS, statement.chamber_rows(c)), (*statement.BY_DIAMETER, statement.diameter_rows(s)), (*statement.TOTALS, statement.total_rows(s, c, c.limit(0)))]
    statement.write(str(tmp_path / "whole.csv"), [("Описание", "a; b")], sections)
    statement.write_parts(str(tmp_path / "parts"), [("Описание", "a; b")], sections)
    assert joined(tmp_path / "parts") == (tmp_path / "whole.csv").read_bytes()


def test_runs_rise_as_a_whole():
    for n, length, flow, want in ((5, 100.0, 3.0, [125] * 5), (3, 100.0, 3.0, [80] * 3), (1, 100.0, 3.0, [50]), (2, 8000.0, 3.0, [1400] * 2)):
        parent = {0: -1, **{i: i - 1 for i in range(1, n + 1)}}
        _, dn = routing.sizes(parent, {n: flow}, {i: length for i in range(1, n + 1)})
        assert [dn[i] for i in range(1, n + 1)] == want
    # A branch keeps its size where only the trunk's run with the other branch is too long.
    parent = {0: -1, 1: 0, 2: 1, 3: 1}
    _, dn = routing.sizes(parent, {2: 1.0, 3: 1.0}, {1: 100.0, 2: 100.0, 3: 50.0})
    assert dn == {1: 65, 2: 65, 3: 50}


def test_corner_names_are_one_point():
    columns = ["district", "kind", "id", "x", "y", "x1", "y1", "flow"]
    one = pd.DataFrame([(1, "box", 5, 0.0, 0.0, 4.0, 4.0, None), (1, "box", 9, 10.0, 0.0, 14.0, 4.0, None)], columns=columns)
    two = pd.DataFrame([(2, "box", 9, 10.0, 0.0, 14.0, 4.0, None)], columns=columns)
    places = lambda d: {n: tuple(p) for n, p in zip(d.names, d.points, strict=True)}
    a, b = places(routing.district(one)), places(routing.district(two))
    assert len(a) == 8 and len(b) == 4 and all(a[n] == p for n, p in b.items())


def test_wider_districts():
    rows = [("square", 0, 0.0, 0.0, 50.0, 50.0, None), ("terminal", 1, 10.0, 10.0, None, None, 2.0), ("terminal", 2, 30.0, 30.0, None, None, 2.0), ("box", 1, 20.0, 20.0, 40.0, 40.0, None)]
    columns = ["kind", "id", "x", "y", "x1", "y1", "flow"]
    alone = pd.DataFrame(rows, columns=columns).assign(district=1)
    assert routing.attempt_district(alone).waits.tolist() == [1]  # 2 is shut in, so no wider district helps it
    wall = [("box", 2, 60.0, -10.0, 70.0, 90.0, None), ("tie", 7, 90.0, 10.0, None, None, 1.0)]
    wide = pd.DataFrame([("square", 0, 0.0, 0.0, 100.0, 100.0, None), *rows[1:], *wall], columns=columns).assign(district=2)
    got = routing.attempt_district(wide)
    assert got.waits.dropna().empty and "terminal:1" in set(got.to_node)
    assert ((got.x0 >= 0) & (got.x0 <= 100) & (got.y0 >= 0) & (got.y0 <= 100)).all() and not (got.y1 < 0).any()  # around the wall's end inside
    twice = routing.district(wide.assign(flow=wide.flow.where(wide.kind != "tie", 2.0)))
    assert routing.routes(twice, twice.terminals) == []  # the tie-in point has its branches already


def test_every_terminal_is_tried_to_the_search_radius(spark):
    small = "/root/testdata/sf0.001"
    found = route_queries.attempts(spark, small)
    reached = {r["to_node"] for _, f in found for r in f.where("to_node LIKE 'terminal:%'").collect()}
    assert len(reached) > 100  # 119 of 150 have a tie-in point within 1200 m
    boxes = route_queries.districts(spark, small, 1).where("kind = 'box'").groupBy("id").count()
    assert boxes.where("count > 1").count() > 0  # boxes across a border are in all districts they touch


def test_no_ends_no_routes():
    empty = pd.DataFrame({"district": [4], "kind": ["box"], "id": [1], "x": [0.0], "y": [0.0], "x1": [1.0], "y1": [1.0], "flow": [None]})
    assert routing.plan_district(empty).empty


def test_boxes_behind_boxes_are_left_out_of_districts(spark, tmp_path):
    at = str(tmp_path)
    spark.range(4000).selectExpr("id AS c_custkey").write.parquet(f"{at}/customer.parquet")
    spark.range(40).selectExpr("id AS s_suppkey").write.parquet(f"{at}/supplier.parquet")
    spark.range(200_000).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").write.parquet(f"{at}/part.parquet")
    shown = route_queries.in_the_open(spark, at, Workspace(spark, "test-open"))
    assert shown.boxes.count() < 100_000 and 0 < shown.terminals.count() < 400
    tried = lambda df: sorted(str(r) for r in routing.attempt(df).collect())
    assert tried(route_queries.districts(spark, at, 0, shown=shown)) == tried(route_queries.districts(spark, at, 0))
