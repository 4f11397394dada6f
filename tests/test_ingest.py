"""A scene from features with gaps."""

import json

import pytest

from gridweave.operators import ingest
from gridweave.sources import geojson


def feature(kind, geometry, at, **props):
    return {"type": "Feature", "properties": {"object_type": kind, **props}, "geometry": geometry and {"type": geometry, "coordinates": at}}


FEATURES = [
    feature("source", "LineString", [[0, 0], [1, 1]], id=90),
    feature("source", "Point", [5, 5], id=91),
    feature("source", "Point", [6, 6], id=92),
    feature("heat_network", "MultiLineString", [[[0, 0], [10, 0]], [[10, 0], [20, 0]]], id="n", diameter=400),
    feature("heat_network", "LineString", [[20, 0], [20, 9]], id="m"),
    feature("heat_network", "Point", [20, 0], id="bad", diameter=123),
    feature("heat_chamber", "Point", [10.2, 0], id="c1"),
    feature("heat_chamber", "LineString", [[20, 0], [3, 3]], id="c2", diameter=200),
    feature("heat_chamber", None, None, id="c3"),
    feature("oks_future", "Polygon", [[[1, 1], [2, 1], [2, 2], [1, 1]]], id="b1", flow_tph=7),
    feature("oks_future", "Polygon", [[[3, 1], [4, 1], [4, 2], [3, 1]]], id="b2"),
    feature("oks_connection_point", "Point", [1.5, 1], id="p2", oks_id="b1", flow_tph=99),
    feature("oks_connection_point", "Point", [1.2, 1], id="p1", oks_id="b1"),
    feature("oks_connection_point", "Point", [8, 8], id=4, flow_tph="3,5"),
    feature("restriction", "Point", [7, 7], restriction_type="River"),
    feature("restriction", "Point", [7, 7], id="r2", restriction_type="swamp"),
    feature("oks_existing", "Polygon", [[[3, 1], [4, 1], [4, 2], [3, 1]]], id="e"),
    feature("quarry", None, None),
]


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    return geojson.read_collection(spark, str(path)).cache()


def rows(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys).collect())


def test_network(features):
    assert rows(ingest.source(features), "id", "x", "y") == [("91", 5.0, 5.0)]
    s = ingest.segments(features)
    assert rows(s, "id", "dn") == [("m", 50), ("n#1", 400), ("n#2", 400)]
    c = ingest.chambers(features)
    assert rows(c, "id", "dn", "x") == [("c1", 0, 10.2), ("c2", 200, 20.0)]
    assert rows(ingest.chambers_with_network(c, s, 0.5), "id", "dn", "inferred", "degree") == [("c1", 400, True, 2), ("c2", 200, False, 2)]


def test_terminals(features):
    assert rows(ingest.terminals(features), "id", "x", "flow", "origin", "id_is_text") == [("4", 8.0, 3.5, "point", False), ("b1", 1.2, 7.0, "building", True), ("b2", 3.0, 0.0, "outline", True)]


def test_restrictions(features):
    got = {r.id: (r.kind, r.rule, r.unknown) for r in ingest.restrictions(features).collect()}
    assert got["restriction:auto:14"] == ("water", "FORBIDDEN", False) and got["r2"] == ("swamp", "FORBIDDEN", True)
    assert got["e"][0] == "oks_existing" and got["existing-net:n"] == ("heat_network", "SPECIAL_CROSSING", False)


def test_diagnostics(features, spark):
    got = {r.code: (r.severity, r.n, r.ids) for r in ingest.diagnostics(features).collect()}
    assert got["segment.noDiameter"] == ("WARNING", 1, ["m"])
    assert got["segment.nonTableDiameter"] == ("WARNING", 1, ["bad"])
    assert got["input.unknownType"] == ("WARNING", 1, ["quarry:auto:17"])
    assert got["source.geometry"][1:] == (1, ["90"]) and got["source.multiple"][1] == 3
    assert got["chamber.geometry"][2] == ["c2", "c3"] and got["restriction.unknownType"][2] == ["r2"]
    none = ingest.diagnostics(features.limit(0))
    assert {r.code for r in none.collect()} == {"scene.noSource", "scene.noNetwork", "scene.noFutureOks"}


def test_upstream(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (4, 1), (8, 9)], "a long, b long")
    got = ingest.upstream(edges, spark.createDataFrame([(1,)], "node long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, None, 0), (2, 1, 1), (3, 2, 2), (4, 1, 1)]
