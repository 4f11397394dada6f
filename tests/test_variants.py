"""From a file of features to ranked variants: the tables against plain recounts, all rules, and the features written."""

import json
import math
from collections import defaultdict

import pytest

from gridweave.operators import compliance
from gridweave.plans import variants
from gridweave.sources import dimensions as D
from gridweave.sources import geojson, results, splitting

LON, LAT = 37.6, 55.7


def deg(x, y):
    return [LON + x / (111320 * math.cos(math.radians(LAT))), LAT + y / 111320]


def feature(kind, geometry, at, **props):
    return {"type": "Feature", "properties": {"object_type": kind, **props}, "geometry": geometry and {"type": geometry, "coordinates": at}}


def box(x, y, w, h):
    return [[deg(*p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]


FEATURES = [
    feature("source", "Point", deg(0, 0), id="s"),
    feature("heat_network", "LineString", [deg(0, 0), deg(100, 0), deg(210, 0)], id="n|1", diameter=400),
    feature("heat_network", "LineString", [deg(210, 0), deg(210, 160)], id="n2", diameter=200),
    feature("heat_chamber", "Point", deg(210, 0), id="c1"),
    feature("heat_chamber", "Point", deg(60, 0), id="c2"),
    feature("oks_future", "Polygon", box(20, 60, 12, 12), id="a|b c", flow_tph=12),
    feature("oks_connection_point", "Point", deg(26, 59), id=1, oks_id="a|b c"),
    feature("oks_future", "Polygon", box(70, 90, 10, 10), id="b", flow_tph="3,5"),
    feature("oks_connection_point", "Point", deg(120, 80), id=7, flow_tph=30),
    feature("oks_connection_point", "Point", deg(150, 40), id=8, flow_tph=5),
    feature("oks_connection_point", "Point", deg(170, 120), id=9),
    feature("oks_connection_point", "Point", deg(106, 46), id="shut", flow_tph=2),
    feature("oks_existing", "Polygon", box(90, 25, 25, 18), id="e1"),
    feature("restriction", "Polygon", box(130, 60, 8, 40), id="r1", restriction_type="park"),
    feature("restriction", "LineString", [deg(40, 40), deg(75, 62)], id="r2", restriction_type="railway"),
    feature("restriction", "LineString", [deg(140, 10), deg(200, 130)], id="r3", restriction_type="road"),
    feature("restriction", None, None, id="r4", restriction_type="river"),
    feature("quarry", None, None),
]


@pytest.fixture(scope="module")
def planned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plan")
    (folder / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}))
    features = splitting.read(spark, str(folder / "in.geojson"))
    result, texts = variants.plan_features(features)
    geojson.write_collection(texts, str(folder / "out.geojson"))
    return result, json.loads((folder / "out.geojson").read_text())["features"]


def test_three_variants_keep_all_rules(planned):
    result, _ = planned
    found = {r["rule"]: (r["checks"], r["findings"]) for r in compliance.report(result).collect()}
    assert set(found) == set(compliance.RULES) and {k: v for k, v in found.items() if v[1]} == {}
    assert found["one_summary_per_variant"][0] == 3 and all(found[k][0] for k in ("network_connected", "chamber_degree", "diameter_capacity", "run_length_limit"))


def test_variants_differ_and_are_ranked_by_score(planned):
    result, _ = planned
    rows = sorted(result.summaries.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == [1, 2, 3] and [r["score"] for r in rows] == sorted(r["score"] for r in rows)
    lines = defaultdict(list)
    for r in result.segments.collect():
        lines[r["variant"]].append(r)
    shapes = {v: frozenset((round(r["xa"]), round(r["ya"]), round(r["xb"]), round(r["yb"])) for r in rs) for v, rs in lines.items()}
    assert len(set(shapes.values())) == 3
    roots = {r["variant"]: set() for r in rows}
    for r in result.ties.collect():
        roots[r["variant"]].add(r["node"])
    assert len(roots[1]) > 1 and len(roots[2]) < len(roots[1])
    price = {r[0]: r[3] for r in D.DIAMETERS}
    listed, pits = defaultdict(int), defaultdict(int)
    for p in result.points.collect():
        if p["listed"]:
            listed[p["variant"]] += D.PENALTY + D.PENALTY_PER_FLOW * p["flow"] / 100
    for c in result.chambers.collect():
        pits[c["variant"]] += c["cost"]
    for r in rows:
        pipes = sum(math.floor(s["geom"] / 100 * price[s["dn"]] + 0.5) for s in lines[r["variant"]])
        total = pipes + pits[r["variant"]] + r["tie_cost"] + listed[r["variant"]]
        metres = sum(s["geom"] for s in lines[r["variant"]]) / 100
        assert r["total"] == pytest.approx(total, abs=len(lines[r["variant"]]))
        assert r["score"] == pytest.approx(0.7 * total / 25_000_000 + 0.3 * metres / 100, abs=0.01)


def test_flow_arrives_and_every_terminal_is_a_point(planned):
    result, _ = planned
    points = result.points.collect()
    assert {p["id"] for p in points} == {"a|b c", "b", "7", "8", "9", "shut"} and len(points) == 18
    assert {p["id"] for p in points if p["listed"] and p["variant"] == 1} == {"shut"}  # within 5 m of an existing building
    into = defaultdict(int)
    ties = {(r["variant"], r["node"]) for r in result.ties.collect()}
    for s in result.segments.collect():
        if (s["variant"], s["a"]) in ties:
            into[s["variant"]] += s["flow"]
    for v in (1, 2, 3):
        assert into[v] == sum(p["flow"] for p in points if p["variant"] == v and not p["listed"])


def test_output_features(planned):
    result, out = planned
    kinds = defaultdict(list)
    for f in out:
        kinds[f["properties"]["object_type"]].append(f)
        assert list(f["properties"]) == results.ATTRIBUTES[f["properties"]["object_type"]]
    assert [f["properties"]["rank"] for f in kinds["variant_summary"]] == [1, 2, 3]
    order = [f["properties"]["variant_id"] for f in out]
    assert order == sorted(order, key=[f["properties"]["variant_id"] for f in kinds["variant_summary"]].index)  # by rank
    names = {f["properties"]["id"] for k in ("heat_chamber", "technical_node") for f in kinds[k]} | {p["id"] for p in result.points.collect()}
    for f in kinds["heat_network"]:
        p = f["properties"]
        assert p["end_node_id"] in names and (p["start_node_id"] in names or p["start_node_id"].startswith("tie_"))
        (x0, y0), (x1, y1) = f["geometry"]["coordinates"]
        metres = math.hypot((x1 - x0) * 111320 * math.cos(math.radians(LAT)), (y1 - y0) * 111320)
        assert p["length"] == pytest.approx(metres, rel=0.01, abs=0.1)
    assert len({f["properties"]["id"] for f in out}) == len(out)
    assert all("shut" in f["properties"]["unconnected_oks_ids"] for f in kinds["variant_summary"])


def test_nothing_to_plan_and_no_position(spark):
    features = lambda rows: geojson.decode(spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(rows)], "ordinal long, text string"))
    with pytest.raises(ValueError, match="position"):
        variants.plan_features(features([feature("quarry", None, None)]))
    result, texts = variants.plan_features(features(FEATURES[:1] + [FEATURES[8]]))  # no network: nothing can be reached
    assert [(r["variant"], r["penalty"], r["length"], r["rank"]) for r in result.summaries.collect()] == [(1, 115_000_000, 0, 1)]
    assert [json.loads(r["text"])["properties"]["unconnected_oks_ids"] for r in texts.collect()] == [["7"]]
