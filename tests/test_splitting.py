"""Collections read in splits, against Python's JSON parser."""

import json

import pytest
from pyspark.sql import functions as F

from gridweave.sources import geojson, splitting

TRICKY = ['plain', 'a } brace', '{ "features": [ {', 'quote " and \\ back', "\\", "é∑} 漢", "]}]", "", "line\nbreak"]


def feature(n):
    return {"type": "Feature", "properties": {"object_type": "Heat-Network", "id": n, "name": TRICKY[n % len(TRICKY)], "features": [{"x": n}]}, "geometry": {"type": "LineString", "coordinates": [[n, 0.5], [n, 1.5]]}}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("size", [150, 900, 100000])
@pytest.mark.parametrize("indent,bom,tail", [(None, False, ""), (2, True, "\n"), (None, True, " ")])
def test_splits_give_every_feature_once(spark, tmp_path, splits, size, indent, bom, tail):
    collection = {"crs": {"features": [{"no": 1}]}, "list": [{"no": 2}], "features": [feature(n) for n in range(25)], "type": "FeatureCollection", "after": {"a": {}}}
    text = json.dumps(collection, indent=indent, ensure_ascii=False) + tail
    path = tmp_path / "in.geojson"
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    splits(size)
    rows = splitting.read(spark, str(path)).orderBy("ordinal").collect()
    assert [r.id for r in rows] == [str(n) for n in range(25)]
    assert [r.props["name"] for r in rows] == [TRICKY[n % len(TRICKY)] for n in range(25)]
    assert [r.geom.parts for r in rows] == [[[[float(n), 0.5], [float(n), 1.5]]] for n in range(25)]
    data = text.encode()
    for r in rows:  # the ordinal is the byte of the feature
        assert json.JSONDecoder().raw_decode(data[r.ordinal :].decode())[0]["properties"]["id"] == int(r.id)


def test_same_features_as_one_task(spark, tmp_path, splits):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(n) for n in range(40)] + [{"type": "Feature", "properties": None, "geometry": None}]}))
    splits(500)
    drop = lambda df: sorted(map(str, df.drop("ordinal").withColumn("props", F.to_json("props")).collect()))
    assert drop(splitting.read(spark, str(path))) == drop(geojson.read_collection(spark, str(path)))


def test_several_files_and_an_empty_array(spark, tmp_path, splits):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"features": []}')
    (folder / "b c.json").write_text(json.dumps({"features": [feature(1), feature(2)]}))
    (folder / "d.json").write_text(json.dumps({"features": [feature(3)]}, indent=1))
    splits(90)
    assert sorted(r.id for r in splitting.read(spark, str(folder)).collect()) == ["1", "2", "3"]


GOOD = '{"type": "Feature", "properties": {}, "geometry": null}'


@pytest.mark.parametrize("size", [20, 100000])
@pytest.mark.parametrize(
    "text,said",
    [
        ('{"type": "FeatureCollection"}', "no array of features"),
        ('{"features": 3}', "no array of features"),
        ('{"a": {"features": []}}', "no array of features"),
        ('[{"features": []}]', "no array of features"),
        ('{"features": [', "unexpected end, line 1, column 15"),
        ('{"features": [' + GOOD, "unexpected end"),
        ('{"features": [' + GOOD + "]", "unexpected end"),
        ('{"features": [\n' + GOOD + ",\n" + GOOD + "}\n", "unexpected }, line 3, column 56"),
        ('{"features": [\n' + GOOD + "\n" + GOOD + "]}", "a feature or a comma is missing, line 3, column 1"),
        ('{"features": [\n' + GOOD + ",\n 7]}", "unexpected text after a feature, line 3, column 3"),
        ('{"features": [\n' + GOOD + ",\n {" + '"type": what}]}', "unexpected character, line 3, column 11"),
        ('{"features": [\n{"type": 1 2}]}', "Expecting ',' delimiter, line 2, column 12"),
        ('{"features": []} {', "unexpected end"),
        ("", "without text"),
    ],
)
def test_faults_have_a_place(spark, tmp_path, splits, size, text, said):
    path = tmp_path / "bad.geojson"
    path.write_text(text)
    splits(size)
    spans = "delimiter" in said and size == 20  # a feature over two splits is parsed when it is put together
    with pytest.raises(geojson.FormatError) as e:
        geojson.check(splitting.read(spark, str(path)))
    assert spans or said in str(e.value)


def test_text_that_is_not_utf8(spark, tmp_path):
    path = tmp_path / "bad.geojson"
    path.write_bytes('{"features": [], "name": "Москва"}'.encode("cp1251"))
    with pytest.raises(geojson.FormatError, match="not plain text"):
        splitting.read(spark, str(path))
