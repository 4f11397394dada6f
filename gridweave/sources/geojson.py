"""GeoJSON in and out. Features become rows (ordinal, object_type, id, id_is_text, props, geom); nothing is inferred here."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All coordinate nestings as text: GeoJSON's depth depends on the geometry's type.
FEATURE = "struct<type:string, id:string, properties:string, geometry:struct<type:string, coordinates:string, geometries:string>>"
#: Geometry types, and how often their coordinates are nested.
NESTING = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
GEOMETRY = "struct<type:string, parts:array<array<array<double>>>>"


class FormatError(ValueError):
    """The file isn't a GeoJSON FeatureCollection, or a geometry has an unknown type."""


def _parts(kind: Column, text: Column) -> Column:
    """Coordinates as parts of points: a part per point, line or ring (of all polygons, in order)."""
    point = F.from_json(text, "array<double>")
    lines = F.from_json(text, "array<array<array<double>>>")
    polygons = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    listed = F.from_json(text, "array<array<double>>")
    out = F.when(kind == "Point", F.array(F.array(point))).when(kind == "LineString", F.array(listed)).when(kind == "MultiPoint", F.transform(listed, lambda p: F.array(p)))
    out = out.when(kind == "MultiLineString", lines)
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return out.when(kind == "Polygon", F.transform(lines, closed)).when(kind == "MultiPolygon", F.transform(polygons, closed))


def decode(features: DataFrame) -> DataFrame:
    """Rows of (ordinal, text of one feature) as features. Fails on text that isn't JSON and on unknown geometry types.

    props keeps scalars and arrays of scalars as text; nested objects are dropped. A feature without geometry has null.
    """
    f = features.withColumn("f", F.from_json("text", FEATURE, {"mode": "PERMISSIVE"}))
    kind = F.col("f.geometry.type")
    bad = F.col("f").isNull() | F.col("f.type").isNull()
    unknown = kind.isNotNull() & ~kind.isin(*NESTING, "GeometryCollection")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a feature, at ordinal "), F.col("ordinal").cast("string")))).when(unknown, F.raise_error(F.concat(F.lit("unknown geometry type "), kind))).otherwise(kind)
    raw = F.from_json("f.properties", "map<string,string>")
    # Text may look like an object: only then the value's own kind is looked up.
    kinds = F.from_json("f.properties", "map<string,variant>")
    nested = lambda v: F.coalesce(v, F.lit("")).rlike(r"(?s)^\s*(\{|\[.*\{)")
    scalar = lambda k, v: F.when(nested(v), F.schema_of_variant(kinds[k]) == "STRING").otherwise(True)
    props = F.coalesce(F.map_filter(raw, scalar), F.create_map().cast("map<string,string>"))
    number = F.get_json_object("f.properties", "$.id")
    # Whether the id was text decides how it is written again.
    quoted = F.col("f.properties").rlike(r'"id"\s*:\s*"')
    return f.select(
        "ordinal",
        F.translate(F.lower(F.trim(props["object_type"])), "-", "_").alias("object_type"),
        F.regexp_replace(F.coalesce(number, F.col("f.id")), r"\.0+$", "").alias("id"),
        F.coalesce(quoted, F.lit(False)).alias("id_is_text"),
        props.alias("props"),
        F.when(checked.isNotNull(), F.struct(kind.alias("type"), _parts(kind, F.col("f.geometry.coordinates")).alias("parts"))).alias("geom"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line, a form that splits: the one for large inputs. The ordinal orders lines within a file."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return decode(lines.select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("text")))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """One FeatureCollection a file, whatever the order of its keys. A file is one task's: split large ones into lines first."""
    doc = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    items = F.from_json("value", "struct<features:array<string>>", {"mode": "PERMISSIVE"})
    whole = F.json_array_length(F.get_json_object("value", "$.features"))
    doc = doc.withColumn("features", F.when(whole.isNull(), F.raise_error(F.lit("not a FeatureCollection: no array of features"))).otherwise(items["features"]))
    return decode(doc.select(F.posexplode("features").alias("ordinal", "text")))


def check(features: DataFrame) -> int:
    """Read all features once; the format's faults as FormatError."""
    try:
        return features.select(F.count("ordinal"), F.count("geom")).first()[0]
    except Exception as e:
        if "USER_RAISED_EXCEPTION" in str(e):
            raise FormatError(str(e).split("\n")[0]) from e
        raise


def unknown_types(features: DataFrame, known: list[str]) -> DataFrame:
    """(object_type, n) of features that no table takes."""
    return features.where(~F.coalesce(F.col("object_type").isin(*known), F.lit(False))).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


def number(text: Column) -> Column:
    """A number from text with a point or comma; null where there's none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def to_feature(props: Column, kind: Column, coordinates: Column) -> Column:
    """One feature as JSON text; null attributes stay, and a feature without coordinates has a null geometry."""
    geometry = F.when(coordinates.isNull(), F.lit("null")).otherwise(F.format_string('{"type":"%s","coordinates":%s}', kind, coordinates))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(props, {"ignoreNullFields": "false"}), F.lit("}"))


def degrees(lon: Column, lat: Column) -> Column:
    """A position rounded to seven decimals."""
    seven = lambda v: F.regexp_replace(F.format_string("%.7f", F.floor(v * 1e7 + 0.5) / 1e7), r"\.?0+$", "")
    return F.concat(F.lit("["), seven(lon), F.lit(","), seven(lat), F.lit("]"))


def write_collection(features: DataFrame, path: str) -> int:
    """(ordinal, text) as one FeatureCollection file, streamed through the driver a partition at a time; the number of features."""
    n = 0
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as out:
        out.write('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[')
        for row in features.orderBy("ordinal").select("text").toLocalIterator():
            out.write((",\n" if n else "\n") + row.text)
            n += 1
        out.write("\n]}\n")
    os.replace(part, path)
    return n


HEAD = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":['


def write_collection_parts(features: DataFrame, path: str) -> None:
    """(ordinal, text) as part files in a folder, which put together in the order of their names are one FeatureCollection.

    A task writes a range of ordinals, so a collection of any size is written by all of them; equal ordinals go by their text.
    """
    spark = features.sparkSession
    rows = features.select(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("ordinal"), "text")
    first = rows.agg(F.min(F.struct("ordinal", "text")).alias("first"))
    # Equal rows can't be told apart: the comma stands before all but the first of them, by its number.
    head = spark.createDataFrame([(0, 0, HEAD), (2, 0, "]}")], "part int, ordinal long, text string")
    least = first.first()["first"]
    if least is not None:
        same = (F.col("ordinal").eqNullSafe(F.lit(least["ordinal"]))) & (F.col("text") == F.lit(least["text"]))
        firsts = rows.where(same).limit(1)
        copies = rows.where(same).count() - 1
        others = rows.where(~F.coalesce(same, F.lit(False))).withColumn("text", F.concat(F.lit(","), F.col("text")))
        again = firsts.withColumn("text", F.concat(F.lit(","), F.col("text"))).withColumn("ordinal", F.explode(F.array_repeat("ordinal", copies))).withColumn("again", F.lit(1))
        rows = firsts.withColumn("again", F.lit(0)).unionByName(again).unionByName(others.withColumn("again", F.lit(1)))
    else:
        rows = rows.withColumn("again", F.lit(0))
    every = head.withColumn("again", F.lit(0)).unionByName(rows)
    every.orderBy("part", F.asc_nulls_first("ordinal"), "again", "text").select("text").write.text(path)
