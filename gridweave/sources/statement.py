"""The work statement: a CSV with semicolons, a byte order mark, CRLF and decimal commas, in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles and headings of the sections.
TITLE = "ВЕДОМОСТЬ ОБЪЁМОВ РАБОТ"
BY_DIAMETER = ("СВОД ПО УСЛОВНЫМ ДИАМЕТРАМ (новое строительство)", "ДУ, мм;Длина, м;Стоимость, руб.")
CHAMBERS = ("НОВЫЕ ТЕПЛОВЫЕ КАМЕРЫ", "№;Камера;ДУ, мм;Примыканий;Стоимость, руб.")
TOTALS = ("ИТОГО", "Раздел;Количество;Длина, м;Стоимость, руб.")
NAMES = ("Новые участки сети", "Новые тепловые камеры", "Врезки в существующие камеры", "Стоимость строительства", "ВСЕГО")


def comma(x: Column, digits: int) -> Column:
    """A number with a decimal comma, halves away from zero; no thousands separator."""
    return F.translate(F.format_string(f"%.{digits}f", F.round(x, digits)), ".", ",")


def quoted(text: Column) -> Column:
    """A field in quotes where it holds a separator, a quote or a line's end; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line(*fields: Column) -> Column:
    return F.concat_ws(";", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def chamber_rows(chambers: DataFrame) -> DataFrame:
    """(ordinal, text) of chambers (ordinal, id, dn, degree, cost)."""
    return chambers.select("ordinal", line(F.col("ordinal"), quoted(F.col("id")), F.col("dn"), F.col("degree"), F.col("cost").cast("long")).alias("text"))


def diameter_rows(segments: DataFrame) -> DataFrame:
    """(ordinal, text): length in metres and cost by diameter, ascending."""
    g = segments.groupBy("dn").agg(F.sum("length").alias("length"), F.sum("cost").alias("cost"))
    return g.select(F.col("dn").cast("long").alias("ordinal"), line(F.col("dn"), comma(F.col("length"), 1), F.col("cost").cast("long")).alias("text"))


def total_rows(segments: DataFrame, chambers: DataFrame, tie_ins: DataFrame, penalties: float = 0) -> DataFrame:
    """(ordinal, text): segments, chambers, tie-ins, what building costs, and all with penalties."""
    pair = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("cost"))
    s = segments.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("cost"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    one = s.crossJoin(pair(chambers).toDF("cn", "cc")).crossJoin(pair(tie_ins).toDF("tn", "tc"))  # three single rows
    built = F.col("cost") + F.col("cc") + F.col("tc")
    metres, none = comma(F.col("length"), 1), F.lit(None).cast("string")
    rows = [(F.col("n"), metres, F.col("cost")), (F.col("cn"), none, F.col("cc")), (F.col("tn"), none, F.col("tc")), (none, metres, built), (none, metres, (built + F.lit(penalties)).cast("long"))]
    texts = [F.struct(F.lit(i).cast("long").alias("ordinal"), line(F.lit(name), *r).alias("text")) for i, (name, r) in enumerate(zip(NAMES, rows, strict=True))]
    return one.select(F.explode(F.array(*texts)).alias("r")).select("r.*")


def write(path: str, header: list[tuple[str, str]], sections: list[tuple[str, str, DataFrame]]) -> None:
    """The statement as a file: a title, header pairs, then sections of a title, a heading and rows in order."""
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        put = lambda text: out.write(text + "\r\n")
        put(TITLE)
        for name, value in header:
            put(f"{name};" + (f'"{value}"' if ";" in value else value))
        for title, heading, rows in sections:
            put("")
            put(title)
            put(heading)
            for row in rows.orderBy("ordinal").select("text").toLocalIterator():
                put(row.text)


def write_parts(path: str, header: list[tuple[str, str]], sections: list[tuple[str, str, DataFrame]]) -> None:
    """The statement as part files in a folder, which put together in the order of their names are the file that write makes."""
    spark = sections[0][2].sparkSession
    top = ["\ufeff" + TITLE, *(f"{name};" + (f'"{value}"' if ";" in value else value) for name, value in header)]
    lines = [(-1, 0, i, text) for i, text in enumerate(top)]
    for i, (title, heading, _) in enumerate(sections):
        lines += [(i, 0, k, text) for k, text in enumerate(("", title, heading))]
    out = spark.createDataFrame(lines, "section int, kind int, ordinal long, text string")
    for i, (_, _, rows) in enumerate(sections):
        out = out.unionByName(rows.select(F.lit(i).alias("section"), F.lit(1).alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), "text"))
    out.orderBy("section", "kind", "ordinal").select("text").write.option("lineSep", "\r\n").text(path)
