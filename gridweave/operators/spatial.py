"""Spatial joins on grid cells: equi joins that spread over the cluster, exact by integer distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import geometry as G
from gridweave.operators.storage import Workspace


def _cells(x: Column, y: Column, size: int) -> Column:
    cx, cy = F.floor(x / size), F.floor(y / size)
    return F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def _within(points: DataFrame, targets: DataFrame, point: str, target: str, radius: int) -> DataFrame:
    """(point, target, d2): the nearest target within the radius, the smallest id of equally near ones.

    Targets are found in the point's grid cell and its eight neighbours, cells being as wide as the radius.
    """
    p = points.select(point, F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    t = targets.select(target, F.col("x").alias("tx"), F.col("y").alias("ty"), _cells(F.col("x"), F.col("y"), radius).alias("c")).select(target, "tx", "ty", "c.cx", "c.cy")
    d2 = (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty"))
    near = G.spread(p, "cx", "cy").join(G.spread(t, "cx", "cy").hint("merge"), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return near.groupBy(point).agg(F.min(F.struct("d2", target)).alias("m")).select(point, F.col("m")[target].alias(target), F.col("m.d2").alias("d2"))


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str, extent: int) -> DataFrame:
    """(point, target, d2) for every point with a target within the extent; others have no row. Coordinates are whole.

    The first cells hold about two targets, however many there are; points without a target as near as a cell is wide try again
    in cells four times as wide, up to the extent. What is found and what is left is written after each round.
    """
    work = Workspace(points.sparkSession, "nearest")
    # Of targets in one place the smallest id counts.
    targets = work.write(targets.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(target).alias(target)), "targets")
    size = targets.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    cell = extent if not size["n"] else min(extent, 1 + int(1.5 * (max(size["w"], 1) * max(size["h"], 1) / size["n"]) ** 0.5))
    left, found, at = points.select(point, "x", "y").where("x IS NOT NULL AND y IS NOT NULL"), None, 0
    while True:
        here = work.write(_within(left, targets, point, target, cell), f"found-{at}")
        found = here if found is None else found.unionByName(here)
        if cell >= extent:
            return found
        left = work.write(left.join(here.select(point), point, "left_anti"), f"left-{at}")
        if left.isEmpty():
            return found
        cell, at = min(extent, cell * 4), at + 1


def without_hidden(shapes: DataFrame, whole: Column, area: str) -> DataFrame:
    """Shapes in cells (cx, cy) without those that are larger than one that fills the cell: none of them is a point's smallest."""
    shapes = G.spread(shapes.withColumn("_whole", whole), "cx", "cy")
    least = shapes.where("_whole").groupBy("cx", "cy").agg(F.min(area).alias("_least"))
    return shapes.join(least.hint("merge"), ["cx", "cy"], "left").where(F.col("_least").isNull() | (F.col(area) <= F.col("_least"))).drop("_whole", "_least")


def covering_box(points: DataFrame, boxes: DataFrame, point: str, box: str, cell: int) -> DataFrame:
    """(point, box): the box of least area that covers the point, the smallest id of equal ones. Boxes meet cells they touch.

    Boxes larger than one that fills a cell are left out there, so a point meets few boxes, however many cover it.
    """
    cx, cy = F.col("cx") * cell, F.col("cy") * cell
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    b = G.with_cells(boxes.select(box, "x0", "y0", "x1", "y1", area.alias("area")), tuple(F.col(n) for n in ("x0", "y0", "x1", "y1")), cell)
    whole = (F.col("x0") <= cx) & (F.col("x1") >= cx + cell) & (F.col("y0") <= cy) & (F.col("y1") >= cy + cell)
    p = G.spread(points.select(point, "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), "cx", "cy")
    hit = p.join(without_hidden(b, whole, "area").hint("merge"), ["cx", "cy"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return hit.groupBy(point).agg(F.min(F.struct("area", box))[box].alias(box))
