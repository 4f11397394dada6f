"""Obstacles that routes keep away from: any rings and lines, grown by a clearance, two segments a quarter turn.

A buffer is not one outline but many convex pieces: one around every edge of the obstacle, its two sides and a half turn at each
end. Together with the obstacle's inside they are the buffer, for concave outlines, holes and lines as well, and nothing has to be
dissolved: buffers stay apart, so that one owner's can be left out. A segment enters the buffer if it enters a piece; it
could only lie in the inside without that if both its ends did, so it's enough to leave out points that lie inside.

Obstacles are tables (obstacle, rings, closed, clearance): rings as arrays of arrays of (x, y), not closed by a repeated point,
holes as further rings; closed is false for lines. Edge cases: a null or empty ring has no pieces; a single point is a disc; repeated points are passed
over; a clearance of null counts as 0, whose pieces have no inside; extra columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.storage import Workspace

#: How deep (m) a point lies inside before it counts, so that running along a border is no entry.
SKIN = 1e-6
TURNS = [math.radians(t) for t in (-90, -45, 0, 45, 90, 90, 135, 180, 225, 270)]


def tasks(spark: SparkSession) -> int:
    """How many tasks groups that are little data but much work are dealt to."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def edges(obstacles: DataFrame) -> DataFrame:
    """(obstacle, clearance, ax, ay, bx, by): the straight parts of all rings; those of lines aren't closed."""
    # A ring whose points all coincide keeps one edge without length.
    after = lambda r, i: r[F.when(i + 1 == F.size(r), F.lit(0)).otherwise(i + 1)]
    pair = lambda a, b: F.struct(a.x.cast("double").alias("ax"), a.y.cast("double").alias("ay"), b.x.cast("double").alias("bx"), b.y.cast("double").alias("by"))
    parts = lambda r: F.transform(r, lambda p, i: F.when((i + 1 < F.size(r)) | F.col("closed") | (F.size(r) == 1), pair(p, after(r, i))))
    far = lambda e: (e.ax != e.bx) | (e.ay != e.by)
    every = F.array_compact(parts(F.col("ring")))
    kept = F.filter(every, far)
    rows = obstacles.select("obstacle", F.coalesce("clearance", F.lit(0.0)).cast("double").alias("clearance"), "closed", F.explode("rings").alias("ring"))
    rows = rows.select("obstacle", "clearance", F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.slice(every, 1, 1))).alias("e"))
    return rows.select("obstacle", "clearance", "e.*")


def pieces(obstacles: DataFrame) -> DataFrame:
    """(obstacle, px, py, x0, y0, x1, y1): the convex pieces of the buffers, turning left, and their boxes."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rows = edges(obstacles).withColumn("l", length)
    ux = F.when(F.col("l") > 0, (F.col("bx") - F.col("ax")) / F.col("l")).otherwise(1.0)
    uy = F.when(F.col("l") > 0, (F.col("by") - F.col("ay")) / F.col("l")).otherwise(0.0)
    rows = rows.withColumn("ux", ux).withColumn("uy", uy)
    d = F.col("clearance")
    # As one array of turns: written out, the twenty expressions are too long to be compiled.
    turns = F.array(*[F.struct(F.lit(k < 5).alias("end"), F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s")) for k, t in enumerate(TURNS)])
    xs = F.transform(turns, lambda t: F.when(t.end, F.col("bx")).otherwise(F.col("ax")) + d * (F.col("ux") * t.c - F.col("uy") * t.s))
    ys = F.transform(turns, lambda t: F.when(t.end, F.col("by")).otherwise(F.col("ay")) + d * (F.col("uy") * t.c + F.col("ux") * t.s))
    rows = rows.select("obstacle", xs.alias("px"), ys.alias("py"))
    return rows.select("*", *[f(c).alias(n) for n, f, c in (("x0", F.array_min, "px"), ("y0", F.array_min, "py"), ("x1", F.array_max, "px"), ("y1", F.array_max, "py"))])


def reach(obstacles: DataFrame) -> DataFrame:
    """(obstacle, x0, y0, x1, y1): the boxes of the buffers; those without points have none."""
    every, d = F.flatten(F.array_compact("rings")), F.coalesce("clearance", F.lit(0.0)).cast("double")
    side = lambda f, n: f(every.getField(n)).cast("double")
    rows = obstacles.select("obstacle", (side(F.array_min, "x") - d).alias("x0"), (side(F.array_min, "y") - d).alias("y0"), (side(F.array_max, "x") + d).alias("x1"), (side(F.array_max, "y") + d).alias("y1"))
    return rows.where("x0 IS NOT NULL")


def within_pieces(at: np.ndarray, own: np.ndarray, shapes: np.ndarray, of: np.ndarray, skin: float = SKIN) -> np.ndarray:
    """Whether each point (n x 2) lies inside one of convex pieces (m x k x 2) that isn't of its own obstacle.

    Large pieces come first and a point that one holds meets no more, so where buffers cover much, few pairs are looked at.
    """
    low, high = shapes.min(1), shapes.max(1)
    order = np.argsort(-(high - low).prod(1), kind="stable")
    step = np.roll(shapes, -1, axis=1) - shapes
    length = np.hypot(step[..., 0], step[..., 1])
    out, begin, width = np.zeros(len(at), bool), 0, 16
    while begin < len(order):
        some = order[begin : begin + width]
        alive = np.flatnonzero(~out)
        for first in range(0, len(alive), 20_000):
            mine = alive[first : first + 20_000]
            k, m = np.nonzero(((at[mine, None] >= low[some]) & (at[mine, None] <= high[some])).all(2) & (own[mine, None] != of[some]))
            k, m = mine[k], some[m]
            d = at[k, None] - shapes[m]
            left = step[m][..., 0] * d[..., 1] - step[m][..., 1] * d[..., 0] > length[m] * skin
            out[k[(left | (length[m] < 1e-9)).all(1)]] = True
        begin, width = begin + width, min(2 * width, 128)
    return out


def _inside(points: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """The keys of a cell's points that lie inside its pieces."""
    if not len(points) or not len(parts):
        return points[["key"]].head(0)
    names = pd.factorize(pd.concat([points["own"], parts["obstacle"]], ignore_index=True))[0]
    shapes = np.stack([np.stack(parts["px"].to_list()), np.stack(parts["py"].to_list())], -1)
    return points.loc[within_pieces(points[["x", "y"]].to_numpy(float), names[: len(points)], shapes, names[len(points) :]), ["key"]]


def within_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies inside closed rings by the even-odd rule; on their border it may count as either."""

    def crossed(ring: Column) -> Column:
        def over(p: Column, i: Column) -> Column:
            q = ring[F.when(i + 1 == F.size(ring), F.lit(0)).otherwise(i + 1)]
            return F.when(((p.y <= y) != (q.y <= y)) & (x < p.x + (y - p.y) / (q.y - p.y) * (q.x - p.x)), 1).otherwise(0)

        return F.aggregate(F.transform(ring, over), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, crossed), F.lit(0), lambda a, b: a + b) % 2 == 1


def dealt(df: DataFrame, size: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """A row for every grid cell (cx, cy) that a box touches."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return df.withColumn("cx", F.explode(cells(x0, x1))).withColumn("cy", F.explode(cells(y0, y1)))


def spot(df: DataFrame, size: float) -> DataFrame:
    """The grid cell of each row's (x, y)."""
    return df.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def holders(points: DataFrame, obstacles: DataFrame, key: str, cell: float = 50.0) -> DataFrame:
    """(key, obstacle, area): the closed obstacles that hold a point (x, y), and how large they are."""
    ring = F.col("rings")
    every = F.flatten(ring)
    box = [f(every.getField(n)).cast("double").alias(a) for a, f, n in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))]
    turned = lambda r: F.aggregate(F.transform(r, lambda p, i: p.x * r[(i + 1) % F.size(r)].y - r[(i + 1) % F.size(r)].x * p.y), F.lit(0.0), lambda a, v: a + v)
    area = F.abs(F.aggregate(F.transform(ring, turned), F.lit(0.0), lambda a, v: a + v)) / 2
    shapes = obstacles.where("closed").select("obstacle", "rings", area.alias("area"), *box)
    met = spot(points.select(key, "x", "y"), cell).join(dealt(shapes, cell), ["cx", "cy"])
    met = met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").where(within_rings(F.col("x"), F.col("y"), ring))
    return met.select(key, "obstacle", "area")


def shut(points: DataFrame, obstacles: DataFrame, parts: DataFrame, key: str, cell: float = 50.0) -> DataFrame:
    """The keys of points (key, x, y, own) inside a buffer that isn't of their own obstacle (null: none)."""
    other = lambda df: df.where(~F.col("own").eqNullSafe(F.col("obstacle")))
    near = spot(points.select(F.col(key).alias("key"), "x", "y", F.col("own").cast("string").alias("own")), cell)
    dealt_parts = dealt(parts.select(F.col("obstacle").cast("string").alias("obstacle"), "px", "py", "x0", "y0", "x1", "y1"), cell).select("cx", "cy", "obstacle", "px", "py")
    n, by = tasks(points.sparkSession), ["cx", "cy"]
    inside = near.repartition(n, *by).groupBy(*by).cogroup(dealt_parts.repartition(n, *by).groupBy(*by)).applyInPandas(_inside, f"key {points.schema[key].dataType.simpleString()}")
    inside = inside.select(F.col("key").alias(key))
    held = other(holders(points, obstacles, key, cell).join(points.select(key, "own"), key)).select(key)
    return inside.unionByName(held).distinct()


#: Width (m) of the cells that are looked at for being covered, where a scene has no more than MOST_CELLS of them; else they are wider.
COVERED, MOST_CELLS = 2.5, 1_000_000


@dataclass
class Covered:
    """Cells that lie whole in the buffers of two obstacles or more: nothing outside is seen past them, whoever's own one of these is.

    Where no obstacle is anybody's own, one is enough.
    """

    keys: DataFrame | None  # key: at most MOST_CELLS
    size: float
    x0: float
    y0: float

    def key(self, cx: Column, cy: Column) -> Column:
        return cx * 4_000_000 + cy

    def without_hidden_points(self, points: DataFrame) -> DataFrame:
        """Points (x, y) that don't lie in such cells."""
        at = self.key(F.floor((F.col("x") - self.x0) / self.size), F.floor((F.col("y") - self.y0) / self.size))
        return points.withColumn("_key", at).join(F.broadcast(self.keys.withColumnRenamed("key", "_key")), "_key", "left_anti").drop("_key")

    def in_the_open(self, boxes: DataFrame, key: str) -> DataFrame:
        """The keys of boxes (x0, y0, x1, y1) that touch another cell than such."""
        low, high = (lambda c, o: F.floor((F.col(c) - 0.01 - o) / self.size)), (lambda c, o: F.floor((F.col(c) + 0.01 - o) / self.size))
        cells = boxes.select(key, F.explode(F.sequence(low("x0", self.x0), high("x1", self.x0))).alias("cx"), "y0", "y1")
        cells = cells.select(key, "cx", F.explode(F.sequence(low("y0", self.y0), high("y1", self.y0))).alias("cy"))
        return cells.withColumn("_key", self.key(F.col("cx"), F.col("cy"))).join(F.broadcast(self.keys.withColumnRenamed("key", "_key")), "_key", "left_anti").select(key).distinct()


def covered_by(rects: DataFrame, several: bool, least: float, work: Workspace) -> Covered | None:
    """The cells that lie whole inside a rectangle (obstacle, x0, y0, x1, y1), or where several is set, in two of different obstacles.

    Cells are as wide as least, or wider where there would be more than MOST_CELLS. None where there are no rectangles.
    """
    box = rects.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    if box["x0"] is None:
        return None
    x, y = box["x0"] - 1, box["y0"] - 1
    wide, high = box["x1"] + 1 - x, box["y1"] + 1 - y
    size = max(least, (wide * high / MOST_CELLS) ** 0.5, wide / 2_000_000, high / 2_000_000)
    out = Covered(None, size, x, y)
    # A millimetre (or a thousandth of the unit) inside, so that what runs along a border enters no covered cell.
    first, last = (lambda c, o: F.ceil((F.col(c) + 1e-3 - o) / size)), (lambda c, o: F.floor((F.col(c) - 1e-3 - o) / size) - 1)
    held = rects.select("obstacle", first("x0", x).alias("a"), last("x1", x).alias("b"), first("y0", y).alias("c"), last("y1", y).alias("e")).where("a <= b AND c <= e")
    held = held.select("obstacle", F.explode(F.sequence("a", "b")).alias("cx"), "c", "e").select("obstacle", "cx", F.explode(F.sequence("c", "e")).alias("cy"))
    found = held.withColumn("key", out.key(F.col("cx"), F.col("cy"))).groupBy("key").agg(F.min("obstacle").alias("least"), F.max("obstacle").alias("most"))
    out.keys = work.write((found.where("least <> most") if several else found).select("key"), "covered")
    return out


def covered(obstacles: DataFrame, work: Workspace) -> Covered | None:
    """The cells that two obstacles cover; only rectangles along the axes are taken to cover any. None where there are none.

    A segment that starts outside all buffers, or in one only, enters such a cell only through pieces that touch other cells: it has to pass the
    border of both buffers before.
    """
    every = F.flatten(F.array_compact("rings"))
    d = F.coalesce("clearance", F.lit(0.0)).cast("double")
    shapes = obstacles.select("obstacle", "closed", d.alias("d"), "rings", *[f(every.getField(n)).cast("double").alias(a) for a, f, n in (("x0", F.array_min, "x"), ("y0", F.array_min, "y"), ("x1", F.array_max, "x"), ("y1", F.array_max, "y"))])
    p = [F.col("rings")[0][k] for k in range(4)]
    level, upright = (lambda a, b: p[a].y == p[b].y), (lambda a, b: p[a].x == p[b].x)
    turned = (level(0, 1) & upright(1, 2) & level(2, 3) & upright(3, 0)) | (upright(0, 1) & level(1, 2) & upright(2, 3) & level(3, 0))
    whole = shapes.where(F.col("closed") & (F.size("rings") == 1)).where(F.size(F.col("rings")[0]) == 4).where(turned)
    sides = F.array(*[F.struct((F.col("x0") - a).alias("x0"), (F.col("y0") - b).alias("y0"), (F.col("x1") + a).alias("x1"), (F.col("y1") + b).alias("y1")) for a, b in ((F.col("d"), F.lit(0.0)), (F.lit(0.0), F.col("d")))])
    return covered_by(whole.select("obstacle", F.inline(sides)), True, COVERED, work)


def corners(parts: DataFrame) -> DataFrame:
    """(node, x, y): the points of the pieces, one a millimetre; named by where they are, so a name means one place."""
    rows = parts.select(F.explode(F.arrays_zip("px", "py")).alias("p")).select(F.col("p.px").alias("x"), F.col("p.py").alias("y"))
    rows = rows.withColumn("mx", F.floor(F.col("x") * 1000 + 0.5)).withColumn("my", F.floor(F.col("y") * 1000 + 0.5))
    one = rows.groupBy("mx", "my").agg(F.min(F.struct("x", "y")).alias("p"))
    return one.select(F.concat_ws(":", F.lit("corner"), "mx", "my").alias("node"), "p.x", "p.y")
