"""From lines that nearly meet to a network: stitched nodes, what stands on them, and the way to the source.

Edge cases: an empty table gives no rows; null coordinates meet nothing; extra columns aren't read; ids are taken as unique,
of equally near or equal candidates the smallest counts, so results don't depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridweave.operators import geometry as G
from gridweave.operators import trees
from gridweave.operators.storage import Workspace


def links(lines: DataFrame, key: str = "id") -> DataFrame:
    """(key, x0, y0, x1, y1): the straight parts of lines with points, a row each; a single point is a link without length."""
    p = F.col("points")
    pair = lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))
    parts = F.when(F.size(p) == 1, F.array(pair(p[0], p[0]))).otherwise(F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, i: pair(a, p[i + 1])))
    return lines.select(key, F.explode(parts).alias("l")).select(key, "l.*")


def _onto(px, py, ax, ay, bx, by):
    """Where points fall onto segments; segments without length are points."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(square > 0, square, 1), 0, 1)
    return ax + t * dx, ay + t * dy


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("d", "x", "y")]))
def _meeting(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.DataFrame:
    """(d, x, y): the least distance of two links and the place on the first; where they cross, the crossing. In batches, since as columns
    the many terms take longer to plan and compile than to work out."""
    ax, ay, bx, by, cx, cy, dx, dy = (v.to_numpy(float) for v in (ax, ay, bx, by, cx, cy, dx, dy))
    options = []
    for x, y in ((ax, ay), (bx, by)):
        fx, fy = _onto(x, y, cx, cy, dx, dy)
        options.append((np.hypot(x - fx, y - fy), x, y))
    for x, y in ((cx, cy), (dx, dy)):
        fx, fy = _onto(x, y, ax, ay, bx, by)
        options.append((np.hypot(x - fx, y - fy), fx, fy))
    side = lambda px, py, qx, qy, x, y: (qx - px) * (y - py) - (qy - py) * (x - px)
    a, b = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    cross = (a * b < 0) & (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0)
    t = a / np.where(cross, a - b, 1)
    options.append((np.where(cross, 0.0, np.inf), ax + t * (bx - ax), ay + t * (by - ay)))
    d, x, y = (np.stack(v) for v in zip(*options, strict=True))
    # Of equally near places the smallest.
    first = np.lexsort((y, x, d), axis=0)[:1]
    return pd.DataFrame({n: np.take_along_axis(v, first, 0)[0] for n, v in (("d", d), ("x", x), ("y", y))})


def nearest_links(shapes: DataFrame, network: DataFrame, key: str, within: float | None = None) -> DataFrame:
    """(key, d, x, y): how near the network comes to each shape, and the shape's nearest place. Both are links (x0, y0, x1, y1).

    Shapes look as far as a few links are to be expected, however densely these lie; those that find none look four times as far, and what
    is left is written. With a limit, they look that far and shapes beyond it have no row. Both sides are listed in the grid cells that they
    pass, never smaller than a twelfth of a link, so that the list grows with the links only; a pair's distance from the line that the link
    is on is compared before anything dearer is worked out.
    """
    work = Workspace(shapes.sparkSession, "nearest")
    ends = ["x0", "y0", "x1", "y1"]
    c = F.col
    length = F.hypot(c("x1") - c("x0"), c("y1") - c("y0"))
    targets = network.select(*ends).dropna()
    left = work.write(shapes.select(key, *ends).dropna(), "left-0")
    found = left.select(key, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("m")).limit(0)
    bounds = [f(g(a, b)).alias(n) for n, f, g, a, b in (("x0", F.min, F.least, "x0", "x1"), ("y0", F.min, F.least, "y0", "y1"), ("x1", F.max, F.greatest, "x0", "x1"), ("y1", F.max, F.greatest, "y0", "y1"))]
    size, own = (df.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"), *bounds).first() for df in (targets, left))
    if not size["n"] or not own["n"]:
        return found.select(key, "m.*")
    w, h = (max(max(size[a], own[a]) - min(size[b], own[b]), 1e-9) for a, b in (("x1", "x0"), ("y1", "y0")))
    # As far as about eight links are to be expected if they lie evenly, as lines and as places.
    reach = within or max(max(w, h) * 1e-6, min(4 * w * h / max(size["length"], 1e-9), 2 * (w * h / size["n"]) ** 0.5, 2 * max(w, h)))
    least, at = max(size["length"] / size["n"], own["length"] / own["n"]) / 12, 0
    while not left.isEmpty():
        cell = max(2 * reach, least)
        near = G.spread(G.with_passed_cells(left, reach, cell, cell * 1e-3), "cx", "cy")
        far = G.spread(G.with_passed_cells(targets, 0, cell, cell * 1e-3), "cx", "cy").select("cx", "cy", *[c(n).alias("t" + n) for n in ends])
        t = [c("t" + n) for n in ends]
        off = F.abs(G.side(*t, (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2))
        most = (reach + length / 2) * F.hypot(t[2] - t[0], t[3] - t[1])
        met = near.join(far.hint("merge"), ["cx", "cy"]).where(off <= most * (1 + 1e-9) + 1e-9)
        best = met.select(key, _meeting(*[c(n) for n in ends], *t).alias("m")).groupBy(key).agg(F.min("m").alias("m")).where(c("m.d") <= reach)
        best = work.write(best, f"found-{at}")
        found = found.unionByName(best)
        if within is not None:
            break
        at += 1
        left = work.write(left.join(best.select(key), key, "left_anti"), f"left-{at}")
        reach *= 4
    return found.select(key, "m.*")


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) over pairs (a, b): the smallest node of each component.

    Every root hooks to its smallest neighbour, chains are walked by doubling; written rounds go on until no pair is split.
    """
    work = Workspace(nodes.sparkSession, "components")
    label, at = work.write(nodes.select("node", F.col("node").alias("root")).distinct(), "label-0"), 0
    while True:
        names = lambda end: label.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        cut = pairs.select("a", "b").join(names("a"), "a").join(names("b"), "b").where("_a <> _b").select("_a", "_b").distinct()
        cut = work.write(cut, f"cut-{at}")
        if cut.isEmpty():
            return label
        both = cut.unionByName(cut.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        hooked = both.groupBy(F.col("_a").alias("node")).agg(F.min("_b").alias("parent")).select("node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"))
        top = trees.roots(hooked).select(F.col("node").alias("root"), F.col("root").alias("_top"))
        at += 1
        label = work.write(label.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root")), f"label-{at}")


def _close_cells(places: DataFrame, width: float, tolerance: float) -> DataFrame:
    """(cx, cy, ocx, ocy): different cells with places (x, y) within the tolerance of each other, each pair once.

    A place is sent to those of the twelve cells ahead that it can reach."""
    c = F.col
    gap = lambda i, at, v: (at + 1) * width - v if i > 0 else v - at * width if i < 0 else F.lit(0.0)
    far = lambda i, at, v: gap(i, at, v) + max(abs(i) - 1, 0) * width
    ahead = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    slack = tolerance * (1 + 1e-9) + (F.abs("x") + F.abs("y")) * 1e-12
    reach = [F.when(F.hypot(far(i, c("cx"), c("x")), far(j, c("cy"), c("y"))) <= slack, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j in ahead]
    other = places.select("x", "y", "cx", "cy", F.inline(F.array_compact(F.array(*reach)))).select(c("x").alias("ox"), c("y").alias("oy"), (c("cx") + c("i")).alias("cx"), (c("cy") + c("j")).alias("cy"), c("i").cast("byte").alias("i"), c("j").cast("byte").alias("j"))
    met = places.hint("merge").join(other, ["cx", "cy"]).where(F.hypot(c("x") - c("ox"), c("y") - c("oy")) <= tolerance)
    return met.select("cx", "cy", (c("cx") - c("i")).alias("ocx"), (c("cy") - c("j")).alias("ocy")).distinct()


#: Cells along a side of the tiles within which cells are joined first.
TILE = 64


def _join_tile(cells: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The cells (cx, cy, head, more) of a tile with the smallest head (root) of those that its pairs (cx, cy, ocx, ocy) join."""
    at = {k: i for i, k in enumerate(zip(cells["cx"], cells["cy"], strict=True))}
    heads, above = cells["head"].to_list(), list(range(len(cells)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for x, y, u, v in zip(pairs["cx"], pairs["cy"], pairs["ocx"], pairs["ocy"], strict=True):
        a, b = top(at[x, y]), top(at[u, v])
        if a != b:
            a, b = (a, b) if heads[a] < heads[b] else (b, a)
            above[b] = a
    return pd.DataFrame({"cx": cells["cx"], "cy": cells["cy"], "more": cells["more"], "root": [heads[top(i)] for i in range(len(heads))]})


def _joined_cells(cells: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """(cx, cy, more, root): cells (cx, cy, head, more) with the smallest head of those that pairs (cx, cy, ocx, ocy) join.

    Tiles join their own cells, each in a task that holds TILE * TILE of them at most; rounds of joins only see what passes their borders.
    """
    tile = lambda x, y: [F.floor(F.col(v) / TILE) for v in (x, y)]
    within = F.lit(True)
    for a, b in zip(tile("cx", "cy"), tile("ocx", "ocy"), strict=True):
        within = within & (a == b)
    named = lambda df: df.withColumns(dict(zip(("tx", "ty"), tile("cx", "cy"), strict=True))).groupBy("tx", "ty")
    joined = named(cells).cogroup(named(pairs.where(within))).applyInPandas(_join_tile, "cx long, cy long, more boolean, root string")
    return _named_alike(work.write(joined, "known"), pairs.where(~within), work, "tiles")


def _named_alike(known: DataFrame, pairs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Cells (cx, cy, root, ...) of which those that pairs (cx, cy, ocx, ocy) join have the smallest of their roots."""
    at = known.select("cx", "cy", "root")
    both = pairs.hint("merge").join(at.hint("merge"), ["cx", "cy"]).withColumnRenamed("root", "a").select("a", "ocx", "ocy")
    both = both.hint("merge").join(at.toDF("ocx", "ocy", "b").hint("merge"), ["ocx", "ocy"])
    both = work.write(both.where("a <> b").select("a", "b").distinct(), f"both-{name}")
    if both.isEmpty():
        return known
    tops = components(both.select(F.explode(F.array("a", "b")).alias("node")), both).toDF("root", "_top")
    return work.write(known.join(tops, "root", "left").withColumn("root", F.coalesce("_top", "root")).drop("_top"), f"known-{name}")


def stitch(segments: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) and edges (id, a, b) of segments (id, points): ends as near as the tolerance are one node, and what
    they are near to as well. A node is named after its smallest end and stands there.

    Ends in a cell whose diagonal is the tolerance belong together without pairing. Neighbouring cells are compared by their outermost
    ends in eight directions first, which joins nearly all that belong together, however many ends a cell holds; all ends are compared only
    where neighbours are still apart and one holds more ends than those. No table of cells is broadcast: the driver holds none.
    """
    work = Workspace(segments.sparkSession, "stitch")
    p, c = F.col("points"), F.col
    end = lambda at, name: F.struct(F.concat("id", F.lit(name)).alias("node"), F.element_at(p, at)[0].alias("x"), F.element_at(p, at)[1].alias("y"))
    ends = segments.where(F.size(p) >= 2).select("id", F.explode(F.array(end(1, "|a"), end(-1, "|b"))).alias("e")).select("id", "e.*")
    width = tolerance / 2**0.5
    ends = work.write(ends.dropna().withColumn("cx", F.floor(c("x") / width)).withColumn("cy", F.floor(c("y") / width)), "ends")
    by = [c("x"), c("y"), c("x") + c("y"), c("x") - c("y")]
    outer = F.array_distinct(F.array(*[F.struct(*[f(F.struct(v.alias("v"), "x", "y"))[n].alias(n) for n in ("x", "y")]) for v in by for f in (F.min, F.max)]))
    cells = ends.repartition("cx", "cy").groupBy("cx", "cy").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"), outer.alias("outer"))
    cells = work.write(cells, "cells")
    linked = work.write(_close_cells(cells.select("cx", "cy", F.inline("outer")), width, tolerance), "linked")
    known = _joined_cells(cells.select("cx", "cy", "head", (c("n") > F.size("outer")).alias("more")), linked, work)
    # Neighbours that are still apart, where ends were left out of the comparison.
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)])
    there = known.where("more").select(c("root").alias("_root"), c("cx").alias("ocx"), c("cy").alias("ocy"), F.inline(around)).select("_root", "ocx", "ocy", (c("ocx") + c("i")).alias("cx"), (c("ocy") + c("j")).alias("cy"))
    apart = there.join(known.select("cx", "cy", "root").hint("merge"), ["cx", "cy"]).where(c("root") != c("_root"))
    apart = work.write(apart.select(F.inline(F.array(F.struct("cx", "cy"), F.struct(c("ocx").alias("cx"), c("ocy").alias("cy"))))).distinct(), "apart")
    if not apart.isEmpty():
        places = ends.join(apart.hint("merge"), ["cx", "cy"], "left_semi").select("cx", "cy", "x", "y").distinct()
        # Roots stand for what is joined already, so few are left to join.
        known = _named_alike(known, _close_cells(places, width, tolerance), work, "all")
    named = ends.join(known.select("cx", "cy", "root").hint("merge"), ["cx", "cy"])
    nodes = named.where("node = root").select("node", "x", "y")
    at = lambda name: F.max(F.when(c("node") == F.concat("id", F.lit(name)), c("root")))
    edges = named.groupBy("id").agg(at("|a").alias("a"), at("|b").alias("b"))
    return nodes, edges


def at_nodes(points: DataFrame, nodes: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, node, d): the nearest node within the tolerance."""
    cell = lambda v: F.floor(F.col(v) / tolerance)
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    here = points.select(key, "x", "y", around.alias("c")).select(key, "x", "y", "c.cx", "c.cy")
    there = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = here.join(there, ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).where(F.col("d") <= tolerance)
    return near.groupBy(key).agg(F.min(F.struct("d", "node")).alias("m")).select(key, "m.node", "m.d")


def source_node(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, node, d): the nearest node of all to the one source (id, x, y)."""
    one = source.select(F.col("id").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy")).limit(1)
    far = nodes.join(F.broadcast(one), F.lit(True)).withColumn("d", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))  # one row
    return far.groupBy("source").agg(F.min(F.struct("d", "node")).alias("m")).select("source", "m.node", "m.d")


def upstream(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(node, parent, depth) by breadth from the root over edges (a, b), each usable both ways; the smallest parent of several.

    A round joins the frontier only and is written, so that the plan doesn't grow; there are as many rounds as steps.
    """
    work = Workspace(edges.sparkSession, "upstream")
    both = work.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    kind = edges.schema["a"].dataType
    done = work.write(root.select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")), "done-0")
    depth = 0
    while True:
        edge = done.where(F.col("depth") == depth).select(F.col("node").alias("a"))
        step = edge.join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        depth += 1
        fresh = work.write(step.join(done.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"fresh-{depth}")
        if fresh.isEmpty():
            return done
        done = work.write(done.unionByName(fresh), f"done-{depth}")
        work.drop(f"done-{depth - 1}", f"fresh-{depth}")


def next_to_source(edges: DataFrame, chambers: DataFrame, source: DataFrame) -> DataFrame:
    """(id, kind, upstream): the next object towards the source of each segment (id, a, b) and each chamber (id, node).

    source is (source, node). A segment hangs on its end nearer the source: on the chamber there, else on the source if that is
    its node, else on the segment that leads on; a chamber on the source at its node, else on that segment. What the source
    doesn't reach has null.
    """
    tree = upstream(edges, source.select("node"))
    way = edges.select("id", "a", "b").unionByName(edges.select("id", F.col("b").alias("a"), F.col("a").alias("b")))
    leads = tree.where("parent IS NOT NULL").join(way, (F.col("node") == F.col("a")) & (F.col("parent") == F.col("b"))).groupBy("node").agg(F.min("id").alias("line"))
    known = tree.select("node", "depth").join(leads, "node", "left").join(source.select("node", "source"), "node", "left")
    stands = chambers.groupBy("node").agg(F.min("id").alias("chamber"))
    near = way.select("id", F.col("a").alias("node")).join(known, "node").groupBy("id").agg(F.min(F.struct("depth", "node", "line", "source")).alias("m")).select("id", "m.node", "m.line", "m.source")
    near = near.join(stands, "node", "left").select("id", F.coalesce("chamber", "source", "line").alias("upstream"))
    lines = edges.select("id").join(near, "id", "left").select("id", F.lit("segment").alias("kind"), "upstream")
    held = chambers.select("id", "node").join(known, "node", "left").select("id", F.lit("chamber").alias("kind"), F.coalesce("source", "line").alias("upstream"))
    return lines.unionByName(held)
