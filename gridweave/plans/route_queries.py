"""Queries of routing: no SQL says them; tests hold the kernels against brute force.

Terminals are planned in districts of DISTRICT, then what is left in districts of twice the side, and so on to one that holds the
whole scene: what a district holds depends on density, and few terminals need a wide one. A terminal stops waiting when a
route reaches it or when boxes shut it in. Tie-in points farther than SEARCH from all terminals of a district aren't taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import obstacles as O
from gridweave.operators import routing
from gridweave.operators.storage import Workspace, shared_result
from gridweave.plans.base import query
from gridweave.plans.geometry_queries import geo_tie_in_samples
from gridweave.sources import dimensions as D
from gridweave.sources import scene

#: Side of the smallest districts in centimetres. What one holds depends on density alone.
DISTRICT = 5000
#: Largest distance from a terminal to a tie-in point in centimetres.
SEARCH = 120_000
#: Districts of one width have numbers below this.
PER_WIDTH = 1_000_000_000


def _number(cx, cy, width: int):
    return (F.lit(width * PER_WIDTH).cast("long") + cx * 10_000 + cy).alias("district")


def _district(x: str, y: str, width: int = 0):
    side = DISTRICT << width
    return _number(F.floor(F.col(x) / side), F.floor(F.col(y) / side), width)


def _touched(width: int):
    """The districts whose squares a box (x0, y0, x1, y1) touches."""
    side = DISTRICT << width
    over = lambda a, b: F.sequence(F.greatest(F.ceil(F.col(a) / side) - 1, F.lit(0)), F.floor(F.col(b) / side))
    return F.explode(F.flatten(F.transform(over("x0", "x1"), lambda cx: F.transform(over("y0", "y1"), lambda cy: _number(cx, cy, width))))).alias("district")


@dataclass
class Open:
    """What of the scene lies or shows outside boxes, in its columns: what is strictly inside one sees nothing and is seen by nothing."""

    terminals: DataFrame
    ties: DataFrame
    boxes: DataFrame


def in_the_open(spark, sf, work: Workspace) -> Open:
    """The scene without what only touches cells that lie inside a box: a way would have to cross that box's border in another cell."""
    ends, ties, boxes = scene.terminals(spark, sf), geo_tie_in_samples(spark, sf), scene.restrictions(spark, sf)
    hidden = O.covered_by(boxes.withColumnRenamed("box", "obstacle"), False, 100 * O.COVERED, work)
    if hidden is None:
        return Open(ends, ties, boxes)
    shown = boxes.join(hidden.in_the_open(boxes, "box").withColumnRenamed("box", "_b"), F.col("box").eqNullSafe(F.col("_b")), "left_semi")
    return Open(*[work.write(df, n) for df, n in ((hidden.without_hidden_points(ends), "open-terminals"), (hidden.without_hidden_points(ties), "open-ties"), (shown, "open-boxes"))])


def districts(spark, sf, width: int = 0, terminals: DataFrame | None = None, used: DataFrame | None = None, shown: Open | None = None):
    """The scene dealt into districts, in metres: tie-in points along the network, terminals, boxes that touch it, its square.

    width: how often the side is doubled. terminals: those still to plan (all where None), only in whose districts there are
    rows. used: (node, n), branches of tie-in points. shown: the part of the scene to deal, all where None.
    """
    shown = shown or Open(scene.terminals(spark, sf), geo_tie_in_samples(spark, sf), scene.restrictions(spark, sf))
    m = lambda name: (F.col(name) / 100.0).alias(name)
    none = lambda name: F.lit(None).cast("double").alias(name)
    side = DISTRICT << width
    wanted = shown.terminals
    wanted = wanted if terminals is None else wanted.join(terminals, "terminal", "left_semi")
    ends = wanted.select(_district("x", "y", width), F.lit("terminal").alias("kind"), F.col("terminal").alias("id"), m("x"), m("y"), none("x1"), none("y1"), m("flow"))
    here = ends.select("district").distinct()
    ties = shown.ties.select(_district("x", "y", width), F.lit("tie").alias("kind"), (F.col("line") * 1_000_000 + F.col("i")).alias("id"), m("x"), m("y"), none("x1"), none("y1"), none("flow"))
    ties = ties.join(here, "district", "left_semi")
    if side > SEARCH // 2:  # narrower squares hold nothing farther apart
        near = ends.select("district", F.col("x").alias("tx"), F.col("y").alias("ty"))
        ties = ties.join(near, ["district"]).where(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) <= SEARCH / 100).drop("tx", "ty").distinct()
    if used is not None:
        ties = ties.withColumn("node", F.concat(F.lit("tie:"), F.col("id"))).join(used, "node", "left").withColumn("flow", F.col("n").cast("double")).drop("node", "n")
    boxes = shown.boxes.select(_touched(width), F.lit("box").alias("kind"), F.col("box").alias("id"), m("x0"), m("y0"), m("x1"), m("y1"), none("flow")).withColumnsRenamed({"x0": "x", "y0": "y"})
    at = F.col("district") % PER_WIDTH
    x, y = F.floor(at / 10_000) * side / 100.0, at % 10_000 * side / 100.0
    square = here.select("district", F.lit("square").alias("kind"), F.lit(0).cast("long").alias("id"), x.alias("x"), y.alias("y"), (x + side / 100.0).alias("x1"), (y + side / 100.0).alias("y1"), none("flow"))
    return ends.unionByName(ties).unionByName(boxes.join(here, "district", "left_semi")).unionByName(square)


def attempts(spark, sf):
    """For each width: its rows, and what routing.attempt gives for them, written, as long as the scene's tables are the same."""
    return _tried(spark, sf)[0]


def _tried(spark, sf):
    """What attempts gives, and the terminals in the open."""
    inputs = [scene.table(spark, sf, t) for t in ("customer", "supplier", "part")]
    return shared_result(spark, f"{sf}/routes", inputs, lambda work: _attempt_widths(spark, sf, work))


def _attempt_widths(spark, sf, work: Workspace):
    most = lambda df, *c: df.agg(F.max(F.greatest(*c))).first()[0] or 0
    ends = [most(scene.terminals(spark, sf), "x", "y"), most(geo_tie_in_samples(spark, sf), "x", "y"), most(scene.restrictions(spark, sf), "x1", "y1")]
    out, left, used, width = [], None, None, 0
    shown = in_the_open(spark, sf, work)
    while True:
        rows = work.write(districts(spark, sf, width, left, used, shown), f"rows-{width}")
        found = work.write(routing.attempt(rows), f"width-{width}")
        out.append((rows, found))
        left = found.where("waits IS NOT NULL").select(F.col("waits").alias("terminal"))
        if DISTRICT << width > max(ends) or left.isEmpty():  # that square held all there is
            return out, shown.terminals
        branches = _all([f.where("from_node LIKE 'tie:%'").select(F.col("from_node").alias("node")) for _, f in out])
        used = branches.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        width += 1


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def route_plan(spark, sf):
    return _all([found.where("waits IS NULL").drop("waits") for _, found in attempts(spark, sf)])


@query()
def route_unconnected(spark, sf):
    """Terminals that no route reaches in any width, with their smallest district."""
    reached = route_plan(spark, sf).select(F.col("to_node").alias("node"))
    t = scene.terminals(spark, sf).select(_district("x", "y"), F.col("terminal").alias("id"), (F.col("flow") / 100.0).alias("flow"))
    t = t.withColumn("node", F.concat(F.lit("terminal:"), F.col("id"))).join(reached, "node", "left_anti")
    return t.select("district", "id", "flow", (D.PENALTY + D.PENALTY_PER_FLOW * F.col("flow")).alias("penalty"))


@query()
def route_leave_one_out(spark, sf):
    """What each terminal adds to the cost and length of the district that serves it; inside a box, nothing to those of its smallest."""
    tried, shown = _tried(spark, sf)
    shut = scene.terminals(spark, sf).join(shown.select("terminal"), "terminal", "left_anti")
    nothing = shut.select(_district("x", "y"), "terminal", F.lit(0.0).alias("adds_cost"), F.lit(0.0).alias("adds_length"))
    return _all([*[routing.sensitivity(rows, waiting=True) for rows, _ in tried], nothing])
