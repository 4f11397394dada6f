"""The scene as the planner takes it: obstacles with clearances, free nodes, and the steps from them to a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import forest, sight
from gridweave.operators import obstacles as O
from gridweave.operators.storage import Workspace
from gridweave.plans.geometry_queries import geo_tie_in_samples
from gridweave.sources import dimensions as D
from gridweave.sources import scene

#: Diameter that clearances are taken for while nothing is sized yet.
DESIGN_DN = 400


@dataclass
class Planned:
    nodes: DataFrame  # node, kind, x, y, own, room, flow
    parts: DataFrame  # pieces of the buffers of forbidden obstacles, without those that others hide from all free nodes
    work: Workspace
    layered: int | None = None  # how many pieces there are with those


def obstacles(spark: SparkSession, sf: str) -> DataFrame:
    """Forbidden restrictions of the scene in metres: (obstacle, rings, closed, clearance)."""
    kind = C.canonical_type(C.normal_type(F.col("raw")))
    corner = lambda x, y: F.struct((F.col(x) / 100.0).alias("x"), (F.col(y) / 100.0).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    rows = scene.restrictions(spark, sf).where(C.rule_of(kind) == "FORBIDDEN")
    return rows.select(F.col("box").alias("obstacle"), F.array(ring).alias("rings"), F.lit(True).alias("closed"), C.least_distance(kind, F.lit(DESIGN_DN)).alias("clearance"))


def free_nodes(terminals: DataFrame, ties: DataFrame, forbidden: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, x, y, own, room, flow) outside all buffers but their own, and the pieces of the buffers.

    terminals: (node, x, y, flow), ties: (node, x, y, room). A terminal's own obstacle is the smallest that holds it.
    Where obstacles lie in many layers, most of them are behind others for all free nodes: what only touches covered cells is left out.
    """
    hidden = O.covered(forbidden, work)
    if hidden is None:
        parts = work.write(O.pieces(forbidden), "pieces")
    else:
        forbidden = work.write(forbidden.join(hidden.in_the_open(O.reach(forbidden).withColumnRenamed("obstacle", "_o"), "_o"), F.col("obstacle").eqNullSafe(F.col("_o")), "left_semi"), "in-the-open")
        every = O.pieces(forbidden).withColumn("_piece", F.struct("obstacle", "x0", "y0", "x1", "y1"))
        parts = work.write(every.join(hidden.in_the_open(every, "_piece"), "_piece", "left_semi").drop("_piece"), "pieces")
        terminals, ties = hidden.without_hidden_points(terminals), hidden.without_hidden_points(ties)
    own = O.holders(terminals, forbidden, "node").groupBy("node").agg(F.min(F.struct("area", "obstacle"))["obstacle"].alias("own"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    every = terminals.join(own, "node", "left").select("node", F.lit("terminal").alias("kind"), "x", "y", "own", F.lit(0).alias("room"), "flow")
    every = every.unionByName(ties.select("node", F.lit("tie").alias("kind"), "x", "y", none("own", "long"), "room", none("flow", "double")))
    turns = O.corners(parts) if hidden is None else hidden.without_hidden_points(O.corners(parts))
    every = every.unionByName(turns.select("node", F.lit("corner").alias("kind"), "x", "y", none("own", "long"), F.lit(D.MAX_DEGREE - 1).alias("room"), none("flow", "double")))
    every = work.write(every.dropDuplicates(["node"]), "every")
    return work.write(every.join(O.shut(every, forbidden, parts, "node"), "node", "left_anti"), "free"), parts


def scene_of(spark: SparkSession, sf: str) -> Planned:
    """The star-schema scene: terminals and tie-in points every 25 m along the existing lines, which have two branches already."""
    work = Workspace(spark, "plan")
    m = lambda c: (F.col(c) / 100.0).alias(c)
    t = scene.terminals(spark, sf).select(F.concat(F.lit("terminal:"), F.col("terminal")).alias("node"), m("x"), m("y"), m("flow"))
    ties = geo_tie_in_samples(spark, sf).select(F.concat_ws(":", F.lit("tie"), "line", "i").alias("node"), m("x"), m("y"), F.lit(D.MAX_DEGREE - 2).alias("room"))
    forbidden = obstacles(spark, sf)
    nodes, parts = free_nodes(t, ties, forbidden, work)
    return Planned(nodes, parts, work, O.edges(forbidden).count())


def plan(scene: Planned, runs: DataFrame) -> DataFrame:
    """The sized edges of every run's forest; runs: (run, node) of the terminals each is for.

    (run, root, node, parent, x, y, px, py, own, length, flow, dn, cost), own being the obstacle that the edge may leave. Terminals without an edge can't be reached.
    """
    work, nodes = scene.work, scene.nodes
    edges = work.write(sight.graph(nodes, scene.parts, work, scene.layered), "edges")
    labels = work.write(forest.distances(nodes, edges, work), "labels")
    ends = work.write(runs.join(nodes.where("kind = 'terminal'").select("node"), "node").select("run", "node").distinct(), "ends")
    grown = forest.grow(nodes, edges, labels, ends, work)
    places = nodes.select("node", "x", "y", "own").join(labels.select("node", "d"), "node")
    lines = work.write(forest.placed(grown, places), "grown-lines")
    waiting = ends.join(lines.select("run", "node"), ["run", "node"], "left_anti").join(nodes.select("node", "x", "y", "own"), "node").join(labels.select("node", "d"), "node")
    lines = forest.branch_off(lines, waiting, scene.parts, work)
    done = forest.uncross(lines, ends, work)
    return forest.sized(done, ends.join(nodes.select("node", "flow"), "node"))
