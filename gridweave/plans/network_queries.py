"""Queries of the plan over the whole scene: one graph, one forest, whatever the scene's size; see operators/sight and forest.

The plan is written once for the same tables. It is made for all terminals (run 0) and, at once, for all but each of the
HEAVIEST terminals of most flow: what a terminal adds is the difference of two whole plans. That only these are left out is
the analysis's own limit, which users set.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import compliance, forest
from gridweave.operators import geometry as G
from gridweave.operators import obstacles as O
from gridweave.operators.storage import Workspace, shared_result, temporary_tables
from gridweave.plans import planning, variants
from gridweave.plans.base import query
from gridweave.plans.geometry_queries import lines
from gridweave.sources import scene

HEAVIEST = 3
#: The zone whose metres the star-schema scene's are taken for.
SCENE_ZONE = 37


def _heaviest(nodes: DataFrame) -> DataFrame:
    """(run, left_out): the terminals of most flow, numbered from 1."""
    top = nodes.where("kind = 'terminal'").orderBy(F.desc("flow"), "node").limit(HEAVIEST)
    return top.select(F.row_number().over(Window.orderBy(F.desc("flow"), "node")).cast("long").alias("run"), F.col("node").alias("left_out"))


def network(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The sized edges of all runs, and the free nodes."""

    def build(work):
        with temporary_tables():  # what the steps wrote for themselves goes once the plan is written
            return made(work)

    def made(work):
        p = planning.scene_of(spark, sf)
        ends = p.nodes.where("kind = 'terminal'").select("node")
        without = ends.join(F.broadcast(_heaviest(p.nodes)), F.col("node") != F.col("left_out")).select("run", "node")
        runs = ends.select(F.lit(0).cast("long").alias("run"), "node").unionByName(without)
        return work.write(planning.plan(p, runs), "network"), work.write(p.nodes, "nodes")

    return shared_result(spark, f"{sf}/network", [scene.table(spark, sf, t) for t in ("customer", "supplier", "part")], build)


@query()
def route_network(spark, sf):
    """The edges of the whole plan: from each node to the next on its way to a tie-in point."""
    edges, _ = network(spark, sf)
    return edges.where("run = 0").select("root", "node", "parent", *[C.half_up(F.col(c), 2).alias(c) for c in ("x", "y", "px", "py", "length", "flow")], "dn", "cost")


@query()
def route_network_left(spark, sf):
    """Terminals without a route, whether a buffer shuts them in, and their penalty."""
    edges, nodes = network(spark, sf)
    t = scene.terminals(spark, sf).select("terminal", F.concat(F.lit("terminal:"), F.col("terminal")).alias("node"), (F.col("flow") / 100.0).alias("flow"))
    left = t.join(edges.where("run = 0").select("node"), "node", "left_anti").join(nodes.select("node", F.lit(False).alias("_free")), "node", "left")
    return left.select("terminal", F.coalesce("_free", F.lit(True)).alias("shut_in"), "flow", C.penalty(F.col("flow")).alias("penalty"))


@query()
def route_network_adds(spark, sf):
    """What each of the heaviest terminals adds to cost and length: the whole plan less the whole plan without it."""
    edges, nodes = network(spark, sf)
    sums = edges.groupBy("run").agg(F.sum("cost").alias("cost"), F.sum("length").alias("length"))
    whole = sums.where("run = 0").select(F.col("cost").alias("_c"), F.col("length").alias("_l"))
    less = _heaviest(nodes).join(sums, "run").join(F.broadcast(whole))  # one row
    return less.select(F.substring_index("left_out", ":", -1).cast("long").alias("terminal"), (F.col("_c") - F.col("cost")).alias("adds_cost"), C.half_up(F.col("_l") - F.col("length"), 2).alias("adds_length"))


@query("SELECT CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM terminals WHERE false")
def rule_route_crossings(spark, sf):
    """Edges of the plan whose insides cross: none."""
    return forest.crossings(network(spark, sf)[0].where("run = 0"), 50.0).select("a", "b")


@query("SELECT CAST(NULL AS VARCHAR) AS node, CAST(NULL AS BIGINT) AS box FROM terminals WHERE false")
def rule_route_clear(spark, sf):
    """Edges of the plan nearer to a forbidden box than its clearance, measured on the boxes themselves: none.

    A quarter turn of a buffer is two straight parts, so the clearance is kept to the cosine of an eighth of a turn's half. A terminal
    may leave the box that holds it, and so may what its first edge is cut into where others join it.
    """
    kind = C.canonical_type(C.normal_type(F.col("raw")))
    apart = C.least_distance(kind, F.lit(planning.DESIGN_DN)) * math.cos(math.pi / 8)
    m = lambda c: (F.col(c) / 100.0).alias(f"b_{c}")
    boxes = scene.restrictions(spark, sf).where(C.rule_of(kind) == "FORBIDDEN").select("box", *[m(c) for c in ("x0", "y0", "x1", "y1")], apart.alias("apart"))
    return too_near(network(spark, sf)[0].where("run = 0"), boxes)


def too_near(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(node, box): edges (node, own, x, y, px, py) nearer to a box (box, b_x0, b_y0, b_x1, b_y1, apart) than apart, but to their own."""
    grown = boxes.withColumns({"g0": F.col("b_x0") - 10, "g1": F.col("b_y0") - 10, "g2": F.col("b_x1") + 10, "g3": F.col("b_y1") + 10})
    ways = edges.select("node", "own", *[F.col(c).alias(n) for c, n in (("x", "x0"), ("y", "y0"), ("px", "x1"), ("py", "y1"))])
    low = {"l0": F.least("x0", "x1"), "l1": F.least("y0", "y1"), "l2": F.greatest("x0", "x1"), "l3": F.greatest("y0", "y1")}
    met = O.dealt(ways.withColumns(low), 50.0, "l0", "l1", "l2", "l3").join(O.dealt(grown, 50.0, "g0", "g1", "g2", "g3"), ["cx", "cy"])
    far = G.box_distances([F.col(c) for c in ("x0", "y0", "x1", "y1")], tuple(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    return met.where(~F.col("own").eqNullSafe(F.col("box"))).where(far < F.col("apart") - 0.001).select("node", "box").distinct()


@query("SELECT rule, CAST(0 AS BIGINT) AS findings FROM (VALUES " + ", ".join(f"('{n}')" for n in compliance.RULES) + ") t(rule)")
def rule_route_compliance(spark, sf):
    """What every rule finds on the whole plan as a result with its chambers, points and features: nothing."""
    edges, nodes = network(spark, sf)
    ends = scene.terminals(spark, sf).select(F.col("terminal").cast("string").alias("id"), F.concat(F.lit("terminal:"), F.col("terminal")).alias("node"), *[(F.col(c) / 100.0).alias(c) for c in ("x", "y", "flow")])
    dn = lines(spark, sf).select("line", F.col("dn").alias("host_dn"))
    ties = nodes.where("kind = 'tie'").select("node", "x", "y", "room", F.split("node", ":")[1].cast("long").alias("line"), F.lit(False).alias("chamber"), F.lit(2).alias("slots")).join(dn, "line")
    site = variants.Site(ends, ties, planning.obstacles(spark, sf), SCENE_ZONE, Workspace(spark, "route-compliance"))
    mine = edges.where("run = 0").drop("run").withColumn("variant", F.lit(1).cast("long"))
    found = compliance.report(variants.tables(site, mine, spark.range(1, 2).select(F.col("id").alias("variant"))))
    return found.select("rule", "findings")
