"""Trees as tables of (node, parent): ancestors, depths, roots and roll-ups by pointer doubling.

Every round doubles the steps that a node knows and is written, so the plan doesn't grow and the number of rounds is the
logarithm of the deepest path, whatever it is. A cycle raises ValueError: on one, nodes have somewhere to go after as many
steps as there are nodes.

Edge cases: a null parent, or one that isn't a node, makes a root; null nodes are no nodes; an empty table gives no rows;
extra columns aren't read. A node listed twice is not a tree: its rows multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.storage import Workspace


def _jumps(tree: DataFrame, *extra: str) -> DataFrame:
    """(node, up, extra): up is null at roots."""
    rows = tree.where("node IS NOT NULL").select("node", F.col("parent").alias("up"), *extra)
    return rows.join(rows.select(F.col("node").alias("up"), F.lit(True).alias("_there")), "up", "left").select("node", F.when(F.col("_there"), F.col("up")).alias("up"), *extra)


def _rounds(work: Workspace, rows: DataFrame, name: str, step):
    """Apply step to written rows (with `up`) until no row has a further step; all rounds' rows are in the last."""
    rows, n, at = work.write(rows, f"{name}-0"), None, 0
    while not rows.where("up IS NOT NULL").isEmpty():
        n = rows.count() if n is None else n
        if 1 << max(at - 1, 0) > n:
            raise ValueError("the tree has a cycle")
        at += 1
        after = work.write(step(rows), f"{name}-{at}")
        work.drop(f"{name}-{at - 1}")
        rows = after
    return rows


def roots(tree: DataFrame) -> DataFrame:
    """(node, root, depth): the end of each node's path and the steps to it."""
    far = lambda rows: rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))

    def step(rows: DataFrame) -> DataFrame:
        met = rows.join(far(rows), "up", "left")
        return met.select("node", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))

    first = _jumps(tree).select("node", "up", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    return _rounds(Workspace(tree.sparkSession, "roots"), first, "r", step).select("node", "root", "depth")


def subtree_sums(tree: DataFrame, value: str) -> DataFrame:
    """(node, total): the value of a node and all below it, null values as 0.

    A node's total covers the steps below it that are known; a round adds the totals of the nodes just beyond them. Sums are
    partial per task, so a node with very many children stays spread.
    """

    def step(rows: DataFrame) -> DataFrame:
        more = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("_more"))
        onward = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        met = rows.join(more, "node", "left").join(onward, "up", "left")
        return met.select("node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_more", F.lit(0))).cast(rows.schema["total"].dataType).alias("total"))

    first = _jumps(tree, value)
    kind = first.agg(F.sum(value)).schema[0].dataType
    first = first.select("node", "up", F.coalesce(value, F.lit(0)).cast(kind).alias("total"))
    return _rounds(Workspace(tree.sparkSession, "sums"), first, "s", step).select("node", "total")


def rollup(tree: DataFrame, value: str) -> DataFrame:
    """(node, root, depth, total): what roots and subtree_sums give, in the same rounds."""

    def step(rows: DataFrame) -> DataFrame:
        more = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("_more"))
        onward = rows.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        met = rows.join(more, "node", "left").join(onward, "up", "left")
        total = (F.col("total") + F.coalesce("_more", F.lit(0))).cast(rows.schema["total"].dataType)
        return met.select("node", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), total.alias("total"))

    first = _jumps(tree, value)
    kind = first.agg(F.sum(value)).schema[0].dataType
    depth = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")
    first = first.select("node", "up", F.coalesce("up", "node").alias("root"), depth, F.coalesce(value, F.lit(0)).cast(kind).alias("total"))
    return _rounds(Workspace(tree.sparkSession, "rollup"), first, "u", step).select("node", "root", "depth", "total")


def ancestors(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, steps), itself included, of all nodes or those in `of` (node): as many rows as their paths have nodes."""
    work = Workspace(tree.sparkSession, "ancestors")
    jump = work.write(_jumps(tree), "j-0")
    first = jump if of is None else jump.join(of.select("node"), "node", "left_semi")
    known = work.write(first.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps")), "k-0")
    n, at = None, 0
    while not jump.where("up IS NOT NULL").isEmpty():
        n = jump.count() if n is None else n
        if 1 << at > 2 * n:
            raise ValueError("the tree has a cycle")
        reach = 1 << at
        at += 1
        onward = jump.where("up IS NOT NULL").withColumnsRenamed({"node": "ancestor", "up": "_up"})
        further = known.join(onward, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        known = work.write(known.unionByName(further), f"k-{at}")
        jump = work.write(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_up")), "up", "left").select("node", F.col("_up").alias("up")), f"j-{at}")
        work.drop(f"k-{at - 1}", f"j-{at - 1}")
    return known
