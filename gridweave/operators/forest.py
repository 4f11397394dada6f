"""From a visibility graph to a forest that joins terminals to tie-in points, in rounds of joins; no task holds a whole scene.

Distances: nodes are dealt to districts; a round settles every district that has news by itself (Dijkstra over its own edges)
and hands what crosses its border to the next round, until nothing gets shorter. The result is that of one search over the
whole graph.

Forest: every node may hang on a node with a smaller distance, so however parents are chosen, and by however many tasks at once,
there's no cycle. Each node proposes to the nearest such node of the forest; a node takes the nearest of its proposals, as many as it
has room for, and the others propose to their next. Nodes without a terminal below are dropped and the rest choose anew, until
nothing is dropped. Several plans (column run) are made at once: they share graph and distances.

Crossings: where two edges cross, a node at the crossing takes the shorter of the two ways on and both nodes hang on it. As it lies
nearer than either and farther than its parent, there's still no cycle, and the total gets shorter. Edges that cross several
others wait for the next round.

Edge cases: unreachable terminals have no distance and no edge; terminals pass nothing on; ties are broken by name; repeated
nodes count once; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators import geometry as G
from gridweave.operators import obstacles as O
from gridweave.operators import trees
from gridweave.operators.sight import enters
from gridweave.operators.storage import Workspace
from gridweave.sources import dimensions as D

#: Side of the districts (m) that settle distances by themselves.
DISTRICT = 150.0
SETTLED = "node string, d double, origin string, back string, inside boolean"


def _settle(state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Shortest ways inside a district from the distances known so far, and what its edges offer to nodes beyond.

    state: node, d, origin, back, passes. edges: node, other, w, inside (whether `other` lies in the district as well).
    """
    best = {n: (d, o, b) for n, d, o, b in zip(state["node"], state["d"], state["origin"], state["back"], strict=True) if d == d}
    passes = set(state["node"][state["passes"].astype(bool)])
    known = {n: v[0] for n, v in best.items()}
    out: dict[str, list[tuple[str, float, bool]]] = {}
    for a, b, w, inside in zip(edges["node"], edges["other"], edges["w"], edges["inside"], strict=True):
        out.setdefault(a, []).append((b, w, inside))
    beyond: dict[str, tuple[float, str, str]] = {}
    heap = [(v[0], n) for n, v in best.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if d > best[n][0] or n not in passes:
            continue
        origin = best[n][1]
        for b, w, inside in out.get(n, ()):
            far = d + w
            held = best if inside else beyond
            if b not in held or (far, origin, n) < held[b]:
                closer = b not in held or far < held[b][0]
                held[b] = (far, origin, n)
                if inside and closer:
                    heapq.heappush(heap, (far, b))
    rows = [(n, *v, True) for n, v in best.items() if n not in known or v[0] < known[n]] + [(n, *v, False) for n, v in beyond.items()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SETTLED.split(", ")], dtype=object)


def distances(nodes: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, d, origin, back): the way from each node to its nearest tie-in point, and the next node on it (null there).

    nodes: node, kind, x, y. edges: node, other, w, each pair once. Terminals end ways but don't pass them on.
    """
    tile = [F.floor(F.col(c) / DISTRICT) for c in ("x", "y")]
    places = work.write(nodes.select("node", F.concat_ws(":", *tile).alias("district"), (F.col("kind") != "terminal").alias("passes"), "kind").dropDuplicates(["node"]), "places")
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
    away = places.select(F.col("node").alias("other"), F.col("district").alias("_to"))
    spread = both.join(places.select("node", "district"), "node").join(away, "other").select("district", "node", "other", "w", (F.col("_to") == F.col("district")).alias("inside"))
    tasks = O.tasks(nodes.sparkSession)
    spread = work.write(spread.repartition(tasks, "district"), "spread")
    zero = places.select("node", "district", "passes", F.when(F.col("kind") == "tie", 0.0).alias("d"), F.when(F.col("kind") == "tie", F.col("node")).alias("origin"), F.lit(None).cast("string").alias("back"), (F.col("kind") == "tie").alias("fresh"))
    state, at = work.write(zero, "state-0"), 0
    while True:
        live = state.where("fresh").select("district").distinct()
        known = state.where("d IS NOT NULL").join(live, "district", "left_semi")
        mine = known.repartition(tasks, "district").groupBy("district")
        offers = mine.cogroup(spread.join(live, "district", "left_semi").groupBy("district")).applyInPandas(_settle, SETTLED)
        best = offers.groupBy("node").agg(F.min(F.struct("d", "origin", "back", "inside")).alias("o"))
        met = state.withColumnsRenamed({"d": "_d", "origin": "_origin", "back": "_back"}).drop("fresh").join(best, "node", "left")
        closer = F.col("o").isNotNull() & (F.col("_d").isNull() | (F.col("o.d") < F.col("_d")))
        pick = lambda n: F.when(closer, F.col(f"o.{n}")).otherwise(F.col(f"_{n}")).alias(n)
        at += 1
        # A district that settled a node by itself has no news; one that was offered a shorter way has.
        state = work.write(met.select("node", "district", "passes", pick("d"), pick("origin"), pick("back"), (closer & ~F.col("o.inside") & F.col("passes")).alias("fresh")), f"state-{at}")
        work.drop(f"state-{at - 1}")
        if state.where("fresh").isEmpty():
            return state.where("d IS NOT NULL").select("node", "d", "origin", "back")


def _matched(wishes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(run, node, parent, w): each node on the nearest parent that has room for it. wishes: run, node, parent, w, room."""
    mine = Window.partitionBy("run", "node")
    ranked = wishes.withColumn("choice", F.row_number().over(mine.orderBy("w", "parent"))).withColumn("last", F.count(F.lit(1)).over(mine))
    ranked = work.write(ranked, f"{name}-wishes")
    state, at = ranked.select("run", "node").distinct().withColumn("choice", F.lit(1)), 0
    while True:
        asked = ranked.join(state, ["run", "node", "choice"]).withColumn("_share", F.pmod(F.xxhash64("node"), F.lit(16)))
        # A node that very many ask is first ranked in shares, so none of them holds all that ask.
        order = lambda *by: Window.partitionBy("run", "parent", *by).orderBy("w", "node")
        asked = asked.withColumn("_r", F.row_number().over(order("_share"))).withColumn("_kept", F.col("_r") <= F.col("room"))
        some = asked.where("_kept").withColumn("_r", F.row_number().over(order())).withColumn("taken", F.col("_r") <= F.col("room"))
        columns = ["run", "node", "parent", "w", "choice", "taken", (F.col("_r") == F.col("room")).alias("worst")]
        rows = some.select(*columns).unionByName(asked.where("NOT _kept").withColumn("taken", F.lit(False)).select(*columns))
        rows = work.write(rows, f"{name}-{at}")
        at += 1
        # Who is refused asks the next node that has room or would rather have it: what a full node holds only gets nearer.
        full = rows.where("taken AND worst").select("run", "parent", F.struct("w", "node").alias("_full"))
        refused = rows.where("NOT taken").select("run", "node", F.col("choice").alias("_at"))
        onward = ranked.join(refused, ["run", "node"]).where("choice > _at").join(full, ["run", "parent"], "left")
        again = onward.where(F.col("_full").isNull() | (F.struct("w", "node") < F.col("_full"))).groupBy("run", "node").agg(F.min("choice").alias("choice"))
        again = work.write(again, f"{name}-again-{at}")
        if again.isEmpty():
            return rows.where("taken").select("run", "node", "parent", "w")
        state = rows.where("taken").select("run", "node", "choice").unionByName(again)


def _alive(forest: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges (run, node, parent, ...) that lead from a terminal of the run (run, node) to a tie-in point."""
    named = lambda c: F.concat_ws("|", F.col("run").cast("string"), c)
    held = forest.select(named("node").alias("node"), named("parent").alias("parent"))
    tops = held.select(F.col("parent").alias("node")).join(held.select("node"), "node", "left_anti").distinct()
    tree = held.unionByName(tops.select("node", F.lit(None).cast("string").alias("parent")))
    marks = ends.select(named("node").alias("node"), F.lit(1).alias("one"))
    good = trees.rollup(tree.join(marks, "node", "left"), "one").where((F.col("total") > 0) & F.split("root", r"\|")[1].startswith("tie:")).select("node")
    return forest.withColumn("_n", named("node")).join(good.withColumnRenamed("node", "_n"), "_n", "left_semi").drop("_n")


def grow(nodes: DataFrame, edges: DataFrame, labels: DataFrame, ends: DataFrame, work: Workspace) -> DataFrame:
    """(run, node, parent, w) for every run's terminals (run, node); some edges may lead to no terminal, which uncross drops.

    nodes: node, kind, room (how many may hang on it). labels: as distances gives them.
    """
    back = labels.where("back IS NOT NULL").select("node", F.col("back").alias("parent"))
    runs = ends.select("run").distinct()
    start = back.crossJoin(F.broadcast(runs)).select("run", "node", "parent")  # a row a run and node; runs are few
    forest = work.write(_alive(start, ends), "grown-0")
    facts = nodes.select("node", "kind", "room").join(labels.select("node", "d"), "node")
    up = facts.where("kind <> 'terminal'").select(F.col("node").alias("parent"), F.col("d").alias("_pd"), "room")
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "w")).withColumnRenamed("other", "parent")
    down = both.join(facts.select("node", "d"), "node").join(up, "parent").where("_pd < d").select("node", "parent", "w", "room")
    down = work.write(down, "downhill")
    at, size = 0, None
    while True:
        # Who may hang on whom: terminals and what something hangs on; parents are tie-in points or hang on something themselves.
        used = forest.select("run", F.col("parent").alias("node")).distinct()
        hung = forest.select("run", "node")
        members = work.write(hung.join(used, ["run", "node"], "left_semi").unionByName(used.where("node LIKE 'tie:%'")).unionByName(ends.select("run", "node")).distinct(), f"members-{at}")
        n = members.count()
        if n == size:  # members only ever leave, so the choice would be the same
            return forest
        size, at = n, at + 1
        wishes = down.join(members, "node").join(members.withColumnRenamed("node", "parent"), ["run", "parent"])
        forest = _matched(wishes.select("run", "node", "parent", "w", "room"), work, f"m{at}")


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """(run, a, b, x, y), a < b: edges (run, node, x, y, px, py) whose insides cross, and where."""
    box = [f("x", "px").alias(n) if n[0] == "x" else f("y", "py").alias(n) for n, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]
    cells = O.dealt(lines.select("run", "node", "x", "y", "px", "py", *box), cell)
    side = lambda s: cells.select("run", "cx", "cy", *[F.col(n).alias(f"{s}_{n}") for n in ("node", "x", "y", "px", "py", "x0", "y0")])
    pairs = side("a").join(side("b"), ["run", "cx", "cy"]).where("a_node < b_node")
    first = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("cy"))
    a, b = [F.col(f"a_{n}") for n in ("x", "y", "px", "py")], [F.col(f"b_{n}") for n in ("x", "y", "px", "py")]
    s, t = G.side(*b, a[0], a[1]), G.side(*b, a[2], a[3])
    u, v = G.side(*a, b[0], b[1]), G.side(*a, b[2], b[3])
    # Sides are twice areas: an end within a micrometre of the other line touches it and doesn't cross.
    la, lb = F.hypot(a[2] - a[0], a[3] - a[1]) * 1e-6, F.hypot(b[2] - b[0], b[3] - b[1]) * 1e-6
    proper = (F.signum(s) * F.signum(t) < 0) & (F.signum(u) * F.signum(v) < 0) & (F.least(F.abs(s), F.abs(t)) > lb) & (F.least(F.abs(u), F.abs(v)) > la)
    at = s / (s - t)
    hit = pairs.where(first & proper)
    return hit.select("run", F.col("a_node").alias("a"), F.col("b_node").alias("b"), (a[0] + at * (a[2] - a[0])).alias("x"), (a[1] + at * (a[3] - a[1])).alias("y"))


def placed(forest: DataFrame, places: DataFrame) -> DataFrame:
    """forest with the places (x, y, px, py) and distances (d, pd) of both ends, and whose obstacle an edge may leave. places: node, x, y, d, own."""
    up = places.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("d").alias("pd"))
    return forest.join(places.select("node", "x", "y", "d", "own"), "node").join(up, "parent").select("run", "node", "parent", "x", "y", "px", "py", "d", "pd", "own")


def uncross(lines: DataFrame, ends: DataFrame, work: Workspace, cell: float = 50.0) -> DataFrame:
    """Edges (run, node, parent, x, y, px, py, d, pd, own) without crossings; what leads to no terminal any more is dropped.

    own: the obstacle that an edge may leave; what an edge is cut into keeps it.
    """
    lines, at = work.write(lines, "lines-0"), 0
    while True:
        met = crossings(lines, cell).withColumn("key", F.struct(F.xxhash64("a", "b").alias("h"), "a", "b"))
        now = _apart(work.write(met, f"met-{at}")).withColumn("cross", F.concat_ws(":", F.lit("cross"), F.lit(str(at)), F.xxhash64("run", "a", "b").cast("string"), "a"))
        end = lambda s: lines.select("run", F.col("node").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in ("parent", "px", "py", "pd", "own")])
        now = now.join(end("a"), ["run", "a"]).join(end("b"), ["run", "b"])
        far = lambda s: F.col(f"{s}_pd") + F.hypot(F.col("x") - F.col(f"{s}_px"), F.col("y") - F.col(f"{s}_py"))
        use = (far("a") < far("b")) | ((far("a") == far("b")) & (F.col("a") < F.col("b")))
        pick = lambda n: F.when(use, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")).alias(n)
        now = work.write(now.select("run", "a", "b", "cross", "x", "y", pick("parent"), pick("px"), pick("py"), pick("pd"), pick("own"), F.least(far("a"), far("b")).alias("d")), f"repairs-{at}")
        if now.isEmpty():  # the least key of all is always chosen, so nothing crosses any more
            return work.write(_alive(lines, ends), "uncrossed")
        moved = now.select("run", F.explode(F.array("a", "b")).alias("node"), F.col("cross").alias("_to"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("d").alias("_d"))
        kept = lines.join(moved, ["run", "node"], "left")
        new = lambda old, n: F.coalesce(n, old).alias(old)
        kept = kept.select("run", "node", new("parent", "_to"), "x", "y", new("px", "_x"), new("py", "_y"), "d", new("pd", "_d"), "own")
        every = kept.unionByName(now.select("run", F.col("cross").alias("node"), "parent", "x", "y", "px", "py", "d", "pd", "own"))
        # Ends of dead branches go at once; what is left of them goes at the end.
        held = every.select("run", F.col("parent").alias("node")).unionByName(ends.select("run", "node")).distinct()
        at += 1
        lines = work.write(every.join(held, ["run", "node"], "left_semi"), f"lines-{at}")


def _apart(met: DataFrame) -> DataFrame:
    """Crossings of which no two share an edge: those whose key is least for both of their edges."""
    of = met.select("run", F.explode(F.array("a", "b")).alias("node"), "key").groupBy("run", "node").agg(F.min("key").alias("least"))
    side = lambda s: of.select("run", F.col("node").alias(s), F.col("least").alias(f"_{s}"))
    return met.join(side("a"), ["run", "a"]).join(side("b"), ["run", "b"]).where("_a = key AND _b = key").select("run", "a", "b", "x", "y")


def _clear(ways: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """The rows of ways (way, own, x, y, fx, fy) whose segment enters no piece but of its own obstacle."""
    box = {"x0": F.least("x", "fx"), "y0": F.least("y", "fy"), "x1": F.greatest("x", "fx"), "y1": F.greatest("y", "fy")}
    near = O.dealt(ways.withColumns(box), cell).join(O.dealt(parts.select("obstacle", "px", "py", *[F.col(n).alias(f"p_{n}") for n in ("x0", "y0", "x1", "y1")]), cell, "p_x0", "p_y0", "p_x1", "p_y1"), ["cx", "cy"])
    near = near.where("x0 <= p_x1 AND x1 >= p_x0 AND y0 <= p_y1 AND y1 >= p_y0").where(~F.col("own").eqNullSafe(F.col("obstacle")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                shapes = np.stack([np.stack(b["px"].to_list()), np.stack(b["py"].to_list())], -1)
                hit = enters(b[["x", "y"]].to_numpy(float), b[["fx", "fy"]].to_numpy(float), shapes)
                yield b.loc[hit, ["way"]]

    blocked = near.select("way", "x", "y", "fx", "fy", "px", "py").mapInPandas(run, "way string").distinct()
    return ways.join(blocked, "way", "left_anti")


def branch_off(lines: DataFrame, waiting: DataFrame, parts: DataFrame, work: Workspace, cell: float = 25.0) -> DataFrame:
    """lines with an edge for each terminal of waiting (run, node, x, y, own, d) that can reach one of them straight on.

    Where all nodes near a terminal are full, a chamber on the nearest clear edge takes it, at least a metre from the edge's ends.
    An edge gets one chamber a round, for the terminal nearest to it. Rounds search in cells of twice the size each when nothing is found, until a
    cell holds all. A terminal has nothing hanging on it, so no cycle can come of it.
    """
    at, lines, waiting = 0, work.write(lines, "branch-lines-0"), work.write(waiting, "branch-waiting-0")
    extent = lines.agg(*[f(g(a, b)) for a, b in (("x", "px"), ("y", "py")) for f, g in ((F.max, F.greatest), (F.min, F.least))]).first()
    if extent[0] is None:
        return lines
    extent = max(extent[0] - extent[1], extent[2] - extent[3]) + cell
    while not waiting.isEmpty():
        around = {"x0": F.least("ax", "bx") - cell, "y0": F.least("ay", "by") - cell, "x1": F.greatest("ax", "bx") + cell, "y1": F.greatest("ay", "by") + cell}
        edges = lines.select("run", F.col("node").alias("on"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("px").alias("bx"), F.col("py").alias("by"))
        edges = O.dealt(edges.withColumns(around), cell).drop(*around)
        met = O.spot(waiting, cell).join(edges, ["run", "cx", "cy"]).where("node <> on")
        t, fx, fy = G.nearest_on_segment(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
        met = met.withColumns({"fx": fx, "fy": fy}).withColumn("w", F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))).where(F.col("w") <= cell)
        met = met.where((F.hypot(F.col("fx") - F.col("ax"), F.col("fy") - F.col("ay")) >= 1) & (F.hypot(F.col("fx") - F.col("bx"), F.col("fy") - F.col("by")) >= 1))
        met = work.write(met.withColumn("way", F.concat_ws("|", "run", "node", "on")), f"branch-met-{at}")
        best = _clear(met, parts, cell).groupBy("run", "node", "x", "y", "d", "own").agg(F.min(F.struct("w", "on", "fx", "fy")).alias("b"))
        first = best.withColumn("_r", F.row_number().over(Window.partitionBy("run", "b.on").orderBy("b.w", "node"))).where("_r = 1")
        now = work.write(first.select("run", "node", "x", "y", "d", "own", "b.on", "b.fx", "b.fy", F.concat_ws(":", F.lit("branch"), F.lit(str(at)), "node").alias("chamber")), f"branch-now-{at}")
        at += 1
        if now.isEmpty():
            if cell > 2 * extent:
                return lines
            cell *= 2
            continue
        cut = lines.join(now.select("run", F.col("on").alias("node"), "chamber", "fx", "fy"), ["run", "node"])
        way = F.col("pd") + F.hypot(F.col("fx") - F.col("px"), F.col("fy") - F.col("py"))
        upper = cut.select("run", F.col("chamber").alias("node"), "parent", F.col("fx").alias("x"), F.col("fy").alias("y"), "px", "py", way.alias("d"), "pd", "own")
        lower = cut.select("run", "node", F.col("chamber").alias("parent"), "x", "y", F.col("fx").alias("px"), F.col("fy").alias("py"), "d", way.alias("pd"), "own")
        fresh = now.join(upper.select("run", F.col("node").alias("chamber"), F.col("d").alias("pd")), ["run", "chamber"])
        hung = F.col("pd") + F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy"))
        fresh = fresh.select("run", "node", F.col("chamber").alias("parent"), "x", "y", F.col("fx").alias("px"), F.col("fy").alias("py"), hung.alias("d"), "pd", "own")
        rest = lines.join(cut.select("run", "node"), ["run", "node"], "left_anti")
        waiting = work.write(waiting.join(now.select("run", "node"), ["run", "node"], "left_anti"), f"branch-waiting-{at}")
        lines = work.write(rest.unionByName(upper).unionByName(lower).unionByName(fresh), f"branch-lines-{at}")
    return lines


def diameters(parent: dict, length: dict, flow: dict) -> dict:
    """Diameter of the edge above each node: by flow, never falling on the way up, then runs that are too long raised whole.

    A run is what has one diameter on a path from the root to a leaf. Leaves are tried in order; after a run was raised, the leaves
    below it are tried again, the first one first.
    """
    table = [(r[0], r[1], r[2]) for r in D.DIAMETERS]
    children: dict = {}
    for n in sorted(parent):
        children.setdefault(parent[n], []).append(n)
    order, first, last, leaves = [], {}, {}, []
    stack = [(r, False) for r in sorted((p for p in children if p not in parent), reverse=True)]
    while stack:
        n, done = stack.pop()
        if done:
            last[n] = len(leaves)
            continue
        first[n] = len(leaves)
        if n in parent:
            order.append(n)
        if n not in children:
            leaves.append(n)
        stack.append((n, True))
        stack += [(c, False) for c in reversed(children.get(n, []))]
    step = {n: next((i for i, r in enumerate(table) if r[1] >= flow[n]), len(table) - 1) for n in order}
    for n in reversed(order):
        if parent[n] in step:
            step[parent[n]] = max(step[parent[n]], step[n])
    waiting = list(range(len(leaves)))
    queued = set(waiting)
    while waiting:
        leaf = heapq.heappop(waiting)
        queued.discard(leaf)
        path, n = [], leaves[leaf]
        while n in parent:
            path.append(n)
            n = parent[n]
        path.reverse()
        begin = 0
        while begin < len(path):
            size, end, total = step[path[begin]], begin, 0.0
            while end < len(path) and step[path[end]] == size:
                total += length[path[end]]
                end += 1
            if total > table[size][2] + 1e-6 and size < len(table) - 1:
                for n in path[begin:end]:
                    step[n] += 1
                for k in range(first[path[begin]], last[path[begin]]):
                    if k not in queued:
                        queued.add(k)
                        heapq.heappush(waiting, k)
                break
            begin = end
    return {n: table[i][0] for n, i in step.items()}


def rise(tree: pd.DataFrame) -> pd.DataFrame:
    """(run, node, dn) of one tree's edges (run, node, parent, length, flow); a tree has no more leaves than its pipe's capacity feeds."""
    of = lambda c: dict(zip(tree["node"], tree[c], strict=True))
    dn = diameters(of("parent"), of("length"), of("flow"))
    return pd.DataFrame({"run": tree["run"], "node": tree["node"], "dn": [dn[n] for n in tree["node"]]})


def sized(lines: DataFrame, flows: DataFrame) -> DataFrame:
    """lines with root, length, flow, dn and cost. flows: run, node, flow of the terminals."""
    named = lambda c: F.concat_ws("|", F.col("run").cast("string"), c)
    keyed = lines.withColumn("_n", named("node")).withColumn("_p", named("parent"))
    tops = keyed.select(F.col("_p").alias("node")).join(keyed.select(F.col("_n").alias("node")), "node", "left_anti").distinct()
    tree = keyed.select(F.col("_n").alias("node"), F.col("_p").alias("parent")).unionByName(tops.select("node", F.lit(None).cast("string").alias("parent")))
    mine = flows.select(named("node").alias("node"), F.col("flow").alias("own_flow"))
    total = trees.rollup(tree.join(mine, "node", "left"), "own_flow").select(F.col("node").alias("_n"), F.col("total").alias("flow"), F.split("root", r"\|")[1].alias("root"))
    length = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    known = keyed.join(total, "_n").drop("_n", "_p").withColumn("length", length)
    known = Workspace(lines.sparkSession, "sized").write(known, "known")
    # Runs are held against their limits in whole centimetres, as results state them.
    stated = (F.floor(F.col("length") * 100 + 0.5) / 100).alias("length")
    dn = known.select("run", "root", "node", "parent", stated, "flow").groupBy("run", "root").applyInPandas(rise, "run long, node string, dn int")
    price = F.create_map(*[F.lit(x) for r in D.DIAMETERS for x in (r[0], float(r[3]))])
    return known.join(dn, ["run", "node"]).withColumn("cost", F.floor(F.col("length") * price[F.col("dn")] + 0.5).cast("double"))
