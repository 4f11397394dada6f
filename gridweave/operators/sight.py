"""Which nodes see each other past buffers: the edges of the visibility graph that ways to a tie-in point need, as a table.

Rounds of twice the radius each: nodes are dealt to tiles twice as wide as the radius, with the pieces and nodes within the
radius of them, and each looks for nodes in the ring between the last radius and this. A node leaves the rounds once the
pieces within the radius hide every direction in which there are nodes at all (none lie outside the box of all nodes), or once it knows a way to a tie-in point that is no longer than the radius: a
longer edge is on no shortest way from it. The others go on until the radius holds all data. Tiles with many nodes that still
look are dealt to several tasks.

A way turns at a corner only around its buffer, so a corner looks where its own buffer lies neither ahead nor behind, and two corners are
joined only if that holds for both; terminals look all around. Of nodes in one line the nearest counts, as the way to the
others leads through it. Tie-in points don't look, and nothing looks for terminals: they are where ways begin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import obstacles as O
from gridweave.operators.storage import Workspace

#: How many pieces the first round's circles hold in the mean, and how many nodes of a tile look in one task.
AT_FIRST, LOOKERS = 40, 128
SEEN = "node string, other string, w double, open boolean, goes boolean"


def enters(a: np.ndarray, b: np.ndarray, shapes: np.ndarray, skin: float = O.SKIN) -> np.ndarray:
    """Whether each segment from a to b (n x 2) enters its own convex shape (n x k x 2, turning left)."""
    step = np.roll(shapes, -1, axis=1) - shapes
    size = np.hypot(step[..., 0], step[..., 1])
    flat = size < 1e-9
    size = np.where(flat, 1.0, size)
    nx, ny = np.where(flat, 0.0, -step[..., 1] / size), np.where(flat, 0.0, step[..., 0] / size)
    off = nx * shapes[..., 0] + ny * shapes[..., 1] + np.where(flat, -1.0, skin)
    s = a[:, :1] * nx + a[:, 1:] * ny - off
    e = b[:, :1] * nx + b[:, 1:] * ny - off
    with np.errstate(divide="ignore", invalid="ignore"):
        t = s / (s - e)
    low = np.where((s <= 0) & (e > 0), t, 0.0).max(1)
    high = np.where((s > 0) & (e <= 0), t, 1.0).min(1)
    return (low < high) & ~((s <= 0) & (e <= 0)).any(1)


def bearings(p: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The directions from a point between which each convex shape lies, the first in 0 to a full turn."""
    middle = shapes.mean(1) - p
    middle = np.arctan2(middle[:, 1], middle[:, 0])
    dx, dy = shapes[..., 0] - p[0], shapes[..., 1] - p[1]
    turn = (np.arctan2(dy, dx) - middle[:, None] + np.pi) % (2 * np.pi) - np.pi
    turn = np.where(np.hypot(dx, dy) < 1e-6, 0.0, turn)
    low = (middle + turn.min(1)) % (2 * np.pi)
    return low, low + (turn.max(1) - turn.min(1))


def on_border(p: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Whether a point outside the insides of convex shapes touches each."""
    step = np.roll(shapes, -1, axis=1) - shapes
    size = np.hypot(step[..., 0], step[..., 1])
    depth = step[..., 0] * (p[1] - shapes[..., 1]) - step[..., 1] * (p[0] - shapes[..., 0])
    return (depth >= -1e-6 * size).all(1)


def hides(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions that segments from a to b hide, as far as these lie in the circle."""
    d, f = b - a, a - p
    square, half, rest = (d * d).sum(1), (d * f).sum(1), (f * f).sum(1) - radius * radius
    inside = half * half - square * rest
    with np.errstate(divide="ignore", invalid="ignore"):
        root = np.sqrt(np.maximum(inside, 0.0))
        t, u = np.maximum((-half - root) / square, 0.0), np.minimum((-half + root) / square, 1.0)
    good = (inside > 0) & (square > 0) & (t < u)
    a, b = (f + t[:, None] * d)[good], (f + u[:, None] * d)[good]
    one, two = np.arctan2(a[:, 1], a[:, 0]), np.arctan2(b[:, 1], b[:, 0])
    turn = (two - one + np.pi) % (2 * np.pi) - np.pi
    low = np.where(turn < 0, two, one) % (2 * np.pi)
    return low, low + np.abs(turn)


def cover(p: np.ndarray, shapes: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions that pieces hide within the radius: those of their middle lines, as far as these lie in the circle.

    A piece's points 7 and 2 are the ends of its middle line; pieces without an inside hide nothing.
    """
    a, b = shapes[:, 7], shapes[:, 2]
    a, b = a + 1e-3 * (b - a), b - 1e-3 * (b - a)
    wide = np.hypot(*(shapes[:, 0] - shapes[:, 4]).T) > 1e-3
    return hides(p, a[wide], b[wide], radius)


def hidden(low: np.ndarray, high: np.ndarray) -> bool:
    """Whether intervals of bearings leave no direction open; directions along sides are open, so intervals must overlap."""
    if len(low) < 2:
        return False
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    end = max(high[-1] - 2 * np.pi, 0.0)  # how far intervals that pass the full turn reach into the next
    before = np.concatenate([[end], np.maximum(high[:-1], end)])
    return bool((low < before - 1e-7).all() and high[-1] > 2 * np.pi + low[0] + 1e-7)


def within(bearing: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each bearing, of 0 to a full turn, lies inside one of the intervals."""
    if not len(low):
        return np.zeros(len(bearing), bool)
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    out = np.zeros(len(bearing), bool)
    for b in (bearing, bearing + 2 * np.pi):
        at = np.searchsorted(low, b - 1e-9) - 1
        out |= (at >= 0) & (high[at] > b + 1e-9)
    return out


def runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each number in it, for many ranges."""
    size = np.maximum(end - begin, 0)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _seen(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], going_on: list[tuple[str, bool]]) -> pd.DataFrame:
    """Rows (node, other, w), and for every node that pieces don't hide a row with `open` and `goes`: whether it goes on."""
    node, other, w = (np.concatenate([f[k] for f in found]) if found else np.empty(0, str if k < 2 else float) for k in range(3))
    n, m = len(node), len(going_on)
    names = lambda values: pd.Series(values, dtype=object)
    goes = np.append(np.zeros(n, bool), np.array([g for _, g in going_on], bool))
    return pd.DataFrame({"node": names([*node.tolist(), *(g for g, _ in going_on)]), "other": names([*other.tolist(), *[None] * m]), "w": np.append(w, np.full(m, np.nan)), "open": np.arange(n + m) >= n, "goes": goes})


def walls(box: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The sides of a box (x0, y0, x1, y1) that holds all nodes, a metre away and with their ends a metre further: nothing lies beyond."""
    x0, y0, x1, y1 = box[0] - 1, box[1] - 1, box[2] + 1, box[3] + 1
    ends = np.array([(x0, y0 - 1, x0, y1 + 1), (x1, y0 - 1, x1, y1 + 1), (x0 - 1, y0, x1 + 1, y0), (x0 - 1, y1, x1 + 1, y1)])
    return ends[:, :2], ends[:, 2:]


def _look(rows: pd.DataFrame, inner: float, radius: float, box: tuple[float, float, float, float]) -> pd.DataFrame:
    """What the looking nodes of a tile see in the ring, and which of them go on. box: holds the nodes of all tiles."""
    is_node = rows["px"].isna()
    nodes, parts = rows[is_node].reset_index(drop=True), rows[~is_node]
    looking = nodes.index[nodes["looks"].astype(bool)].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    going_on: list[tuple[str, bool]] = []
    if not len(looking):
        return _seen(found, going_on)
    at, names = nodes[["x", "y"]].to_numpy(float), nodes["name"].to_numpy(str)
    searching = nodes["searches"].to_numpy(bool)
    kinds, opens, own = nodes["kind"].to_numpy(str), nodes["open"].to_numpy(bool), nodes["obstacle"].to_numpy(float)
    corner = kinds == "corner"
    rank = np.argsort(np.argsort(names))
    shapes = np.stack([np.stack(parts["px"].to_list()), np.stack(parts["py"].to_list())], -1) if len(parts) else np.zeros((0, 10, 2))
    of = parts["obstacle"].to_numpy(float)
    low, high = shapes.min(1), shapes.max(1)
    turn = 2 * np.pi
    sides = walls(box)
    touching: dict[int, np.ndarray] = {}

    def own_shapes(j: int) -> np.ndarray:
        """The pieces that a node lies on."""
        if j not in touching:
            touching[j] = np.flatnonzero(((low <= at[j] + 2e-3) & (high >= at[j] - 2e-3)).all(1))
        return touching[j]

    for i in looking:
        p = at[i]
        apart = np.hypot(*(at - p).T)
        gap = np.maximum(np.maximum(low - p, p - high), 0.0)
        near = np.hypot(gap[:, 0], gap[:, 1])
        touched = np.flatnonzero((near <= radius) & (of != own[i]))
        first, last = bearings(p, shapes[touched])
        close = near[touched] < 1e-6  # the box holds the point; whether the piece does is looked at closely
        close[close] = on_border(p, shapes[touched[close]])
        # Of two corners that look, the first looks for the other.
        to = np.flatnonzero((apart > inner) & (apart <= radius) & opens & (kinds != "terminal") & ((rank > rank[i]) | ~searching | (not corner[i])))
        to = to[to != i]
        if corner[i]:
            # Behind a buffer that the corner belongs to, a line would run on into it.
            mine_too = close
            back = (first[mine_too] + np.pi) % turn, (first[mine_too] + np.pi) % turn + last[mine_too] - first[mine_too]
            ahead = np.arctan2(*(at[to] - p).T[::-1]) % turn
            useless = np.zeros(len(to), bool)
            for lo, hi in zip(*back, strict=True):
                useless |= ((ahead > lo + 1e-9) & (ahead < hi - 1e-9)) | (ahead + turn < hi - 1e-9)
            to = to[~useless]
        else:
            back = np.empty(0), np.empty(0)
        if len(to):
            mine = np.arctan2(*(at[to] - p).T[::-1]) % turn
            order = np.argsort(mine)
            to, mine = to[order], mine[order]
            if inner:
                behind = within(mine, *cover(p, shapes[touched], inner))
                to, mine = to[~behind], mine[~behind]
        if len(to):
            # A shape can only hide what lies in its directions, and not what is nearer than it.
            twice = np.concatenate([mine, mine + turn])
            shape, k = runs(np.searchsorted(twice, first - 1e-9), np.searchsorted(twice, last + 1e-9))
            shape, k = touched[shape], k % len(to)
            met = (near[shape] < apart[to[k]]) & (of[shape] != own[to[k]])
            shape, k = shape[met], k[met]
            free = np.ones(len(to), bool)
            nearest = np.argsort(near[shape], kind="stable")
            shape, k = shape[nearest], k[nearest]
            for begin in range(0, len(k), 20_000):
                some = slice(begin, begin + 20_000)
                live = free[k[some]]
                kk, ss = k[some][live], shape[some][live]
                free[kk[enters(np.broadcast_to(p, (len(kk), 2)), at[to[kk]], shapes[ss])]] = False
            to, mine = to[free], mine[free]
        if len(to):
            # Between corners, a line that would run on into a buffer beyond the other is of no use either.
            way = (at[to] - p) / apart[to][:, None]
            some = [own_shapes(j) for j in to] if corner[i] else []
            k, shape = np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate([*some, to[:0]])
            off = np.zeros(len(to), bool)
            k, shape = (g[corner[to[k]]] for g in (k, shape))
            off[k[enters(at[to[k]], at[to[k]] + way[k] * 1e-3, shapes[shape])]] = True
            to, mine = to[~off], mine[~off]
        if len(to):
            # A corner in between stands in the way: two shorter edges lead through it.
            turns = np.flatnonzero(corner & (apart > 1e-9) & (apart <= radius))
            bearing = np.arctan2(*(at[turns] - p).T[::-1]) % turn
            order = np.argsort(bearing)
            turns, bearing = turns[order], bearing[order]
            k, m = runs(np.searchsorted(bearing, mine - 1e-7), np.searchsorted(bearing, mine + 1e-7))
            between = (apart[turns[m]] < apart[to[k]] - 1e-6) & (apart[turns[m]] * np.abs(bearing[m] - mine[k]) < 1e-6)
            free = np.ones(len(to), bool)
            free[k[between]] = False
            to = to[free]
        found.append((np.repeat(names[i], len(to)), names[to], apart[to]))
        lines = cover(p, shapes[touched], radius)
        begin, end = np.concatenate([lines[0], first[close], back[0]]), np.concatenate([lines[1], last[close], back[1]])
        if not hidden(begin, end):
            # Whoever only looks out past all nodes stays in sight of others, but has no more to find.
            outer = hides(p, *sides, radius)
            going_on.append((names[i], not hidden(np.append(begin, outer[0]), np.append(end, outer[1]))))
    return _seen(found, going_on)


def _looker(inner: float, radius: float, box: tuple[float, float, float, float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def look(rows: pd.DataFrame) -> pd.DataFrame:
        return _look(rows, inner, radius, box)

    return look


def graph(nodes: DataFrame, parts: DataFrame, work: Workspace, layered: int | None = None) -> DataFrame:
    """(node, other, w), each pair once, of nodes (node, kind: tie, terminal or corner, x, y, own) outside all buffers but their own.

    layered: how many pieces there are with those that are left out of parts because others hide them; they set the first radius.
    """
    box = nodes.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))]).first()
    if box["x0"] is None:
        return nodes.sparkSession.createDataFrame([], "node string, other string, w double")
    extent = float(np.hypot(box["x1"] - box["x0"], box["y1"] - box["y0"])) + 1.0
    area = max(box["x1"] - box["x0"], 1.0) * max(box["y1"] - box["y0"], 1.0)
    first = min(extent, (AT_FIRST * area / (np.pi * max(parts.count() if layered is None else layered, 1))) ** 0.5)
    spark = nodes.sparkSession
    tasks = O.tasks(spark)
    # open: not known to be hidden all around; searches: open and without a way as short as the radius.
    state = nodes.withColumn("open", F.lit(True)).withColumn("searches", F.col("kind") != "tie")
    found, inner, radius, at = None, 0.0, float(first), 0
    while True:
        # Tiles around every searching node; the tile itself is where it looks from.
        named = state
        tile = 2 * radius
        look = O.spot(named.where("searches"), tile)
        crowd = look.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / LOOKERS).cast("int").alias("shares"))
        around = [F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius]
        near = named.withColumns(dict(zip(("x0", "y0", "x1", "y1"), around, strict=True)))
        base = lambda kind: [F.lit(None).cast("double").alias(n) if kind == "piece" else F.col(n) for n in ("x", "y")]
        node_rows = O.dealt(near, tile).join(crowd, ["cx", "cy"]).select(
            "cx", "cy", "shares", F.col("node").alias("name"), "kind", "open", "searches", F.col("own").cast("double").alias("obstacle"), *base("node"), F.lit(None).cast("array<double>").alias("px"), F.lit(None).cast("array<double>").alias("py"),
            ((F.floor(F.col("x") / tile) == F.col("cx")) & (F.floor(F.col("y") / tile) == F.col("cy")) & F.col("searches")).alias("here"),
        )
        grown = parts.withColumns({"x0": F.col("x0") - radius, "y0": F.col("y0") - radius, "x1": F.col("x1") + radius, "y1": F.col("y1") + radius})
        piece_rows = O.dealt(grown, tile).join(crowd, ["cx", "cy"]).select(
            "cx", "cy", "shares", F.lit(None).cast("string").alias("name"), F.lit("piece").alias("kind"), F.lit(False).alias("open"), F.lit(False).alias("searches"), F.col("obstacle").cast("double").alias("obstacle"), *base("piece"), "px", "py", F.lit(False).alias("here"),
        )
        rows = node_rows.unionByName(piece_rows).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        rows = rows.withColumn("looks", F.col("here") & (F.pmod(F.xxhash64("name"), F.col("shares")) == F.col("share"))).drop("here", "shares")
        dealt = rows.repartition(tasks, "cx", "cy", "share").groupBy("cx", "cy", "share")
        seen = work.write(dealt.applyInPandas(_looker(inner, radius, tuple(box)), SEEN), f"ring-{at}")
        edges = seen.where("other IS NOT NULL").select("node", "other", "w")
        found = edges if found is None else found.unionByName(edges)
        on = seen.where("open").select("node", F.lit(True).alias("_on"), F.col("goes").alias("_goes"))  # a node looks in one task
        # The shortest known way: to a tie-in point in sight, or past one node that has one in sight. Only of nodes that still search.
        mine = state.where("searches").select("node")
        both = found.unionByName(found.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
        direct = both.where("other LIKE 'tie:%'").groupBy("node").agg(F.min("w").alias("_w"))
        past = both.join(mine, "node", "left_semi").join(direct.withColumnsRenamed({"node": "other", "_w": "_o"}), "other").groupBy("node").agg(F.min(F.col("w") + F.col("_o")).alias("_p"))
        known = mine.join(on, "node", "left").join(direct, "node", "left").join(past, "node", "left")
        short = F.coalesce(F.least("_w", "_p") <= radius, F.lit(False))
        known = known.select("node", F.coalesce("_on", F.lit(False)).alias("_open"), (F.coalesce("_goes", F.lit(False)) & ~short).alias("_on"))
        at += 1
        state = work.write(state.join(known, "node", "left").select(*nodes.columns, F.coalesce("_open", "open").alias("open"), F.coalesce("_on", F.lit(False)).alias("searches")), f"nodes-{at}")
        if radius >= extent or state.where("searches").isEmpty():
            return found
        inner, radius = radius, radius * 2
