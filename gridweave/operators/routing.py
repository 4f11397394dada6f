"""Routes around obstacles for many districts at once: one Arrow group a district, a numpy kernel inside.

A district's obstacles are boxes that routes may touch but not enter. Its vertices are the boxes' corners, terminals and tie-in
points; edges are the pairs that see each other. What a vertex sees is worked out when a path first comes through it, in
widening circles, until the boxes within hide everything beyond. Where a district has a square, its routes stay in it; what it can't join but
might be joined beyond its sides is left to a wider district. The tree grows by attaching the terminal nearest to what is built; flows
add up towards the tie-in and decide diameters, which never fall on the way up.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.forest import diameters
from gridweave.sources import dimensions as D

ROUTES = "district long, edge long, from_node string, to_node string, x0 double, y0 double, x1 double, y1 double, flow double, dn int, length double, cost double"
ATTEMPT = f"{ROUTES}, waits long"


def visible(a: np.ndarray, b: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For pairs of points whether the segment between them misses the inside of all boxes (n x 4)."""
    if not len(boxes):
        return np.ones(len(a), bool)
    low, high = np.zeros((len(a), len(boxes))), np.ones((len(a), len(boxes)))
    outside = np.zeros_like(low, bool)
    for axis in (0, 1):
        start, step = a[:, None, axis], (b - a)[:, None, axis]
        least, most = boxes[None, :, axis], boxes[None, :, axis + 2]
        still = step == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (least - start) / step, (most - start) / step
        low = np.where(still, low, np.maximum(low, np.minimum(p, q)))
        high = np.where(still, high, np.minimum(high, np.maximum(p, q)))
        outside |= still & ((start <= least) | (start >= most))
    return (outside | (low >= high - 1e-9)).all(axis=1)


def past_all(p: np.ndarray, span: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions that lead within the radius past a metre beyond a side of span (x0, y0, x1, y1), which holds all points there are."""
    gap = np.array([span[2] - p[0], span[3] - p[1], p[0] - span[0], p[1] - span[1]]) + 1.0
    good = (gap > 0) & (gap < radius)
    half = np.arccos(gap[good] / radius)
    low = (np.arange(4)[good] * np.pi / 2 - half) % (2 * np.pi)
    return low, low + 2 * half


def hidden_beyond(p: np.ndarray, boxes: np.ndarray, past: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))) -> bool:
    """Whether boxes around a point, and directions in which there's nothing (past), leave none open. Directions along sides are open, so intervals must overlap."""
    outside = boxes[~((boxes[:, 0] < p[0]) & (p[0] < boxes[:, 2]) & (boxes[:, 1] < p[1]) & (p[1] < boxes[:, 3]))]
    if len(outside) < len(boxes):
        return True  # inside one
    if len(outside) + len(past[0]) < 2:
        return False
    middle = np.arctan2((outside[:, 1] + outside[:, 3]) / 2 - p[1], (outside[:, 0] + outside[:, 2]) / 2 - p[0])
    dx, dy = outside[:, [0, 2, 2, 0]] - p[0], outside[:, [1, 1, 3, 3]] - p[1]
    turn = np.arctan2(dy, dx) - middle[:, None]
    turn = np.where((dx == 0) & (dy == 0), 0.0, (turn + np.pi) % (2 * np.pi) - np.pi)
    low = (middle + turn.min(axis=1)) % (2 * np.pi)
    low, high = np.append(low, past[0]), np.append(low + (turn.max(axis=1) - turn.min(axis=1)), past[1])
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    end = max(high[-1] - 2 * np.pi, 0.0)  # how far intervals that pass the full turn reach into the next
    before = np.concatenate([[end], np.maximum(high[:-1], end)])
    return bool((low < before - 1e-9).all() and high[-1] > 2 * np.pi + low[0] + 1e-9)


def sees(p: np.ndarray, points: np.ndarray, boxes: np.ndarray, start: float = 50.0, span: np.ndarray | None = None, within: float = np.inf) -> np.ndarray | None:
    """Indices of the points in sight of p, by circles of twice the radius each; boxes nearer by are tried first.

    span: the box that holds all points. within: how far points and boxes are given; None if p may see farther.
    """
    far = np.hypot(*(points - p).T)
    if span is None and len(points):
        span = np.concatenate([points.min(axis=0), points.max(axis=0)])
    dx, dy = (np.maximum(np.maximum(boxes[:, k] - p[k], p[k] - boxes[:, k + 2]), 0.0) for k in (0, 1))
    near, most = np.hypot(dx, dy), np.hypot(*(np.maximum(np.abs(boxes[:, k] - p[k]), np.abs(boxes[:, k + 2] - p[k])) for k in (0, 1)))
    order = np.argsort(near, kind="stable")
    boxes, near, most = boxes[order], near[order], most[order]
    found, inner, radius = [], -1.0, start
    while radius <= within:
        left = np.flatnonzero((far > inner) & (far <= radius))
        until, at, width = int(np.searchsorted(near, radius, "right")), 0, 16
        while at < until and len(left):
            some = boxes[at : min(at + width, until)]
            left = left[visible(np.broadcast_to(p, (len(left), 2)), points[left], some)]
            at, width = at + width, width * 2
        found.append(left)
        if within == np.inf and (not len(far) or radius >= far.max()) or hidden_beyond(p, boxes[:until][most[:until] <= radius], past_all(p, span, radius)):
            return np.concatenate(found)
        inner, radius = radius, radius * 2
    return None


#: How far a vertex looks at first, in metres: of many points and boxes, most are farther than it sees.
WINDOWS = (100.0, 400.0)


class Sight:
    """What each of some points sees, with distances, worked out once when asked for."""

    def __init__(self, points: np.ndarray, boxes: np.ndarray):
        self.points, self.boxes, self.known = points, boxes, {}
        self.span = np.concatenate([points.min(axis=0), points.max(axis=0)]) if len(points) else np.zeros(4)
        self.x, self.y = (np.ascontiguousarray(points[:, k]) for k in (0, 1))
        self.sides = [np.ascontiguousarray(boxes[:, k]) for k in range(4)]

    def _seen(self, p: np.ndarray) -> np.ndarray:
        for far in WINDOWS if len(self.points) > 500 else ():
            some = np.flatnonzero((np.abs(self.x - p[0]) <= far) & (np.abs(self.y - p[1]) <= far))
            x0, y0, x1, y1 = self.sides
            around = (x0 <= p[0] + far) & (x1 >= p[0] - far) & (y0 <= p[1] + far) & (y1 >= p[1] - far)
            seen = sees(p, self.points[some], self.boxes[around], span=self.span, within=far)
            if seen is not None:
                return some[seen]
        return sees(p, self.points, self.boxes, span=self.span)

    def __call__(self, v: int) -> list[tuple[int, float]]:
        if v not in self.known:
            seen = self._seen(self.points[v])
            seen = seen[seen != v]
            self.known[v] = list(zip(seen.tolist(), np.hypot(*(self.points[seen] - self.points[v]).T).tolist(), strict=True))
        return self.known[v]


def shortest(neighbours, sources: list[int], closed) -> tuple[dict[int, float], dict[int, int]]:
    """Distance of each reachable node to the nearest source and the step towards it; nodes in closed end paths but don't pass them on."""
    paths = Paths(neighbours, sources)
    for _ in paths.settle(closed):
        pass
    return paths.distance, paths.back


class Paths:
    """Shortest paths from sources; nodes come out by distance, as far as they are asked for."""

    def __init__(self, neighbours, sources: list[int]):
        self.neighbours, self.distance, self.back = neighbours, dict.fromkeys(sources, 0.0), {}
        self.heap = [(0.0, s) for s in sorted(sources)]

    def settle(self, closed):
        while self.heap:
            d, v = heapq.heappop(self.heap)
            if d > self.distance[v]:
                continue
            if v not in closed or d == 0:
                for u, w in self.neighbours(v):
                    if d + w < self.distance.get(u, np.inf):
                        self.distance[u], self.back[u] = d + w, v
                        heapq.heappush(self.heap, (d + w, u))
            yield v


class _Either:
    """What lies in one of two containers, as they are when it's asked."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __contains__(self, v: int) -> bool:
        return v in self.a or v in self.b


def grow(neighbours, roots: list[int], terminals: list[int], most: int = D.MAX_DEGREE, used: dict[int, int] | None = None, started: dict[int, tuple] | None = None, absent: list[int] | tuple = ()) -> dict[int, int]:
    """Parents of the nodes of a forest from the roots that reaches every terminal it can; terminals don't pass flow on.

    The terminal nearest to the forest is attached first. Each terminal seeks the forest from its side, so only its
    surroundings are looked at; what joins the forest later may be nearer, and only where a node on the way has all its
    branches is a search repeated. Which searches came past a node is kept, so a step looks at these alone. used: branches
    that roots have already. absent: further terminals, not served; no way turns at them. started: first searches by terminal, filled and
    read here; they are the same for all plans of the same roots and branches in which the terminals, absent ones included, are the same.
    """
    parent: dict[int, int] = {r: -1 for r in roots}
    degree = {r: 2 + (used or {}).get(r, 0) for r in roots}
    ends = set(terminals)
    shut = ends.union(absent)
    open_ = {r for r in roots if r not in ends and degree[r] < most}
    searches: dict[int, Paths] = {}
    best: dict[int, tuple[float, int]] = {}
    queue: list[tuple[float, int]] = []
    passed: dict[int, list[int]] = {}  # terminals whose search came past a node; repeated searches may not any more

    def take(t: int, paths: Paths, found: tuple[float, int]) -> None:
        searches[t], best[t] = paths, found
        heapq.heappush(queue, (found[0], t))
        for x in paths.distance:
            passed.setdefault(x, []).append(t)

    def seek(t: int) -> tuple[Paths, tuple[float, int]]:
        paths = Paths(neighbours, [t])
        met = next((v for v in paths.settle(_Either(shut, parent)) if v in open_), None)
        return paths, ((np.inf, -1) if met is None else (paths.distance[met], met))

    started = {} if started is None else started
    for t in sorted(ends - set(roots)):
        if t not in started:
            started[t] = seek(t)
        take(t, *started[t])
    while best:
        d, t = heapq.heappop(queue)
        if t not in best or best[t][0] != d:
            continue
        _, v = best.pop(t)
        if v < 0:
            break
        back, joined = searches.pop(t).back, [v]
        while v != t:
            u = back[v]
            parent[u] = v
            degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
            joined.append(u)
            v = u
        filled = [x for x in joined if x not in ends and degree[x] >= most]
        fresh = [x for x in joined[1:] if x not in ends and degree[x] < most]
        open_.difference_update(filled)
        open_.update(fresh)
        again = {o for x in filled for o in passed.get(x, ()) if o in searches and x in searches[o].distance}
        for other in again:
            take(other, *seek(other))
        for x in fresh:
            for other in passed.get(x, ()):
                if other in searches and other not in again and searches[other].distance.get(x, np.inf) < best[other][0]:
                    best[other] = (searches[other].distance[x], x)
                    heapq.heappush(queue, (best[other][0], other))
    return parent


def sizes(parent: dict[int, int], flows: dict[int, float], lengths: dict[int, float]) -> tuple[dict[int, float], dict[int, int]]:
    """Flow and diameter of the edge above each node. A run of equal diameter longer than its limit goes up a size as a whole."""
    children: dict[int, list[int]] = {}
    for v, u in parent.items():
        if u >= 0:
            children.setdefault(u, []).append(v)
    order = [v for v, u in parent.items() if u < 0]
    for v in order:
        order.extend(children.get(v, ()))
    total: dict[int, float] = {}
    for v in reversed(order):
        total[v] = flows.get(v, 0.0) + sum(total[c] for c in children.get(v, ()))
    return total, diameters({v: u for v, u in parent.items() if u >= 0}, lengths, total)


@dataclass
class District:
    """The graph of a district; nodes are tie-in points and terminals, then corners."""

    points: np.ndarray
    names: list[str]
    roots: list[int]
    terminals: list[int]
    flows: dict[int, float]
    sight: Sight
    used: dict[int, int]
    boxes: np.ndarray
    square: np.ndarray | None
    started: dict[int, tuple] = field(default_factory=dict)  # first searches of terminals, see grow


def district(rows: pd.DataFrame) -> District:
    """From rows (kind, id, x, y, x1, y1, flow), in metres. The flow of a tie-in point counts the branches it has already."""
    rows = rows.sort_values(["kind", "id"], kind="stable")
    boxes = rows[rows.kind == "box"][["x", "y", "x1", "y1"]].to_numpy(float).reshape(-1, 4)
    square = rows[rows.kind == "square"][["x", "y", "x1", "y1"]].to_numpy(float)
    square = square[0] if len(square) else None
    ends = rows[rows.kind.isin(["tie", "terminal"])]
    corners = np.concatenate([boxes[:, c] for c in ([0, 1], [2, 1], [2, 3], [0, 3])])
    box_ids = rows[rows.kind == "box"]["id"].to_list()
    ids = np.array([f"{b}:{k}" for k in range(4) for b in box_ids], object)  # a name means one point in every district
    if square is not None:  # boxes beyond the sides are unknown, so nothing turns there
        inside = (corners >= square[:2]).all(axis=1) & (corners <= square[2:]).all(axis=1)
        corners, ids = corners[inside], ids[inside]
    points = np.concatenate([ends[["x", "y"]].to_numpy(float).reshape(-1, 2), corners])
    names = [f"{k}:{i}" for k, i in zip(ends.kind, ends.id, strict=True)] + [f"corner:{i}" for i in ids]
    terminals = [i for i, k in enumerate(ends.kind) if k == "terminal"]
    flows = {i: float(ends.flow.iloc[i]) for i in terminals}
    roots = [i for i, k in enumerate(ends.kind) if k == "tie"]
    used = {i: int(ends.flow.iloc[i]) for i in roots if ends.flow.iloc[i] == ends.flow.iloc[i]}
    return District(points, names, roots, terminals, flows, Sight(points, boxes), used, boxes, square)


def gets_out(d: District, terminals: list[int]) -> list[int]:
    """The terminals from which a side of the square can be reached: they, or a corner they reach, see straight on to it.

    A shortest way to a side ends at a right angle to it, or where a box crosses it; the latter is in sight of a corner of
    that box or of one whose side it slides along, so the feet of both coordinates are tried from every vertex.
    """
    if d.square is None or not terminals:
        return []
    sides = [(0, d.square[0]), (0, d.square[2]), (1, d.square[1]), (1, d.square[3])]

    def exits(v: int) -> bool:
        feet = np.repeat(d.points[v][None], 4, axis=0)
        for k, (axis, side) in enumerate(sides):
            feet[k, axis] = side
        return bool(len(sees(d.points[v], feet, d.boxes)))

    out, known = [], {}
    for t in terminals:
        if t not in known:
            reach, stack, free = {t}, [t], False
            while stack and not free:
                v = stack.pop()
                free = known.get(v) or exits(v)
                for u, _ in [] if free else d.sight(v):
                    if u not in reach:
                        reach.add(u)
                        stack.append(u)
            known |= dict.fromkeys(reach, free)
        if known[t]:
            out.append(t)
    return out


PRICE = {r[0]: r[3] for r in D.DIAMETERS}


def routes(d: District, terminals: list[int]) -> list[tuple]:
    """(from, to, flow, diameter, length, cost) of the edges that serve the terminals."""
    parent = grow(d.sight, d.roots, terminals, used=d.used, started=d.started, absent=d.terminals) if d.roots else {}
    lengths = {v: float(np.hypot(*(d.points[v] - d.points[u]))) for v, u in parent.items() if u >= 0}
    total, dn = sizes(parent, {t: d.flows[t] for t in terminals}, lengths)
    return [(u, v, round(total[v], 3), dn[v], round(lengths[v], 2), float(np.floor(lengths[v] * PRICE[dn[v]] + 0.5))) for v, u in parent.items() if u >= 0]


def plan_district(rows: pd.DataFrame) -> pd.DataFrame:
    return _plan_rows(int(rows.district.iloc[0]), district(rows))


def _plan_rows(name: int, d: District) -> pd.DataFrame:
    out = [(name, n, d.names[u], d.names[v], *d.points[u], *d.points[v], *rest) for n, (u, v, *rest) in enumerate(routes(d, d.terminals))]
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROUTES.split(", ")])


def sensitivity_district(rows: pd.DataFrame) -> pd.DataFrame:
    """The district planned whole and without each terminal; what one sees doesn't change, so the graph is built once."""
    return _sensitivity(int(rows.district.iloc[0]), district(rows), set())


def _sensitivity(name: int, d: District, without: set[int]) -> pd.DataFrame:
    def sums(terminals: list[int]) -> np.ndarray:
        return np.sum([r[4:] for r in routes(d, terminals)] or [(0.0, 0.0)], axis=0)

    whole = sums(d.terminals) if d.terminals else None
    out = []
    for t in d.terminals:
        if int(d.names[t].split(":")[1]) in without:
            continue
        length, cost = whole - sums([u for u in d.terminals if u != t])
        out.append((name, int(d.names[t].split(":")[1]), float(cost), round(float(length), 2)))
    return pd.DataFrame(out, columns=["district", "terminal", "adds_cost", "adds_length"])


def _left(d: District, reached: set[str]) -> list[int]:
    """Terminals that no route reaches here but one may in a wider district."""
    return gets_out(d, [t for t in d.terminals if d.names[t] not in reached])


def attempt_district(rows: pd.DataFrame) -> pd.DataFrame:
    """The routes of a district, and a row for each terminal that is left to a wider one."""
    d, columns = district(rows), [c.split()[0] for c in ATTEMPT.split(", ")]
    built = _plan_rows(int(rows.district.iloc[0]), d)
    waits = [(*[None] * (len(columns) - 1), int(d.names[t].split(":")[1])) for t in sorted(_left(d, set(built.to_node)))]
    return pd.DataFrame([(*r, None) for r in built.itertuples(index=False)] + waits, columns=columns, dtype=object)


def sensitivity_attempt(rows: pd.DataFrame) -> pd.DataFrame:
    """As sensitivity_district, without the terminals that are left to a wider district."""
    d = district(rows)
    waits = {int(d.names[t].split(":")[1]) for t in _left(d, {d.names[v] for _, v, *_ in routes(d, d.terminals)})}
    return _sensitivity(int(rows.district.iloc[0]), d, waits)


def _dealt(rows: DataFrame) -> DataFrame:
    """By district to a fixed number of tasks: a district is little data but much work, so few bytes don't mean few tasks."""
    tasks = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "district")


def attempt(rows: DataFrame) -> DataFrame:
    """Routes of every district, and rows with only `waits`: terminals left to a wider district."""
    return _dealt(rows).groupBy("district").applyInPandas(attempt_district, ATTEMPT)


def plan(rows: DataFrame) -> DataFrame:
    """Routes of every district in rows (district, kind: tie, terminal or box, id, x, y, x1, y1, flow).

    A district is one task's: its size is set by whoever draws the districts, not by the number of them.
    """
    return _dealt(rows).groupBy("district").applyInPandas(plan_district, ROUTES)


def unconnected(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """(district, id, flow, penalty) of terminals that no route reaches."""
    reached = routes.select("district", F.col("to_node").alias("node"))
    t = rows.where("kind = 'terminal'").withColumn("node", F.concat(F.lit("terminal:"), F.col("id")))
    return t.join(reached, ["district", "node"], "left_anti").select("district", "id", "flow", (D.PENALTY + D.PENALTY_PER_FLOW * F.col("flow")).alias("penalty"))


def sensitivity(rows: DataFrame, waiting: bool = False) -> DataFrame:
    """(district, terminal, adds_cost, adds_length): each district planned anew without each terminal.

    waiting: whether terminals that are left to a wider district are left out.
    """
    return _dealt(rows).groupBy("district").applyInPandas(sensitivity_attempt if waiting else sensitivity_district, "district long, terminal long, adds_cost double, adds_length double")
