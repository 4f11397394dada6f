"""The planner on small scenes of concave outlines, holes and lines: buffers, sight, distances, forests, against brute force."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import forest, sight
from gridweave.operators import obstacles as O
from gridweave.operators.storage import Workspace
from gridweave.plans import network_queries, planning
from gridweave.sources import dimensions as D

SCHEMA = "obstacle long, rings array<array<struct<x: double, y: double>>>, closed boolean, clearance double"


def star(rng, x, y, r, n):
    """A ring that turns left, concave more often than not."""
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = r * rng.uniform(0.35, 1, n)
    return [(float(x + f * math.cos(t)), float(y + f * math.sin(t))) for t, f in zip(turn, far, strict=True)]


def scene(seed, side=220.0):
    rng = np.random.default_rng(seed)
    out = [(k, [star(rng, *rng.uniform(20, side - 20, 2), 22, int(rng.integers(5, 9)))], True, float(rng.choice([1.0, 2.0, 5.0]))) for k in range(9)]
    hole = [(40.0, 150.0), (80.0, 150.0), (80.0, 190.0), (40.0, 190.0)]
    out.append((20, [hole, [(50.0, 160.0), (70.0, 160.0), (70.0, 180.0), (50.0, 180.0)]], True, 1.0))
    out.append((21, [[(120.0, 10.0), (120.0, 10.0), (150.0, 60.0), (190.0, 50.0)]], False, 2.0))
    out.append((22, [[(5.0, 5.0)]], False, 3.0))
    return out


def distance(p, rows):
    """Of points to an obstacle's edges, and whether they lie inside."""
    _, rings, closed, _ = rows
    best, odd = np.full(len(p), np.inf), np.zeros(len(p), bool)
    for ring in rings:
        pairs = list(zip(ring, ring[1:] + ring[:1], strict=True))
        for a, b in pairs if closed or len(ring) == 1 else pairs[:-1]:
            a, b = np.array(a), np.array(b)
            d = b - a
            t = np.clip(((p - a) @ d) / (d @ d), 0, 1) if d @ d else np.zeros(len(p))
            best = np.minimum(best, np.hypot(*(p - a - t[:, None] * d).T))
            if closed:
                up = (a[1] <= p[:, 1]) != (b[1] <= p[:, 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    odd ^= up & (p[:, 0] < a[0] + (p[:, 1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]))
    return best, odd


@pytest.mark.parametrize("seed", [1, 2])
def test_buffers_against_distances(spark, seed):
    obstacles = scene(seed)
    rng = np.random.default_rng(seed)
    p = rng.uniform(-10, 230, (4000, 2))
    points = spark.createDataFrame([(str(i), float(x), float(y), None) for i, (x, y) in enumerate(p)], "node string, x double, y double, own long")
    table = spark.createDataFrame(obstacles, SCHEMA)
    shut = {int(r["node"]) for r in O.shut(points, table, O.pieces(table), "node").collect()}
    surely, maybe = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for o in obstacles:
        d, inside = distance(p, o)
        surely |= inside | (d < o[3] * math.cos(math.pi / 8) - 1e-5)
        maybe |= inside | (d <= o[3] + 1e-5)
    assert set(np.flatnonzero(surely)) <= shut <= set(np.flatnonzero(maybe))
    own = points.withColumn("own", F.lit(20).cast("long"))
    free = {int(r["node"]) for r in O.shut(own, table, O.pieces(table), "node").collect()}
    d, inside = distance(p, obstacles[9])
    assert free < shut and all(inside[i] or d[i] <= 1.0 + 1e-5 for i in shut - free)


def test_odd_obstacles(spark):
    rows = [(1, None, True, 1.0), (2, [], True, 1.0), (3, [[]], True, 1.0), (4, [[(0.0, 0.0)] * 3], True, 2.0), (5, [[(9.0, 9.0), (9.0, 9.0), (12.0, 9.0)]], False, None)]
    parts = O.pieces(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["obstacle"] for r in parts) == [4, 5]
    assert next(r for r in parts if r["obstacle"] == 4)["x1"] == pytest.approx(2.0)
    assert O.pieces(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def planned(spark):
    """A scene with everything worked out for two runs: all terminals, and all but the first."""
    obstacles = scene(4)
    rng = np.random.default_rng(4)
    table = spark.createDataFrame(obstacles, SCHEMA)
    work = Workspace(spark, "test-planner")
    t = spark.createDataFrame([(f"terminal:{i}", *map(float, rng.uniform(0, 220, 2)), 3.0 + i) for i in range(25)], "node string, x double, y double, flow double")
    ties = spark.createDataFrame([(f"tie:{i}", float(15 * i), -12.0, 2) for i in range(15)], "node string, x double, y double, room int")
    nodes, parts = planning.free_nodes(t, ties, table, work)
    runs = nodes.where("kind = 'terminal'").select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("run"), "node")
    first = runs.agg(F.min("node")).first()[0]
    runs = work.write(runs.where(~((F.col("run") == 1) & (F.col("node") == first))), "runs")
    sized = work.write(planning.plan(planning.Planned(nodes, parts, work), runs), "sized")
    edges, labels, ends, lines = (spark.read.parquet(work.path(n)) for n in ("edges", "labels", "ends", "branch-lines-0"))
    return {"obstacles": obstacles, "nodes": nodes.collect(), "edges": edges.collect(), "labels": {r["node"]: r for r in labels.collect()}, "ends": ends.collect(), "lines": lines.collect(), "sized": sized.collect(), "parts": parts.collect(), "first": first}


def test_distances_are_those_of_one_search_over_all_pairs(planned):
    nodes = planned["nodes"]
    at = np.array([(r["x"], r["y"]) for r in nodes])
    shapes = np.array([list(zip(r["px"], r["py"], strict=True)) for r in planned["parts"]])
    of = np.array([r["obstacle"] for r in planned["parts"]])
    near: dict[int, list] = {i: [] for i in range(len(nodes))}
    for i in range(len(nodes)):
        for j in range(i):
            other = shapes[(of != nodes[i]["own"]) & (of != nodes[j]["own"])] if nodes[i]["own"] is not None or nodes[j]["own"] is not None else shapes
            if not sight.enters(np.tile(at[i], (len(other), 1)), np.tile(at[j], (len(other), 1)), other).any():
                w = math.dist(at[i], at[j])
                near[i].append((j, w))
                near[j].append((i, w))
    best = {i: 0.0 for i, r in enumerate(nodes) if r["kind"] == "tie"}
    heap = [(0.0, i) for i in best]
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i] or nodes[i]["kind"] == "terminal":
            continue
        for j, w in near[i]:
            if d + w < best.get(j, math.inf):
                best[j] = d + w
                heapq.heappush(heap, (d + w, j))
    ends = {i: d for i, d in best.items() if nodes[i]["kind"] == "terminal"}
    assert {nodes[i]["node"] for i in ends} == {n for n in planned["labels"] if n.startswith("terminal:")} and len(ends) > 15
    for i, d in ends.items():
        assert planned["labels"][nodes[i]["node"]]["d"] == pytest.approx(d, abs=1e-6)
    assert len(planned["edges"]) < sum(map(len, near.values())) / 2  # lines that no way needs are left out


@pytest.mark.parametrize("run", [0, 1])
def test_forest(planned, run):
    mine = [r for r in planned["sized"] if r["run"] == run]
    parent = {r["node"]: r["parent"] for r in mine}
    assert len(parent) == len(mine)
    ends = {r["node"] for r in planned["ends"] if r["run"] == run}
    reached = {n for n in ends if n in planned["labels"]}
    assert reached <= set(parent) and (planned["first"] in parent) == (run == 0)
    for n in parent:  # every way ends at a tie-in point
        steps = 0
        while n in parent:
            n, steps = parent[n], steps + 1
            assert steps <= len(parent)
        assert n.startswith("tie:")
    assert set(parent) - set(parent.values()) <= ends and not {p for p in parent.values() if p.startswith("terminal:")}
    held = {}
    for p in parent.values():
        held[p] = held.get(p, 0) + 1
    assert all(k <= (2 if p.startswith("tie:") else D.MAX_DEGREE - 1) for p, k in held.items())
    before = sum(math.hypot(r["x"] - r["px"], r["y"] - r["py"]) for r in planned["lines"] if r["run"] == run)
    assert sum(r["length"] for r in mine) <= before + 1e-6
    root_flow = sum(r["flow"] for r in mine if r["parent"].startswith("tie:"))
    assert root_flow == pytest.approx(sum(3.0 + int(n.split(":")[1]) for n in reached))
    capacity, price = {r[0]: r[1] for r in D.DIAMETERS}, {r[0]: r[3] for r in D.DIAMETERS}
    dn = {r["node"]: r["dn"] for r in mine}
    assert all(capacity[r["dn"]] >= r["flow"] and r["cost"] == math.floor(r["length"] * price[r["dn"]] + 0.5) for r in mine)
    assert all(dn[n] <= dn[p] for n, p in parent.items() if p in dn)


def test_routes_keep_clear_and_apart(planned):
    own = {r["node"]: r["own"] for r in planned["nodes"]}
    mine = [r for r in planned["sized"] if r["run"] == 0]
    for r in mine:
        t = np.linspace(0, 1, 400)[:, None]
        p = np.array([r["x"], r["y"]]) * (1 - t) + np.array([r["px"], r["py"]]) * t
        for o in planned["obstacles"]:
            if own.get(r["node"]) != o[0]:
                d, inside = distance(p, o)
                assert not inside.any() and d.min() >= o[3] * math.cos(math.pi / 8) - 1e-5
    for i, a in enumerate(mine):
        for b in mine[:i]:
            cross = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0])
            a0, a1, b0, b1 = ((r[x], r[y]) for r in (a, b) for x, y in (("x", "y"), ("px", "py")))
            inside = cross(a0, a1, b0) * cross(a0, a1, b1) < -1e-6 and cross(b0, b1, a0) * cross(b0, b1, a1) < -1e-6
            assert not inside


def test_ways_that_join_inside_a_box_may_leave_it_together(spark):
    work = Workspace(spark, "test-own")
    box = spark.createDataFrame([(7, [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]], True, 1.0)], SCHEMA)
    t = spark.createDataFrame([("terminal:1", 15.0, 10.0, 3.0), ("terminal:2", 16.5, 19.5, 3.0)], "node string, x double, y double, flow double")
    ties = spark.createDataFrame([("tie:0", 40.0, 10.0, 1)], "node string, x double, y double, room int")
    nodes, parts = planning.free_nodes(t, ties, box, work)
    edges = planning.plan(planning.Planned(nodes, parts, work), nodes.where("kind = 'terminal'").select(F.lit(0).cast("long").alias("run"), "node"))
    made = {r["node"]: r["own"] for r in edges.collect()}
    assert len(made) == 3 and set(made.values()) == {7} and any(n.startswith("branch:") for n in made)  # they join inside the box
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 20.0, 20.0, 0.9)], "box long, b_x0 double, b_y0 double, b_x1 double, b_y1 double, apart double")
    assert network_queries.too_near(edges, boxes).count() == 0
    assert network_queries.too_near(edges, boxes.withColumn("box", F.lit(8).cast("long"))).count() == 3


def test_pieces_behind_two_layers_are_left_out_and_hide_nothing_else(spark):
    rng = np.random.default_rng(5)
    boxes = []
    for k in range(900):  # both sides of a lane in many layers, and some boxes in the lane
        x, y = rng.uniform(0, 90), rng.uniform(0, 26) + (36 if k % 2 else 0)
        boxes.append((k, x, y, x + 8, y + 8))
    boxes += [(1000 + k, 12.0 * k, 35.5 + k % 3, 12.0 * k + 2, 37.5 + k % 3) for k in range(6)]
    rows = [(k, [[(x, y), (u, y), (u, v), (x, v)]], True, 1.0) for k, x, y, u, v in boxes]
    table, work = spark.createDataFrame(rows, SCHEMA), Workspace(spark, "test-layers")
    t = spark.createDataFrame([(f"terminal:{i}", *map(float, rng.uniform((-5, -5), (105, 75))), 3.0) for i in range(60)], "node string, x double, y double, flow double")
    ties = spark.createDataFrame([("tie:0", -20.0, 35.0, 2)], "node string, x double, y double, room int")
    nodes, parts = planning.free_nodes(t, ties, table, work)
    every = O.pieces(table)
    layered = every.count()
    assert parts.count() < layered / 2
    own = O.holders(t, table, "node").groupBy("node").agg(F.min(F.struct("area", "obstacle"))["obstacle"].alias("own"))
    points = t.join(own, "node", "left").select("node", "x", "y", "own").unionByName(O.corners(every).withColumn("own", F.lit(None).cast("long")))
    free = points.join(O.shut(points, table, every, "node"), "node", "left_anti")
    assert {r["node"] for r in free.collect()} == {r["node"] for r in nodes.collect()} - {"tie:0"}
    seen = lambda p: {(*sorted((r["node"], r["other"])), round(r["w"], 6)) for r in sight.graph(nodes, p, Workspace(spark, "test-seen"), layered).collect()}
    few = seen(parts)
    assert few == seen(every) and len(few) > 20


def test_nothing_to_plan(spark):
    work = Workspace(spark, "test-empty")
    t = spark.createDataFrame([], "node string, x double, y double, flow double")
    ties = spark.createDataFrame([], "node string, x double, y double, room int")
    nodes, parts = planning.free_nodes(t, ties, spark.createDataFrame([], SCHEMA), work)
    assert nodes.count() == 0 and sight.graph(nodes, parts, work).count() == 0


def test_who_only_looks_out_past_all_nodes_stops(spark):
    work = Workspace(spark, "test-outside")
    wall = spark.createDataFrame([(1, [[(5.0, -50.0), (5.0, 50.0)]], False, 1.0)], SCHEMA)
    nodes = spark.createDataFrame([("terminal:1", "terminal", 0.0, 0.0, None), ("tie:1", "tie", 1000.0, 0.0, None)], "node string, kind string, x double, y double, own long")
    assert sight.graph(nodes, O.pieces(wall), work).count() == 0
    assert {n for n in work.written if n.startswith("ring")} == {"ring-0"}  # beyond the first circle there's nothing in sight
    p = np.array([3.0, 4.0])
    assert sight.hidden(*sight.hides(p, *sight.walls((0.0, 0.0, 10.0, 10.0)), 20.0)) and not sight.hidden(*sight.hides(p, *sight.walls((0.0, 0.0, 10.0, 10.0)), 7.0))


def test_points_in_many_pieces_as_one_by_one():
    rng = np.random.default_rng(3)
    at, own = rng.uniform(0, 100, (500, 2)), rng.integers(-1, 5, 500)
    turn = np.linspace(0, 2 * math.pi, 10, endpoint=False)
    shapes = rng.uniform(0, 100, (300, 1, 2)) + rng.uniform(1, 6, (300, 1, 1)) * np.stack([np.cos(turn), np.sin(turn)], -1)
    of = rng.integers(-1, 5, 300)
    inside = np.zeros(500, bool)
    for shape, o in zip(shapes, of, strict=True):
        step = np.roll(shape, -1, axis=0) - shape
        d = at[:, None] - shape
        inside |= (step[:, 0] * d[..., 1] - step[:, 1] * d[..., 0] > O.SKIN * np.hypot(*step.T)).all(1) & (own != o)
    assert (O.within_pieces(at, own, shapes, of) == inside).all() and 0 < inside.sum() < 500
