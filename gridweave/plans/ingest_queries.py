"""Queries of ingest and topology over the scene: boxes' diagonals stand for lines, chambers and their parents for a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import ingest, topology
from gridweave.plans.base import query
from gridweave.sources import scene

TOLERANCE = 300


def _diagonals(spark, sf):
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return scene.restrictions(spark, sf).select(F.col("box").cast("string").alias("id"), F.array(corner("x0", "y0"), corner("x1", "y1")).alias("points"))


@query(
    f"""/*RECURSION*/, ends AS (SELECT box || '|a' AS node, x0 AS x, y0 AS y FROM boxes UNION ALL SELECT box || '|b', x1, y1 FROM boxes),
pairs AS (SELECT p.node AS a, q.node AS b FROM ends p JOIN ends q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {TOLERANCE * TOLERANCE}),
reach AS (SELECT node AS a, node AS b FROM ends UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
named AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)
SELECT CAST(b.box AS VARCHAR) AS id, p.root AS a, q.root AS b FROM boxes b JOIN named p ON p.node = b.box || '|a' JOIN named q ON q.node = b.box || '|b'"""
)
def ing_stitched_nodes(spark, sf):
    """The nodes at both ends of each line: ends within 3 m are one, and what they are near to as well."""
    return topology.stitch(_diagonals(spark, sf), TOLERANCE)[1]


_FOOT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((t.x - b.x0) * (b.x1 - b.x0) + (t.y - b.y0) * (b.y1 - b.y0))::DOUBLE / ((b.x1 - b.x0) * (b.x1 - b.x0) + (b.y1 - b.y0) * (b.y1 - b.y0))))"


@query(
    f""", feet AS (SELECT t.terminal, t.x, t.y, b.x0, b.y0, b.x1, b.y1, {_FOOT} AS f FROM terminals t CROSS JOIN boxes b)
SELECT terminal, CAST(floor(min(sqrt(pow(x - x0 - f * (x1 - x0), 2) + pow(y - y0 - f * (y1 - y0), 2))) + 0.5) AS BIGINT) AS distance FROM feet GROUP BY terminal"""
)
def ing_nearest_link(spark, sf):
    """How far each terminal is from the nearest line, in centimetres."""
    t = scene.terminals(spark, sf).select("terminal", *[F.col(c).cast("double").alias(c + n) for n in ("0", "1") for c in ("x", "y")])
    near = topology.nearest_links(t, topology.links(_diagonals(spark, sf)), "terminal")
    return near.select("terminal", F.floor(F.col("d") + 0.5).alias("distance"))


@query(
    """, held AS (SELECT t.terminal, b.box, row_number() OVER (PARTITION BY t.terminal ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.box) AS r
  FROM terminals t JOIN boxes b ON t.x BETWEEN b.x0 AND b.x1 AND t.y BETWEEN b.y0 AND b.y1) SELECT terminal, box AS restriction FROM held WHERE r = 1"""
)
def ing_own_footprint(spark, sf):
    """The smallest polygon that holds a terminal without a building of its own."""
    at = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    shapes = scene.restrictions(spark, sf).select(F.col("box").alias("id"), F.lit("FORBIDDEN").alias("rule"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("parts")).alias("geom"))
    return ingest.own_footprints(scene.terminals(spark, sf).select(F.col("terminal").alias("id"), "x", "y", F.lit("point").alias("origin")), shapes, 2500)


@query(
    """, tree AS (SELECT chamber, parent FROM chambers WHERE parent IS NOT NULL)
SELECT 's' || chamber AS id, 'segment' AS kind, CASE WHEN parent % 3 = 1 THEN 'c' || parent WHEN parent = 0 THEN 'source' ELSE 's' || parent END AS upstream FROM tree
UNION ALL SELECT 'c' || chamber, 'chamber', 's' || chamber FROM tree WHERE chamber % 3 = 1"""
)
def ing_next_to_source(spark, sf):
    """The next object towards the source of lines between chambers, every third node holding a chamber."""
    c = scene.chambers(spark, sf).where("parent IS NOT NULL")
    name = lambda kind: F.concat(F.lit(kind), F.col("chamber").cast("string")).alias("id")
    edges = c.select(name("s"), F.col("chamber").alias("a"), F.col("parent").alias("b"))
    source = spark.range(1).select(F.lit("source").alias("source"), F.lit(0).cast("long").alias("node"))
    return topology.next_to_source(edges, c.where("chamber % 3 = 1").select(name("c"), F.col("chamber").alias("node")), source)
