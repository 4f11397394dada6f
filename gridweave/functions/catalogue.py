"""Catalogue lookups as columns: the tables have under twenty rows, so they are literals inside the expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.sources import dimensions as D


def diameter_for_flow(flow: Column) -> Column:
    """The smallest diameter whose capacity suffices; null above the table."""
    out = F.lit(None).cast("int")
    for dn, capacity, *_ in reversed(D.DIAMETERS):
        out = F.when(flow <= capacity, F.lit(dn)).otherwise(out)
    return out


def of_diameter(dn: Column, what: int) -> Column:
    """A field of the diameter's row; null for a diameter that the table lacks. The diameter is evaluated once."""
    return F.create_map(*[F.lit(x) for row in D.DIAMETERS for x in (row[0], row[what])])[dn.cast("int")]


def chamber_cost(dn: Column) -> Column:
    """By band; below all bands the first, in a gap or above the last."""
    out = F.lit(D.CHAMBER_COSTS[-1][2])
    for low, high, cost in D.CHAMBER_COSTS:
        out = F.when((dn >= low) & (dn <= high), F.lit(cost)).otherwise(out)
    return F.when(dn < D.CHAMBER_COSTS[0][0], F.lit(D.CHAMBER_COSTS[0][2])).otherwise(out)


def normal_type(raw: Column) -> Column:
    return F.translate(F.lower(F.trim(raw)), "- ", "__")


def canonical_type(name: Column) -> Column:
    """The type an alias stands for; other names stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in D.ALIASES for x in pair])[name], name)


def rule_of(kind: Column) -> Column:
    """The rule of a canonical type; unknown types are forbidden."""
    return F.coalesce(F.create_map(*[F.lit(x) for r in D.RESTRICTIONS for x in r[:2]])[kind], F.lit("FORBIDDEN"))


def least_distance(kind: Column, dn: Column) -> Column:
    """Least horizontal distance to a restriction, for existing buildings by diameter."""
    fixed = F.create_map(*[F.lit(x) for r in D.RESTRICTIONS if r[2] is not None for x in (r[0], r[2])])[kind]
    by_dn = F.lit(D.BUILDING_DISTANCES[-1][1])
    for most, distance in reversed(D.BUILDING_DISTANCES):
        by_dn = F.when(dn <= most, F.lit(distance)).otherwise(by_dn)
    return F.when(kind == "oks_existing", by_dn).otherwise(F.coalesce(fixed, F.lit(1.0)))


def depth_factor(depth: Column) -> Column:
    return F.when(depth <= D.FREE_DEPTH, F.lit(1.0)).otherwise(1 + D.DEPTH_STEP * (depth - D.FREE_DEPTH))


def penalty(flow: Column) -> Column:
    return D.PENALTY + D.PENALTY_PER_FLOW * flow


def score(cost: Column, length: Column) -> Column:
    return D.COST_WEIGHT * cost / D.COST_BASE + D.LENGTH_WEIGHT * length / D.LENGTH_BASE


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)
