"""WGS84 to UTM and back as columns: the published transverse Mercator series, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH_SOUTH = 0.9996, 500_000.0, 10_000_000.0

E2 = FLATTENING * (2 - FLATTENING)
SECOND = E2 / (1 - E2)
#: Meridian arc: factors of the latitude and of the sines of two, four and six times it.
ARC = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024), 15 * E2**2 / 256 + 45 * E2**3 / 1024, -35 * E2**3 / 3072)
_N = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
#: The same inverted: factors of the sines for the latitude at which an arc ends.
FOOT = (3 * _N / 2 - 27 * _N**3 / 32, 21 * _N**2 / 16 - 55 * _N**4 / 32, 151 * _N**3 / 96, 1097 * _N**4 / 512)


def zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + zone(lon)


def _power_sum(x: Column, factors: list) -> Column:
    """Sum of factors[i] * x^(i + 1), by Horner's rule."""
    out = F.lit(0.0)
    for f in reversed(factors):
        out = (out + f) * x
    return out


def project(lon: Column, lat: Column, utm_zone: int) -> tuple[Column, Column]:
    """Metres east and north in a northern zone (subtract nothing; south of the equator add FALSE_NORTH_SOUTH)."""
    phi, away = F.radians(lat), F.radians(lon - F.lit(float(utm_zone * 6 - 183)))
    t, c = F.pow(F.tan(phi), 2), SECOND * F.pow(F.cos(phi), 2)
    radius = AXIS / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    a = away * F.cos(phi)
    a2 = a * a
    arc = AXIS * (ARC[0] * phi + sum((ARC[i] * F.sin(2 * i * phi) for i in (1, 2, 3)), F.lit(0.0)))
    east = radius * a * (1 + _power_sum(a2, [(1 - t + c) / 6, (5 - 18 * t + t * t + 72 * c - 58 * SECOND) / 120]))
    north = arc + radius * F.tan(phi) * _power_sum(a2, [F.lit(0.5), (5 - t + 9 * c + 4 * c * c) / 24, (61 - 58 * t + t * t + 600 * c - 330 * SECOND) / 720])
    return FALSE_EAST + SCALE * east, SCALE * north


def unproject(x: Column, y: Column, utm_zone: int) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of a point in a northern zone."""
    mu = y / SCALE / (AXIS * ARC[0])
    foot = mu + sum((f * F.sin(2 * (i + 1) * mu) for i, f in enumerate(FOOT)), F.lit(0.0))
    t, c = F.pow(F.tan(foot), 2), SECOND * F.pow(F.cos(foot), 2)
    bend = 1 - E2 * F.pow(F.sin(foot), 2)
    across, along = AXIS / F.sqrt(bend), AXIS * (1 - E2) / F.pow(bend, 1.5)
    d = (x - FALSE_EAST) / (across * SCALE)
    d2 = d * d
    drop = _power_sum(d2, [F.lit(0.5), -(5 + 3 * t + 10 * c - 4 * c * c - 9 * SECOND) / 24, (61 + 90 * t + 298 * c + 45 * t * t - 252 * SECOND - 3 * c * c) / 720])
    turn = d * (1 + _power_sum(d2, [-(1 + 2 * t + c) / 6, (5 - 2 * c + 28 * t - 3 * c * c + 8 * SECOND + 24 * t * t) / 120])) / F.cos(foot)
    return F.degrees(turn) + float(utm_zone * 6 - 183), F.degrees(foot - across * F.tan(foot) / along * drop)
