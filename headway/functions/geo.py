"""Geometry as column expressions: all of it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84, and UTM zone 35 north.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1.0 / 298.257_223_563
SCALE, FALSE_EASTING, CENTRAL_MERIDIAN_DEG = 0.9996, 500_000.0, 27.0


def utm(lon: Column, lat: Column, meridian_deg: float = CENTRAL_MERIDIAN_DEG) -> tuple[Column, Column]:
    """Easting and northing in metres, by the usual series for the transverse Mercator projection."""
    e2 = 2 * FLATTENING - FLATTENING**2
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    a = F.cos(phi) * (F.radians(lon) - math.radians(meridian_deg))
    t, c = F.tan(phi) * F.tan(phi), F.cos(phi) * F.cos(phi) * ep2
    n = SEMI_MAJOR / F.sqrt(1 - F.sin(phi) * F.sin(phi) * e2)
    arc = (
        phi * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
        - F.sin(2 * phi) * (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)
        + F.sin(4 * phi) * (15 * e2**2 / 256 + 45 * e2**3 / 1024)
        - F.sin(6 * phi) * (35 * e2**3 / 3072)
    ) * SEMI_MAJOR
    a2 = a * a
    x = (a + (1 - t + c) * a2 * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a2 * a2 * a / 120) * n * SCALE + FALSE_EASTING
    y = (arc + n * F.tan(phi) * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a2 * a2 * a2 / 720)) * SCALE
    return x, y


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def bearing_diff(a: Column, b: Column) -> Column:
    """The angle between two bearings, in [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def segment_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the nearest point of a segment lies, from 0 at its start to 1; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    return F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(0.0)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    s = segment_share(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + s * (bx - ax)), py - (ay + s * (by - ay)))


def box_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A lower bound on the distance to what lies in a box; 0 inside."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - px, px - x1, zero), F.greatest(y0 - py, py - y1, zero))
