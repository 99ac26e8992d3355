"""Map projections as column expressions (Snyder, Map Projections: A Working Manual)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
#: EPSG:3413.
LAT_TS, LON_0 = math.radians(70), -45.0
#: EPSG:32622.
UTM_LON_0, UTM_K0, UTM_EAST = -51.0, 0.9996, 500000.0


def _t(lat: float) -> float:
    s = math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)


#: Distance from the pole per unit of t, fixed by the true scale at LAT_TS.
RHO = A * math.cos(LAT_TS) / math.sqrt(1 - E2 * math.sin(LAT_TS) ** 2) / _t(LAT_TS)


def to_polar(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in EPSG:3413 of degrees; null where either is."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(LON_0))
    es = F.lit(E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(E / 2))
    rho = F.lit(RHO) * t
    return rho * F.sin(lam), -rho * F.cos(lam)


def from_polar(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of EPSG:3413 coordinates, by the series in the conformal latitude."""
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.sqrt(x * x + y * y) / F.lit(RHO))
    terms = (
        E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360,
        7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520,
        7 * E2**3 / 120 + 81 * E2**4 / 1120,
        4279 * E2**4 / 161280,
    )
    phi = chi
    for i, k in enumerate(terms, 1):
        phi = phi + F.lit(k) * F.sin(2 * i * chi)
    return F.degrees(F.atan2(x, -y)) + F.lit(LON_0), F.degrees(phi)


def to_utm22(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(east, north) in EPSG:32622 of degrees north of the equator."""
    e2, ep = E2, E2 / (1 - E2)
    phi = F.radians(lat)
    n = F.lit(A) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(phi), F.lit(2)))
    t, c = F.pow(F.tan(phi), F.lit(2)), F.lit(ep) * F.pow(F.cos(phi), F.lit(2))
    a = F.radians(lon - F.lit(UTM_LON_0)) * F.cos(phi)
    m = F.lit(A) * (
        F.lit(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - F.lit(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + F.lit(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - F.lit(35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    p = lambda k: F.pow(a, F.lit(k))
    east = F.lit(UTM_K0) * n * (a + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - F.lit(58 * ep)) * p(5) / 120) + F.lit(UTM_EAST)
    north = F.lit(UTM_K0) * (
        m + n * F.tan(phi) * (p(2) / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - F.lit(330 * ep)) * p(6) / 720)
    )
    return east, north


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of (x, y), closed or not.

    A point counts as inside on lower and left edges; callers that need the boundary excluded test it
    themselves.
    """
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (F.get(ring, i)["y"] > y) != (F.get(ring, (i + 1) % n)["y"] > y),
            F.when(
                x
                < (F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"])
                * (y - F.get(ring, i)["y"])
                / (F.get(ring, (i + 1) % n)["y"] - F.get(ring, i)["y"])
                + F.get(ring, i)["x"],
                F.lit(1),
            ).otherwise(F.lit(0)),
        ).otherwise(F.lit(0)),
    )
    return crossings % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area of a ring by the shoelace sum."""
    n = F.size(ring)
    twice = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"],
    )
    return F.abs(twice) / 2
