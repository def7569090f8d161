"""ETRS89 / UTM zone 30N by the Krüger series, on Columns or on plain floats.

Every formula takes the maths namespace as its first argument: ``pyspark.sql.functions`` builds
Column expressions, ``math`` computes a literal on the driver (a query centre, an envelope corner).
"""

from __future__ import annotations

import math
from types import ModuleType

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the zone's parameters.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
CENTRAL_MERIDIAN = -3.0
FALSE_EASTING = 500000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _sphere(m: ModuleType, lon, lat):
    """Conformal tangent and longitude offset of a geographic position."""
    s = m.sin(m.radians(lat))
    return m.sinh(m.atanh(s) - ECCENTRICITY * m.atanh(ECCENTRICITY * s)), m.radians(
        lon - CENTRAL_MERIDIAN
    )


def _transverse(m: ModuleType, t, dlon):
    return m.atan2(t, m.cos(dlon)), m.atanh(m.sin(dlon) / m.sqrt(1 + t * t))


def _plane(m: ModuleType, xi, eta):
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north


def forward(m: ModuleType, lon, lat):
    """Degrees to metres, as an (east, north) pair."""
    return _plane(m, *_transverse(m, *_sphere(m, lon, lat)))


def inverse(m: ModuleType, east, north):
    """Metres to degrees, as a (lon, lat) pair."""
    xi0 = north / (SCALE * RADIUS)
    eta0 = (east - FALSE_EASTING) / (SCALE * RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, start=1):
        xi = xi - b * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta - b * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    lat = chi
    for j, d in enumerate(DELTA, start=1):
        lat = lat + d * m.sin(2 * j * chi)
    return CENTRAL_MERIDIAN + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(lat)


def to_metres(lon: Column, lat: Column) -> Column:
    """Struct<x, y> in metres, stage by stage: written out as one expression, the first stages stand in it dozens of times."""
    at = F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    return F.get(ring_to_metres(F.array(at)), F.lit(0))


def to_degrees(x: Column, y: Column) -> Column:
    """Struct<x, y> in degrees (x = longitude)."""
    lon, lat = inverse(F, x, y)
    return F.struct(lon.alias("x"), lat.alias("y"))


def ring_to_metres(ring: Column) -> Column:
    """Project each vertex, one series stage per pass so that no stage is evaluated twice."""

    def named(pair, a, b):
        return F.struct(pair[0].alias(a), pair[1].alias(b))

    sphere = F.transform(ring, lambda v: named(_sphere(F, v["x"], v["y"]), "t", "d"))
    angles = F.transform(sphere, lambda v: named(_transverse(F, v["t"], v["d"]), "u", "v"))
    return F.transform(angles, lambda v: named(_plane(F, v["u"], v["v"]), "x", "y"))


# Samples per side of the metric square whose image bounds a query circle.
_SIDE_SAMPLES = 64


def circle_bounds(lon: float, lat: float, radius_m: float) -> tuple[float, float, float, float]:
    """Degrees box that holds every position within ``radius_m`` metres of the centre.

    The extremes of the square's image lie on its border. One per cent more radius outweighs the
    sagitta between neighbouring samples by orders of magnitude, so nothing inside is lost.
    """
    cx, cy = forward(math, lon, lat)
    r = radius_m * 1.01
    steps = [-r + 2 * r * i / _SIDE_SAMPLES for i in range(_SIDE_SAMPLES + 1)]
    border = [(s, e) for s in steps for e in (-r, r)] + [(e, s) for s in steps for e in (-r, r)]
    images = [inverse(math, cx + dx, cy + dy) for dx, dy in border]
    lons, lats = [p[0] for p in images], [p[1] for p in images]
    return min(lons), min(lats), max(lons), max(lats)
