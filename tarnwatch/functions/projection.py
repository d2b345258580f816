"""Transverse Mercator in column expressions, both ways, by Krueger's series in the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of WGS84 and of the UTM zones.
SEMI_MAJOR_M, FLATTENING, SCALE, FALSE_EAST_M, FALSE_NORTH_M = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = SCALE * SEMI_MAJOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of powers of n from the second to the fourth term, forward, inverse, and from conformal to geographic latitude.
_ALPHA = tuple(sum(c * _N**p for p, c in terms) for terms in (((1, 1 / 2), (2, -2 / 3), (3, 5 / 16), (4, 41 / 180)), ((2, 13 / 48), (3, -3 / 5), (4, 557 / 1440)), ((3, 61 / 240), (4, -103 / 140)), ((4, 49561 / 161280),)))
_BETA = tuple(sum(c * _N**p for p, c in terms) for terms in (((1, 1 / 2), (2, -2 / 3), (3, 37 / 96), (4, -1 / 360)), ((2, 1 / 48), (3, 1 / 15), (4, -437 / 1440)), ((3, 17 / 480), (4, -37 / 840)), ((4, 4397 / 161280),)))
_DELTA = tuple(sum(c * _N**p for p, c in terms) for terms in (((1, 2), (2, -2 / 3), (3, -2), (4, 116 / 45)), ((2, 7 / 3), (3, -8 / 5), (4, -227 / 45)), ((3, 56 / 15), (4, -136 / 35)), ((4, 4279 / 630),)))


def _meridian(zone: int) -> float:
    return zone * 6 - 183.0


def _waves(x: Column, y: Column, coefficients: tuple[float, ...]) -> tuple[Column, Column]:
    """Sums of c sin(2j x) cosh(2j y) and of c cos(2j x) sinh(2j y)."""
    terms = [(c, 2.0 * j) for j, c in enumerate(coefficients, 1)]
    return sum((c * F.sin(k * x) * F.cosh(k * y) for c, k in terms), F.lit(0.0)), sum((c * F.cos(k * x) * F.sinh(k * y) for c, k in terms), F.lit(0.0))


def utm_from_degrees(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """(east, north) in metres; within a millimetre in and beside the zone. South of the equator the false northing is added."""
    t, away = F.tan(F.radians(lat)), F.radians(lon - _meridian(zone))
    s = F.sinh(_E * F.atanh(_E * t / F.sqrt(1 + t * t)))
    conformal = t * F.sqrt(1 + s * s) - s * F.sqrt(1 + t * t)
    x, y = F.atan2(conformal, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(conformal * conformal + F.cos(away) * F.cos(away)))
    dx, dy = _waves(x, y, _ALPHA)
    return FALSE_EAST_M + _RADIUS * (y + dy), _RADIUS * (x + dx) + F.when(lat < 0, FALSE_NORTH_M).otherwise(0.0)


def degrees_from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lat, lon) of metres in a zone."""
    x, y = (north - (FALSE_NORTH_M if south else 0.0)) / _RADIUS, (east - FALSE_EAST_M) / _RADIUS
    dx, dy = _waves(x, y, _BETA)
    x, y = x - dx, y - dy
    conformal = F.asin(F.sin(x) / F.cosh(y))
    lat = conformal + sum((d * F.sin(2.0 * j * conformal) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return F.degrees(lat), _meridian(zone) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))
