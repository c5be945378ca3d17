"""Coordinate systems by EPSG code: degrees, Web Mercator and transverse Mercator zones.

Formulas stand once, over a namespace of functions.  Degrees and Web Mercator
serve columns; the series of the zones, whose terms would be repeated many times
in a column expression, serve single numbers and arrays.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
#: Where Web Mercator's square ends.
MAX_LATITUDE = 85.05112877980659
#: The published series of the transverse Mercator projection, in the third flattening of the WGS 84 ellipsoid.
_N = 1 / (2 * 298.257223563 - 1)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ROUND = 2 * math.sqrt(_N) / (1 + _N)
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
#: First code, first zone, last zone, northing of the equator; on ellipsoids that differ by less than a millimetre.
ZONES = ((32600, 1, 60, 0.0), (32700, 1, 60, SOUTH), (25800, 28, 38, 0.0), (26900, 1, 23, 0.0))


def zone(epsg: int) -> tuple[float, float] | None:
    """(central meridian, northing of the equator) of a transverse Mercator zone, or None."""
    for base, first, last, north in ZONES:
        if base + first <= epsg <= base + last:
            return (epsg - base) * 6 - 183.0, north
    return None


def known(epsg: int | None) -> bool:
    return epsg in (3857, 4326) or epsg is not None and zone(epsg) is not None


#: The functions of ``math`` on arrays.
ARRAYS = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, exp=np.exp, log=np.log, sqrt=np.sqrt, radians=np.radians, degrees=np.degrees,
    min=np.minimum, max=np.maximum,
)


def from_degrees(lon, lat, epsg: int, m=F):
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        least, greatest = (F.least, F.greatest) if m is F else (getattr(m, "min", min), getattr(m, "max", max))
        edge = F.lit(MAX_LATITUDE) if m is F else MAX_LATITUDE
        lat = least(greatest(lat, -edge), edge)
        return m.radians(lon) * RADIUS, m.log(m.tan(m.radians(lat) / 2 + math.pi / 4)) * RADIUS
    meridian, equator = _zone(epsg)
    sine, turn = m.sin(m.radians(lat)), m.radians(lon - meridian)
    t = m.sinh(m.atanh(sine) - m.atanh(sine * _ROUND) * _ROUND)
    xi, eta = m.atan2(t, m.cos(turn)), m.atanh(m.sin(turn) / m.sqrt(t * t + 1))
    east = eta + sum(m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a for j, a in enumerate(_ALPHA, 1))
    north = xi + sum(m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a for j, a in enumerate(_ALPHA, 1))
    return east * (SCALE * _A) + EAST, north * (SCALE * _A) + equator


def to_degrees(x, y, epsg: int, m=F):
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return m.degrees(x / RADIUS), m.degrees(m.atan(m.exp(y / RADIUS)) * 2 - math.pi / 2)
    meridian, equator = _zone(epsg)
    xi, eta = (y - equator) / (SCALE * _A), (x - EAST) / (SCALE * _A)
    up = xi - sum(m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b for j, b in enumerate(_BETA, 1))
    out = eta - sum(m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b for j, b in enumerate(_BETA, 1))
    chi = m.asin(m.sin(up) / m.cosh(out))
    lat = chi + sum(m.sin(chi * (2 * j)) * d for j, d in enumerate(_DELTA, 1))
    return m.degrees(m.atan2(m.sinh(out), m.cos(up))) + meridian, m.degrees(lat)


def _zone(epsg: int) -> tuple[float, float]:
    found = zone(epsg)
    if found is None:
        raise ValueError(f"EPSG:{epsg} is not known; degrees (4326), Web Mercator (3857) and transverse Mercator zones are")
    return found


def moved(x: Column, y: Column, source: int | None, target: int | None) -> tuple[Column, Column]:
    """Coordinates in degrees or Web Mercator in the other; unknown systems (None) are taken to be the same."""
    if source == target or None in (source, target):
        return x, y
    if zone(source) or zone(target):
        raise ValueError("zones have no column expressions")
    return from_degrees(*to_degrees(x, y, source), target)


def moved_point(x: float, y: float, source: int | None, target: int | None) -> tuple[float, float]:
    """One point of one system in another."""
    if source == target or None in (source, target):
        return x, y
    return from_degrees(*to_degrees(x, y, source, math), target, math)


def moved_arrays(x: np.ndarray, y: np.ndarray, source: int | None, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of coordinates of one system in another."""
    if source == target or None in (source, target):
        return x, y
    return from_degrees(*to_degrees(x, y, source, ARRAYS), target, ARRAYS)
