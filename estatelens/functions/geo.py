"""Coordinate expressions: projection to plane metres, flat distances, segment distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Published parameters of the WGS 84 ellipsoid and of EPSG:3414.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
ORIGIN_LAT = 1.0 + 22.0 / 60
ORIGIN_LON = 103.0 + 50.0 / 60
FALSE_EASTING = 28001.642
FALSE_NORTHING = 38744.572
SCALE = 1.0

# Flat-earth walking estimate.
KM_PER_DEGREE = 111.32
WALK_DETOUR = 1.2
WALK_KMPH = 4.8

_E2 = WGS84_F * (2 - WGS84_F)
_E4, _E6 = _E2**2, _E2**3
_A0 = 1 - _E2 / 4 - 3 * _E4 / 64 - 5 * _E6 / 256
_A2 = 3 / 8 * (_E2 + _E4 / 4 + 15 * _E6 / 128)
_A4 = 15 / 256 * (_E4 + 3 * _E6 / 4)
_A6 = 35 * _E6 / 3072
_LAT0, _LON0 = math.radians(ORIGIN_LAT), math.radians(ORIGIN_LON)
_M0 = WGS84_A * (
    _A0 * _LAT0 - _A2 * math.sin(2 * _LAT0) + _A4 * math.sin(4 * _LAT0) - _A6 * math.sin(6 * _LAT0)
)


def _curvature(sin_lat: Column) -> tuple[Column, Column]:
    """Radii of curvature in the prime vertical and in the meridian."""
    w = 1 - _E2 * sin_lat * sin_lat
    nu = WGS84_A / F.sqrt(w)
    rho = WGS84_A * (1 - _E2) / F.pow(w, F.lit(1.5))
    return nu, rho


def to_svy21(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """WGS 84 degrees to (x, y) metres by the transverse Mercator series."""
    lat, dlon = F.radians(latitude), F.radians(longitude) - _LON0
    s, c = F.sin(lat), F.cos(lat)
    nu, rho = _curvature(s)
    psi = nu / rho
    t2 = (s / c) * (s / c)
    w2 = dlon * dlon
    arc = WGS84_A * (
        _A0 * lat - _A2 * F.sin(2 * lat) + _A4 * F.sin(4 * lat) - _A6 * F.sin(6 * lat)
    )
    c2, psi2 = c * c, psi * psi
    y = arc - _M0 + nu * s * c * w2 / 2 * (
        1
        + w2 * c2 / 12 * (4 * psi2 + psi - t2)
        + w2 * w2 * c2 * c2 / 360
        * (8 * psi2 * psi2 * (11 - 24 * t2) - 28 * psi2 * psi * (1 - 6 * t2) + psi2 * (1 - 32 * t2)
           - 2 * psi * t2 + t2 * t2)
    )
    x = nu * dlon * c * (
        1
        + w2 * c2 / 6 * (psi - t2)
        + w2 * w2 * c2 * c2 / 120
        * (4 * psi2 * psi * (1 - 6 * t2) + psi2 * (1 + 8 * t2) - 2 * psi * t2 + t2 * t2)
    )
    return FALSE_EASTING + SCALE * x, FALSE_NORTHING + SCALE * y


def from_svy21(x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) metres back to (latitude, longitude) in WGS 84 degrees."""
    n = WGS84_F / (2 - WGS84_F)
    mean_radius = WGS84_A * (1 - n) * (1 - n * n) * (1 + 9 * n * n / 4 + 225 * n**4 / 64)
    sigma = (y - FALSE_NORTHING + _M0 * SCALE) / (mean_radius * SCALE)
    foot = (
        sigma
        + (3 * n / 2 - 27 * n**3 / 32) * F.sin(2 * sigma)
        + (21 * n * n / 16 - 55 * n**4 / 32) * F.sin(4 * sigma)
        + 151 * n**3 / 96 * F.sin(6 * sigma)
        + 1097 * n**4 / 512 * F.sin(8 * sigma)
    )
    s, c = F.sin(foot), F.cos(foot)
    nu, rho = _curvature(s)
    psi, t = nu / rho, s / c
    t2, psi2 = t * t, psi * psi
    e = (x - FALSE_EASTING) / (nu * SCALE)
    e2 = e * e
    lat = foot - (t * e * (x - FALSE_EASTING)) / (rho * SCALE * 2) * (
        1
        - e2 / 12 * (-4 * psi2 + 9 * psi * (1 - t2) + 12 * t2)
        + e2 * e2 / 360
        * (8 * psi2 * psi2 * (11 - 24 * t2) - 12 * psi2 * psi * (21 - 71 * t2)
           + 15 * psi2 * (15 - 98 * t2 + 15 * t2 * t2) + 180 * psi * (5 * t2 - 3 * t2 * t2)
           + 360 * t2 * t2)
    )
    lon = _LON0 + e / c * (
        1
        - e2 / 6 * (psi + 2 * t2)
        + e2 * e2 / 120 * (-4 * psi2 * psi * (1 - 6 * t2) + psi2 * (9 - 68 * t2) + 72 * psi * t2
                           + 24 * t2 * t2)
    )
    return F.degrees(lat), F.degrees(lon)


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def flat_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km on a local plane, longitude shrunk by the cosine of the mean latitude."""
    dy = (lat2 - lat1) * KM_PER_DEGREE
    dx = (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a zero-length segment counts as its end point."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return plane_distance(px, py, x1 + t * dx, y1 + t * dy)


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the rightward ray from the point crosses the edge (half-open in y)."""
    spans = (y1 > py) != (y2 > py)
    return F.when(spans, px < (x2 - x1) * (py - y1) / F.when(spans, y2 - y1) + x1).otherwise(False)


def on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    aligned = (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)
    return (
        aligned
        & px.between(F.least(x1, x2), F.greatest(x1, x2))
        & py.between(F.least(y1, y2), F.greatest(y1, y2))
    )


def segments_distance(a: tuple, b: tuple) -> Column:
    """Least distance between two segments, each given as (x1, y1, x2, y2); 0 if they meet."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b

    def side(x1, y1, x2, y2, px, py):
        return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))

    properly_cross = (
        (side(ax1, ay1, ax2, ay2, bx1, by1) * side(ax1, ay1, ax2, ay2, bx2, by2) < 0)
        & (side(bx1, by1, bx2, by2, ax1, ay1) * side(bx1, by1, bx2, by2, ax2, ay2) < 0)
    )
    ends = F.least(
        point_segment_distance(ax1, ay1, *b),
        point_segment_distance(ax2, ay2, *b),
        point_segment_distance(bx1, by1, *a),
        point_segment_distance(bx2, by2, *a),
    )
    return F.when(properly_cross, F.lit(0.0)).otherwise(ends)
