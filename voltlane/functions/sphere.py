"""Geometry on the sphere as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col
from .fixed import EARTH_RADIUS_KM


def _num(value: ColumnLike | float) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else as_col(value)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; null when a coordinate is null.

    The square root is clamped at 1 because rounding can push antipodal points just past it."""
    lat1, lon1, lat2, lon2 = (_num(v) for v in (lat1, lon1, lat2, lon2))
    half = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    root = F.sqrt(half)
    # `when` rather than `least`: least() would turn a null distance into 1.
    return F.asin(F.when(root > 1.0, 1.0).otherwise(root)) * (2 * EARTH_RADIUS_KM)


def unit_xyz(lat, lon) -> list[Column]:
    """The point as a 3-d unit vector. In this space there is no dateline and no pole to treat apart."""
    la, lo = F.radians(_num(lat)), F.radians(_num(lon))
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def chord(km: float) -> float:
    """Straight-line length, on the unit sphere, of an arc of ``km``; padded so rounding never hides a pair."""
    arc = min(max(km, 0.0) / EARTH_RADIUS_KM, math.pi)
    return 2 * math.sin(arc / 2) * (1 + 1e-9) + 1e-12


def search_box(lat: float, lon: float, km: float) -> tuple[tuple[float, float], list[tuple[float, float]]]:
    """Latitude range and one or two longitude ranges that hold every point within ``km``."""
    arc = km / EARTH_RADIUS_KM + 1e-9
    south, north = lat - math.degrees(arc), lat + math.degrees(arc)
    if south <= -90 or north >= 90 or arc >= math.pi / 2:
        return (max(south, -90.0), min(north, 90.0)), [(-180.0, 180.0)]
    spread = math.degrees(math.asin(min(1.0, math.sin(arc) / math.cos(math.radians(lat))))) + 1e-9
    west, east = lon - spread, lon + spread
    if west < -180:
        return (south, north), [(-180.0, east), (west + 360, 180.0)]
    if east > 180:
        return (south, north), [(west, 180.0), (-180.0, east - 360)]
    return (south, north), [(west, east)]


def segment_km(lat, lon, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """Distance from a point to the great-circle segment between two places."""
    (lat1, lon1), (lat2, lon2) = start, end

    def bearing(la1, lo1, la2, lo2):
        la1, lo1, la2, lo2 = (F.radians(_num(v)) for v in (la1, lo1, la2, lo2))
        y = F.sin(lo2 - lo1) * F.cos(la2)
        x = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(lo2 - lo1)
        return F.atan2(y, x)

    to_point = haversine_km(lat1, lon1, lat, lon) / EARTH_RADIUS_KM
    length = haversine_km(lat1, lon1, lat2, lon2)
    turn = bearing(lat1, lon1, lat, lon) - bearing(lat1, lon1, lat2, lon2)
    cross = F.asin(F.sin(to_point) * F.sin(turn))
    along = F.atan2(F.sin(to_point) * F.cos(turn), F.cos(to_point)) * EARTH_RADIUS_KM
    return (F.when(along < 0, to_point * EARTH_RADIUS_KM)
            .when(along > length, haversine_km(lat2, lon2, lat, lon))
            .otherwise(F.abs(cross) * EARTH_RADIUS_KM))
