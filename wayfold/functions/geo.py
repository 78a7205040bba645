"""Distances and map zoom as column expressions, with numpy twins for the sequential kernels."""

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, metres per degree and zoom limits.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
MIN_ZOOM, MAX_ZOOM, POINT_ZOOM = 2, 18, 16


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def equirect_m(lat1, lon1, lat2, lon2) -> Column:
    """Flat distance in metres from point 1 to point 2, scaled by the latitude of point 2."""
    lat1, lon1, lat2, lon2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    north = (lat2 - lat1) * METRES_PER_DEGREE
    east = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat2))
    return F.hypot(north, east)


def zoom_for_span(lat_span, lon_span) -> Column:
    """Map zoom level that fits the larger of two spans in degrees."""
    span = F.greatest(_col(lat_span), _col(lon_span))
    level = F.floor(F.log2(F.lit(360.0) / F.when(span > 0, span))).cast("int")
    fitted = F.greatest(F.lit(MIN_ZOOM), F.least(F.lit(MAX_ZOOM), level))
    return F.when(span <= 0, F.lit(POINT_ZOOM)).when(span > 0, fitted).cast("int")


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half_lat = math.sin(math.radians(lat2 - lat1) / 2)
    half_lon = math.sin(math.radians(lon2 - lon1) / 2)
    h = half_lat**2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon**2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def np_haversine_m(lat1, lon1, lat2, lon2):
    half_lat = np.sin(np.radians(lat2 - lat1) / 2)
    half_lon = np.sin(np.radians(lon2 - lon1) / 2)
    h = half_lat**2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon**2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def np_equirect_m(lat1, lon1, lat2, lon2):
    north = (lat2 - lat1) * METRES_PER_DEGREE
    east = (lon2 - lon1) * METRES_PER_DEGREE * np.cos(np.radians(lat2))
    return np.hypot(north, east)


def _col(c):
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)
