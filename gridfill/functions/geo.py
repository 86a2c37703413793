"""Column functions for degrees, distances and polygons. Everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree of latitude, and the sphere radius behind the distance factor.
KM_PER_DEGREE = 111
EARTH_RADIUS_KM = 6371.0


def degree_gaps(grid_length: float, lat_max: float, lat_min: float) -> tuple[float, float]:
    """Grid step in km -> (lat step, lon step) in degrees, longitude scaled at the middle latitude."""
    mid = (lat_max + lat_min) / 2
    return grid_length / KM_PER_DEGREE, grid_length / (KM_PER_DEGREE * math.cos(math.pi * mid / 180))


def lat_gap_col(g: Column) -> Column:
    return g / F.lit(float(KM_PER_DEGREE))


def lon_gap_col(g: Column, mid_lat: Column) -> Column:
    return g / (F.lit(float(KM_PER_DEGREE)) * F.cos(F.lit(math.pi) * mid_lat / F.lit(180.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def haversine_km_value(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(a))


def alpha(lat: Column) -> Column:
    """Length in km of one degree of longitude at the whole-degree part of a latitude, 4 places."""
    d = F.radians(F.floor(F.abs(lat)).cast("double"))
    return F.round(F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.cos(d) * F.lit(math.sin(math.radians(0.5)))), 4)


def alpha_value(lat: float) -> float:
    d = math.radians(math.floor(abs(lat)))
    return round(2 * EARTH_RADIUS_KM * math.asin(math.cos(d) * math.sin(math.radians(0.5))), 4)


def euclidean(dlat: Column, dlon: Column) -> Column:
    return F.sqrt(dlat * dlat + dlon * dlon)


def triangle_area(x1, y1, x2, y2, x3, y3):
    """Signed area; positive when the corners run counter-clockwise. Works on columns and numbers."""
    return 0.5 * ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1))


def circumcentre(x1, y1, x2, y2, x3, y3):
    """Centre of the circle through three points (not collinear), relative to the first for accuracy."""
    bx, by, cx, cy = x2 - x1, y2 - y1, x3 - x1, y3 - y1
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    return x1 + (cy * b2 - by * c2) / d, y1 + (bx * c2 - cx * b2) / d


def inside_polygon(lat: Column, lon: Column, vertices: Column) -> Column:
    """Odd number of sides met on the way towards growing lat. A side holds its upper end in lon but not its lower one, so a
    shared vertex counts once and a side along the way never; points on a side that is met count as below it."""

    def met(a: Column, b: Column) -> Column:
        turn = (lon - a["lon"]) * (b["lat"] - a["lat"]) - (lat - a["lat"]) * (b["lon"] - a["lon"])
        spans = (a["lon"] < lon) != (b["lon"] < lon)
        return (spans & F.when(b["lon"] > a["lon"], turn >= 0).otherwise(turn <= 0)).cast("int")

    ends = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))
    count = F.aggregate(F.zip_with(vertices, ends, met), F.lit(0), lambda n, x: n + x)
    return F.coalesce((F.size(vertices) >= 3) & (count % 2 == 1), F.lit(False))
