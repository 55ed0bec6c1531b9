"""Distances in metres and angles in degrees on a sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371008.8


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, clockwise from north, 0 to 360."""
    d_lon = F.radians(lon2 - lon1)
    east = F.sin(d_lon) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d_lon)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    return F.least(F.pmod(a - b, F.lit(360.0)), F.pmod(b - a, F.lit(360.0)))


def valid_coords(lat: Column, lon: Column) -> Column:
    """Both coordinates present and on the globe."""
    return lat.isNotNull() & lon.isNotNull() & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
