"""Column functions on coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii in km, one per use.
R_MEAN = 6371.0088        # cell areas and great circles
R_HAVERSINE = 6371.0      # distances between unit centres
R_AUTHALIC = 6371.007181  # cell areas in the regional studies
KM_PER_DEGREE = 111.0     # planar approximation


def wrap180(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def box_edges(center: Column, span: Column) -> tuple[Column, Column]:
    return center - span / 2, center + span / 2


def cos_lat(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def cell_area_km2(lat: Column, dlat, dlon, radius: float = R_MEAN) -> Column:
    """Area on the sphere of the cell of height dlat and width dlon centred at lat."""
    dlat, dlon = F.lit(dlat), F.lit(dlon)
    return (F.lit(radius ** 2) * F.radians(dlon)
            * (F.sin(F.radians(lat + dlat / 2)) - F.sin(F.radians(lat - dlat / 2))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius: float = R_HAVERSINE) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * radius * F.asin(F.sqrt(a))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                    radius: float = R_MEAN) -> Column:
    dot = (F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
           + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
           * F.cos(F.radians(lon1) - F.radians(lon2)))
    return radius * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def planar_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    return F.hypot((lat - lat0) * KM_PER_DEGREE,
                   (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat0)))


def equal_area_x(lon: Column, radius: float = R_MEAN) -> Column:
    """Easting of the cylindrical equal-area projection with parallels at 30 degrees."""
    return radius * F.radians(lon) * math.cos(math.radians(30))


def equal_area_y(lat: Column, radius: float = R_MEAN) -> Column:
    return radius * F.sin(F.radians(lat)) / math.cos(math.radians(30))
