"""Unit conversions (F19) and the value guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact or conventional conversion factors.
M3_PER_ACRE_FOOT = 1233.48184
KM2_PER_ACRE = 0.0040468564224
MM_PER_CM = 10.0
SECONDS_PER_DAY = 86400.0
MM_PER_FOOT = 304.8


def cm_to_mm(v: Column) -> Column:
    return v * MM_PER_CM


def rate_to_mm_month(rate: Column, days: Column) -> Column:
    """kg m-2 s-1 to mm per month."""
    return rate * SECONDS_PER_DAY * days


def acre_feet_to_mm(af: Column, area_km2: Column) -> Column:
    return F.try_divide(af * M3_PER_ACRE_FOOT, area_km2 * 1e6) * 1e3


def thousand_acre_feet_to_mm(taf: Column, area_km2: Column) -> Column:
    return acre_feet_to_mm(taf * 1e3, area_km2)


def hm3_to_mm(hm3: Column, area_km2: Column) -> Column:
    return F.try_divide(hm3 * 1000.0, area_km2)


def acres_to_km2(acres: Column) -> Column:
    return acres * KM2_PER_ACRE


def acre_feet_per_acre_to_mm(depth: Column) -> Column:
    return depth * MM_PER_FOOT


def mm_yr_to_km3_yr(rate: Column, area_km2: Column) -> Column:
    return rate * area_km2 * 1e-6


def volumetric_to_mm(fraction: Column, depth_mm: float = 1000.0) -> Column:
    return fraction * depth_mm


def percent_of(value: Column, capacity: Column) -> Column:
    return 100.0 * safe_div(value, capacity)


def safe_div(num: Column, den: Column) -> Column:
    """Null when the denominator is not positive."""
    return num / F.when(den > 0, den)


def clip(v: Column, low=None, high=None) -> Column:
    """Nulls stay null, which greatest and least alone would not do."""
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(v.isNotNull(), out)


def flag(cond: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(cond, F.lit(False))
