"""String keys, JSON and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position_key(lat: Column, lon: Column) -> Column:
    """Two decimals of each coordinate, as text."""
    return F.concat_ws("_", F.format_string("%.2f", lat), F.format_string("%.2f", lon))


def site_key(prefix: str, name: Column, code: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.trim(name), F.lit("|"), F.trim(code))


def strip_marks(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit("*"), F.lit("")))


def water_year_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"WY\s*(\d{4})", 1), F.lit("")).cast("int")


def year_suffix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d{4})$", 1), F.lit("")).cast("int")


def as_json(value: Column) -> Column:
    return F.to_json(value)


def series_fingerprint(pairs: Column) -> Column:
    """Digest of an array of (month, value) structs, ordered by month."""
    return F.sha2(F.to_json(F.array_sort(pairs)), 256)
