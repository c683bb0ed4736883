"""Column functions on the time axis (F08-F18). A month is its first day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 365.25 * 86400


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM-dd")


def from_year_doy(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def from_mjd(mjd: Column) -> Column:
    """Whole days since 1858-11-17."""
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(mjd).cast("int"))


def month_from_decimal_year(dy: Column) -> Column:
    year = F.floor(dy)
    month = F.greatest(F.lit(1), F.least(F.lit(12), F.floor((dy - year) * 12).cast("int") + 1))
    return F.make_date(year.cast("int"), month, F.lit(1))


def from_days_since(days: Column, units_text: Column, default: str = "2002-01-01") -> Column:
    epoch = F.regexp_extract(units_text, r"(\d{4}-\d{2}-\d{2})", 1)
    epoch = F.coalesce(F.to_date(F.nullif(epoch, F.lit(""))), F.lit(default).cast("date"))
    return F.date_add(epoch, F.floor(days).cast("int"))


def from_months_since_1960(months: Column) -> Column:
    return F.add_months(F.lit("1960-01-01").cast("date"), F.floor(months).cast("int"))


def from_ref_day(day: Column) -> Column:
    """Day 1 is 2002-01-01."""
    return F.date_add(F.lit("2002-01-01").cast("date"), (day - 1).cast("int"))


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month))


def decimal_year(d: Column) -> Column:
    length = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    return F.year(d) + (F.dayofyear(d) - 1) / length


def epoch_seconds(d: Column) -> Column:
    """Seconds since 1970 as the clock shows them, whatever the session's time zone."""
    return F.unix_date(F.to_date(d)) * F.lit(86400).cast("bigint") + F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)


def epoch_years(d: Column) -> Column:
    """Years of 365.25 days since 1970."""
    return epoch_seconds(d) / SECONDS_PER_YEAR


def water_year(d: Column) -> Column:
    """October to September, named by the year it ends in."""
    return F.year(F.add_months(d, 3))


def water_year_months(wy: Column) -> Column:
    """The twelve months November to October of the irrigation water year."""
    first = F.make_date((wy - 1).cast("int"), F.lit(11), F.lit(1))
    return F.sequence(first, F.add_months(first, 11), F.expr("interval 1 month"))


def month_index(d: Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    return F.year(d) * 12 + F.month(d) - 1


def month_sequence(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 month"))
