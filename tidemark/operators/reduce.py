"""Aggregations (A01-A54): null-aware means, moments, counts, bins.

All of these are plain aggregates, so Spark combines inside each map task and a
hot key costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_seconds
from tidemark.functions.stats import pearson
from tidemark.functions.units import flag, safe_div
from tidemark.operators.order import quantiles


# --- weighted means, one per null rule -------------------------------------

def weighted_mean(v: Column, w: Column) -> Column:
    """Missing values drop from the numerator and the denominator."""
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def covered_mean(v: Column, w: Column, min_cover: float) -> Column:
    """As above, null unless at least min_cover of the weight is present."""
    present = F.sum(F.when(v.isNotNull(), w))
    return F.when(F.try_divide(present, F.sum(w)) >= min_cover, weighted_mean(v, w))


def strict_mean(v: Column, w: Column) -> Column:
    """Null when any value is missing."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.try_divide(F.sum(v * w), F.sum(w)))


def fixed_weight_mean(v: Column, w: Column) -> Column:
    """Denominator is the whole weight, null when nothing reported."""
    return F.when(F.count(v) > 0, F.try_divide(F.sum(v * w), F.sum(w)))


def all_reporting_sum(v: Column, n_expected: Column) -> Column:
    """Null unless every expected contributor reported."""
    return F.when(F.count(v) == F.max(n_expected), F.sum(v))


def sum_min_count(v: Column, k: int) -> Column:
    return F.when(F.count(v) >= k, F.sum(v))


def always_complete_mean(df: DataFrame, keys: list[str], member: str, month: str,
                         v: str, w: str) -> DataFrame:
    """Weighted mean over members that have a value in every month of the table."""
    n_months = df.select(F.countDistinct(month)).scalar()
    full = (df.groupBy(*keys, member).agg(F.count(v).alias("_n"))
            .where(F.col("_n") == n_months).select(*keys, member))
    return (df.join(full, [*keys, member], "left_semi").groupBy(*keys, month)
            .agg(weighted_mean(F.col(v), F.col(w)).alias(v),
                 F.countDistinct(member).alias("members")))


def overlay_means(overlap: DataFrame, obs: DataFrame, cell: list[str], unit: str, month: str,
                  v: str, w: str) -> DataFrame:
    """Per unit and month over an overlap table.

    The overlap has one row per (unit, cell); it is broadcast by Spark when it is
    under the size limit, else both sides shuffle on the cell. The mean combines
    before its own shuffle, so a unit with most of the cells is not one task's work.
    """
    return (obs.join(overlap, cell).groupBy(unit, month)
            .agg(weighted_mean(F.col(v), F.col(w)).alias(v)))


# --- collapse to months -----------------------------------------------------

def to_monthly(df: DataFrame, keys: list[str], ts: str, v: str) -> DataFrame:
    """Plain mean of the solutions that fall in one calendar month."""
    return (df.groupBy(*keys, F.trunc(F.to_date(ts), "MM").alias("month"))
            .agg(F.avg(v).alias(v)))


def collapse_by_days(df: DataFrame, keys: list[str], month: str, v: str, noise: str, days: str,
                     start: str, end: str, mid: str) -> DataFrame:
    """Solutions of one month weighted by days used; noise averaged the same way."""
    d = F.col(days)

    def by_days(c: Column) -> Column:
        return F.try_divide(F.sum(c * d), F.sum(d))

    return df.groupBy(*keys, month).agg(
        by_days(F.col(v)).alias(v), by_days(F.col(noise)).alias(noise),
        F.min(start).alias(start), F.max(end).alias(end), F.sum(d).alias(days),
        by_days(epoch_seconds(F.col(mid))).alias("mid_epoch"))


# --- moments ------------------------------------------------------------------

def variance_ratio(num: Column, den: Column) -> Column:
    """Population variances; null when the denominator has none."""
    return F.try_divide(F.var_pop(num), F.var_pop(den))


def paired_r(x: Column, y: Column, min_pairs: int = 10) -> Column:
    """Pearson r over rows that have both, null for few pairs or a constant side."""
    pairs = F.count_if(x.isNotNull() & y.isNotNull())
    return F.when(pairs >= min_pairs, pearson(x, y))


def flag_tally(df: DataFrame, flags: list[str], area: str, by: list[str] | None = None) -> DataFrame:
    """Count and area share of every flag in one pass, one row per flag."""
    by = by or []
    long = df.select(*by, area, F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), flag(F.col(f).cast("boolean")).alias("hit"))
        for f in flags])).alias("_f"))
    return long.groupBy(*by, F.col("_f.flag").alias("flag")).agg(
        F.count_if(F.col("_f.hit")).alias("n"),
        F.try_divide(F.sum(F.when(F.col("_f.hit"), F.col(area)).otherwise(0.0)), F.sum(area)).alias("area_share"))


def eta_squared(df: DataFrame, y: str, group: str) -> DataFrame:
    """Between-group share of the sum of squares, from group sums only."""
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"),
                              F.var_pop(y).alias("v"))
    grand = F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))
    between = (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand)
    within = F.sum(F.col("n") * F.col("v"))
    return g.where(F.col("n") > 0).agg(F.try_divide(between, between + within).alias("eta_squared"),
                                       F.count("*").alias("groups"))


# --- bins -----------------------------------------------------------------------

def fixed_bins(v: Column, low: float, high: float, n: int) -> Column:
    """Bin number 0..n-1, values outside go to the end bins."""
    raw = F.floor((v - low) / (high - low) * n)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("bigint")


def right_closed_bin(v: Column, width: float) -> Column:
    return F.ceil(v / width).cast("bigint")


def decile_shares(df: DataFrame, measure: str, flagged: str) -> DataFrame:
    """Ten bins between exact percentiles of the measure; the last one is closed."""
    edges = quantiles(df, measure, [i / 10 for i in range(11)])
    listed = edges.agg(F.array_sort(F.collect_list(F.struct("prob", "quantile"))).alias("e"))
    bounds = listed.select(F.transform("e", lambda s: s["quantile"])).scalar()
    inner = F.size(F.filter(F.slice("_e", 2, 9), lambda e: e <= F.col(measure)))
    rows = (df.where(F.col(measure).isNotNull()).withColumn("_e", bounds)
            .withColumn("decile", (inner + 1).cast("bigint")))
    return rows.groupBy("decile").agg(
        F.first(F.element_at("_e", F.col("decile").cast("int"))).alias("low"),
        F.first(F.element_at("_e", (F.col("decile") + 1).cast("int"))).alias("high"),
        F.count("*").alias("n"), F.avg(flag(F.col(flagged)).cast("double")).alias("share"))


def round_up_limit(df: DataFrame, value: str, steps: list[float], q: float = 0.95) -> DataFrame:
    """Floor-index quantile of the absolute values, rounded up to a step."""
    from tidemark.operators.order import value_counts
    mag = df.select(F.abs(value).alias("v")).where("v is not null")
    counts = value_counts(mag, "v")
    place = F.floor(F.col("total") * q)
    hit = counts.where((F.col("before") <= place) & (place < F.col("before") + F.col("n")))
    choices = F.array(*[F.lit(float(s)) for s in steps])
    return hit.select(F.col("v").alias("q_value"), F.coalesce(
        F.array_min(F.filter(choices, lambda s: s >= F.col("v"))), F.lit(float(steps[-1])))
        .alias("limit"))


def regional_uncertainty(noise: Column, leakage: Column, cap: int = 22) -> Column:
    n = F.count(F.lit(1))
    return (F.avg(noise) + F.avg(leakage)) / F.sqrt(n / F.least(F.lit(cap), n))


def change_first_last(v: Column, month: Column, min_n: int = 10) -> Column:
    """Last minus first value in month order, ignoring missing ones."""
    when = F.when(v.isNotNull(), month)
    return F.when(F.count(v) >= min_n, F.max_by(v, when) - F.min_by(v, when))


def window_mean(v: Column, month: Column, first: str, last: str) -> Column:
    inside = month.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return F.avg(F.when(inside, v))


def share(part: Column, whole: Column) -> Column:
    return safe_div(F.sum(part), F.sum(whole))
