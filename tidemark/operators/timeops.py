"""Time-axis operators (W01-W18) on series with one row per (unit, month).

``reduce.to_monthly`` makes that shape, with a combine before its shuffle. A
window over one unit then holds at most one row per calendar month, whatever
the size of the raw data, so windows by unit are bounded by the record length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.dates import month_index, month_sequence


def _by(keys: list[str], month: str = "month"):
    return W.partitionBy(*keys).orderBy(month)


def deseasonalise(df: DataFrame, keys: list[str], month: str, v: str, out: str) -> DataFrame:
    w = W.partitionBy(*keys, F.month(month))
    return df.withColumn(out, F.col(v) - F.avg(v).over(w))


def recentre(df: DataFrame, keys: list[str], v: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(v) - F.avg(v).over(W.partitionBy(*keys)))


def rereference(df: DataFrame, keys: list[str], month: str, v: str, first: str, last: str,
                out: str) -> DataFrame:
    base = F.when(F.col(month).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col(v))
    return df.withColumn(out, F.col(v) - F.avg(base).over(W.partitionBy(*keys)))


def zscore(df: DataFrame, keys: list[str], v: str, out: str) -> DataFrame:
    w = W.partitionBy(*keys)
    sd = F.stddev_pop(v).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(v) - F.avg(v).over(w)) / sd))


def accumulated_anomaly(df: DataFrame, keys: list[str], month: str, v: str, out: str,
                        climatology: bool = False, nulls_as_zero: bool = False) -> DataFrame:
    """Running sum of departures over the rows given, re-centred."""
    base = W.partitionBy(*keys, F.month(month)) if climatology else W.partitionBy(*keys)
    a = F.col(v) - F.avg(v).over(base)
    if nulls_as_zero:
        a = F.coalesce(a, F.lit(0.0))
    run = F.sum("_a").over(_by(keys, month).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (df.withColumn("_a", a).withColumn("_c", run)
            .withColumn(out, F.col("_c") - F.avg("_c").over(W.partitionBy(*keys)))
            .drop("_a", "_c"))


def lagged(df: DataFrame, keys: list[str], month: str, v: str, lags: list[int],
           prefix: str) -> DataFrame:
    w = _by(keys, month)
    return df.withColumns({f"{prefix}{k}": F.lag(v, k).over(w) if k else F.col(v) for k in lags})


def complete_axis(df: DataFrame, keys: list[str], month: str, per_unit: bool = False) -> DataFrame:
    """Every unit on every month between the first and the last; ``observed`` marks real rows.

    The axis is generated from each unit's own row, so nothing is cross joined.
    """
    for c in (*keys, month):
        df = df.where(F.col(c).isNotNull())
    units = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    if not per_unit:
        span = units.agg(F.array(F.min("_a"), F.max("_b")).alias("s")).scalar()
        units = units.withColumn("_s", span).withColumn("_a", F.col("_s")[0]).withColumn("_b", F.col("_s")[1])
    axis = units.select(*keys, F.explode(month_sequence(F.col("_a"), F.col("_b"))).alias(month))
    return axis.join(df.withColumn("observed", F.lit(True)), [*keys, month], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False)))


def missing_months(df: DataFrame, month: str) -> DataFrame:
    """Months of the complete axis that no row has."""
    seen = df.select(month).distinct()
    span = seen.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    axis = span.select(F.explode(month_sequence(F.col("a"), F.col("b"))).alias(month))
    return axis.join(seen, month, "left_anti")


def year_on_year(df: DataFrame, keys: list[str], year: str, v: str, out: str) -> DataFrame:
    """Change from the year before, null when either year is missing."""
    w = W.partitionBy(*keys).orderBy(year)
    ok = F.col(year) - F.lag(year).over(w) == 1
    return df.withColumn(out, F.when(ok, F.col(v) - F.lag(v).over(w)))


def share_of_group(df: DataFrame, keys: list[str], v: str, out: str) -> DataFrame:
    total = F.sum(v).over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(total > 0, F.col(v) / total))


def centred_difference(df: DataFrame, keys: list[str], month: str, v: str, out: str) -> DataFrame:
    """Half the difference of the two calendar neighbours, only if both exist."""
    w, idx = _by(keys, month), month_index(F.col(month))
    ok = (F.lead(idx).over(w) - idx == 1) & (idx - F.lag(idx).over(w) == 1)
    return df.withColumn(out, F.when(ok, (F.lead(v).over(w) - F.lag(v).over(w)) / 2))


def timed_derivative(df: DataFrame, keys: list[str], month: str, v: str, days: str, out: str,
                     max_days: float = 80.0, calendar: bool = True) -> DataFrame:
    """Value per year on true mid-dates (``days`` = day number of the mid-date).

    calendar: both calendar neighbours present and their span within max_days;
    otherwise adjacent observed rows with each gap within max_days.
    """
    w, idx, d = _by(keys, month), month_index(F.col(month)), F.col(days)
    before, after = d - F.lag(days).over(w), F.lead(days).over(w) - d
    span = before + after
    if calendar:
        ok = ((F.lead(idx).over(w) - idx == 1) & (idx - F.lag(idx).over(w) == 1)
              & (span <= max_days))
    else:
        ok = (before <= max_days) & (after <= max_days)
    slope = F.try_divide(F.lead(v).over(w) - F.lag(v).over(w), span / 365.25)
    return df.withColumn(out, F.when(ok, slope))


def second_difference(df: DataFrame, keys: list[str], month: str, v: str, out: str) -> DataFrame:
    w, idx = _by(keys, month), month_index(F.col(month))
    ok = (F.lead(idx).over(w) - idx == 1) & (idx - F.lag(idx).over(w) == 1)
    return df.withColumn(out, F.when(ok, F.lag(v).over(w) - 2 * F.col(v) + F.lead(v).over(w)))


def noise_floor(df: DataFrame, keys: list[str], month: str, v: str, sample: bool = True) -> DataFrame:
    """Spread of the second difference over root six."""
    spread = F.stddev_samp if sample else F.stddev_pop
    return (second_difference(df, keys, month, v, "_d2").groupBy(*keys)
            .agg((spread("_d2") / F.sqrt(F.lit(6.0))).alias("noise_floor"),
                 F.count("_d2").alias("triplets")))


def rolling_mean(df: DataFrame, keys: list[str], month: str, v: str, window: int, out: str) -> DataFrame:
    """Centred mean over rows, at least window // 2 + 1 values."""
    half = window // 2
    w = _by(keys, month).rowsBetween(-half, half)
    return df.withColumn(out, F.when(F.count(v).over(w) >= half + 1, F.avg(v).over(w)))


def gap_runs(df: DataFrame, keys: list[str], month: str) -> DataFrame:
    """Runs of absent months between observed ones: first, last, length."""
    w, idx = _by(keys, month), month_index(F.col(month))
    prev = F.lag(month).over(w)
    size = idx - month_index(prev) - 1
    return (df.select(*keys, month, prev.alias("_prev"), size.alias("n_missing"))
            .where("n_missing > 0")
            .select(*keys, F.add_months("_prev", 1).alias("first_missing"),
                    F.add_months(month, -1).alias("last_missing"),
                    F.col("n_missing").cast("bigint").alias("n_missing")))


def segments(df: DataFrame, keys: list[str], month: str, out: str) -> DataFrame:
    """Numbers the unbroken runs of months."""
    w, idx = _by(keys, month), month_index(F.col(month))
    new = F.when(idx - F.lag(idx).over(w) > 1, 1).otherwise(0)
    return (df.withColumn("_new", new)
            .withColumn(out, F.sum("_new").over(
                w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("bigint")).drop("_new"))


def era_by_largest_gap(df: DataFrame, keys: list[str], month: str, out: str,
                       names: tuple[str, str]) -> DataFrame:
    """Labels rows up to the largest gap with the first name, later ones with the second."""
    w, idx = _by(keys, month), month_index(F.col(month))
    gaps = df.withColumn("_gap", F.lead(idx).over(w) - idx)
    cut = F.max_by(F.col(month), F.struct(F.col("_gap"), -idx)).over(W.partitionBy(*keys))
    return gaps.withColumn(out, F.when(F.col(month) <= cut, names[0]).otherwise(names[1])).drop("_gap")


def climatology_fill(df: DataFrame, keys: list[str], month: str, v: str) -> DataFrame:
    """Missing values from the unit's calendar-month mean; ``filled`` marks them."""
    w = W.partitionBy(*keys, F.month(month))
    return (df.withColumn("filled", F.col(v).isNull())
            .withColumn(v, F.coalesce(F.col(v), F.avg(v).over(w))))


def endpoint_change(df: DataFrame, keys: list[str], month: str, v: str) -> DataFrame:
    """Deseasonalised year means; last year minus first, and the months in each."""
    years = (deseasonalise(df, keys, month, v, "_d").groupBy(*keys, F.year(month).alias("year"))
             .agg(F.avg("_d").alias("m"), F.count("_d").alias("n")))
    row = F.struct("m", "n", "year")
    ends = years.where("n > 0").groupBy(*keys).agg(F.min_by(row, "year").alias("a"),
                                                   F.max_by(row, "year").alias("b"))
    return ends.select(*keys, F.col("a.year").cast("bigint").alias("first_year"),
                       F.col("b.year").cast("bigint").alias("last_year"),
                       (F.col("b.m") - F.col("a.m")).alias("change"),
                       F.col("a.n").alias("n_first"), F.col("b.n").alias("n_last"))


def trough_recovery(df: DataFrame, keys: list[str], month: str, v: str, before: str,
                    since: str) -> DataFrame:
    """Mean up to ``before``, lowest value from ``since``, mean after it, percent recovered."""
    pre = F.avg(F.when(F.col(month) <= F.lit(before).cast("date"), F.col(v)))
    late = F.when((F.col(month) >= F.lit(since).cast("date")) & F.col(v).isNotNull(), F.col(v))
    low = df.groupBy(*keys).agg(pre.alias("pre"), F.min(late).alias("trough"),
                                F.min_by(F.when(late.isNotNull(), F.col(month)),
                                         F.when(late.isNotNull(), F.struct(late, F.col(month))))
                                .alias("trough_month"))
    after = F.when(F.col(month) > F.col("trough_month"), F.col(v))
    post = (df.join(low.select(*keys, "trough_month"), keys).groupBy(*keys)
            .agg(F.avg(after).alias("post"), F.count(after).alias("n_post")))
    gain = F.try_divide(F.col("post") - F.col("trough"), F.col("pre") - F.col("trough"))
    return low.join(post, keys).withColumn("recovered_pct", 100 * gain)
