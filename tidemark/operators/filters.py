"""Row filters and value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Surface codes of a native cell.
OCEAN, LAND = 90.0, 80.0


def not_ocean(location: Column) -> Column:
    return location != OCEAN


def land_only(location: Column) -> Column:
    return location == LAND


def in_bbox(lat: Column, lon: Column, lat_range, lon_range, pad: float = 0.0) -> Column:
    return (lat.between(lat_range[0] - pad, lat_range[1] + pad)
            & lon.between(lon_range[0] - pad, lon_range[1] + pad))


def between_months(month: Column, first: str, last: str) -> Column:
    return month.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def sentinel_to_null(v: Column, nodata: float = -9999.0, floor: float | None = None) -> Column:
    bad = v == nodata
    if floor is not None:
        bad = bad | (v < floor)
    return F.when(~bad, v)


def irrigated(pct_irr: Column, pct_wet: Column, src: Column, status: Column) -> Column:
    """Three-valued: an unknown status leaves the answer unknown unless decided elsewhere."""
    return (pct_irr > 40) | ((pct_wet > 40) & (src > 0) & (status != 1))


def irrigated_or_unknown(irr: Column, is_crop: Column) -> Column:
    """Unknown counts as irrigated, but only inside the class."""
    return F.coalesce(irr, F.lit(True)) & is_crop


def complete_units(df: DataFrame, unit: str, products: list[str], coverage: DataFrame,
                   min_coverage: float = 0.5, min_months: int = 60) -> DataFrame:
    """Units complete in every product on the table's months, covered, with enough months."""
    n_months = df.select(F.countDistinct("month")).scalar()
    counts = df.groupBy(unit).agg(*[F.count(p).alias("_" + p) for p in products])
    for p in products:
        counts = counts.where(F.col("_" + p) == n_months)
    first = "_" + products[0]
    return (counts.where(F.col(first) >= min_months)
            .join(coverage.where(F.col("coverage") >= min_coverage).select(unit), unit, "left_semi")
            .select(unit, F.col(first).alias("n_months")))


def min_history(df: DataFrame, unit: str, v: str, k: int) -> DataFrame:
    enough = df.groupBy(unit).agg(F.count(v).alias("_n")).where(F.col("_n") >= k)
    return df.join(enough.select(unit), unit, "left_semi")


def zero_without_contributors(df: DataFrame, unit: str, v: str, contributors: DataFrame) -> DataFrame:
    """Zero only for units that have no contributor at all; others keep their nulls."""
    has = contributors.select(unit).distinct().withColumn("_has", F.lit(True))
    return (df.join(has, unit, "left")
            .withColumn(v, F.when(F.col("_has").isNull(), F.lit(0.0)).otherwise(F.col(v))).drop("_has"))


def paired(v: Column, other: Column) -> Column:
    return F.when(other.isNotNull(), v)


def withhold(df: DataFrame, low: Column, cols: list[str]) -> DataFrame:
    keep = ~F.coalesce(low, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in cols})


def decode(df: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    """Labels for a code; a code without a label raises when rows are read."""
    known = labels.withColumn("_known", F.lit(True))
    joined = df.join(known, code, "left")
    bad = F.col(code).isNotNull() & F.col("_known").isNull()
    return joined.withColumn(code, F.when(bad, F.raise_error(
        F.concat(F.lit("no label for code "), F.col(code).cast("string")))).otherwise(F.col(code))).drop("_known")


def region_of_id(unit_id: Column, digits: float = 1e9) -> Column:
    return F.floor(unit_id / digits).cast("bigint")


def outside_share(df: DataFrame, boxes: DataFrame, on: str) -> DataFrame:
    """Share of each label's units outside the box the label implies."""
    out = ~(F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
            & F.col("lat").between(F.col("lat_min"), F.col("lat_max")))
    return df.join(boxes, on).groupBy(on).agg(F.count("*").alias("n"), F.avg(out.cast("double")).alias("outside"))


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fails the query on the first row where ok is not true."""
    fail = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(fail))


def reaches_past(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, lat_range, lon_range) -> Column:
    return ((lat_min < lat_range[0]) | (lat_max > lat_range[1])
            | (lon_min < lon_range[0]) | (lon_max > lon_range[1]))
