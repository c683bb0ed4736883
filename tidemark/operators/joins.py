"""Relational joins with a rule of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_months(frames: list[DataFrame], month: str = "month") -> DataFrame:
    """Months that every source has, from one union rather than a chain of joins."""
    tagged = [f.select(month).distinct().withColumn("_s", F.lit(i)) for i, f in enumerate(frames)]
    return (reduce(DataFrame.unionByName, tagged).groupBy(month).agg(F.count("*").alias("_n"))
            .where(F.col("_n") == len(frames)).select(month))


def on_common_months(frames: list[DataFrame], month: str = "month") -> list[DataFrame]:
    common = common_months(frames, month)
    return [f.join(common, month, "left_semi") for f in frames]


def override(base: DataFrame, over: DataFrame, listed: DataFrame, keys: list[str], unit: str, v: str) -> DataFrame:
    """Listed units take the other source for every row, missing values included."""
    flag = listed.select(unit).distinct().withColumn("_listed", F.lit(True))
    other = over.select(*keys, F.col(v).alias("_over"))
    return (base.join(flag, unit, "left").join(other, keys, "left")
            .withColumn(v, F.when(F.col("_listed"), F.col("_over")).otherwise(F.col(v)))
            .withColumn("overridden", F.coalesce("_listed", F.lit(False))).drop("_listed", "_over"))


def fallback_source(a: DataFrame, b: DataFrame, unit: str, month: str, v: str, more_than: int = 12) -> DataFrame:
    """Source a for units where it has more than so many months, else b; the tag is kept."""
    good = a.groupBy(unit).agg(F.count(v).alias("_n")).where(F.col("_n") > more_than).select(unit)
    first = a.join(good, unit, "left_semi").select(unit, month, v, F.lit("a").alias("source"))
    rest = b.join(good, unit, "left_anti").select(unit, month, v, F.lit("b").alias("source"))
    return first.unionByName(rest)


def reference_unit(units: DataFrame, unit: str) -> DataFrame:
    """The unit nearest to the mean centre, by |dlat| + |dlon|."""
    mean = units.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    d = (F.abs(F.col("lat") - mean.select("lat").scalar()) + F.abs(F.col("lon") - mean.select("lon").scalar()))
    return units.withColumn("_d", d).orderBy("_d", unit).limit(1).drop("_d")


def parent_pairs(series: DataFrame, parent: dict[str, str], product: str, keys: list[str], v: str) -> DataFrame:
    """Each product's rows beside those of the product it was built from."""
    pairs = F.create_map(*[F.lit(x) for kv in parent.items() for x in kv])
    child = series.withColumn("parent", F.try_element_at(pairs, F.col(product))).where("parent is not null")
    other = series.select(F.col(product).alias("parent"), *keys, F.col(v).alias("parent_value"))
    return child.join(other, ["parent", *keys])


def agreement(a: DataFrame, b: DataFrame, keys: list[str], unit: str, v: str) -> DataFrame:
    """Two implementations on shared keys: mean and largest absolute difference, worst unit."""
    d = F.abs(F.col("_a") - F.col("_b"))
    both = a.select(*keys, F.col(v).alias("_a")).join(b.select(*keys, F.col(v).alias("_b")), keys).withColumn("_d", d)
    return both.agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.max("_d").alias("max_diff"),
                    F.max_by(F.col(unit), F.struct(F.col("_d"), -F.col(unit))).alias("worst"))


def nearest_to_wanted(units: DataFrame, unit: str, d: Column, wanted: list[float]) -> DataFrame:
    """The unit nearest to each wanted distance, each unit once."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in wanted]))
    rows = units.withColumn("_d", d).withColumn("wanted", asked)
    best = rows.groupBy("wanted").agg(F.min(F.struct(
        F.abs(F.col("_d") - F.col("wanted")).alias("gap"), F.col(unit).alias("u"), F.col("_d").alias("d"))).alias("_m"))
    return best.groupBy(F.col("_m.u").alias(unit)).agg(F.min("wanted").alias("wanted"), F.first("_m.d").alias("km"))


def spread_annual(annual: DataFrame, weights: DataFrame, keys: list[str], v: str, w: str) -> DataFrame:
    """An annual amount over its months by weight."""
    return weights.join(annual, keys).withColumn("monthly", F.col(v) * F.col(w))
