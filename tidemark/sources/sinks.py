"""Sinks (K01-K07)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_sequence


def write_series(df: DataFrame, path: str, series: str, unit: str, ts: str, v: str) -> None:
    """Monthly series under series=<name>; several solutions of a month are averaged."""
    out = (df.groupBy(F.col(unit).alias("unit_id"), F.trunc(F.to_date(ts), "MM").alias("month"))
           .agg(F.avg(v).alias("value")))
    out.write.mode("overwrite").parquet(f"{path}/series={series}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """Nested summary: rows of structs and arrays as JSON lines."""
    df.write.mode("overwrite").json(path)


def keyed_stack(frames: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn(key, F.lit(k)) for k, f in frames.items()])


def payload_arrays(df: DataFrame, unit: str, month: str, v: str, first: Column, last: Column,
                   factor: int = 10) -> DataFrame:
    """One array of whole numbers per unit on the full month axis, null where a month is missing.

    The array is as long as the record, whatever the size of the data.
    """
    held = df.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(month), F.round(F.col(v) * factor).cast("bigint")))).alias("_m"))
    axis = month_sequence(first, last)
    return held.select(unit, F.transform(axis, lambda m: F.try_element_at(F.col("_m"), m)).alias("values"))


def provenance(df: DataFrame, source: str, unit: str, month: str) -> DataFrame:
    return df.agg(F.lit(source).alias("source"), F.count("*").alias("rows"), F.countDistinct(unit).alias("units"),
                  F.min(month).alias("first_month"), F.max(month).alias("last_month"))


def split_by_membership(df: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Rows in and rows out; unknown membership counts as out."""
    member = F.coalesce(inside, F.lit(False))
    return df.where(member), df.where(~member)
