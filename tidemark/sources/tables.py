"""Table scans and reshapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidemark.functions.geo import box_edges, wrap180
from tidemark.operators.filters import LAND, in_bbox
from tidemark.operators.order import dense_index


def read_csv(spark: SparkSession, path: str, schema: str | StructType, comment: str | None = None) -> DataFrame:
    """Header row, explicit types, nothing inferred."""
    reader = spark.read.schema(schema).option("header", True)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def read_if_present(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """None when the table has not been made; other errors pass."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def csv_view(spark: SparkSession, path: str, schema: str | StructType, view: str) -> DataFrame:
    df = read_csv(spark, path, schema)
    df.createOrReplaceTempView(view)
    return df


def scan_grid(spark: SparkSession, path: str, source: str, years: tuple[int, int]) -> DataFrame:
    """Long cube partitioned by source and year; both filters prune folders."""
    df = spark.read.parquet(path)
    return df.where((F.col("source") == source) & F.col("year").between(*years))


def file_months(df: DataFrame, pattern: str, first: str, last: str) -> DataFrame:
    """Cube files without a date inside, one or more a month: ``month`` is the yyyyMM that the pattern's group finds
    in a file's path. Files of other months, or without one, are not opened."""
    month = F.to_date(F.nullif(F.regexp_extract("_metadata.file_path", pattern, 1), F.lit("")), "yyyyMM")
    return df.where(month.between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).withColumn("month", month)


def with_edges(cells: DataFrame) -> DataFrame:
    lat_lo, lat_hi = box_edges(F.col("lat_center"), F.col("lat_span"))
    lon_lo, lon_hi = box_edges(F.col("lon_center"), F.col("lon_span"))
    return cells.withColumns({"lon_180": wrap180(F.col("lon_center")), "lat_min": lat_lo, "lat_max": lat_hi,
                              "lon_min": lon_lo, "lon_max": lon_hi})


def scan_region(cells: DataFrame, lat_range, lon_range, only_land: bool = True, pad: float = 0.0) -> DataFrame:
    """Box and surface filters, which Parquet takes into the scan."""
    df = cells.where(in_bbox(F.col("lat"), F.col("lon"), lat_range, lon_range, pad))
    return df.where(F.col("location") == LAND) if only_land else df


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def melt_months(df: DataFrame, ids: list[str], pattern: str, variables: list[str]) -> DataFrame:
    """Columns named variable, month and year -> one row per month, one column per variable.

    pattern has three groups: variable, two-digit month, four-digit year.
    """
    cols = [c for c in df.columns if c not in ids]
    long = melt(df, ids, cols)
    part = [F.regexp_extract("name", pattern, g) for g in (1, 2, 3)]
    long = long.select(*ids, part[0].alias("variable"),
                       F.make_date(part[2].cast("int"), part[1].cast("int"), F.lit(1)).alias("month"), "value")
    return long.groupBy(*ids, "month").pivot("variable", variables).agg(F.sum("value"))


def melt_years(df: DataFrame, ids: list[str], variables: list[str], years: list[int]) -> DataFrame:
    """Columns variable_yy -> one row per year, generated in place without a shuffle."""
    rows = F.array(*[F.struct(F.lit(y).alias("year"), *[F.col(f"{v}_{y % 100:02d}").alias(v) for v in variables])
                     for y in years])
    return df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*")


def harmonise(frames: list[DataFrame], renames: dict[str, str], recode: dict[str, str], cls: str) -> DataFrame:
    """Yearly variants under one schema: renamed columns, absent columns null, old classes recoded."""
    def one(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns})

    table = F.create_map(*[F.lit(x) for kv in recode.items() for x in kv])
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(f) for f in frames])
    return merged.withColumn(cls, F.coalesce(F.try_element_at(table, F.col(cls)), F.col(cls)))


def concat_indexed(parts: list[DataFrame], key: str) -> DataFrame:
    return dense_index(reduce(DataFrame.unionByName, parts), key)


def category_pivot(df: DataFrame, keys: list[str], category: str, names: dict[str, str], v: str) -> DataFrame:
    """Listed categories as renamed columns, summed."""
    picked = df.where(F.col(category).isin(list(names)))
    wide = picked.groupBy(*keys).pivot(category, list(names)).agg(F.sum(v))
    return wide.withColumnsRenamed(names)


def assert_units(df: DataFrame, units: Column, wanted: str) -> DataFrame:
    """Fails the query when a row declares another unit."""
    bad = F.raise_error(F.concat(F.lit(f"expected {wanted}, found "), F.coalesce(units, F.lit("none"))))
    return df.where(F.when(F.coalesce(units == wanted, F.lit(False)), F.lit(True)).otherwise(bad.cast("boolean")))
