"""Snapshot JSON, GeoJSON and zipped CSV."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import site_key

SNAPSHOT = ("nombrecomun string, nombreoficial string, estado string, nommunicipio string, "
            "latitud string, longitud string, namoalmac string, almacenaactual string")


def read_snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOT,
                   numeric: tuple[str, ...] = ("latitud", "longitud", "namoalmac", "almacenaactual"),
                   multi_line: bool = True) -> DataFrame:
    """One array of objects per date, the date last in the path; empty arrays give no rows."""
    df = (spark.read.schema(schema).option("multiLine", multi_line)
          .option("recursiveFileLookup", True).json(path))
    date = F.to_date(F.regexp_extract("_metadata.file_path", r".*(\d{4}-\d{2}-\d{2})", 1))
    return df.withColumn("date", date).withColumns({c: F.expr(f"try_cast({c} as double)") for c in numeric})


def read_geojson_years(spark: SparkSession, path: str, prefix: str, year_prefix: str,
                       name: str, code: str) -> DataFrame:
    """Collections of features whose year values are properties, as site, lat, lon, year, value."""
    schema = ("features array<struct<geometry:struct<coordinates:array<double>>,"
              "properties:map<string,string>>>")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return year_properties(rows, prefix, year_prefix, name, code)


def year_properties(rows: DataFrame, prefix: str, year_prefix: str, name: str, code: str) -> DataFrame:
    """Null, empty and non-positive values are dropped."""
    f = rows.select(F.explode("features").alias("f"))
    long = f.select(
        site_key(prefix, F.col("f.properties").getItem(name), F.col("f.properties").getItem(code)).alias("site"),
        F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
        F.explode(F.map_entries("f.properties")).alias("p"))
    value = F.expr("try_cast(p.value as double)")
    return (long.where(F.col("p.key").startswith(year_prefix))
            .select("site", "lat", "lon", F.regexp_extract("p.key", r"(\d{4})$", 1).cast("int").alias("year"),
                    value.alias("value")).where("value > 0"))


def read_zipped_csv(spark: SparkSession, path: str, schema: StructType, year_pattern: str) -> DataFrame:
    """Every CSV member of every archive under a path; the year comes from the archive's name."""
    return zipped_csv_rows(spark.read.format("binaryFile").load(path), schema, year_pattern)


def zipped_csv_rows(archives: DataFrame, schema: StructType, year_pattern: str) -> DataFrame:
    """As read_zipped_csv, of archives(path, content); members are read in blocks."""
    names = [f.name for f in schema.fields]

    def members(batches):
        for pdf in batches:
            for year, content in zip(pdf["year"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if not member.lower().endswith(".csv"):
                            continue
                        with z.open(member) as fh:
                            for block in pd.read_csv(fh, chunksize=50_000):
                                yield block[names].assign(year=year)

    files = archives.select(F.regexp_extract("path", year_pattern, 1).cast("int").alias("year"), "content")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", year int"
    return files.mapInPandas(members, ddl)
