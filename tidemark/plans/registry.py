"""Named queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Comparable types: doubles to six places, whole numbers as bigint, dates as text."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf: finish(fn(spark, sf))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def sel(spec: str) -> str:
    """'a:i b:r c=expr:r' -> select list; i bigint, r rounded double, m date as text, s as is."""
    out = []
    for item in spec.split():
        name, kind = item.rsplit(":", 1)
        out.append({"i": f"CAST({name} AS BIGINT)", "r": f"round(CAST({name} AS DOUBLE), 6) + 0.0",
                    "m": f"strftime({name}, '%Y-%m-%d')", "s": name}[kind] + f" AS {name}")
    return ", ".join(out)
