"""Flag tables with movable thresholds and their sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.units import flag

# Default thresholds, and the range each one is swept over.
DEFAULTS = {"min_cells": 2.0, "max_frac_dominant": 0.95, "min_var_ratio": 0.05, "max_pred_r2": 0.80,
            "min_r": 0.50, "max_trend_diff_ratio": 1.0, "max_rank_shift": 20.0}
SWEEP = {
    "min_cells": [1.0, 2.0, 3.0, 4.0],
    "max_frac_dominant": [0.80, 0.90, 0.95, 0.99],
    "min_var_ratio": [0.02, 0.05, 0.10, 0.20],
    "max_pred_r2": [0.70, 0.80, 0.90, 0.95],
    "min_r": [0.30, 0.50, 0.70, 0.90],
    "max_trend_diff_ratio": [0.5, 1.0, 2.0, 5.0],
    "max_rank_shift": [10.0, 20.0, 30.0, 50.0],
}
FLAGS = ["geometry", "no_departure", "predictor_derived", "disagreement", "rank_unstable"]
FLAG_OF = {"min_cells": "geometry", "max_frac_dominant": "geometry", "min_var_ratio": "no_departure",
           "max_pred_r2": "predictor_derived", "min_r": "disagreement",
           "max_trend_diff_ratio": "disagreement", "max_rank_shift": "rank_unstable"}


def conditions(cut) -> dict[str, Column]:
    """The five flags and their union for a lookup ``cut(name) -> Column``.

    Wants columns n_cells_a, n_cells_b, frac_dominant, var_ratio_a, var_ratio_b,
    pred_r2_a, pred_r2_b, r_ab, trend_diff_ratio, rank_shift. least and greatest
    skip nulls, as wanted here.
    """
    c = {
        "geometry": flag(F.least("n_cells_a", "n_cells_b") < cut("min_cells"))
        | flag(F.col("frac_dominant") > cut("max_frac_dominant")),
        "no_departure": flag(F.least("var_ratio_a", "var_ratio_b") < cut("min_var_ratio")),
        "predictor_derived": flag(F.greatest("pred_r2_a", "pred_r2_b") > cut("max_pred_r2")),
        "disagreement": flag(F.col("r_ab") < cut("min_r"))
        | flag(F.col("trend_diff_ratio") > cut("max_trend_diff_ratio")),
        "rank_unstable": flag(F.col("rank_shift") > cut("max_rank_shift")),
    }
    anyone = F.lit(False)
    for f in FLAGS:
        anyone = anyone | c[f]
    c["any"] = anyone
    return c


def product_conditions(cut, tag: str) -> dict[str, Column]:
    """One product's own three flags and their union."""
    geometry = (flag(F.col(f"n_cells_{tag}") < cut("min_cells"))
                | flag(F.col("frac_dominant") > cut("max_frac_dominant")))
    departure = flag(F.col(f"var_ratio_{tag}") < cut("min_var_ratio"))
    predictor = flag(F.col(f"pred_r2_{tag}") > cut("max_pred_r2"))
    return {f"geometry_{tag}": geometry, f"no_departure_{tag}": departure,
            f"predictor_derived_{tag}": predictor, f"any_own_{tag}": geometry | departure | predictor}


def with_flags(metrics: DataFrame, config: dict[str, float] | None = None) -> DataFrame:
    cfg = {**DEFAULTS, **(config or {})}
    cut = lambda name: F.lit(cfg[name])
    out = {**conditions(cut), **product_conditions(cut, "a"), **product_conditions(cut, "b")}
    return metrics.withColumns(out)


def sweep_configs() -> list[tuple[str, float, dict[str, float]]]:
    """One threshold moved at a time, then both corners."""
    rows = [(key, value, {**DEFAULTS, key: value}) for key, values in SWEEP.items() for value in values]
    loose = {k: (max(v) if k.startswith("max_") else min(v)) for k, v in SWEEP.items()}
    strict = {k: (min(v) if k.startswith("max_") else max(v)) for k, v in SWEEP.items()}
    return [*rows, ("most_generous", 0.0, loose), ("strictest", 0.0, strict)]


def sweep(metrics: DataFrame, area: str) -> DataFrame:
    """Flag counts of every configuration in one pass.

    The 30 configurations are a literal array exploded beside each unit, and the
    counts combine in the same task, so only one row per configuration shuffles.
    """
    listed = F.array(*[F.struct(
        F.lit(key).alias("key"), F.lit(float(value)).alias("value"), F.lit(FLAG_OF.get(key, "any")).alias("own"),
        *[F.lit(cfg[c]).alias(c) for c in DEFAULTS]) for key, value, cfg in sweep_configs()])
    rows = metrics.withColumn("_c", F.explode(listed))
    c = conditions(lambda name: F.col(f"_c.{name}"))
    own = F.lit(False)
    for f in (*FLAGS, "any"):
        own = own | ((F.col("_c.own") == f) & c[f])
    return rows.groupBy(F.col("_c.key").alias("key"), F.col("_c.value").alias("value")).agg(
        F.count_if(own).alias("n_flag"), F.count_if(c["any"]).alias("n_any"),
        (F.count_if(c["any"]) / F.count(F.lit(1))).alias("share_any"),
        F.try_divide(F.sum(F.when(c["any"], F.col(area)).otherwise(0.0)), F.sum(area)).alias("area_share_any"))
