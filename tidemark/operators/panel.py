"""Panels, block hold-out and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import binomial_pvalue, signed_rank_pvalue, solve_normal
from tidemark.operators.fit import gram
from tidemark.operators.order import average_rank, quantiles, salted_join
from tidemark.operators.reduce import paired_r
from tidemark.operators.timeops import zscore


def standard_panel(df: DataFrame, unit: str, cols: list[str]) -> DataFrame:
    """Every column standardised over its unit, rows complete in all of them."""
    for c in cols:
        df = zscore(df, [unit], c, c)
    return df.na.drop("any", subset=cols)


def _quadratic(k: int, prefix: str = "") -> Column:
    """Sum of squared errors of a block from its own sums and the held-out solution."""
    b = [F.element_at("sol", i + 1) for i in range(k)]
    cross = sum((b[i] * F.col(f"{prefix}xy_{i}") for i in range(1, k)), b[0] * F.col(f"{prefix}xy_0"))
    square = F.lit(0.0)
    for i in range(k):
        for j in range(i, k):
            square = square + (1 if i == j else 2) * b[i] * b[j] * F.col(f"{prefix}xx_{i}_{j}")
    return F.col(f"{prefix}yy") - 2 * cross + square


def block_grams(panel: DataFrame, keys: list[str], block: str, y: str, xs: list[str]) -> DataFrame:
    """Sums of products per block; the constant comes first. Built once, used by every model."""
    for c in (*keys, block):
        panel = panel.where(F.col(c).isNotNull())
    return gram(panel.withColumn("one", F.lit(1.0)), [*keys, block], y, ["one", *xs])


def sub_model(grams: DataFrame, keys: list[str], block: str, all_xs: list[str], use: list[str]) -> DataFrame:
    """Rows and columns of the sums that one nested model needs."""
    full = ["one", *all_xs]
    pos = [0] + [full.index(x) for x in use]
    picked = [F.col(f"xx_{min(pos[i], pos[j])}_{max(pos[i], pos[j])}").alias(f"xx_{i}_{j}")
              for i in range(len(pos)) for j in range(i, len(pos))]
    picked += [F.col(f"xy_{p}").alias(f"xy_{i}") for i, p in enumerate(pos)]
    return grams.select(*keys, block, *picked, "yy", "sy", "n")


def held_out(grams: DataFrame, keys: list[str], block: str, k: int) -> DataFrame:
    """Coefficients per block from all other blocks: total sums minus the block's own."""
    sums = [c for c in grams.columns if c not in (*keys, block)]
    # One array keeps every sum in the totals, so that they read the same shuffle as the blocks.
    every = F.array(*[F.sum(c).cast("double") for c in sums]).alias("_all")
    if keys:
        both = grams.join(grams.groupBy(*keys).agg(every), keys)
    else:
        both = grams.withColumn("_all", grams.agg(every).scalar())
    rest = {c: F.col("_all")[i] - F.col(c) for i, c in enumerate(sums)}
    xx = F.array(*[rest[f"xx_{i}_{j}"] for i in range(k) for j in range(i, k)])
    xy = F.array(*[rest[f"xy_{i}"] for i in range(k)])
    return both.withColumn("sol", solve_normal(xx, xy)).drop("_all")


def pooled_r2(solved: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Out-of-sample R2 over all rows, from block sums alone: no second pass over the panel."""
    ok = solved.where("sol is not null").withColumn("sse", _quadratic(k))
    sst = F.sum("yy") - F.sum("sy") * F.sum("sy") / F.sum("n")
    return ok.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_blocks"),
                                 (1 - F.try_divide(F.sum("sse"), sst)).alias("oos_r2"))


def block_r2(solved: DataFrame, keys: list[str], block: str, k: int, min_rows: int = 30) -> DataFrame:
    sst = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    return (solved.where(F.col("sol").isNotNull() & (F.col("n") >= min_rows)).where(sst > 1e-12)
            .select(*keys, block, "n", (1 - F.try_divide(_quadratic(k), sst)).alias("r2")))


def predictions(panel: DataFrame, solved: DataFrame, block: str, xs: list[str]) -> DataFrame:
    """Row predictions with the coefficients that did not see the row's block."""
    full = ["one", *xs]
    fitted = F.lit(0.0)
    for i, x in enumerate(full):
        fitted = fitted + F.element_at("sol", i + 1) * F.col(x)
    rows = salted_join(panel.withColumn("one", F.lit(1.0)), solved.select(block, "sol"), [block])
    return rows.withColumn("pred", fitted).drop("sol", "one")


def unit_scores(pred: DataFrame, unit: str, y: str, min_pairs: int = 10) -> DataFrame:
    return pred.groupBy(unit).agg(F.count("*").alias("n"),
                                  paired_r(F.col(y), F.col("pred"), min_pairs).alias("r"))


def clustered_sign_test(df: DataFrame, block: str, delta: str) -> DataFrame:
    """Share of units improved, and an exact test on the block means, one row."""
    rows = df.where(F.col(delta).isNotNull())
    blocks = rows.groupBy(block).agg(F.avg(delta).alias("m"), F.count("*").alias("n"),
                                     F.count_if(F.col(delta) > 0).alias("up"))
    out = blocks.agg(F.sum("n").alias("n_units"), F.try_divide(F.sum("up"), F.sum("n")).alias("share_units_improved"),
                     F.count("*").alias("n_blocks"), F.count_if(F.col("m") > 0).alias("blocks_improved"))
    median = quantiles(rows, delta, [0.5]).select("quantile").scalar()
    return (out.withColumn("share_blocks_improved", F.try_divide(F.col("blocks_improved"), F.col("n_blocks")))
            .withColumn("median_delta", median)
            .withColumn("p_value", binomial_pvalue("blocks_improved", "n_blocks")))


def paired_blocks(df: DataFrame, d: str) -> DataFrame:
    """Paired differences across blocks: median, share better, sign test, signed-rank test.

    Zero differences leave the signed-rank test; tied sizes share their mean rank.
    """
    rows = df.where(F.col(d).isNotNull())
    head = rows.agg(F.count("*").alias("n_blocks"), F.count_if(F.col(d) > 0).alias("n_better"),
                    F.count_if(F.col(d) == 0).alias("n_zero"))
    median = quantiles(rows, d, [0.5]).select("quantile").scalar()
    sized = rows.where(F.col(d) != 0).select(F.col(d).alias("d"), F.abs(d).alias("size"))
    ranked = average_rank(sized, "size")
    ties = sized.groupBy("size").agg(F.count("*").cast("double").alias("c")).agg(
        F.coalesce(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")), F.lit(0.0)).alias("t"))
    plus = ranked.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w"))
    out = (head.withColumn("median_delta", median).withColumn("w_plus", plus.scalar())
           .withColumn("tie_term", ties.scalar()))
    n = F.col("n_blocks") - F.col("n_zero")
    inexact = (F.col("tie_term") > 0) | (F.col("n_zero") > 0)
    return (out.withColumn("share_better", F.try_divide(F.col("n_better"), F.col("n_blocks")))
            .withColumn("sign_test_p", binomial_pvalue("n_better", "n_blocks"))
            .withColumn("signed_rank_p", F.when(F.col("n_blocks") > 10, signed_rank_pvalue(
                F.col("w_plus"), n, inexact, F.col("tie_term")))))


def ablation(rows: DataFrame, split: str, block: str, y: str, xs: list[str], models: dict[str, list[str]],
             min_rows: int = 500, min_blocks: int = 5) -> DataFrame:
    """Out-of-sample R2 of nested models in every split, from one table of block sums."""
    grams = block_grams(rows, [split], block, y, xs)
    out = None
    for label, use in models.items():
        part = sub_model(grams, [split], block, xs, use)
        r2 = pooled_r2(held_out(part, [split], block, len(use) + 1), [split], len(use) + 1)
        r2 = r2.where((F.col("n_rows") >= min_rows) & (F.col("n_blocks") >= min_blocks)).withColumn("model", F.lit(label))
        out = r2 if out is None else out.unionByName(r2)
    return out


def wetness(rows: DataFrame, unit: str, precip: str, cut: float = 500.0, min_units: int = 50) -> DataFrame:
    """(unit, split): dry below the cut of the unit's mean, else wet; a split of fewer than ``min_units`` units is left out."""
    split = F.when(F.col("_m") < cut, "dry").otherwise("wet")
    units = rows.groupBy(unit).agg(F.avg(precip).alias("_m")).where("_m is not null").select(unit, split.alias("split"))
    large = units.groupBy("split").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_units).select("split")
    return units.join(large, "split", "left_semi")


def ablation_medians(rows: DataFrame, unit: str, block: str, y: str, xs: list[str], models: dict[str, list[str]],
                     min_pairs: int = 10, min_rows: int = 30) -> DataFrame:
    """(model, median_unit_r, median_block_r2) of nested models, from the same block sums."""
    grams = block_grams(rows, [], block, y, xs)
    r = r2 = None
    for label, use in models.items():
        solved = held_out(sub_model(grams, [], block, xs, use), [], block, len(use) + 1)
        own = unit_scores(predictions(rows, solved, block, use), unit, y, min_pairs).select(F.lit(label).alias("model"), "r")
        blocks = block_r2(solved, [], block, len(use) + 1, min_rows).select(F.lit(label).alias("model"), "r2")
        r, r2 = (own, blocks) if r is None else (r.unionByName(own), r2.unionByName(blocks))
    units = quantiles(r, "r", [0.5], ["model"]).select("model", F.col("quantile").alias("median_unit_r"))
    return units.join(quantiles(r2, "r2", [0.5], ["model"]).select("model", F.col("quantile").alias("median_block_r2")), "model")
