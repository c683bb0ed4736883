"""Least squares per unit from Gram sums.

The sums of products combine before their shuffle, so a fit costs one row per
unit and task however long the series. Only the k x k solve runs in Python, on
one row per unit. The coefficients are joined back for the residual pass; Spark
broadcasts them when they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.dates import SECONDS_PER_YEAR, epoch_seconds, epoch_years
from tidemark.functions.regress import lagged_sums, solve_lagged
from tidemark.functions.stats import (clamp_r, harmonics, n_effective, n_effective_bounded,
                                      pearson, solve_normal, t_pvalue)

# Times enter the Gram sums in years from here, which keeps them small. Slopes,
# harmonics and covariates do not depend on the origin.
ORIGIN = "2000-01-01"
TREND = ["one", "t", "c1", "s1", "c2", "s2"]


def years_from_origin(d: Column) -> Column:
    return (epoch_seconds(d) - epoch_seconds(F.lit(ORIGIN).cast("date"))) / SECONDS_PER_YEAR


def trend_design(df: DataFrame, time: str) -> DataFrame:
    """Adds constant, time and the annual and semi-annual pairs.

    The phase of the harmonics is that of years since 1970, as is the time.
    """
    phase = epoch_years(F.col(time))
    return df.withColumns({"one": F.lit(1.0), "t": years_from_origin(F.col(time)),
                           **harmonics(phase)})


def gram_sums(y: str, xs: list[str]) -> dict[str, Column]:
    """Named sums of products; additive over rows, so blocks can be subtracted."""
    sums = {f"xx_{i}_{j}": F.sum(F.col(xs[i]) * F.col(xs[j]))
            for i in range(len(xs)) for j in range(i, len(xs))}
    sums.update({f"xy_{i}": F.sum(F.col(x) * F.col(y)) for i, x in enumerate(xs)})
    sums.update({"yy": F.sum(F.col(y) * F.col(y)), "sy": F.sum(y), "n": F.count(F.lit(1))})
    return sums


def gram_arrays(k: int) -> tuple[Column, Column]:
    xx = F.array(*[F.col(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)])
    return xx, F.array(*[F.col(f"xy_{i}") for i in range(k)])


def gram(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in gram_sums(y, xs).items()])


def solve(grams: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, n and ``sol``: k coefficients, then k diagonal terms of the inverse."""
    xx, xy = gram_arrays(k)
    return grams.select(*keys, "n", solve_normal(xx, xy).alias("sol"))


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop("any", subset=cols)


def linear(xs: list[str]) -> Column:
    """Fitted value from the joined ``sol`` array."""
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + F.element_at("sol", i + 1) * F.col(x)
    return total


def residuals(df: DataFrame, keys: list[str], y: str, xs: list[str],
              min_rows: int | None = None) -> DataFrame:
    """Complete rows with ``sol``, ``n`` and the residual ``e``."""
    k = len(xs)
    rows = complete_rows(df, [y, *xs])
    solved = solve(gram(rows, keys, y, xs), keys, k).where(
        (F.col("n") >= (min_rows or k + 1)) & F.col("sol").isNotNull())
    return rows.join(solved, keys).withColumn("e", F.col(y) - linear(xs))


def fit(df: DataFrame, keys: list[str], y: str, xs: list[str], order: str,
        kind: str = "trend", min_rows: int | None = None, p_values: bool = True) -> DataFrame:
    """One row per unit with ``b_x, se_x, t_x, p_x`` for every column of xs.

    kind, which sets the lag-1 term, the effective n and the degrees of freedom:
      trend     r1 = sum(e e-1) / sum(e-1^2); n_eff unbounded; df = n_eff - k
      flux      Pearson r1 kept within 0.99; n_eff in [3, n]; df >= 1
      inflated  se times sqrt((1+r)/(1-r)), never below 1; df = n - k
      plain     no correction; df = n - k
    Consecutive rows are the observed rows in order, across gaps.
    """
    k = len(xs)
    res = residuals(df, keys, y, xs, min_rows)
    before = F.lag("e").over(W.partitionBy(*keys).orderBy(order))
    res = res.withColumn("_e1", before)
    stats = res.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("sol").alias("sol"),
        F.sum(F.col("e") * F.col("e")).alias("rss"), F.var_pop(y).alias("_var"),
        F.sum(F.col("e") * F.col("_e1")).alias("_num"),
        F.sum(F.col("_e1") * F.col("_e1")).alias("_den"),
        pearson(F.col("e"), F.col("_e1")).alias("_corr"),
        F.stddev_pop("e").alias("resid_std"))
    n, rss = F.col("n"), F.col("rss")
    ratio = F.try_divide(F.col("_num"), F.col("_den"))
    if kind == "trend":
        r1, n_eff = ratio, n_effective(n, ratio)
        scale, dof = F.try_divide(F.try_divide(rss, n - k) * n, n_eff), n_eff - k
    elif kind == "flux":
        r1 = clamp_r(F.col("_corr"))
        n_eff = n_effective_bounded(n, r1)
        scale = F.try_divide(rss / F.greatest(n - k, F.lit(1)) * n, n_eff)
        dof = F.greatest(n_eff - k, F.lit(1.0))
    elif kind == "inflated":
        r1, n_eff = ratio, n.cast("double")
        inflation = F.greatest((1 + r1) / F.greatest(1 - r1, F.lit(1e-6)), F.lit(1.0))
        scale, dof = F.try_divide(rss, n - k) * inflation, (n - k).cast("double")
    elif kind == "plain":
        r1, n_eff = ratio, n.cast("double")
        scale, dof = rss / F.greatest(n - k, F.lit(1)), (n - k).cast("double")
    else:
        raise ValueError(kind)
    base = stats.select(*keys, "n", "rss", "resid_std", "sol", r1.alias("r1"),
                        n_eff.alias("n_eff"), dof.alias("df"), scale.alias("_scale"),
                        (1 - F.try_divide(rss, n * F.col("_var"))).alias("r2"))
    named = {}
    for i, x in enumerate(xs):
        b = F.element_at("sol", i + 1)
        se = F.sqrt(F.col("_scale") * F.element_at("sol", k + i + 1))
        named[f"b_{x}"], named[f"se_{x}"] = b, se
        named[f"t_{x}"] = F.try_divide(b, se)
    out = base.withColumns(named).drop("sol", "_scale")
    if p_values:
        out = out.withColumns({f"p_{x}": t_pvalue(F.col(f"t_{x}"), F.col("df")) for x in xs})
    return out


def lagged_gram(df: DataFrame, keys: list[str], ys: list[str], xs: list[str], order: str) -> DataFrame:
    """keys, n and ``sums``: products of the columns and right-hand sides with each other and with the row before.

    Rows count that are complete in all columns. With a constant ``one`` among xs every other column and
    right-hand side is first centred on its mean in the unit, so sums of large values lose no digits. A unit's
    rows, at most one for each step of the calendar, meet as one array of numbers.
    """
    cols = [*xs, *ys]
    rows = complete_rows(df, cols).select(*keys, F.struct(order, F.array(*[F.col(c).cast("double") for c in cols]).alias("v")).alias("_r"))
    listed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(
        F.sort_array(F.collect_list("_r")), lambda r: r["v"])).alias("_v"))
    sums = lagged_sums(len(xs), len(cols), [("one" in xs) and c != "one" for c in cols])
    return listed.select(*keys, "n", sums("_v").alias("sums"))


def _fields(sol: Column, n: Column, yy: Column, xs: list[str], kind: str) -> dict[str, Column]:
    """The named results of one right-hand side from its solution, in the order of the output."""
    k = len(xs)
    at = lambda i: F.element_at(sol, i)
    rss, num, first, last, total = (at(2 * k + i) for i in range(1, 6))
    ratio = F.try_divide(num, rss - last * last)
    if kind == "trend":
        r1, n_eff = ratio, n_effective(n, ratio)
        scale, dof = F.try_divide(F.try_divide(rss, n - k) * n, n_eff), n_eff - k
    elif kind == "flux":
        m, here, before = n - 1, total - first, total - last
        spread = (m * (rss - first * first) - here * here) * (m * (rss - last * last) - before * before)
        r1 = clamp_r(F.try_divide(m * num - here * before, F.sqrt(F.greatest(spread, F.lit(0.0)))))
        n_eff = n_effective_bounded(n, r1)
        scale = F.try_divide(rss / F.greatest(n - k, F.lit(1)) * n, n_eff)
        dof = F.greatest(n_eff - k, F.lit(1.0))
    elif kind == "inflated":
        r1, n_eff = ratio, n.cast("double")
        inflation = F.greatest((1 + r1) / F.greatest(1 - r1, F.lit(1e-6)), F.lit(1.0))
        scale, dof = F.try_divide(rss, n - k) * inflation, (n - k).cast("double")
    elif kind == "plain":
        r1, n_eff = ratio, n.cast("double")
        scale, dof = rss / F.greatest(n - k, F.lit(1)), (n - k).cast("double")
    else:
        raise ValueError(kind)
    std = F.sqrt(F.greatest(rss / n - (total / n) * (total / n), F.lit(0.0)))
    out = {"rss": rss, "resid_std": std, "r1": r1, "n_eff": n_eff, "df": dof, "r2": 1 - F.try_divide(rss, yy)}
    for i, x in enumerate(xs):
        se = F.sqrt(scale * at(k + i + 1))
        out |= {f"b_{x}": at(i + 1), f"se_{x}": se, f"t_{x}": F.try_divide(at(i + 1), se)}
    return out


def solved(sums: DataFrame, keys: list[str], ys: list[str], xs: list[str], kind: str, min_rows: int | None = None) -> DataFrame:
    """Results from lagged_gram(..., ys, xs): a struct for each right-hand side."""
    solve = solve_lagged(len(xs), xs.index("one") if "one" in xs else None)
    rows = sums.where(F.col("n") >= (min_rows or len(xs) + 1)).withColumn("_sol", solve("sums")).where(F.col("_sol").isNotNull())
    n, named = F.col("n"), []
    for i, y in enumerate(ys):
        sy = F.col("sums.sy")[i]
        var = F.col("sums.yy")[i] - sy * sy / n
        named.append(F.struct(*[c.alias(f) for f, c in _fields(F.col("_sol")[i], n, var, xs, kind).items()]).alias(y))
    return rows.select(*keys, "n", *named)


def fits(df: DataFrame, keys: list[str], ys: list[str], xs: list[str], order: str,
         kind: str = "trend", min_rows: int | None = None) -> DataFrame:
    """One row per unit: n, and for every right-hand side a struct of its name with the results of ``fit``.

    All right-hand sides are taken on the rows that are complete in every one of them, and share one
    pass and one factor.
    """
    return solved(lagged_gram(df, keys, ys, xs, order), keys, ys, xs, kind, min_rows)


def trend(df: DataFrame, keys: list[str], time: str, y: str, covariates: list[str] | None = None,
          kind: str = "trend", min_rows: int = 36) -> DataFrame:
    """Slope per year with harmonics and optional covariates on observed rows."""
    xs = TREND + (covariates or [])
    design = trend_design(df.select(*keys, time, y, *(covariates or [])), time)
    wanted = ["t", *(covariates or [])]
    out = fit(design, keys, y, xs, time, kind, min_rows, p_values=False)
    return out.withColumns({f"p_{x}": t_pvalue(F.col(f"t_{x}"), F.col("df")) for x in wanted})


def adjusted_trend(df: DataFrame, keys: list[str], time: str, y: str, covariate: str,
                   min_rows: int = 60) -> DataFrame:
    """Trend with and without one covariate on the same complete rows."""
    rows = complete_rows(df, [y, covariate])
    plain = trend(rows, keys, time, y, min_rows=min_rows)
    full = trend(rows, keys, time, y, [covariate], min_rows=min_rows)
    cols = [*keys, F.col("b_t").alias("adjusted"), F.col("p_t").alias("p_adjusted"),
            F.col(f"b_{covariate}").alias("b_covariate"), F.col("r1").alias("r1_adjusted"),
            F.col("n_eff").alias("n_eff_adjusted")]
    return (plain.select(*keys, "n", F.col("b_t").alias("unadjusted"),
                         F.col("p_t").alias("p_unadjusted"))
            .join(full.select(*cols), keys)
            .withColumn("fraction_unexplained",
                        F.try_divide(F.col("adjusted"), F.col("unadjusted")))
            .withColumn("explained_trend", F.col("unadjusted") - F.col("adjusted")))


def corrected_series(df: DataFrame, keys: list[str], time: str, y: str,
                     covariates: list[str] | None = None, min_rows: int = 36) -> DataFrame:
    """y without the harmonic and covariate terms; also the trend-removed residual ``e``."""
    xs = TREND + (covariates or [])
    design = trend_design(df, time)
    res = residuals(design, keys, y, xs, min_rows)
    kept = F.element_at("sol", 1) * F.col("one") + F.element_at("sol", 2) * F.col("t")
    return res.withColumn("corrected", kept + F.col("e")).drop("sol", *TREND)


def departure_fit(df: DataFrame, keys: list[str], order: str, y: str, xs: list[str]) -> DataFrame:
    """Adjusted R2 of y on xs and a constant, and the one on the effective n.

    Needs at least ten rows more than columns. The lag-1 term is the Pearson
    correlation of consecutive residuals, kept within 0.99.
    """
    p = len(xs)
    design = df.withColumn("one", F.lit(1.0))
    out = fit(design, keys, y, ["one", *xs], order, "flux", p + 10, p_values=False)
    n, raw = F.col("n"), F.col("r2")
    n_eff = n_effective(n, F.col("r1"))
    r2_adj = 1 - (1 - raw) * (n - 1) / F.greatest(n - p - 1, F.lit(1))
    r2_eff = F.when(n_eff > p + 2, 1 - F.try_divide((1 - raw) * (n_eff - 1), n_eff - p - 1))
    return out.select(*keys, "n", "r1", r2_adj.alias("r2_adj"), r2_eff.alias("r2_eff"))


def departure_fits(df: DataFrame, keys: list[str], order: str, ys: list[str], xs: list[str]) -> DataFrame:
    """For every y a struct with r1, the adjusted R2 of y on xs and a constant, and the one on the effective n.

    Needs at least ten rows more than columns, complete in every y. The lag-1 term is the Pearson
    correlation of consecutive residuals, kept within 0.99.
    """
    p = len(xs)
    out = fits(df.withColumn("one", F.lit(1.0)), keys, ys, ["one", *xs], order, "flux", p + 10)
    n, named = F.col("n"), []
    for y in ys:
        raw, n_eff = F.col(y)["r2"], n_effective(n, F.col(y)["r1"])
        r2_adj = 1 - (1 - raw) * (n - 1) / F.greatest(n - p - 1, F.lit(1))
        r2_eff = F.when(n_eff > p + 2, 1 - F.try_divide((1 - raw) * (n_eff - 1), n_eff - p - 1))
        named.append(F.struct(F.col(y)["r1"].alias("r1"), r2_adj.alias("r2_adj"), r2_eff.alias("r2_eff")).alias(y))
    return out.select(*keys, "n", *named)


def partial_from_r(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y given z, from the three plain ones."""
    return F.try_divide(rxy - rxz * ryz, F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz)))


def partial_corr(df: DataFrame, keys: list[str], order: str, y: str, x: str, z: str,
                 min_rows: int = 30, effective: bool = True) -> DataFrame:
    """Partial r of y and x given z; p on the effective n of y's residual, or on plain n."""
    rows = complete_rows(df, [y, x, z]).withColumn("one", F.lit(1.0))
    r = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        partial_from_r(pearson(F.col(x), F.col(y)), pearson(F.col(x), F.col(z)), pearson(F.col(y), F.col(z))).alias("partial_r"))
    r = r.where(F.col("n") >= min_rows)
    if effective:
        own = fit(rows, keys, y, ["one", z], order, "flux", 3, p_values=False)
        r = r.join(own.select(*keys, "n_eff"), keys)
    else:
        r = r.withColumn("n_eff", F.col("n").cast("double"))
    dof = F.greatest(F.col("n_eff") - 3, F.lit(1.0))
    t = F.col("partial_r") * F.sqrt(dof / F.greatest(
        F.lit(1e-12), 1 - F.col("partial_r") * F.col("partial_r")))
    return r.withColumn("t", t).withColumn("p", t_pvalue(t, dof))


def corr_effective(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Pearson r with the effective n from both series' lag-1 terms, at least 3."""
    rows = complete_rows(df, [x, y])
    w, g = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    dev = rows.withColumn("_x", F.col(x) - F.avg(x).over(g)).withColumn(
        "_y", F.col(y) - F.avg(y).over(g))
    dev = dev.withColumn("_x1", F.lag("_x").over(w)).withColumn("_y1", F.lag("_y").over(w))

    def lag_one(a: str, a1: str) -> Column:
        num, den = F.sum(F.col(a) * F.col(a1)), F.sum(F.col(a1) * F.col(a1))
        return clamp_r(F.coalesce(F.try_divide(num, den), F.lit(0.0)))

    out = dev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("r"),
                                 lag_one("_x", "_x1").alias("r1_x"),
                                 lag_one("_y", "_y1").alias("r1_y")).where("n >= 6")
    prod = F.col("r1_x") * F.col("r1_y")
    n_eff = F.greatest(F.lit(3.0), n_effective(F.col("n"), prod))
    dof = F.greatest(F.col("n_eff") - 2, F.lit(1.0))
    t = F.col("r") * F.sqrt(dof / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12)))
    return out.withColumn("n_eff", n_eff).withColumn("t", t).withColumn("p", t_pvalue(t, dof))


def simple_regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope, r2, n and the p of the slope."""
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"),
                                F.regr_count(y, x).alias("n"))
    dof = F.col("n") - 2
    t = F.signum("slope") * F.sqrt(F.try_divide(F.col("r2") * dof, 1 - F.col("r2")))
    return out.withColumn("t", t).withColumn("p", t_pvalue(t, dof.cast("double")))
