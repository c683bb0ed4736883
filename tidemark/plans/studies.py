"""Studies made of the operators."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.dates import water_year
from tidemark.functions.stats import pearson, t_pvalue
from tidemark.operators import fit, joins, order, overlay, reduce, spatial, timeops
from tidemark.session import cut_lineage


# --- flux footprints --------------------------------------------------------------------

def flux_rows(df: DataFrame, key: str, noise: DataFrame) -> DataFrame:
    """Statistics of rows (key, month, d, c, p): change of storage, consumption, precipitation.

    d may be missing at gaps. noise holds key and noise_floor of the storage series.
    """
    for v in ("d", "c", "p"):
        df = timeops.deseasonalise(df, [key], "month", v, f"{v}_ds")
    # One table of footprint months, read by every statistic below.
    ok = cut_lineage(df.where(F.col("d_ds").isNotNull() & F.col("c_ds").isNotNull()))
    yearly = ok.groupBy(key, F.year("month").alias("y")).agg(F.sum("c").alias("c")).groupBy(key).agg(
        F.avg("c").alias("cu_yr"))
    r = ok.groupBy(key).agg(
        F.count("*").alias("n_months"), (-pearson(F.col("d"), F.col("c"))).alias("r_raw"), (-pearson(F.col("d_ds"), F.col("c_ds"))).alias("r_deseason"),
        pearson(F.col("d_ds"), F.col("p_ds")).alias("r_dsdt_p"), pearson(F.col("p_ds"), F.col("c_ds")).alias("r_p_cu"),
        F.stddev_samp("c_ds").alias("cu_ds_std"), F.stddev_samp("d_ds").alias("dsdt_ds_std"))
    partial = fit.partial_corr(ok.withColumn("neg_c", -F.col("c_ds")), [key], "month", "d_ds", "neg_c", "p_ds").select(
        key, "partial_r", F.col("p").alias("partial_p"))
    reg = fit.fit(ok.withColumn("one", F.lit(1.0)), [key], "d_ds", ["one", "p_ds", "c_ds"], "month", "flux").select(
        key, F.col("n_eff").alias("n_eff_resid"), "resid_std", F.col("b_p_ds").alias("b_p"), F.col("se_p_ds").alias("se_p"),
        F.col("b_c_ds").alias("b_cu"), F.col("se_c_ds").alias("se_cu"), F.col("p_c_ds").alias("p_cu"))
    out = r.join(yearly, key).join(reg, key).join(noise, key).join(partial, key, "left")
    dsdt_noise = F.col("noise_floor") / F.sqrt(F.lit(2.0))
    snr = F.try_divide(F.col("cu_ds_std"), dsdt_noise)
    return out.withColumns({
        "dsdt_noise": dsdt_noise, "snr_noise": snr, "snr_meas": F.try_divide(F.col("cu_ds_std"), F.col("dsdt_ds_std")),
        "snr_resid": F.try_divide(F.col("cu_ds_std"), F.col("resid_std")), "induced_via_p": -F.col("r_dsdt_p") * F.col("r_p_cu"),
        "months_for_2sigma": F.pow(F.try_divide(F.lit(2.0), snr), 2)})


def analyse_footprints(storage: DataFrame, flux: DataFrame, key: str) -> DataFrame:
    """storage(key, month, value) with gaps; flux(key, month, c, p). One row per footprint."""
    storage = cut_lineage(storage.select(key, "month", "value"))
    full = timeops.complete_axis(storage, [key], "month", per_unit=True)
    change = timeops.centred_difference(storage, [key], "month", "value", "d").select(key, "month", "d")
    rows = full.select(key, "month").join(change, [key, "month"], "left").join(flux, [key, "month"])
    noise = timeops.noise_floor(storage, [key], "month", "value").select(key, "noise_floor")
    return flux_rows(rows, key, noise)


def footprint_means(members: DataFrame, series: DataFrame, cols: list[str]) -> DataFrame:
    """Strict area-weighted means: members(footprint, unit_id, area_km2) with series(unit_id, month, ...)."""
    sizes = members.groupBy("footprint").agg(F.count("*").alias("_n"))
    j = members.join(series, "unit_id")
    g = j.groupBy("footprint", "month").agg(
        *[reduce.strict_mean(F.col(c), F.col("area_km2")).alias(c) for c in cols], F.count("*").alias("_have"))
    return g.join(sizes, "footprint").where("_have = _n").drop("_n", "_have")


def nested_footprints(units: DataFrame, share: str, best: DataFrame, radius_km: float, core_share: float) -> DataFrame:
    """Best unit, units within a radius of it, units with enough share, all: (footprint, unit_id, area_km2, share)."""
    cols = ["unit_id", "area_km2", share]
    left = best.select(F.col("unit_id").alias("a"), "lat", "lon")
    near = overlay.within_radius(left, units.select(F.col("unit_id").alias("b"), "lat", "lon"), radius_km)
    near = near.select(F.col("b").alias("unit_id"))
    parts = {"1 best": units.join(best.select("unit_id"), "unit_id", "left_semi"),
             "2 radius": units.join(near, "unit_id", "left_semi"), "3 core": units.where(F.col(share) >= core_share),
             "4 all": units}
    return fold(DataFrame.unionByName, [p.select(*cols).withColumn("footprint", F.lit(n)) for n, p in parts.items()])


def detection_threshold(footprints: DataFrame, per_unit: DataFrame) -> DataFrame:
    """Depth of consumption needed for a two-sigma detection, from footprint and single-unit rows."""
    month = F.col("cu_yr") / 12
    se_pred = F.try_divide(F.lit(1.0), F.col("snr_resid") * F.sqrt("n_eff_resid"))
    fp = footprints.agg(F.avg(F.try_divide(F.col("cu_ds_std"), month)).alias("gamma"), F.avg(F.try_divide(F.col("se_cu"), se_pred)).alias("calibration"),
                        F.avg("n_eff_resid").alias("n_eff"))
    noise = order.quantiles(per_unit, "dsdt_noise", [0.5]).select("quantile").scalar()
    out = fp.withColumn("noise_ref", noise).withColumn(
        "snr_needed", F.try_divide(F.lit(2.0), F.sqrt("n_eff")) * F.col("calibration"))
    out = out.withColumn("sigma_needed", F.col("snr_needed") * F.col("noise_ref"))
    return out.withColumn("depth_needed", F.try_divide(F.col("sigma_needed") * 12, F.col("gamma")))


def annual_test(storage: DataFrame, flux: DataFrame, key: str, min_years: int = 8) -> DataFrame:
    """Change of storage over each water year against the year's sums: r, partial r, two-term fit."""
    wy = water_year(F.col("month"))
    ds = storage.groupBy(key, wy.alias("wy")).agg(reduce.change_first_last(F.col("value"), F.col("month")).alias("ds"))
    sums = flux.groupBy(key, wy.alias("wy")).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    j = ds.join(sums, [key, "wy"]).na.drop("any", subset=["ds", "c", "p"]).withColumn("neg_c", -F.col("c"))
    part = fit.partial_corr(j, [key], "wy", "ds", "neg_c", "p", min_rows=min_years, effective=False)
    raw = j.groupBy(key).agg((-pearson(F.col("ds"), F.col("c"))).alias("r_raw"))
    reg = fit.fit(j.withColumn("one", F.lit(1.0)), [key], "ds", ["one", "p", "c"], "wy", "plain", min_years)
    return (part.select(key, F.col("n").alias("n_years"), "partial_r", F.col("p").alias("partial_p")).join(raw, key)
            .join(reg.select(key, F.col("b_p").alias("b_p"), F.col("se_p").alias("se_p"), F.col("b_c").alias("b_cu"),
                             F.col("se_c").alias("se_cu")), key))


# --- decomposition ----------------------------------------------------------------------

def remove_components(total: DataFrame, parts: list[DataFrame], unit: str, month: str, v: str, out: str) -> DataFrame:
    """(total - its mean) less each (part - its mean), all on the months and units everyone has."""
    rows = total.select(unit, month, F.col(v).alias("_t"))
    for i, part in enumerate(parts):
        rows = rows.join(part.select(unit, month, F.col(v).alias(f"_p{i}")), [unit, month])
    cols = ["_t", *[f"_p{i}" for i in range(len(parts))]]
    rows = rows.na.drop("any", subset=cols)
    g = W.partitionBy(unit)
    left = F.col("_t") - F.avg("_t").over(g)
    for c in cols[1:]:
        left = left - (F.col(c) - F.avg(c).over(g))
    return rows.select(unit, month, left.alias(out))


def by_model_ensemble(total: DataFrame, models: dict[str, DataFrame], unit: str, month: str, v: str) -> DataFrame:
    """Residual per model, then ensemble mean, spread and number of models per unit and month."""
    frames = [remove_components(total, [m], unit, month, v, "gws").withColumn("model", F.lit(n)) for n, m in models.items()]
    return fold(DataFrame.unionByName, frames).groupBy(unit, month).agg(
        F.avg("gws").alias("gws"), (F.max("gws") - F.min("gws")).alias("spread"), F.count("gws").alias("n_models"))


# --- comparisons ------------------------------------------------------------------------

def drying(series: DataFrame, windows: dict[str, tuple[str, str]], units: DataFrame, cls: str, threshold: float,
           time: str = "month", v: str = "value", min_rows: int = 24) -> DataFrame:
    """Per window and class: units, drying units, area shares, significance plain and under dependence.

    All windows are fitted in one job: a row is copied once per window it is in.
    """
    spans = F.array(*[F.struct(F.lit(n).alias("w"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"))
                      for n, (a, b) in windows.items()])
    rows = (series.withColumn("_s", F.explode(spans)).where(F.col(time).between(F.col("_s.a"), F.col("_s.b")))
            .withColumn("window", F.col("_s.w")).drop("_s"))
    fits = fit.trend(rows, ["window", "unit_id"], time, v, min_rows=min_rows).select(
        "window", "unit_id", F.col("b_t").alias("trend"), F.col("p_t").alias("p"))
    j = spatial.accept_mask(fits, "p", keys=["window"]).join(units.select("unit_id", "area_km2", cls), "unit_id")
    dry = F.col("trend") <= threshold
    return j.groupBy("window", cls).agg(
        F.count("*").alias("n"), F.count_if(dry).alias("n_drying"),
        F.try_divide(F.sum(F.when(dry, F.col("area_km2")).otherwise(0.0)), F.sum("area_km2")).alias("area_share"),
        F.count_if(dry & (F.col("p") < 0.05)).alias("n_significant"),
        F.count_if(dry & F.col("accepted")).alias("n_significant_dependent"))


def compare_solutions(a: DataFrame, b: DataFrame, unit: str, time: str, v: str, cut: str, min_rows: int = 36) -> DataFrame:
    """Two series on one geometry: trends, r, sign flip, and the trend difference before and from a date."""
    both = a.select(unit, time, F.col(v).alias("a")).join(b.select(unit, time, F.col(v).alias("b")), [unit, time])
    ta = fit.trend(both, [unit], time, "a", min_rows=min_rows).select(unit, F.col("b_t").alias("trend_a"))
    tb = fit.trend(both, [unit], time, "b", min_rows=min_rows).select(unit, F.col("b_t").alias("trend_b"))
    late = F.col(time) >= F.lit(cut).cast("date")
    moments = both.groupBy(unit).agg(
        reduce.paired_r(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"),
        F.avg(F.when(~late, F.col("a") - F.col("b"))).alias("offset_before"),
        F.avg(F.when(late, F.col("a") - F.col("b"))).alias("offset_from"))
    return (moments.join(ta, unit).join(tb, unit)
            .withColumn("sign_flip", (F.col("trend_a") < 0) != (F.col("trend_b") < 0)))


def list_agreement(df: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """Gap of two values over their mean size, and the shift between their percentile ranks."""
    ra = order.average_rank(df, a).withColumnRenamed("pct_rank", "rank_a").drop("rank")
    rb = order.average_rank(df.select(unit, b), b).select(unit, F.col("pct_rank").alias("rank_b"))
    scale = (F.abs(a) + F.abs(b)) / 2
    return (ra.join(rb, unit).withColumn("diff_ratio", F.abs(F.col(a) - F.col(b)) / F.when(scale > 0, scale))
            .withColumn("rank_shift", F.abs(F.col("rank_a") - F.col("rank_b"))))


def coverage_by_unit(rows: DataFrame, unit: str, year: str, area: Column, flagged: Column, unit_area: DataFrame) -> DataFrame:
    """Share of each unit's area flagged in each year; then mean, lowest and highest over the years."""
    per = rows.groupBy(unit, year).agg(F.sum(F.when(flagged, area).otherwise(0.0)).alias("_f"), F.count("*").alias("_n"))
    shares = per.join(unit_area, unit).withColumn("share", F.try_divide(100 * F.col("_f"), F.col("area_km2")))
    return shares.groupBy(unit).agg(F.avg("share").alias("mean_share"), F.min("share").alias("min_share"),
                                    F.max("share").alias("max_share"), F.sum("_n").alias("rows"))


def storage_inventory(dams: DataFrame, monthly: DataFrame, boxes: DataFrame, dam: str, v: str) -> DataFrame:
    """Dams inside a unit, their capacity and observed range as depth over the unit."""
    placed = overlay.first_box(dams, boxes, dam, "unit_id").where("unit_id >= 0")
    seen = monthly.groupBy(dam).agg(F.min(v).alias("obs_min"), F.max(v).alias("obs_max"), F.count(v).alias("n_months"))
    out = placed.join(dams.select(dam, "capacity"), dam).join(seen, dam, "left").join(
        boxes.select("unit_id", "area_km2"), "unit_id")
    per = F.try_divide(F.lit(1000.0), F.col("area_km2"))
    return out.withColumns({"mm_per_hm3": per, "capacity_mm": F.col("capacity") * per,
                            "obs_range_mm": (F.col("obs_max") - F.col("obs_min")) * per})


def leakage_indicator(df: DataFrame, month: str, v: str, w: str, land: Column, coastal: Column) -> DataFrame:
    """Correlation of the ocean mean with the land, coastal and interior means."""
    ocean = ~land

    def mean(mask: Column) -> Column:
        return reduce.weighted_mean(F.when(mask, F.col(v)), F.when(mask, F.col(w)))

    g = df.groupBy(month).agg(mean(land).alias("land"), mean(ocean).alias("ocean"), mean(land & coastal).alias("coastal"),
                              mean(land & ~coastal).alias("interior"))
    return g.agg(pearson(F.col("land"), F.col("ocean")).alias("r_land_ocean"), pearson(F.col("coastal"), F.col("ocean")).alias("r_coastal_ocean"),
                 pearson(F.col("interior"), F.col("ocean")).alias("r_interior_ocean"), F.count("*").alias("months"))
