"""Fits, panels and spatial statistics M01-M40 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fit, flags, order, overlay, panel, reduce, spatial, timeops
from tidemark.plans import studies
from tidemark.plans.join_queries import CONTACT, RASTER, raster
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import (A, AB, B, G, GB, P, S, SCALE, U, WELL, gappy_products, gappy_totals, great_circle_sql, haversine_sql, ols_sql, points, shipped, sites,
                                  t_p_sql, table, totals, trend_xs, units, wells)
from tidemark.plans.flag_metrics import METRIC, metrics
from tidemark.session import cut_lineage

K = ["unit_id"]


def stats_sql(src: str, k: int, kind: str, b: str = "b") -> str:
    """Columns b, se, r1, n_eff, df, t from an ols_sql fit."""
    if kind == "trend":
        r, ne = "num / den", "(n * (1 - num / den) / (1 + num / den))"
        var, df = f"rss / (n - {k}) / q * n / {ne}", f"({ne} - {k})"
    elif kind == "flux":
        r = "(CASE WHEN isfinite(rc) THEN greatest(-0.99, least(0.99, rc)) END)"
        ne = f"(CASE WHEN isfinite(rc) THEN greatest(3.0, least(n, n * (1 - {r}) / (1 + {r}))) END)"
        var, df = f"rss / greatest(n - {k}, 1) / q * n / {ne}", f"(CASE WHEN isfinite(rc) THEN greatest({ne} - {k}, 1.0) END)"
    elif kind == "inflated":
        r, ne = "num / den", "n"
        var, df = f"rss / (n - {k}) / q * greatest((1 + num / den) / greatest(1 - num / den, 1e-6), 1.0)", f"(n - {k})"
    else:
        r, ne, var, df = "num / den", "n", f"rss / (n - {k}) / q", f"(n - {k})"
    return f"(SELECT *, b / se AS t FROM (SELECT *, {r} AS r1, {ne} AS n_eff, {df} AS df, sqrt({var}) AS se FROM {src}))"


@query("M01_trend_fit", f"""WITH {G}, {ols_sql('a', 'unit_id', 'value', trend_xs(), 'month', min_rows=36)}, x AS (SELECT *, b AS trend, {t_p_sql('t', 'df')} AS p FROM {stats_sql('g_fit', 6, 'trend')})
SELECT {sel('unit_id:i n:i trend:r se:r r1:r n_eff:r p:r')} FROM x""")
def _(spark, sf):
    f = fit.trend(gappy_totals(spark, sf), K, "month", "value")
    return f.select("unit_id", "n", F.col("b_t").alias("trend"), F.col("se_t").alias("se"), "r1", "n_eff", F.col("p_t").alias("p"))


STEP = f"""{G}, d AS (SELECT *, s0 - avg(s0) OVER (PARTITION BY unit_id) AS step FROM (SELECT *, CASE WHEN month >= DATE '1999-02-01' THEN 1.0 ELSE 0.0 END AS s0 FROM a))"""


@query("M02_trend_with_step", f"""WITH {STEP}, {ols_sql('d', 'unit_id', 'value', trend_xs() + ['step'], 'month', min_rows=36)}, pl AS (SELECT unit_id, b AS step, se AS se_plain, {t_p_sql('t', 'df')} AS p_plain FROM {stats_sql('g_fit', 7, 'plain')}),
il AS (SELECT unit_id, se AS se_inflated FROM {stats_sql('g_fit', 7, 'inflated')}) SELECT {sel('unit_id:i step:r se_plain:r p_plain:r se_inflated:r')} FROM pl JOIN il USING (unit_id)""")
def _(spark, sf):
    era = (F.col("month") >= F.lit("1999-02-01").cast("date")).cast("double")
    d = timeops.recentre(gappy_totals(spark, sf).withColumn("step", era), K, "step", "step")
    one = fit.trend(d, K, "month", "value", ["step"], "plain").select("unit_id", F.col("b_step").alias("step"), F.col("se_step").alias("se_plain"), F.col("p_step").alias("p_plain"))
    two = fit.trend(d, K, "month", "value", ["step"], "inflated").select("unit_id", F.col("se_step").alias("se_inflated"))
    return one.join(two, "unit_id")


@query("M03_trends_per_era", f"""WITH {G}, d AS (SELECT *, CASE WHEN month >= DATE '1999-02-01' THEN 'after' ELSE 'before' END AS era FROM a), {ols_sql('d', 'unit_id, era', 'value', trend_xs(), 'month', min_rows=24)},
x AS (SELECT *, b AS trend, {t_p_sql('t', 'df')} AS p FROM {stats_sql('g_fit', 6, 'trend')} WHERE n >= 24) SELECT {sel('unit_id:i era:s n:i trend:r p:r')} FROM x""")
def _(spark, sf):
    d = timeops.era_by_largest_gap(gappy_totals(spark, sf), K, "month", "era", ("before", "after"))
    return fit.trend(d, ["unit_id", "era"], "month", "value", min_rows=24).select("unit_id", "era", "n", F.col("b_t").alias("trend"), F.col("p_t").alias("p"))


CUM = f"""{G}, {B}, ca AS (SELECT unit_id, month, sum(qa) OVER (PARTITION BY unit_id ORDER BY month) AS c FROM (SELECT *, qty - avg(qty) OVER (PARTITION BY unit_id) AS qa FROM b)),
cc AS (SELECT unit_id, month, c - avg(c) OVER (PARTITION BY unit_id) AS cum FROM ca), d AS (SELECT a.unit_id, a.month, a.value, cum FROM a JOIN cc ON a.unit_id = cc.unit_id AND a.month = cc.month)"""


def with_rain(spark, sf):
    cum = timeops.accumulated_anomaly(shipped(spark, sf), K, "month", "qty", "cum").select("unit_id", "month", "cum")
    return gappy_totals(spark, sf).join(cum, ["unit_id", "month"])


@query("M04_adjusted_trend", f"""WITH {CUM}, {ols_sql('d', 'unit_id', 'value', trend_xs(), 'month', 'g', 60)}, {ols_sql('d', 'unit_id', 'value', ['cum'] + trend_xs(), 'month', 'h', 60)},
pl AS (SELECT unit_id, n, b AS unadjusted FROM g_fit WHERE n >= 60), ad AS (SELECT unit_id, b AS adjusted, {t_p_sql('t', 'df')} AS p_adjusted, n_eff AS n_eff_adjusted FROM {stats_sql('h_fit', 7, 'trend')}),
x AS (SELECT *, adjusted / unadjusted AS fraction_unexplained, unadjusted - adjusted AS explained_trend FROM pl JOIN ad USING (unit_id)) SELECT {sel('unit_id:i n:i unadjusted:r adjusted:r p_adjusted:r n_eff_adjusted:r fraction_unexplained:r explained_trend:r')} FROM x""")
def _(spark, sf):
    f = fit.adjusted_trend(with_rain(spark, sf), K, "month", "value", "cum")
    return f.select("unit_id", "n", "unadjusted", "adjusted", "p_adjusted", "n_eff_adjusted", "fraction_unexplained", "explained_trend")


def xs_last(last: str, extra: list[str] | None = None) -> list[str]:
    return (extra or []) + trend_xs(last=last)


T0 = "(epoch(CAST(month AS TIMESTAMP)) / 31557600.0 - 30.0)"


@query("M05_corrected_series", f"""WITH {CUM}, {ols_sql('d', 'unit_id', 'value', ['cum'] + trend_xs(), 'month', 'g', 36)}, {ols_sql('d', 'unit_id', 'value', xs_last('one', ['cum']), 'month', 'h', 36)},
x AS (SELECT ge.unit_id, ge.ord AS month, gf.b * (epoch(CAST(ge.ord AS TIMESTAMP)) / 31557600.0 - 30.0) + hf.b + ge.e AS corrected FROM g_e ge JOIN g_fit gf USING (unit_id) JOIN h_fit hf USING (unit_id)) SELECT {sel('unit_id:i month:m corrected:r')} FROM x""")
def _(spark, sf):
    return fit.corrected_series(with_rain(spark, sf), K, "month", "value", ["cum"]).select("unit_id", "month", "corrected")


@query("M06_harmonic_amplitudes", f"""WITH {G}, {', '.join(ols_sql('a', 'unit_id', 'value', trend_xs(last=c), 'month', 'g' + c, 36) for c in ('c1', 's1', 'c2', 's2'))},
x AS (SELECT a1.unit_id, sqrt(a1.b ** 2 + b1.b ** 2) AS annual, sqrt(a2.b ** 2 + b2.b ** 2) AS semiannual, a1.resid_std, a1.num / a1.den AS r1 FROM gc1_fit a1 JOIN gs1_fit b1 USING (unit_id) JOIN gc2_fit a2 USING (unit_id) JOIN gs2_fit b2 USING (unit_id))
SELECT {sel('unit_id:i annual:r semiannual:r resid_std:r r1:r')} FROM x""")
def _(spark, sf):
    f = fit.trend(gappy_totals(spark, sf), K, "month", "value")
    return f.select("unit_id", F.hypot("b_c1", "b_s1").alias("annual"), F.hypot("b_c2", "b_s2").alias("semiannual"), "resid_std", "r1")


@query("M07_trend_removed_anomaly", f"""WITH {G}, {ols_sql('a', 'unit_id', 'value', trend_xs(), 'month', min_rows=36)}, x AS (SELECT unit_id, ord AS month, e FROM g_e) SELECT {sel('unit_id:i month:m e:r')} FROM x""")
def _(spark, sf):
    return fit.corrected_series(gappy_totals(spark, sf), K, "month", "value").select("unit_id", "month", "e")


def ds(col: str) -> str:
    return f"{col} - avg({col}) OVER (PARTITION BY unit_id, month(month))"


DEPART = f"""{GB}, d0 AS (SELECT unit_id, month, {ds('(a - b * 100)')} AS y, {ds('qty')} AS p, {ds('disc')} AS sm, {ds('cnt')} AS sn FROM ab),
d1 AS (SELECT *, sum(p) OVER (PARTITION BY unit_id ORDER BY month) AS pc0, lag(p, 1) OVER w AS p1, lag(p, 2) OVER w AS p2, lag(p, 3) OVER w AS p3 FROM d0 WINDOW w AS (PARTITION BY unit_id ORDER BY month)),
d AS (SELECT *, pc0 - avg(pc0) OVER (PARTITION BY unit_id) AS pc FROM d1)"""


@query("M08_departure_regression", f"""WITH {DEPART}, {ols_sql('d', 'unit_id', 'y', ['1.0', 'p', 'p1', 'p2', 'p3', 'pc', 'sm', 'sn'], 'month')},
r AS (SELECT *, 1 - rss / ssy AS raw, greatest(-0.99, least(0.99, rc)) AS r1 FROM g_fit WHERE n >= 17), s AS (SELECT *, n * (1 - r1) / (1 + r1) AS ne FROM r),
x AS (SELECT unit_id, n, r1, 1 - (1 - raw) * (n - 1) / (n - 8) AS r2_adj, CASE WHEN ne > 9 THEN 1 - (1 - raw) * (ne - 1) / (ne - 8) END AS r2_eff FROM s) SELECT {sel('unit_id:i n:i r1:r r2_adj:r r2_eff:r')} FROM x""")
def _(spark, sf):
    d = gappy_products(spark, sf).withColumn("y", F.col("a") - F.col("b") * 100).withColumn("cnt", F.col("cnt").cast("double"))
    for src, out in (("y", "y"), ("qty", "p"), ("disc", "sm"), ("cnt", "sn")):
        d = timeops.deseasonalise(d, K, "month", src, out)
    d = timeops.lagged(d, K, "month", "p", [1, 2, 3], "p")
    # The running sum of an already centred series: the mean it removes is zero up to rounding.
    d = timeops.accumulated_anomaly(d, K, "month", "p", "pc", nulls_as_zero=True)
    return fit.departure_fit(d, K, "month", "y", ["p", "p1", "p2", "p3", "pc", "sm", "sn"])


FLUX = f"""{GB}, n0 AS (SELECT unit_id, month, year(month) * 12 + month(month) AS ix, a, b, qty FROM ab), n1 AS (SELECT *, lag(a) OVER w AS v0, lead(a) OVER w AS v1, lag(ix) OVER w AS i0, lead(ix) OVER w AS i1 FROM n0 WINDOW w AS (PARTITION BY unit_id ORDER BY month)),
n2 AS (SELECT unit_id, month, CASE WHEN i1 - ix = 1 AND ix - i0 = 1 THEN (v1 - v0) / 2 END AS dr, b AS cr, qty AS pr FROM n1), d AS (SELECT unit_id, month, {ds('dr')} AS dd, {ds('cr')} AS cc, {ds('pr')} AS pp FROM n2)"""


def flux_series(spark, sf):
    d = timeops.centred_difference(gappy_products(spark, sf), K, "month", "a", "dd")
    for src, out in (("dd", "dd"), ("b", "cc"), ("qty", "pp")):
        d = timeops.deseasonalise(d, K, "month", src, out)
    return d.withColumn("one", F.lit(1.0))


@query("M09_flux_ols", f"""WITH {FLUX}, {ols_sql('d', 'unit_id', 'dd', ['1.0', 'pp', 'cc'], 'month', 'g', 20)}, {ols_sql('d', 'unit_id', 'dd', ['1.0', 'cc', 'pp'], 'month', 'h', 20)},
c AS (SELECT unit_id, n, n_eff, resid_std, b AS b_cc, se AS se_cc, {t_p_sql('t', 'df')} AS p_cc FROM {stats_sql('g_fit', 3, 'flux')}), p AS (SELECT unit_id, b AS b_pp, se AS se_pp FROM {stats_sql('h_fit', 3, 'flux')})
SELECT {sel('unit_id:i n:i n_eff:r resid_std:r b_cc:r se_cc:r p_cc:r b_pp:r se_pp:r')} FROM c JOIN p USING (unit_id)""")
def _(spark, sf):
    f = fit.fit(flux_series(spark, sf), K, "dd", ["one", "pp", "cc"], "month", "flux", 20)
    return f.select("unit_id", "n", "n_eff", "resid_std", "b_cc", "se_cc", "p_cc", "b_pp", "se_pp")


@query("M10_ols_inflated_se", f"""WITH {FLUX}, {ols_sql('d', 'unit_id', 'dd', ['1.0', 'pp', 'cc'], 'month', 'g', 20)}, x AS (SELECT unit_id, n, b AS b_cc, se AS se_cc, r1 FROM {stats_sql('g_fit', 3, 'inflated')}) SELECT {sel('unit_id:i n:i b_cc:r se_cc:r r1:r')} FROM x""")
def _(spark, sf):
    return fit.fit(flux_series(spark, sf), K, "dd", ["one", "pp", "cc"], "month", "inflated", 20).select("unit_id", "n", "b_cc", "se_cc", "r1")


@query("M11_partial_correlation", f"""WITH {FLUX}, k AS (SELECT * FROM d WHERE dd IS NOT NULL), {ols_sql('k', 'unit_id', 'dd', ['1.0', 'pp'], 'month', 'g')}, {ols_sql('k', 'unit_id', '-cc', ['1.0', 'pp'], 'month', 'h')},
r AS (SELECT g_e.unit_id, count(*) AS n, corr(g_e.e, h_e.e) AS partial_r FROM g_e JOIN h_e ON g_e.unit_id = h_e.unit_id AND g_e.ord = h_e.ord GROUP BY 1 HAVING count(*) >= 30),
s AS (SELECT r.*, n_eff, partial_r * sqrt(greatest(n_eff - 3, 1.0) / greatest(1e-12, 1 - partial_r ** 2)) AS t FROM r JOIN (SELECT unit_id, n_eff FROM {stats_sql('g_fit', 2, 'flux')}) USING (unit_id)),
x AS (SELECT *, {t_p_sql('t', 'greatest(n_eff - 3, 1.0)')} AS p FROM s) SELECT {sel('unit_id:i n:i partial_r:r n_eff:r t:r p:r')} FROM x""")
def _(spark, sf):
    d = flux_series(spark, sf).withColumn("neg", -F.col("cc"))
    return fit.partial_corr(d, K, "month", "dd", "neg", "pp")


@query("M12_corr_effective_n", f"""WITH {GB}, c AS (SELECT unit_id, month, a, b, a - avg(a) OVER w AS x, b - avg(b) OVER w AS y FROM ab WINDOW w AS (PARTITION BY unit_id)), l AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY unit_id ORDER BY month)),
g AS (SELECT unit_id, count(*) AS n, corr(a, b) AS r, greatest(-0.99, least(0.99, sum(x * x1) / sum(x1 * x1))) AS r1_x, greatest(-0.99, least(0.99, sum(y * y1) / sum(y1 * y1))) AS r1_y FROM l GROUP BY 1),
h AS (SELECT *, greatest(3.0, n * (1 - r1_x * r1_y) / (1 + r1_x * r1_y)) AS n_eff FROM g), s AS (SELECT *, r * sqrt(greatest(n_eff - 2, 1.0) / greatest(1 - r * r, 1e-12)) AS t FROM h), x AS (SELECT *, {t_p_sql('t', 'greatest(n_eff - 2, 1.0)')} AS p FROM s)
SELECT {sel('unit_id:i n:i r:r r1_x:r r1_y:r n_eff:r t:r p:r')} FROM x""")
def _(spark, sf):
    return fit.corr_effective(gappy_products(spark, sf), K, "month", "a", "b")


def flux_rows_sql(p: str, storage: str, flux: str, key: str) -> str:
    """CTEs ending in {p}_rows, the footprint statistics, from storage(key, month, value) and flux(key, month, c, p)."""
    def dsk(c: str) -> str:
        return f"{c} - avg({c}) OVER (PARTITION BY {key}, month(month))"
    return f"""{p}_n AS (SELECT {key}, month, value, year(month) * 12 + month(month) AS ix, lag(value) OVER w AS v0, lead(value) OVER w AS v1, lag(year(month) * 12 + month(month)) OVER w AS i0, lead(year(month) * 12 + month(month)) OVER w AS i1 FROM {storage} WINDOW w AS (PARTITION BY {key} ORDER BY month)),
{p}_d AS (SELECT {key}, month, CASE WHEN i1 - ix = 1 AND ix - i0 = 1 THEN (v1 - v0) / 2 END AS d, CASE WHEN i1 - ix = 1 AND ix - i0 = 1 THEN v0 - 2 * value + v1 END AS d2 FROM {p}_n),
{p}_sp AS (SELECT {key}, min(month) AS m0, max(month) AS m1 FROM {storage} GROUP BY 1),
{p}_r AS (SELECT f.{key}, f.month, d, f.c, f.p FROM {flux} f JOIN {p}_sp s ON s.{key} = f.{key} AND f.month BETWEEN m0 AND m1 LEFT JOIN {p}_d x ON x.{key} = f.{key} AND x.month = f.month),
{p}_s AS (SELECT *, {dsk('d')} AS dd, {dsk('c')} AS cc, {dsk('p')} AS pp FROM {p}_r), {p}_ok AS (SELECT * FROM {p}_s WHERE dd IS NOT NULL),
{ols_sql(p + '_ok', key, 'dd', ['1.0', 'pp', 'cc'], 'month', p + 'g')},
{p}_y AS (SELECT {key}, avg(c) AS cu_yr FROM (SELECT {key}, year(month) AS y, sum(c) AS c FROM {p}_ok GROUP BY 1, 2) GROUP BY 1), {p}_nf AS (SELECT {key}, stddev_samp(d2) / sqrt(6) AS noise_floor FROM {p}_d GROUP BY 1),
{p}_c AS (SELECT {key}, count(*) AS n_months, -corr(d, c) AS r_raw, -corr(dd, cc) AS r_deseason, corr(dd, pp) AS r_dsdt_p, corr(pp, cc) AS r_p_cu, stddev_samp(cc) AS cu_ds_std, stddev_samp(dd) AS dsdt_ds_std,
CASE WHEN count(*) >= 30 THEN (-corr(dd, cc) + corr(dd, pp) * corr(pp, cc)) / sqrt((1 - corr(dd, pp) ** 2) * (1 - corr(pp, cc) ** 2)) END AS partial_r FROM {p}_ok GROUP BY 1),
{p}_g AS (SELECT {key}, n_eff AS n_eff_resid, resid_std, b AS b_cu, se AS se_cu FROM {stats_sql(p + 'g_fit', 3, 'flux')}),
{p}_rows AS (SELECT *, noise_floor / sqrt(2) AS dsdt_noise, cu_ds_std / (noise_floor / sqrt(2)) AS snr_noise, cu_ds_std / dsdt_ds_std AS snr_meas, cu_ds_std / resid_std AS snr_resid, -r_dsdt_p * r_p_cu AS induced_via_p, (2 / (cu_ds_std / (noise_floor / sqrt(2)))) ** 2 AS months_for_2sigma
FROM {p}_c JOIN {p}_y USING ({key}) JOIN {p}_nf USING ({key}) JOIN {p}_g USING ({key}))"""


def finite(src: str, cols: list[str]) -> str:
    """Not-a-number, which SQL gives for a constant side, is null."""
    return f", {src}_f AS (SELECT * REPLACE ({', '.join(f'CASE WHEN isfinite({c}) THEN {c} END AS {c}' for c in cols)}) FROM {src})"


FLUXIN = f"{G}, {B}, fl AS (SELECT unit_id, month, value AS c, qty AS p FROM b)"
M13_COLS = ["n_months", "cu_yr", "cu_ds_std", "dsdt_ds_std", "noise_floor", "dsdt_noise", "snr_noise", "snr_meas", "snr_resid", "r_raw", "r_deseason",
            "r_dsdt_p", "r_p_cu", "induced_via_p", "partial_r", "n_eff_resid", "b_cu", "se_cu", "months_for_2sigma"]


def flux_inputs(spark, sf):
    return gappy_totals(spark, sf), shipped(spark, sf).select("unit_id", "month", F.col("value").alias("c"), F.col("qty").alias("p"))


@query("M13_footprint_flux", f"""WITH {FLUXIN}, {flux_rows_sql('k', 'a', 'fl', 'unit_id')} {finite('k_rows', M13_COLS[1:])} SELECT {sel('unit_id:i n_months:i ' + ' '.join(c + ':r' for c in M13_COLS[1:]))} FROM k_rows_f""")
def _(spark, sf):
    storage, flux = flux_inputs(spark, sf)
    return studies.analyse_footprints(storage, flux, "unit_id").select("unit_id", *M13_COLS)


FOOT = f"""{G}, {U}, sh AS (SELECT unit_id, area_km2, lat, lon, CAST(unit_id * 7 % 25 AS DOUBLE) AS share FROM u), bst AS (SELECT * FROM sh ORDER BY share DESC, unit_id LIMIT 1), di AS (SELECT sh.*, {haversine_sql('bst', 'sh')} AS km FROM sh, bst),
mem AS (SELECT '1 best' AS footprint, unit_id, area_km2, share FROM bst UNION ALL SELECT '2 radius', unit_id, area_km2, share FROM di WHERE km <= 8000 UNION ALL SELECT '3 core', unit_id, area_km2, share FROM sh WHERE share >= 10 UNION ALL SELECT '4 all', unit_id, area_km2, share FROM sh)"""


def footprints(spark, sf):
    u = units(spark, sf).withColumn("share", (F.col("unit_id") * 7 % 25).cast("double"))
    best = order.top_rows(u, 1, F.desc("share"), F.asc("unit_id"))
    return studies.nested_footprints(u, "share", best, 8000.0, 10.0)


@query("M14_nested_footprints", f"""WITH {FOOT}, sz AS (SELECT footprint, count(*) AS n, sum(area_km2) AS area_km2, sum(share * area_km2) / sum(area_km2) AS share FROM mem GROUP BY 1),
m AS (SELECT footprint, month, sum(value * mem.area_km2) / sum(mem.area_km2) AS v, count(*) AS c FROM mem JOIN a USING (unit_id) GROUP BY 1, 2), x AS (SELECT footprint, month, v, n, area_km2, share FROM m JOIN sz USING (footprint) WHERE c = n) SELECT {sel('footprint:s month:m v:r n:i area_km2:r share:r')} FROM x""")
def _(spark, sf):
    mem = footprints(spark, sf)
    size = mem.groupBy("footprint").agg(F.count("*").alias("n"), reduce.weighted_mean(F.col("share"), F.col("area_km2")).alias("share"), F.sum("area_km2").alias("area_km2"))
    means = studies.footprint_means(mem.drop("share"), gappy_totals(spark, sf).withColumnRenamed("value", "v"), ["v"])
    return means.join(size, "footprint")


PARENTS = f"""{FLUXIN}, {U}, pa AS (SELECT parent_id, month, avg(value) AS value FROM a JOIN u USING (unit_id) GROUP BY 1, 2), pf AS (SELECT parent_id, month, avg(c) AS c, avg(p) AS p FROM fl JOIN u USING (unit_id) GROUP BY 1, 2)"""


@query("M15_detection_threshold", f"""WITH {PARENTS}, {flux_rows_sql('k', 'a', 'fl', 'unit_id')}, {flux_rows_sql('o', 'pa', 'pf', 'parent_id')},
f AS (SELECT avg(cu_ds_std / (cu_yr / 12)) AS gamma, avg(se_cu / (1 / (snr_resid * sqrt(n_eff_resid)))) AS calibration, avg(n_eff_resid) AS n_eff, (SELECT median(dsdt_noise) FROM k_rows) AS noise_ref FROM o_rows),
g AS (SELECT *, 2 / sqrt(n_eff) * calibration AS snr_needed FROM f), h AS (SELECT *, snr_needed * noise_ref AS sigma_needed FROM g), x AS (SELECT *, sigma_needed * 12 / gamma AS depth_needed FROM h) SELECT {sel('gamma:r calibration:r n_eff:r noise_ref:r snr_needed:r sigma_needed:r depth_needed:r')} FROM x""")
def _(spark, sf):
    storage, flux = flux_inputs(spark, sf)
    parent = units(spark, sf).select("unit_id", "parent_id")
    ps = storage.join(parent, "unit_id").groupBy("parent_id", "month").agg(F.avg("value").alias("value"))
    pf = flux.join(parent, "unit_id").groupBy("parent_id", "month").agg(F.avg("c").alias("c"), F.avg("p").alias("p"))
    return studies.detection_threshold(studies.analyse_footprints(ps, pf, "parent_id"), studies.analyse_footprints(storage, flux, "unit_id"))


PVALS = "pv AS (SELECT o_orderkey AS k, (o_totalprice / 500000) ** 6 AS p FROM orders)"


@query("M16_multiple_testing", f"""WITH {PVALS}, r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM pv), c AS (SELECT *, ln(m) + 0.5772156649 + 1.0 / (2 * m) AS cm FROM r),
x AS (SELECT max(m) AS n_tested, max(cm) AS c_m, count(CASE WHEN p < 0.05 THEN 1 END) AS n_raw, count(CASE WHEN p <= 0.05 / m THEN 1 END) AS n_bonferroni, coalesce(max(CASE WHEN p <= 0.05 * i / m THEN i END), 0) AS n_bh,
coalesce(max(CASE WHEN p <= 0.05 * i / (m * cm) THEN i END), 0) AS n_by, max(CASE WHEN p <= 0.05 * i / (m * cm) THEN p END) * 1e6 AS by_cut FROM c), y AS (SELECT *, (SELECT count(*) FROM pv, x WHERE p * 1e6 <= by_cut) AS n_mask FROM x)
SELECT {sel('n_tested:i c_m:r n_raw:i n_bonferroni:i n_bh:i n_by:i by_cut:r n_mask:i')} FROM y""")
def _(spark, sf):
    pv = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.pow(F.col("o_totalprice") / 500000, 6).alias("p"))
    mask = spatial.accept_mask(pv, "p").agg(F.count_if("accepted").alias("n"))
    t = spatial.multiple_testing(pv, "p").withColumn("n_mask", mask.scalar())
    return t.select("n_tested", "c_m", "n_raw", "n_bonferroni", "n_bh", "n_by", (F.col("by_cut") * 1e6).alias("by_cut"), "n_mask")


SUPSER = f"""{S}, ss AS (SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
ad AS (SELECT unit_id, month, v - avg(v) OVER (PARTITION BY unit_id, month(month)) AS x FROM ss)"""


def supplier_series(spark, sf):
    l = table(spark, sf, "lineitem")
    s = l.groupBy(F.col("l_suppkey").alias("unit_id"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.sum("l_quantity").alias("v"))
    return timeops.deseasonalise(s, K, "month", "v", "v")


def vectors(spark, sf):
    """One value per month of the record for each unit, null where absent."""
    s = timeops.complete_axis(supplier_series(spark, sf), K, "month")
    vec = s.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "v"))), lambda r: F.coalesce(r["v"], F.lit(float("nan")))).alias("vec"))
    return vec.join(sites(spark, sf).select("unit_id", "lat", "lon"), "unit_id")


@query("M17_pair_decorrelation", f"""WITH {SUPSER}, pr AS (SELECT a.unit_id AS ua, b.unit_id AS ub, corr(a.x, b.x) AS r FROM ad a JOIN ad b ON a.month = b.month AND a.unit_id < b.unit_id GROUP BY 1, 2),
d AS (SELECT r, {haversine_sql('s1', 's2')} AS km FROM pr JOIN s s1 ON s1.unit_id = ua JOIN s s2 ON s2.unit_id = ub WHERE r IS NOT NULL), bn AS (SELECT CAST(ceil(km / 500) AS BIGINT) AS bin, r FROM d UNION ALL SELECT 0, r FROM d WHERE km < 1300),
x AS (SELECT bin, count(*) AS n, avg(r) AS mean_r, stddev_samp(r) AS std_r, min(r) AS min_r, (bin - 0.5) * 500 AS dist_mid FROM bn GROUP BY 1) SELECT {sel('bin:i n:i mean_r:r std_r:r min_r:r dist_mid:r')} FROM x""")
def _(spark, sf):
    return spatial.pair_decorrelation(vectors(spark, sf), 500.0, 1300.0, 0)


@query("M17_crossing_distances", f"""WITH {SUPSER}, pr AS (SELECT a.unit_id AS ua, b.unit_id AS ub, corr(a.x, b.x) AS r FROM ad a JOIN ad b ON a.month = b.month AND a.unit_id < b.unit_id GROUP BY 1, 2),
d AS (SELECT r, {haversine_sql('s1', 's2')} AS km FROM pr JOIN s s1 ON s1.unit_id = ua JOIN s s2 ON s2.unit_id = ub WHERE r IS NOT NULL), bn AS (SELECT CAST(ceil(km / 500) AS BIGINT) AS bin, avg(r) AS mean_r FROM d GROUP BY 1),
x AS (SELECT min(CASE WHEN bin > 0 AND mean_r < 0.7 THEN (bin - 0.5) * 500 END) AS km_07, min(CASE WHEN bin > 0 AND mean_r < 0.5 THEN (bin - 0.5) * 500 END) AS km_05, min(CASE WHEN bin > 0 AND mean_r < -0.02 THEN (bin - 0.5) * 500 END) AS km_below FROM bn) SELECT {sel('km_07:r km_05:r km_below:r')} FROM x""")
def _(spark, sf):
    bins = spatial.pair_decorrelation(vectors(spark, sf), 500.0, 1300.0, 0)
    return bins.agg(*[spatial.crossing_distance(bins, level).alias(name) for name, level in (("km_07", 0.7), ("km_05", 0.5), ("km_below", -0.02))])


COMPLETE = f"""{SUPSER}, nm AS (SELECT count(DISTINCT month) AS n FROM ad), okm AS (SELECT month FROM ad GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT unit_id) FROM ad)), cx AS (SELECT unit_id, month, x - avg(x) OVER (PARTITION BY unit_id) AS z FROM ad WHERE month IN (SELECT month FROM okm))"""


def complete_departures(spark, sf):
    """Centred values on the months every unit has."""
    s = supplier_series(spark, sf)
    n = s.select(F.countDistinct("unit_id")).scalar()
    full = s.groupBy("month").agg(F.count("v").alias("_n")).where(F.col("_n") == n).select("month")
    return timeops.recentre(s.join(full, "month", "left_semi"), K, "v", "z")


@query("M18_effective_modes", f"""WITH {COMPLETE}, c AS (SELECT a.unit_id AS i, b.unit_id AS j, sum(a.z * b.z) AS c FROM cx a JOIN cx b USING (month) GROUP BY 1, 2), x AS (SELECT (sum(CASE WHEN i = j THEN c END)) ** 2 / sum(c * c) AS effective_dof, sum(CASE WHEN i = j THEN c END) / 1e4 AS total_variance FROM c)
SELECT {sel('effective_dof:r total_variance:r')} FROM x""")
def _(spark, sf):
    out = spatial.effective_modes(complete_departures(spark, sf), "unit_id", "month", "z")
    return out.select("effective_dof", (F.col("total_variance") / 1e4).alias("total_variance"))


@query("M18_mode_shares")
def _(spark, sf):
    return spatial.variance_modes(complete_departures(spark, sf), "unit_id", "month", "z")


# The shares sum to one and their squares to one over the effective dof; the counts of modes are tested against singular values.
@query("M18_mode_summary", f"""WITH {COMPLETE}, c AS (SELECT a.unit_id AS i, b.unit_id AS j, sum(a.z * b.z) AS c FROM cx a JOIN cx b USING (month) GROUP BY 1, 2), x AS (SELECT 1.0 AS total_share, sum(c * c) / (sum(CASE WHEN i = j THEN c END)) ** 2 AS square_sum, (SELECT count(*) FROM okm) AS n_months FROM c)
SELECT {sel('total_share:r square_sum:r n_months:i')} FROM x WHERE n_months > 24""")
def _(spark, sf):
    out = spatial.mode_counts(spatial.variance_modes(complete_departures(spark, sf), "unit_id", "month", "z"), [0.9, 0.95, 0.99])
    return out.select("total_share", "square_sum", "n_months")


EDGE = f"""{S}, {RASTER}, {CONTACT}, lone AS (SELECT * FROM s WHERE unit_id NOT IN (SELECT src FROM pairs UNION SELECT dst FROM pairs)),
nd AS (SELECT lone.unit_id AS a, s.unit_id AS b, {haversine_sql('lone', 's')} AS km FROM lone JOIN s ON lone.unit_id <> s.unit_id), nk AS (SELECT a, b FROM nd QUALIFY row_number() OVER (PARTITION BY a ORDER BY km, b) <= 4),
pr AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs UNION SELECT a, b FROM nk UNION SELECT b, a FROM nk), ew AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM pr)"""


def site_graph(spark, sf):
    """Touching outlines, and the four nearest of suppliers that touch none."""
    return cut_lineage(overlay.contiguity_graph(raster(spark, sf), sites(spark, sf).select("unit_id", "lat", "lon"), 144))


def site_edges(graph, keep=None):
    """Row-standardised weights; among the units of keep(unit_id) only, if given."""
    raw = graph.withColumn("w", F.lit(1.0))
    for end in ("src", "dst") if keep is not None else ():
        raw = raw.join(keep.select(F.col("unit_id").alias(end)), end, "left_semi")
    return spatial.row_standardise(raw)


def moran_sql(x: str, where: str, tag: str) -> str:
    return f"""(WITH v AS (SELECT unit_id, x - avg(x) OVER () AS z FROM (SELECT unit_id, {x} AS x FROM s WHERE {where})), l AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM pr WHERE src IN (SELECT unit_id FROM v) AND dst IN (SELECT unit_id FROM v))
SELECT '{tag}' AS variant, (SELECT count(*) FROM v) AS n, count(*) AS links, (SELECT count(*) FROM v) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM v) AS i, -1.0 / ((SELECT count(*) FROM v) - 1) AS e_i FROM l JOIN v a ON a.unit_id = src JOIN v b ON b.unit_id = dst)"""


@query("M19_morans_i", f"""WITH {EDGE}, x AS ({moran_sql('x', 'true', 'all')} UNION ALL {moran_sql('rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0', 'true', 'all_ranks')} UNION ALL {moran_sql('x', 'area > 2000', 'no_ice')}) SELECT {sel('variant:s n:i links:i i:r e_i:r')} FROM x""")
def _(spark, sf):
    s = sites(spark, sf)
    graph = site_graph(spark, sf)
    edges = site_edges(graph)
    ranks = order.average_rank(s.select("unit_id", F.col("x").alias("x0")), "x0").select("unit_id", F.col("rank").alias("x"))
    dry = F.col("area") > 2000
    parts = {"all": spatial.morans_i(s.select("unit_id", "x"), edges), "all_ranks": spatial.morans_i(ranks, edges),
             "no_ice": spatial.morans_i(s.where(dry).select("unit_id", "x"), site_edges(graph, s.where(dry)))}
    out = None
    for name, part in parts.items():
        part = part.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def deals_sql(n: int, seed: str) -> str:
    """dz(perm, unit_id, z): the value of each unit in each permutation, 0 being the observed one."""
    mix, mask = spatial.MIX, spatial.MASK
    rounds = ", ".join(f"""d{r + 1} AS (SELECT perm, unit_id, CASE WHEN ((xor(t, t >> 16) * {mix}) & {mask}) >> 31 = 1 THEN m ELSE x END AS x FROM
(SELECT perm, unit_id, x, m, (xor(t, t >> 16) * {mix} + b) & {mask} AS t FROM (SELECT perm, unit_id, x, m, b, (greatest(x, m) + a) & {mask} AS t FROM
(SELECT perm, unit_id, x, a, b, (mid + n - x) % n AS m FROM d{r} JOIN (SELECT * FROM kk WHERE r = {r}) USING (perm)))))""" for r in range(spatial.ROUNDS))
    part = "CAST('0x' || substr(h, {}, {}) AS BIGINT)".format
    return f"""v AS (SELECT unit_id, x - avg(x) OVER () AS z, row_number() OVER (ORDER BY unit_id) - 1 AS idx FROM s), pm AS (SELECT CAST(unnest(range(1, {n + 1})) AS BIGINT) AS perm),
rh AS (SELECT perm, r, md5('{seed}' || '|' || CAST(perm AS VARCHAR) || '|' || CAST(r AS VARCHAR)) AS h FROM pm, (SELECT unnest(range({spatial.ROUNDS})) AS r)),
kk AS (SELECT perm, r, n, {part(1, 13)} % n AS mid, {part(14, 7)} AS a, {part(21, 7)} AS b FROM rh, (SELECT count(*) AS n FROM v)),
d0 AS (SELECT perm, unit_id, idx AS x FROM v, pm), {rounds},
dz AS (SELECT perm, d.unit_id, v.z FROM d{spatial.ROUNDS} d JOIN v ON v.idx = d.x UNION ALL SELECT 0, unit_id, z FROM v)"""


@query("M20_moran_permutation", f"""WITH {EDGE}, {deals_sql(9999, '20260916')}, i AS (SELECT a.perm, (SELECT count(*) FROM v) / sum(w) * sum(w * a.z * b.z) / (SELECT sum(z * z) FROM v) AS i FROM ew JOIN dz a ON a.unit_id = src JOIN dz b ON b.unit_id = dst AND b.perm = a.perm GROUP BY 1),
o AS (SELECT i AS io FROM i WHERE perm = 0), x AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT io FROM o) AS i, stddev_pop(i) AS sd_perm, ((SELECT io FROM o) - avg(i)) / stddev_pop(i) AS z_perm, (count(CASE WHEN i >= (SELECT io FROM o) - 1e-12 THEN 1 END) + 1) / (count(*) + 1) AS p_perm, count(*) AS n_perm FROM i WHERE perm > 0)
SELECT {sel('n:i i:r sd_perm:r z_perm:r p_perm:r n_perm:i')} FROM x""")
def _(spark, sf):
    return spatial.moran_permutation(sites(spark, sf).select("unit_id", "x", "lat", "lon"), site_edges(site_graph(spark, sf)), 9999)


BANDLIST = "(VALUES (0, 0, 250), (1, 250, 500), (2, 500, 750), (3, 750, 1000), (4, 1000, 1500), (5, 1500, 2000), (6, 2000, 3000), (7, 3000, 4000), (8, 4000, 6000))"
BANDSQL = f"""{S}, gd AS (SELECT a.unit_id AS src, b.unit_id AS dst, {great_circle_sql('a', 'b')} AS km FROM s a JOIN s b ON a.unit_id < b.unit_id), bl AS (SELECT * FROM {BANDLIST} t(band, lo_km, hi_km)),
be AS (SELECT band, lo_km, hi_km, src, dst FROM gd JOIN bl ON km > lo_km AND km <= hi_km), bp AS (SELECT band, min(lo_km) AS lo_km, min(hi_km) AS hi_km, count(*) AS pairs FROM be GROUP BY 1 HAVING count(*) >= 50),
{deals_sql(49, '20260916')}, bi AS (SELECT band, a.perm, (SELECT count(*) FROM v) * sum(a.z * b.z) / count(*) / (SELECT sum(z * z) FROM v) AS i FROM be JOIN dz a ON a.unit_id = src JOIN dz b ON b.unit_id = dst AND b.perm = a.perm GROUP BY 1, 2),
bo AS (SELECT band, i AS io FROM bi WHERE perm = 0), bands AS (SELECT bi.band, lo_km, hi_km, pairs, io AS i, stddev_pop(bi.i) AS sd_perm, (count(CASE WHEN bi.i >= io - 1e-12 THEN 1 END) + 1) / (count(*) + 1) AS p_perm FROM bi JOIN bp USING (band) JOIN bo USING (band) WHERE perm > 0 GROUP BY 1, 2, 3, 4, 5)"""


@query("M21_correlogram", f"""WITH {BANDSQL} SELECT {sel('band:i lo_km:r hi_km:r pairs:i i:r sd_perm:r p_perm:r')} FROM bands""")
def _(spark, sf):
    return spatial.band_moran(sites(spark, sf), 49)


@query("M22_effective_n", f"""WITH {BANDSQL}, rk AS (SELECT CASE WHEN count(*) >= 2 THEN -sum(pairs * ((lo_km + hi_km) / 2) ** 2) / sum(pairs * ((lo_km + hi_km) / 2) * ln(i)) END AS a FROM bands WHERE i > 0.01),
x AS (SELECT (SELECT count(*) FROM s) AS n, a AS range_km, (SELECT count(*) FROM s) ** 2 / ((SELECT count(*) FROM s) + CASE WHEN a IS NULL THEN 0 ELSE 2 * (SELECT sum(exp(-km / a)) FROM gd) END) AS n_eff FROM rk), y AS (SELECT *, n_eff / n AS n_eff_share FROM x) SELECT {sel('n:i range_km:r n_eff:r n_eff_share:r')} FROM y""")
def _(spark, sf):
    s = sites(spark, sf)
    return spatial.effective_n(s, spatial.range_km(spatial.band_moran(s, 0)))


def sweep_sql() -> str:
    rows = ", ".join("('" + key + f"', CAST({value} AS DOUBLE), '{flags.FLAG_OF.get(key, 'any')}', " + ", ".join(f"CAST({cfg[c]} AS DOUBLE)" for c in flags.DEFAULTS) + ")" for key, value, cfg in flags.sweep_configs())
    names = ", ".join(f"c_{c}" for c in flags.DEFAULTS)
    return f"""WITH {METRIC}, c AS (SELECT * FROM (VALUES {rows}) t(key, value, own, {names})), f AS (SELECT key, value, own, area,
coalesce(least(n_cells_a, n_cells_b) < c_min_cells, false) OR coalesce(frac_dominant > c_max_frac_dominant, false) AS geometry, coalesce(least(var_ratio_a, var_ratio_b) < c_min_var_ratio, false) AS no_departure,
coalesce(greatest(pred_r2_a, pred_r2_b) > c_max_pred_r2, false) AS predictor_derived, coalesce(r_ab < c_min_r, false) OR coalesce(trend_diff_ratio > c_max_trend_diff_ratio, false) AS disagreement, coalesce(rank_shift > c_max_rank_shift, false) AS rank_unstable FROM m, c),
g AS (SELECT *, geometry OR no_departure OR predictor_derived OR disagreement OR rank_unstable AS hit FROM f),
x AS (SELECT key, value, count(CASE WHEN CASE own WHEN 'geometry' THEN geometry WHEN 'no_departure' THEN no_departure WHEN 'predictor_derived' THEN predictor_derived WHEN 'disagreement' THEN disagreement WHEN 'rank_unstable' THEN rank_unstable ELSE hit END THEN 1 END) AS n_flag,
count(CASE WHEN hit THEN 1 END) AS n_any, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS share_any, sum(CASE WHEN hit THEN area ELSE 0 END) / sum(area) AS area_share_any FROM g GROUP BY 1, 2) SELECT {sel('key:s value:r n_flag:i n_any:i share_any:r area_share_any:r')} FROM x"""


@query("M23_sensitivity_sweep", sweep_sql())
def _(spark, sf):
    return flags.sweep(metrics(spark, sf), "area")


def z(col: str) -> str:
    return f"({col} - avg({col}) OVER w) / nullif(stddev_pop({col}) OVER w, 0) AS {col}"


PANEL = f"""{WELL}, pz AS (SELECT unit_id, year, block_id, class, {z('y')}, {z('x1')}, {z('x2')}, {z('x3')}, {z('x4')} FROM w WINDOW w AS (PARTITION BY unit_id)),
pn AS (SELECT * FROM pz WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL)"""
XS = ["x1", "x2", "x4"]


def well_panel(spark, sf):
    return panel.standard_panel(wells(spark, sf), "unit_id", ["y", "x1", "x2", "x3", "x4"])


def holdout_sql(name: str, src: str, xs: list[str]) -> str:
    """CTEs ending in {name}_pred(unit_id, year, block_id, class, y, pred): a refit without each block."""
    cols = ["1.0", *xs]
    parts = [f"{name}_b AS (SELECT DISTINCT block_id AS held FROM {src})", f"{name}_t AS (SELECT held, p.* FROM {src} p JOIN {name}_b ON block_id <> held)"]
    for i, c in enumerate(cols):
        parts.append(ols_sql(f"{name}_t", "held", "y", [x for x in cols if x != c] + [c], "unit_id", f"{name}{i}"))
    terms = " + ".join([f"{name}0_fit.b"] + [f"{name}{i + 1}_fit.b * {x}" for i, x in enumerate(xs)])
    join = " ".join(f"JOIN {name}{i}_fit ON {name}{i}_fit.held = p.block_id" for i in range(len(cols)))
    parts.append(f"{name}_pred AS (SELECT p.unit_id, p.year, p.block_id, p.class, p.y, {terms} AS pred FROM {src} p {join})")
    return ",\n".join(parts)


R2 = "1 - sum((y - pred) ** 2) / (count(*) * var_pop(y))"


@query("M24_leave_one_block_out", f"""WITH {PANEL}, {holdout_sql('h', 'pn', XS)}, x AS (SELECT count(*) AS n_rows, count(DISTINCT block_id) AS n_blocks, {R2} AS oos_r2 FROM h_pred) SELECT {sel('n_rows:i n_blocks:i oos_r2:r')} FROM x""")
def _(spark, sf):
    grams = panel.block_grams(well_panel(spark, sf), [], "block_id", "y", XS)
    return panel.pooled_r2(panel.held_out(grams, [], "block_id", 4), [], 4)


@query("M25_common_panel", f"""WITH {PANEL} SELECT {sel('unit_id:i year:i block_id:i y:r x1:r x2:r x3:r x4:r')} FROM pn""")
def _(spark, sf):
    return well_panel(spark, sf).select("unit_id", "year", "block_id", "y", "x1", "x2", "x3", "x4")


@query("M26_unit_r_and_block_r2", f"""WITH {PANEL}, {holdout_sql('h', 'pn', XS)}, k AS (SELECT 'unit' AS kind, unit_id AS id, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(y) > 0 AND stddev_pop(pred) > 0 THEN corr(y, pred) END AS score FROM h_pred GROUP BY 2
UNION ALL SELECT 'block', block_id, count(*), {R2} FROM h_pred GROUP BY 2 HAVING count(*) >= 30) SELECT {sel('kind:s id:i n:i score:r')} FROM k""")
def _(spark, sf):
    p = well_panel(spark, sf)
    solved = panel.held_out(panel.block_grams(p, [], "block_id", "y", XS), [], "block_id", 4)
    per_unit = panel.unit_scores(panel.predictions(p, solved, "block_id", XS), "unit_id", "y", 5)
    per_block = panel.block_r2(solved, [], "block_id", 4)
    return (per_unit.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"), "n", F.col("r").alias("score"))
            .unionByName(per_block.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), "n", F.col("r2").alias("score"))))


@query("M27_component_removal", f"""WITH {A}, {B}, {U}, m1 AS (SELECT a.unit_id, a.month, (a.value - avg(a.value) OVER w) - (b.value - avg(b.value) OVER w) AS g FROM a JOIN b ON a.unit_id = b.unit_id AND a.month = b.month WINDOW w AS (PARTITION BY a.unit_id)),
m2 AS (SELECT a.unit_id, a.month, (a.value - avg(a.value) OVER w) - (b.qty - avg(b.qty) OVER w) AS g FROM a JOIN b ON a.unit_id = b.unit_id AND a.month = b.month WINDOW w AS (PARTITION BY a.unit_id)), al AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
en AS (SELECT unit_id, month, avg(g) AS gws, max(g) - min(g) AS spread, count(g) AS n_models FROM al GROUP BY 1, 2), rg AS (SELECT parent_id, month, sum(gws * area_km2) / sum(area_km2) AS gws, sum(spread * area_km2) / sum(area_km2) AS spread FROM en JOIN u USING (unit_id) GROUP BY 1, 2),
{ols_sql('rg', 'parent_id', 'gws', trend_xs(), 'month', min_rows=36)}, x AS (SELECT parent_id, n, b AS trend, n_eff FROM {stats_sql('g_fit', 6, 'trend')}), y AS (SELECT x.*, sp FROM x JOIN (SELECT parent_id, avg(spread) AS sp FROM rg GROUP BY 1) USING (parent_id)) SELECT {sel('parent_id:i n:i trend:r n_eff:r sp:r')} FROM y""")
def _(spark, sf):
    b = shipped(spark, sf)
    models = {"value": b.select("unit_id", "month", "value"), "qty": b.select("unit_id", "month", F.col("qty").alias("value"))}
    en = studies.by_model_ensemble(totals(spark, sf), models, "unit_id", "month", "value")
    rg = en.join(units(spark, sf).select("unit_id", "parent_id", "area_km2"), "unit_id").groupBy("parent_id", "month").agg(
        reduce.weighted_mean(F.col("gws"), F.col("area_km2")).alias("gws"), reduce.weighted_mean(F.col("spread"), F.col("area_km2")).alias("spread"))
    t = fit.trend(rg, ["parent_id"], "month", "gws").select("parent_id", "n", F.col("b_t").alias("trend"), "n_eff")
    return t.join(rg.groupBy("parent_id").agg(F.avg("spread").alias("sp")), "parent_id")


DELTA = f"""{WELL}, r AS (SELECT unit_id, block_id, CASE WHEN count(*) >= 4 THEN round(corr(y, x1) - corr(y, x2), 9) END AS d FROM w GROUP BY 1, 2), dk AS (SELECT * FROM r WHERE d IS NOT NULL AND NOT isnan(d))"""


def deltas(spark, sf):
    d = wells(spark, sf).groupBy("unit_id", "block_id").agg(
        F.round(reduce.paired_r(F.col("y"), F.col("x1"), 4) - reduce.paired_r(F.col("y"), F.col("x2"), 4), 9).alias("d"))
    return d.where("d is not null")


@query("M28_clustered_sign_test", f"""WITH {DELTA}, bm AS (SELECT block_id, avg(d) AS m FROM dk GROUP BY 1), k AS (SELECT count(*) AS n, count(CASE WHEN m > 0 THEN 1 END) AS k FROM bm),
x AS (SELECT (SELECT count(*) FROM dk) AS n_units, (SELECT avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FROM dk) AS share_units_improved, n AS n_blocks, k AS blocks_improved, k / n AS share_blocks_improved, (SELECT median(d) FROM dk) AS median_delta,
CASE WHEN 2 * least(k, n - k) = n THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))) END AS p_value FROM k)
SELECT {sel('n_units:i share_units_improved:r n_blocks:i blocks_improved:i share_blocks_improved:r median_delta:r p_value:r')} FROM x""")
def _(spark, sf):
    return panel.clustered_sign_test(deltas(spark, sf), "block_id", "d")


@query("M29_paired_blocks", f"""WITH RECURSIVE {DELTA}, bm AS (SELECT block_id, avg(d) AS d FROM dk GROUP BY 1), rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS r FROM bm), ws AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM rk),
dp AS (SELECT 0 AS k, list_prepend(1.0::DOUBLE, list_transform(range(1, 1276), lambda i: 0.0::DOUBLE)) AS ways UNION ALL SELECT k + 1, list_transform(range(1, 1277), lambda i: ways[i] + CASE WHEN i > k + 1 THEN ways[i - k - 1] ELSE 0.0 END) FROM dp WHERE k < (SELECT n FROM ws)),
x AS (SELECT n AS n_blocks, w AS w_plus, (SELECT median(d) FROM bm) AS median_delta, (SELECT avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FROM bm) AS share_better, least(1.0, 2 * list_sum(ways[1:CAST(least(w, n * (n + 1) / 2 - w) AS BIGINT) + 1]) / pow(2, n)) AS signed_rank_p FROM ws, dp WHERE k = n)
SELECT {sel('n_blocks:i w_plus:r median_delta:r share_better:r signed_rank_p:r')} FROM x""")
def _(spark, sf):
    blocks = deltas(spark, sf).groupBy("block_id").agg(F.avg("d").alias("d"))
    return panel.paired_blocks(blocks, "d").select("n_blocks", "w_plus", "median_delta", "share_better", "signed_rank_p")


MODELS = {"A_base": ["x2"], "B_plus_x1": ["x2", "x1"], "C_plus_x4": ["x2", "x4"]}


def ablation_sql() -> str:
    parts, rows = [], []
    for i, (label, xs) in enumerate(MODELS.items()):
        parts.append(holdout_sql(f"m{i}", "pn", xs))
        rows.append(f"SELECT 'all' AS split, '{label}' AS model, count(*) AS n_rows, count(DISTINCT block_id) AS n_blocks, {R2} AS oos_r2 FROM m{i}_pred")
    return f"WITH {PANEL}, {', '.join(parts)}, x AS ({' UNION ALL '.join(rows)}) SELECT {sel('split:s model:s n_rows:i n_blocks:i oos_r2:r')} FROM x"


@query("M30_ablation_table", ablation_sql())
def _(spark, sf):
    return panel.ablation(well_panel(spark, sf).withColumn("split", F.lit("all")), "split", "block_id", "y", ["x2", "x1", "x4"], MODELS)


CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# The cut is no mean of whole months, so that no unit lies on it.
WETNESS = {"dry": "wet < 6.4871", "wet": "wet >= 6.4871"}


def split_ablation_sql(panel_sql: str, splits: dict[str, str]) -> str:
    parts, rows = [], []
    for j, (tag, rule) in enumerate(splits.items()):
        parts.append(f"c{j} AS (SELECT * FROM pw WHERE {rule})")
        for i, (label, xs) in enumerate(MODELS.items()):
            parts.append(holdout_sql(f"c{j}m{i}", f"c{j}", xs))
            rows.append(f"SELECT '{tag}' AS split, '{label}' AS model, count(*) AS n_rows, count(DISTINCT block_id) AS n_blocks, {R2} AS oos_r2 FROM c{j}m{i}_pred HAVING count(*) >= 100 AND count(DISTINCT block_id) >= 5")
    return f"WITH {panel_sql}, {', '.join(parts)}, x AS ({' UNION ALL '.join(rows)}) SELECT {sel('split:s model:s n_rows:i n_blocks:i oos_r2:r')} FROM x"


@query("M30_ablation_by_class", split_ablation_sql(f"{PANEL}, pw AS (SELECT * FROM pn)", {c: f"class = '{c}'" for c in CLASSES}))
def _(spark, sf):
    return panel.ablation(well_panel(spark, sf), "class", "block_id", "y", ["x2", "x1", "x4"], MODELS, 100).withColumnRenamed("class", "split")


@query("M30_ablation_by_wetness", split_ablation_sql(f"{PANEL}, uw AS (SELECT unit_id, avg(x2) AS wet FROM w GROUP BY 1), pw AS (SELECT pn.*, wet FROM pn JOIN uw USING (unit_id))", WETNESS))
def _(spark, sf):
    split = panel.wetness(wells(spark, sf), "unit_id", "x2", 6.4871, 50)
    return panel.ablation(well_panel(spark, sf).join(split, "unit_id"), "split", "block_id", "y", ["x2", "x1", "x4"], MODELS, 100)


@query("M30_unit_and_block_medians", f"""WITH {PANEL}, {', '.join(holdout_sql(f"m{i}", "pn", xs) for i, xs in enumerate(MODELS.values()))},
u AS ({" UNION ALL ".join(f"SELECT '{label}' AS model, unit_id, CASE WHEN count(*) >= 5 AND stddev_pop(y) > 0 AND stddev_pop(pred) > 0 THEN corr(y, pred) END AS r FROM m{i}_pred GROUP BY 2" for i, label in enumerate(MODELS))}),
b AS ({" UNION ALL ".join(f"SELECT '{label}' AS model, block_id, {R2} AS r2 FROM m{i}_pred GROUP BY 2 HAVING count(*) >= 30" for i, label in enumerate(MODELS))}),
x AS (SELECT model, median_unit_r, median_block_r2 FROM (SELECT model, median(r) AS median_unit_r FROM u GROUP BY 1) JOIN (SELECT model, median(r2) AS median_block_r2 FROM b GROUP BY 1) USING (model)) SELECT {sel('model:s median_unit_r:r median_block_r2:r')} FROM x""")
def _(spark, sf):
    return panel.ablation_medians(well_panel(spark, sf), "unit_id", "block_id", "y", ["x2", "x1", "x4"], MODELS, 5)


FLAGGED = f"""{EDGE}, fl AS (SELECT * FROM s WHERE x < 6), ed AS (SELECT src, dst FROM pr WHERE src IN (SELECT unit_id FROM fl) AND dst IN (SELECT unit_id FROM fl)),
rc AS (SELECT unit_id AS u, unit_id AS v FROM fl UNION SELECT rc.u, ed.dst FROM rc JOIN ed ON ed.src = rc.v), cp AS (SELECT u AS unit_id, min(v) AS component FROM rc GROUP BY 1)"""


def site_components(spark, sf):
    f = sites(spark, sf).where("x < 6")
    edges = site_graph(spark, sf)
    for end in ("src", "dst"):
        edges = edges.join(f.select(F.col("unit_id").alias(end)), end, "left_semi")
    return f, spatial.components(f, edges)


@query("M31_connected_components", f"""WITH RECURSIVE {FLAGGED} SELECT {sel('unit_id:i component:i')} FROM cp""")
def _(spark, sf):
    return site_components(spark, sf)[1]


@query("M32_component_summary", f"""WITH RECURSIVE {FLAGGED}, mb AS (SELECT component, fl.* FROM cp JOIN fl USING (unit_id)), bx AS (SELECT r_name AS name, -180.0 + 72 * r_regionkey AS lo, -108.0 + 72 * r_regionkey AS hi FROM region),
g AS (SELECT component, count(*) AS units, sum(area) AS area, min(lon) AS lon_lo, max(lat) AS lat_hi, median(x) AS median_trend FROM mb GROUP BY 1 HAVING sum(area) >= 5000), h AS (SELECT component, name, sum(area) AS inside FROM mb JOIN bx ON lon BETWEEN lo AND hi GROUP BY 1, 2),
b AS (SELECT component, arg_max(name, (inside, name)) AS name, max(inside) AS inside FROM h GROUP BY 1), x AS (SELECT g.*, coalesce(inside / area, 0) AS share_inside, CASE WHEN coalesce(inside / area, 0) >= 0.5 THEN name ELSE 'none' END AS label FROM g LEFT JOIN b USING (component))
SELECT {sel('component:i units:i area:r lon_lo:r lat_hi:r median_trend:r share_inside:r label:s')} FROM x""")
def _(spark, sf):
    f, comp = site_components(spark, sf)
    members = comp.join(f, "unit_id").withColumnRenamed("x", "trend")
    k = F.col("r_regionkey")
    boxes = table(spark, sf, "region").select(F.col("r_name").alias("name"), (k * 72.0 - 180).alias("lon_min"), (k * 72.0 - 108).alias("lon_max"), F.lit(-90.0).alias("lat_min"), F.lit(90.0).alias("lat_max"))
    out = spatial.component_summary(members, boxes, 5000.0).na.fill("none", ["label"])
    return out.select("component", "units", "area", "lon_lo", "lat_hi", "median_trend", "share_inside", "label")


@query("M33_identical_series", f"""WITH d AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT o_custkey, list((y, n) ORDER BY y) AS fp FROM d GROUP BY 1), g AS (SELECT fp, count(*) AS cells, sum(o_custkey % 10 + 1.0) AS area FROM f GROUP BY 1),
x AS (SELECT cells, count(*) AS groups, sum(area) AS area FROM g GROUP BY 1) SELECT {sel('cells:i groups:i area:r')} FROM x""")
def _(spark, sf):
    d = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    d = d.withColumn("area", F.col("o_custkey") % 10 + 1.0)
    return spatial.identical_series(d, ["o_custkey"], "y", "n", "area").groupBy("cells").agg(F.count("*").alias("groups"), F.sum("area").alias("area"))


DRY = f"""{A}, {U}, d AS (SELECT 'early' AS win, * FROM a WHERE month BETWEEN DATE '1995-01-01' AND DATE '1999-12-01' UNION ALL SELECT 'full', * FROM a), {ols_sql('d', 'win, unit_id', 'value', trend_xs(), 'month', min_rows=24)},
tr AS (SELECT win, unit_id, b AS trend, {t_p_sql('t', 'df')} AS p FROM {stats_sql('g_fit', 6, 'trend')} WHERE n >= 24), rk AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY p) AS i, count(*) OVER (PARTITION BY win) AS m FROM tr),
ct AS (SELECT win, max(CASE WHEN p <= 0.05 * i / (m * (ln(m) + 0.5772156649 + 1.0 / (2 * m))) THEN p END) AS cut FROM rk GROUP BY 1)"""


@query("M34_drying_by_window", f"""WITH {DRY}, x AS (SELECT tr.win AS "window", parent_id, count(*) AS n, count(CASE WHEN trend <= -0.2 THEN 1 END) AS n_drying, sum(CASE WHEN trend <= -0.2 THEN area_km2 ELSE 0 END) / sum(area_km2) AS area_share,
count(CASE WHEN trend <= -0.2 AND p < 0.05 THEN 1 END) AS n_significant, count(CASE WHEN trend <= -0.2 AND coalesce(p <= cut, false) THEN 1 END) AS n_significant_dependent FROM tr JOIN ct USING (win) JOIN u USING (unit_id) GROUP BY 1, 2)
SELECT "window", {sel('parent_id:i n:i n_drying:i area_share:r n_significant:i n_significant_dependent:i')} FROM x""")
def _(spark, sf):
    windows = {"early": ("1995-01-01", "1999-12-01"), "full": ("1900-01-01", "2100-01-01")}
    return studies.drying(totals(spark, sf), windows, units(spark, sf), "parent_id", -0.2)


@query("M35_two_solutions", f"""WITH {AB}, {ols_sql('ab', 'unit_id', 'a', trend_xs(), 'month', 'g', 36)}, {ols_sql('ab', 'unit_id', 'b', trend_xs(), 'month', 'h', 36)},
mo AS (SELECT unit_id, count(*) AS n, corr(a, b) AS r, avg(CASE WHEN month < DATE '1999-01-01' THEN a - b END) AS offset_before, avg(CASE WHEN month >= DATE '1999-01-01' THEN a - b END) AS offset_from FROM ab GROUP BY 1),
x AS (SELECT mo.*, g_fit.b AS trend_a, h_fit.b AS trend_b, (g_fit.b < 0) <> (h_fit.b < 0) AS sign_flip FROM mo JOIN g_fit USING (unit_id) JOIN h_fit USING (unit_id)) SELECT {sel('unit_id:i n:i r:r offset_before:r offset_from:r trend_a:r trend_b:r sign_flip:i')} FROM x""")
def _(spark, sf):
    return studies.compare_solutions(totals(spark, sf), shipped(spark, sf), "unit_id", "month", "value", "1999-01-01")


@query("M36_coverage_by_unit", f"""WITH {P}, {U}, bx AS (SELECT point_id, min(u.unit_id) AS unit_id FROM p JOIN u ON p.lat >= lat_min AND p.lat < lat_max AND CASE WHEN lon_min < lon_max THEN p.lon >= lon_min AND p.lon < lon_max ELSE p.lon >= lon_min OR p.lon < lon_max END GROUP BY 1),
r AS (SELECT unit_id, year(o_orderdate) AS y, o_totalprice / {SCALE} AS area, o_orderstatus = 'F' AS hit FROM orders JOIN bx ON point_id = o_custkey), s AS (SELECT r.unit_id, y, 100 * sum(CASE WHEN hit THEN area ELSE 0 END) / max(area_km2) AS share, count(*) AS c FROM r JOIN u USING (unit_id) GROUP BY 1, 2),
x AS (SELECT unit_id, avg(share) AS mean_share, min(share) AS min_share, max(share) AS max_share, sum(c) AS rows FROM s GROUP BY 1) SELECT {sel('unit_id:i mean_share:r min_share:r max_share:r rows:i')} FROM x""")
def _(spark, sf):
    u = units(spark, sf)
    box = overlay.first_box(points(spark, sf), u, "point_id", "unit_id").where("unit_id >= 0")
    r = table(spark, sf, "orders").join(box, F.col("o_custkey") == F.col("point_id")).select(
        "unit_id", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") / SCALE).alias("area"), (F.col("o_orderstatus") == "F").alias("hit"))
    return studies.coverage_by_unit(r, "unit_id", "y", F.col("area"), F.col("hit"), u.select("unit_id", "area_km2"))


@query("M37_storage_inventory", f"""WITH {S}, {U}, bx AS (SELECT s.unit_id AS dam, min(u.unit_id) AS unit_id FROM s JOIN u ON s.lat >= lat_min AND s.lat < lat_max AND CASE WHEN lon_min < lon_max THEN s.lon >= lon_min AND s.lon < lon_max ELSE s.lon >= lon_min OR s.lon < lon_max END GROUP BY 1),
mo AS (SELECT l_suppkey AS dam, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), sn AS (SELECT dam, max(v) - min(v) AS rng, count(v) AS n_months FROM mo GROUP BY 1),
x AS (SELECT dam, unit_id, 1000.0 / area_km2 AS mm_per_hm3, s.area * 1000.0 / area_km2 AS capacity_mm, rng * 1000.0 / area_km2 AS obs_range_mm, n_months FROM bx JOIN (SELECT unit_id AS dam, area FROM s) s USING (dam) JOIN (SELECT unit_id, area_km2 FROM u) u USING (unit_id) LEFT JOIN sn USING (dam))
SELECT {sel('dam:i unit_id:i mm_per_hm3:r capacity_mm:r obs_range_mm:r n_months:i')} FROM x""")
def _(spark, sf):
    dams = sites(spark, sf).select(F.col("unit_id").alias("dam"), "lat", "lon", F.col("area").alias("capacity"))
    monthly = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dam"), F.trunc("l_shipdate", "MM").alias("m")).agg(F.sum("l_quantity").alias("v"))
    out = studies.storage_inventory(dams, monthly, units(spark, sf), "dam", "v")
    return out.select("dam", "unit_id", "mm_per_hm3", "capacity_mm", "obs_range_mm", "n_months")


@query("M38_leakage_indicator", f"""WITH {A}, {U}, g AS (SELECT month, sum(CASE WHEN location <> 90 THEN value * area_km2 END) / sum(CASE WHEN location <> 90 THEN area_km2 END) AS land, sum(CASE WHEN location = 90 THEN value * area_km2 END) / sum(CASE WHEN location = 90 THEN area_km2 END) AS ocean,
sum(CASE WHEN location = 1 THEN value * area_km2 END) / sum(CASE WHEN location = 1 THEN area_km2 END) AS coastal, sum(CASE WHEN location = 80 THEN value * area_km2 END) / sum(CASE WHEN location = 80 THEN area_km2 END) AS interior FROM a JOIN u USING (unit_id) GROUP BY 1),
x AS (SELECT corr(land, ocean) AS r_land_ocean, corr(coastal, ocean) AS r_coastal_ocean, corr(interior, ocean) AS r_interior_ocean, count(*) AS months FROM g) SELECT {sel('r_land_ocean:r r_coastal_ocean:r r_interior_ocean:r months:i')} FROM x""")
def _(spark, sf):
    j = totals(spark, sf).join(units(spark, sf).select("unit_id", "area_km2", "location"), "unit_id")
    return studies.leakage_indicator(j, "month", "value", "area_km2", F.col("location") != 90, F.col("location") == 1)


@query("M39_list_agreement", f"""WITH t AS (SELECT l_suppkey AS unit_id, regr_slope(l_quantity, l_discount) AS a, regr_slope(l_quantity, l_tax) AS b FROM lineitem GROUP BY 1), r AS (SELECT *, 100.0 * (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS rank_a,
100.0 * (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS rank_b FROM t), x AS (SELECT unit_id, rank_a, rank_b, abs(a - b) / nullif((abs(a) + abs(b)) / 2, 0) AS diff_ratio, abs(rank_a - rank_b) AS rank_shift FROM r) SELECT {sel('unit_id:i rank_a:r rank_b:r diff_ratio:r rank_shift:r')} FROM x""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.regr_slope("l_quantity", "l_discount").alias("a"), F.regr_slope("l_quantity", "l_tax").alias("b"))
    return studies.list_agreement(t, "unit_id", "a", "b").select("unit_id", "rank_a", "rank_b", "diff_ratio", "rank_shift")


@query("M40_annual_water_year_test", f"""WITH {B}, d0 AS (SELECT unit_id, month, CAST(year(month + INTERVAL 3 MONTH) AS BIGINT) AS wy, value, qty, disc FROM b), yr AS (SELECT unit_id, wy, CASE WHEN count(value) >= 10 THEN arg_max(value, month) - arg_min(value, month) END AS ds, sum(qty) AS c, sum(disc) AS p FROM d0 GROUP BY 1, 2),
k AS (SELECT * FROM yr WHERE ds IS NOT NULL), {ols_sql('k', 'unit_id', 'ds', ['1.0', 'p', 'c'], 'wy', 'g')}, r AS (SELECT unit_id, count(*) AS n_years, -corr(ds, c) AS r_raw, (-corr(ds, c) + corr(ds, p) * corr(p, c)) / sqrt((1 - corr(ds, p) ** 2) * (1 - corr(p, c) ** 2)) AS partial_r FROM k GROUP BY 1 HAVING count(*) >= 6),
s AS (SELECT *, partial_r * sqrt((n_years - 3) / greatest(1e-12, 1 - partial_r ** 2)) AS tt FROM r), x AS (SELECT s.*, {t_p_sql('tt', '(n_years - 3)')} AS partial_p, b AS b_cu, se AS se_cu FROM s JOIN {stats_sql('g_fit', 3, 'plain')} USING (unit_id)) SELECT {sel('unit_id:i n_years:i r_raw:r partial_r:r partial_p:r b_cu:r se_cu:r')} FROM x""")
def _(spark, sf):
    b = shipped(spark, sf)
    out = studies.annual_test(b.select("unit_id", "month", "value"), b.select("unit_id", "month", F.col("qty").alias("c"), F.col("disc").alias("p")), "unit_id", 6)
    return out.select("unit_id", "n_years", "r_raw", "partial_r", "partial_p", "b_cu", "se_cu")
