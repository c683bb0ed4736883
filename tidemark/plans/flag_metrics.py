"""Metrics of the flag table, each by its own operator: cells, dominance, variance ratio, departure fit, r, trends, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fit, order, overlay, reduce, timeops
from tidemark.plans.roles import CROSS, E, P, ols_sql, outlines, points, sites, table, trend_xs
from tidemark.session import cut_lineage

K = ["unit_id"]


def three_series(spark: SparkSession, sf: str) -> DataFrame:
    """Products a and b, their parent c and the predictors p, sm, sn of every supplier and month."""
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return l.groupBy(F.col("l_suppkey").alias("unit_id"), F.trunc("l_shipdate", "MM").alias("month")).agg(
        F.sum("l_quantity").alias("a"), (F.sum("l_extendedprice") / 1500).alias("b"), (F.count("*") * 25.0).alias("c"),
        F.avg("l_discount").alias("p"), F.avg("l_tax").alias("sm"), F.max("l_quantity").alias("sn"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    # One row for each unit and month, read by every metric below.
    s = cut_lineage(three_series(spark, sf))
    unit = sites(spark, sf).select("unit_id", "area")

    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, 5.0)
    cells = points(spark, sf).select("point_id", "lat", "lon", F.col("w").alias("ww"), (F.col("v") > 0).cast("double").alias("n_land"), ci.alias("ci"), cj.alias("cj"))
    coarse = overlay.points_in_polygons(cells, outlines(spark, sf), "point_id", by=["ci", "cj"], sums=["ww", "n_land"])
    geometry = timeops.share_of_group(coarse, K, "ww", "share").groupBy("unit_id").agg(
        F.sum("n").cast("double").alias("n_cells_a"), F.sum("n_land").cast("double").alias("n_cells_b"), F.max("share").alias("frac_dominant"))

    pairs = s.groupBy("unit_id").agg(
        reduce.variance_ratio(F.col("a") - F.col("c"), F.col("c")).alias("var_ratio_a"),
        reduce.variance_ratio(F.col("b") - F.col("c"), F.col("c")).alias("var_ratio_b"), reduce.paired_r(F.col("a"), F.col("b")).alias("r_ab"))

    d = s.withColumn("ya", F.col("a") - F.col("c")).withColumn("yb", F.col("b") - F.col("c"))
    for name in ("ya", "yb", "p", "sm", "sn"):
        d = timeops.deseasonalise(d, K, "month", name, name)
    d = timeops.accumulated_anomaly(timeops.lagged(d, K, "month", "p", [1, 2, 3], "p"), K, "month", "p", "pc", nulls_as_zero=True)
    predictors = ["p", "p1", "p2", "p3", "pc", "sm", "sn"]
    departures = fit.departure_fits(d, K, "month", ["ya", "yb"], predictors).select(
        "unit_id", *[F.col(f"y{x}")["r2_adj"].alias(f"pred_r2_{x}") for x in "ab"])

    out = unit.join(geometry, "unit_id", "left").na.fill(0.0, ["n_cells_a", "n_cells_b"]).join(pairs, "unit_id", "left")
    out = out.join(departures, "unit_id", "left")
    trends = fit.fits(fit.trend_design(s, "month"), K, ["a", "b", "c"], fit.TREND, "month", "trend", 36)
    # One row a unit, read by both ranks.
    trends = cut_lineage(trends.select("unit_id", *[F.col(x)["b_t"].alias(f"t_{x}") for x in "abc"]))
    for x in "ab":
        trends = order.average_rank(trends, f"t_{x}").drop("rank").withColumnRenamed("pct_rank", f"rank_{x}")
    out = out.join(trends, "unit_id", "left")
    ratio = F.try_divide(F.abs(F.col("t_a") - F.col("t_b")), F.abs("t_c"))
    return out.select("unit_id", "area", "n_cells_a", "n_cells_b", "frac_dominant", "var_ratio_a", "var_ratio_b", "pred_r2_a", "pred_r2_b",
                      "r_ab", ratio.alias("trend_diff_ratio"), F.abs(F.col("rank_a") - F.col("rank_b")).alias("rank_shift"))


def _sql() -> str:
    def ds(c: str) -> str:
        return f"{c} - avg({c}) OVER (PARTITION BY unit_id, month(month))"

    parts = [f"{P}, {E}", """ser AS (SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS a,
  sum(l_extendedprice) / 1500 AS b, count(*) * 25.0 AS c, avg(l_discount) AS p, avg(l_tax) AS sm, max(l_quantity) AS sn FROM lineitem GROUP BY 1, 2)""",
             f"hit AS (SELECT point_id, unit_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2 HAVING count(*) % 2 = 1)",
             """crs AS (SELECT unit_id, CAST(floor((lat + 90) / 5) AS BIGINT) AS ci, CAST(floor((lon + 180) / 5) AS BIGINT) AS cj, sum(w) AS ww, count(*) AS n,
  count(CASE WHEN v > 0 THEN 1 END) AS n_land FROM hit JOIN p USING (point_id) GROUP BY 1, 2, 3)""",
             "shr AS (SELECT *, ww / sum(ww) OVER (PARTITION BY unit_id) AS share FROM crs)",
             "geo AS (SELECT unit_id, sum(n) AS n_cells_a, sum(n_land) AS n_cells_b, max(share) AS frac_dominant FROM shr GROUP BY 1)",
             """prs AS (SELECT unit_id, var_pop(a - c) / nullif(var_pop(c), 0) AS var_ratio_a, var_pop(b - c) / nullif(var_pop(c), 0) AS var_ratio_b,
  CASE WHEN count(*) >= 10 THEN corr(a, b) END AS r_ab FROM ser GROUP BY 1)""",
             f"dp0 AS (SELECT unit_id, month, {ds('(a - c)')} AS ya, {ds('(b - c)')} AS yb, {ds('p')} AS p, {ds('sm')} AS sm, {ds('sn')} AS sn FROM ser)",
             """dp1 AS (SELECT *, sum(p) OVER (PARTITION BY unit_id ORDER BY month) AS pc0, lag(p, 1) OVER w AS p1, lag(p, 2) OVER w AS p2, lag(p, 3) OVER w AS p3
  FROM dp0 WINDOW w AS (PARTITION BY unit_id ORDER BY month))""",
             "dp AS (SELECT *, pc0 - avg(pc0) OVER (PARTITION BY unit_id) AS pc FROM dp1)"]
    for x in "ab":
        parts.append(ols_sql("dp", "unit_id", f"y{x}", ["1.0", "p", "p1", "p2", "p3", "pc", "sm", "sn"], "month", f"f{x}"))
        parts.append(f"dep{x} AS (SELECT unit_id, 1 - (rss / ssy) * (n - 1) / (n - 8) AS pred_r2_{x} FROM f{x}_fit WHERE n >= 17)")
    for x in "abc":
        parts.append(ols_sql("ser", "unit_id", x, trend_xs(), "month", f"t{x}"))
        rank = "100.0 * (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 1) / greatest(count(*) OVER () - 1, 1)"
        parts.append(f"tr{x} AS (SELECT unit_id, b AS t_{x}, {rank} AS rank_{x} FROM t{x}_fit)")
    parts.append("""m AS (SELECT s_suppkey AS unit_id, abs(s_acctbal) + 100.0 AS area, coalesce(n_cells_a, 0) AS n_cells_a, coalesce(n_cells_b, 0) AS n_cells_b, frac_dominant,
  var_ratio_a, var_ratio_b, pred_r2_a, pred_r2_b, r_ab, abs(t_a - t_b) / abs(t_c) AS trend_diff_ratio, abs(rank_a - rank_b) AS rank_shift
  FROM supplier LEFT JOIN geo ON geo.unit_id = s_suppkey LEFT JOIN prs ON prs.unit_id = s_suppkey LEFT JOIN depa ON depa.unit_id = s_suppkey LEFT JOIN depb ON depb.unit_id = s_suppkey
  LEFT JOIN tra ON tra.unit_id = s_suppkey LEFT JOIN trb ON trb.unit_id = s_suppkey LEFT JOIN trc ON trc.unit_id = s_suppkey)""")
    return ",\n".join(parts)


#: CTEs that end in m, one row of metrics for each unit.
METRIC = _sql()
