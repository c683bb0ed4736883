"""Aggregations A01-A54 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import water_year
from tidemark.operators import order, overlay, reduce, timeops
from tidemark.operators.fit import simple_regression
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import (A, AB, B, CROSS, E, P, SCALE, U, outlines, points, products, shipped, sites, t_p_sql, table, totals, units)
from tidemark.session import cut_lineage

K = ["unit_id"]


def items(spark, sf):
    return table(spark, sf, "lineitem")


@query("A01_group_aggregates", f"""WITH x AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, avg(l_discount) AS mean,
count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2)
SELECT {sel('l_returnflag:s l_linestatus:s total:r mean:r n:i low:r high:r')} FROM x""")
def _(spark, sf):
    return items(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("total"), F.avg("l_discount").alias("mean"), F.count("*").alias("n"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("A02_named_last_and_median", f"""WITH x AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, (o_orderdate, o_orderkey))
FILTER (WHERE o_orderstatus <> 'O') AS last_status, median(o_totalprice) AS mid, count(*) AS n FROM orders GROUP BY 1)
SELECT {sel('o_custkey:i last_status:s mid:r n:i')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    when = F.when(status.isNotNull(), F.struct("o_orderdate", "o_orderkey"))
    last = o.groupBy("o_custkey").agg(F.max_by(status, when).alias("last_status"), F.count("*").alias("n"))
    mid = order.quantiles(o, "o_totalprice", [0.5], ["o_custkey"]).select("o_custkey", F.col("quantile").alias("mid"))
    return last.join(mid, "o_custkey")


@query("A03_distinct_count", f"""WITH x AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT {sel('l_suppkey:i parts:i')} FROM x""")
def _(spark, sf):
    return items(spark, sf).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("A04_conditional_sums", f"""WITH x AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned,
sum(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS discounted FROM lineitem GROUP BY 1) SELECT {sel('l_suppkey:i returned:r discounted:r')} FROM x""")
def _(spark, sf):
    return items(spark, sf).groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"),
        F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("discounted"))


# Cells are customers, their observations monthly order totals, some set to missing.
CELL = f"""{P}, obs AS (SELECT o_custkey AS cell, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
CASE WHEN min(o_orderkey) % 5 <> 0 THEN sum(o_totalprice) / {SCALE} END AS v FROM orders GROUP BY 1, 2),
ov AS (SELECT nation AS unit_id, point_id AS cell, w FROM p),
j AS (SELECT unit_id, month, v, w FROM obs JOIN ov USING (cell))"""


def cell_obs(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell"), F.trunc("o_orderdate", "MM").alias("month"))
            .agg((F.sum("o_totalprice") / SCALE).alias("_v"), F.min("o_orderkey").alias("_k"))
            .select("cell", "month", F.when(F.col("_k") % 5 != 0, F.col("_v")).alias("v")))


def overlap(spark, sf):
    return points(spark, sf).select(F.col("nation").alias("unit_id"), F.col("point_id").alias("cell"), "w")


def joined(spark, sf):
    return cell_obs(spark, sf).join(overlap(spark, sf), "cell")


@query("A05_weighted_mean", f"""WITH {CELL}, x AS (SELECT unit_id, month, sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) AS v FROM j GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    return reduce.overlay_means(overlap(spark, sf), cell_obs(spark, sf), ["cell"], "unit_id", "month", "v", "w")


@query("A06_covered_mean", f"""WITH {CELL}, x AS (SELECT unit_id, month, CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) / sum(w) >= 0.9
THEN sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) END AS v FROM j GROUP BY 1, 2) SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    return joined(spark, sf).groupBy("unit_id", "month").agg(reduce.covered_mean(F.col("v"), F.col("w"), 0.9).alias("v"))


@query("A07_strict_mean", f"""WITH {CELL}, x AS (SELECT unit_id, month, CASE WHEN count(v) = count(*) THEN sum(w * v) / sum(w) END AS v FROM j GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    return joined(spark, sf).groupBy("unit_id", "month").agg(reduce.strict_mean(F.col("v"), F.col("w")).alias("v"))


@query("A08_fixed_weight_mean", f"""WITH {CELL}, x AS (SELECT unit_id, month, sum(w * v) / sum(w) AS v FROM j GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    return joined(spark, sf).groupBy("unit_id", "month").agg(reduce.fixed_weight_mean(F.col("v"), F.col("w")).alias("v"))


@query("A09_to_monthly", f"""WITH x AS (SELECT o_custkey AS unit_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), "o_orderdate", F.col("o_totalprice").alias("v"))
    return reduce.to_monthly(o, K, "o_orderdate", "v")


@query("A10_collapse_by_days", f"""WITH d AS (SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_shipdate AS ts,
l_extendedprice / 9973.0 AS v, l_discount / 3 AS noise, l_quantity AS days FROM lineitem),
x AS (SELECT unit_id, month, sum(v * days) / sum(days) AS v, sum(noise * days) / sum(days) AS noise, CAST(min(ts) AS DATE) AS first_day,
CAST(max(ts) AS DATE) AS last_day, sum(days) AS days, sum(epoch(ts) * days) / sum(days) / 86400 AS mid_day FROM d GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r noise:r first_day:m last_day:m days:r mid_day:r')} FROM x""")
def _(spark, sf):
    d = items(spark, sf).select(F.col("l_suppkey").alias("unit_id"), F.trunc("l_shipdate", "MM").alias("month"),
                                (F.col("l_extendedprice") / SCALE).alias("v"), (F.col("l_discount") / 3).alias("noise"),
                                F.col("l_quantity").alias("days"), F.to_date("l_shipdate").alias("day"))
    d = d.withColumn("last_day", F.col("day")).withColumn("first_day", F.col("day"))
    x = reduce.collapse_by_days(d, K, "month", "v", "noise", "days", "first_day", "last_day", "day")
    return x.withColumn("mid_day", F.col("mid_epoch") / 86400).drop("mid_epoch")


@query("A11_annual_demeaned", f"""WITH {A}, y AS (SELECT unit_id, year(month) AS year, avg(value) AS m FROM a GROUP BY 1, 2),
ax AS (SELECT unit_id, year FROM (SELECT DISTINCT unit_id FROM a), (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) + 1 FROM y))) AS year)),
x AS (SELECT ax.unit_id, ax.year, m - avg(m) OVER (PARTITION BY ax.unit_id) AS anomaly FROM ax LEFT JOIN y USING (unit_id, year))
SELECT {sel('unit_id:i year:i anomaly:r')} FROM x""")
def _(spark, sf):
    years = totals(spark, sf).groupBy("unit_id", F.year("month").alias("year")).agg(F.avg("value").alias("m"))
    axis = years.select("unit_id").distinct().withColumn("year", F.explode(F.sequence(years.agg(F.min("year")).scalar(), years.agg(F.max("year")).scalar())))
    return timeops.recentre(axis.join(years, ["unit_id", "year"], "left"), K, "m", "anomaly").select("unit_id", "year", "anomaly")


@query("A12_sum_min_count", f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2),
x AS (SELECT user_id, CAST(date_trunc('month', day) AS DATE) AS month, CASE WHEN count(v) >= 25 THEN sum(v) END AS v, count(v) AS days FROM d GROUP BY 1, 2)
SELECT {sel('user_id:i month:m v:r days:i')} FROM x""")
def _(spark, sf):
    day = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return day.groupBy("user_id", F.trunc("day", "MM").alias("month")).agg(
        reduce.sum_min_count(F.col("v"), 25).alias("v"), F.count("v").alias("days"))


@query("A13_all_reporting_sum", f"""WITH {CELL}, full_n AS (SELECT unit_id, month, count(*) AS n FROM j GROUP BY 1, 2),
x AS (SELECT j.unit_id, j.month, CASE WHEN count(v) = max(n) THEN sum(v) END AS v FROM j JOIN full_n ON j.unit_id = full_n.unit_id AND j.month = full_n.month GROUP BY 1, 2)
SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    j = joined(spark, sf)
    expected = j.groupBy("unit_id", "month").agg(F.count("*").alias("n"))
    return j.join(expected, ["unit_id", "month"]).groupBy("unit_id", "month").agg(
        reduce.all_reporting_sum(F.col("v"), F.col("n")).alias("v"))


@query("A14_overlap_weights", f"""WITH {P}, x AS (SELECT nation AS unit_id, CAST(floor((lat + 90) / 10) AS BIGINT) AS ci, CAST(floor((lon + 180) / 10) AS BIGINT) AS cj, sum(w) AS weight FROM p GROUP BY 1, 2, 3)
SELECT {sel('unit_id:i ci:i cj:i weight:r')} FROM x""")
def _(spark, sf):
    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, 10.0)
    return points(spark, sf).groupBy(F.col("nation").alias("unit_id"), ci.alias("ci"), cj.alias("cj")).agg(F.sum("w").alias("weight"))


@query("A15_coverage_share", f"""WITH {CELL}, x AS (SELECT unit_id, coalesce(sum(CASE WHEN v IS NOT NULL THEN w END) / sum(w), 0) AS coverage FROM j GROUP BY 1)
SELECT {sel('unit_id:i coverage:r')} FROM x""")
def _(spark, sf):
    ok = F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0)
    return joined(spark, sf).groupBy("unit_id").agg(reduce.share(ok, F.col("w")).alias("coverage"))


@query("A16_dominance", f"""WITH {P}, f AS (SELECT nation AS unit_id, CAST(floor((lat + 90) / 30) AS BIGINT) AS ci, CAST(floor((lon + 180) / 30) AS BIGINT) AS cj, sum(w) AS ww FROM p GROUP BY 1, 2, 3),
s AS (SELECT *, ww / sum(ww) OVER (PARTITION BY unit_id) AS share FROM f),
x AS (SELECT unit_id, count(*) AS footprints, count(CASE WHEN share >= 0.05 THEN 1 END) AS footprints_5pct, max(share) AS frac_dominant FROM s GROUP BY 1)
SELECT {sel('unit_id:i footprints:i footprints_5pct:i frac_dominant:r')} FROM x""")
def _(spark, sf):
    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, 30.0)
    f = points(spark, sf).groupBy(F.col("nation").alias("unit_id"), ci.alias("ci"), cj.alias("cj")).agg(F.sum("w").alias("ww"))
    s = timeops.share_of_group(f, K, "ww", "share")
    return s.groupBy("unit_id").agg(F.count("*").alias("footprints"), F.count_if(F.col("share") >= 0.05).alias("footprints_5pct"),
                                    F.max("share").alias("frac_dominant"))


@query("A17_cell_centres_per_unit", f"""WITH {P}, {E}, h AS (SELECT point_id, unit_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2 HAVING count(*) % 2 = 1),
x AS (SELECT s_suppkey AS unit_id, count(point_id) AS n FROM supplier LEFT JOIN h ON unit_id = s_suppkey GROUP BY 1) SELECT {sel('unit_id:i n:i')} FROM x""")
def _(spark, sf):
    n = overlay.points_in_polygons(points(spark, sf).select("point_id", "lat", "lon"), outlines(spark, sf), "point_id", by=[])
    return sites(spark, sf).select("unit_id").join(n, "unit_id", "left").na.fill(0, ["n"])


@query("A18_population_and_sample_spread", f"""WITH {A}, x AS (SELECT unit_id, var_pop(value) AS vp, var_samp(value) AS vs, stddev_pop(value) AS sp, stddev_samp(value) AS ss FROM a GROUP BY 1)
SELECT {sel('unit_id:i vp:r vs:r sp:r ss:r')} FROM x""")
def _(spark, sf):
    return totals(spark, sf).groupBy("unit_id").agg(F.var_pop("value").alias("vp"), F.var_samp("value").alias("vs"),
                                                    F.stddev_pop("value").alias("sp"), F.stddev_samp("value").alias("ss"))


@query("A19_variance_ratio", f"""WITH {AB}, x AS (SELECT unit_id, var_pop(a - b) / nullif(var_pop(b), 0) AS ratio FROM ab GROUP BY 1) SELECT {sel('unit_id:i ratio:r')} FROM x""")
def _(spark, sf):
    return products(spark, sf).groupBy("unit_id").agg(reduce.variance_ratio(F.col("a") - F.col("b"), F.col("b")).alias("ratio"))


@query("A20_quantiles", f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 1.0]) AS v, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT l_returnflag, unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS prob, unnest(v) AS quantile, n FROM q)
SELECT {sel('l_returnflag:s prob:r quantile:r n:i')} FROM x""")
def _(spark, sf):
    return order.quantiles(items(spark, sf), "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 1.0], ["l_returnflag"])


# The round limits of the reports.
STEPS = [10, 20, 25, 40, 50, 75, 100, 150, 200, 300, 400, 500]


@query("A21_scale_limit", f"""WITH r AS (SELECT abs(l_extendedprice / 100) AS v, row_number() OVER (ORDER BY abs(l_extendedprice / 100)) - 1 AS i, count(*) OVER () AS n FROM lineitem),
h AS (SELECT v FROM r WHERE i = floor(n * 0.95)),
x AS (SELECT v AS q_value, coalesce((SELECT min(s) FROM (SELECT unnest({STEPS}) AS s) WHERE s >= v), 500) AS "limit" FROM h)
SELECT {sel('q_value:r')}, CAST("limit" AS DOUBLE) AS "limit" FROM x""")
def _(spark, sf):
    return reduce.round_up_limit(items(spark, sf).select((F.col("l_extendedprice") / 100).alias("v")), "v", STEPS)


@query("A22_paired_r", f"""WITH {AB}, x AS (SELECT unit_id, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS r, count(*) AS n FROM ab GROUP BY 1) SELECT {sel('unit_id:i r:r n:i')} FROM x""")
def _(spark, sf):
    return products(spark, sf).groupBy("unit_id").agg(reduce.paired_r(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))


@query("A23_spearman", f"""WITH c AS (SELECT c_custkey, c_acctbal AS x, count(o_orderkey) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c),
x AS (SELECT corr(rx, ry) AS rho, count(*) AS n FROM r) SELECT {sel('rho:r n:i')} FROM x""")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"))
    c = (table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
         .join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "x", F.coalesce("y", F.lit(0)).alias("y")))
    # Ranked twice: without the cut, the second ranking would plan the first one for each of its branches.
    rx = cut_lineage(order.average_rank(c, "x").select("y", F.col("rank").alias("rx")))
    return order.average_rank(rx, "y").agg(F.corr("rx", "rank").alias("rho"), F.count("*").alias("n"))


@query("A24_arg_min_max", f"""WITH {A}, x AS (SELECT unit_id, arg_min(month, (value, month)) AS low_month, min(value) AS low, arg_max(month, (value, month)) AS high_month, max(value) AS high FROM a GROUP BY 1)
SELECT {sel('unit_id:i low_month:m low:r high_month:m high:r')} FROM x""")
def _(spark, sf):
    return totals(spark, sf).groupBy("unit_id").agg(F.min_by("month", F.struct("value", "month")).alias("low_month"), F.min("value").alias("low"),
                                                    F.max_by("month", F.struct("value", "month")).alias("high_month"), F.max("value").alias("high"))


@query("A25_mode", f"""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS rn FROM c),
x AS (SELECT l_suppkey, l_quantity AS mode, n FROM r WHERE rn = 1) SELECT {sel('l_suppkey:i mode:r n:i')} FROM x""")
def _(spark, sf):
    # Counts per value combine first; the built-in mode would hold every value of a key in one task.
    c = items(spark, sf).groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    best = c.groupBy("l_suppkey").agg(F.max(F.struct(F.col("n"), (-F.col("l_quantity")).alias("v"))).alias("m"))
    return best.select("l_suppkey", (-F.col("m.v")).alias("mode"), F.col("m.n").alias("n"))


@query("A26_flag_tally", f"""WITH f AS (SELECT c_mktsegment, abs(c_acctbal) AS area, c_acctbal < 0 AS negative, c_acctbal > 5000 AS rich FROM customer),
x AS (SELECT c_mktsegment, 'negative' AS flag, count(CASE WHEN negative THEN 1 END) AS n, sum(CASE WHEN negative THEN area ELSE 0 END) / sum(area) AS area_share FROM f GROUP BY 1
UNION ALL SELECT c_mktsegment, 'rich', count(CASE WHEN rich THEN 1 END), sum(CASE WHEN rich THEN area ELSE 0 END) / sum(area) FROM f GROUP BY 1)
SELECT {sel('c_mktsegment:s flag:s n:i area_share:r')} FROM x""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", F.abs("c_acctbal").alias("area"),
                                            (F.col("c_acctbal") < 0).alias("negative"), (F.col("c_acctbal") > 5000).alias("rich"))
    return reduce.flag_tally(c, ["negative", "rich"], "area", ["c_mktsegment"])


@query("A27_first_last_change", f"""WITH {B}, d AS (SELECT unit_id, CAST(year(month + INTERVAL 3 MONTH) AS BIGINT) AS wy, month, value FROM b),
x AS (SELECT unit_id, wy, CASE WHEN count(value) >= 10 THEN arg_max(value, month) - arg_min(value, month) END AS change FROM d GROUP BY 1, 2) SELECT {sel('unit_id:i wy:i change:r')} FROM x""")
def _(spark, sf):
    return shipped(spark, sf).groupBy("unit_id", water_year(F.col("month")).alias("wy")).agg(
        reduce.change_first_last(F.col("value"), F.col("month")).alias("change"))


@query("A28_endpoint_change", f"""WITH {A}, d AS (SELECT *, value - avg(value) OVER (PARTITION BY unit_id, month(month)) AS des FROM a),
y AS (SELECT unit_id, year(month) AS year, avg(des) AS m, count(des) AS n FROM d GROUP BY 1, 2),
x AS (SELECT unit_id, min(year) AS first_year, max(year) AS last_year, arg_max(m, year) - arg_min(m, year) AS change, arg_min(n, year) AS n_first, arg_max(n, year) AS n_last FROM y GROUP BY 1)
SELECT {sel('unit_id:i first_year:i last_year:i change:r n_first:i n_last:i')} FROM x""")
def _(spark, sf):
    return timeops.endpoint_change(totals(spark, sf), K, "month", "value")


@query("A29_decile_shares", f"""WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders),
d AS (SELECT o_orderstatus = 'F' AS hit, 1 + len(list_filter(q[2:10], lambda v: v <= o_totalprice)) AS decile, q FROM orders, e),
x AS (SELECT decile, any_value(q)[decile] AS low, any_value(q)[decile + 1] AS high, count(*) AS n, avg(CAST(hit AS DOUBLE)) AS share FROM d GROUP BY 1)
SELECT {sel('decile:i low:r high:r n:i share:r')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("hit"))
    return reduce.decile_shares(o, "o_totalprice", "hit")


@query("A30_histogram", f"""WITH d AS (SELECT l_returnflag, CAST(greatest(0, least(19, floor((log10(l_extendedprice) - 3) / 2 * 20))) AS BIGINT) AS bin FROM lineitem),
x AS (SELECT bin, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS "A", count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS "N", count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS "R" FROM d GROUP BY 1)
SELECT {sel('bin:i A:i N:i R:i')} FROM x""")
def _(spark, sf):
    rows = items(spark, sf).select("l_returnflag", reduce.fixed_bins(F.log10("l_extendedprice"), 3.0, 5.0, 20).alias("bin"))
    return rows.groupBy("bin").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A31_distance_bins", f"""WITH d AS (SELECT CAST(ceil(o_totalprice / 50000) AS BIGINT) AS bin, o_orderkey % 101 AS r FROM orders),
x AS (SELECT bin, avg(r) AS mean, stddev_samp(r) AS std, count(*) AS n, (bin - 0.5) * 50000 AS mid FROM d GROUP BY 1) SELECT {sel('bin:i mean:r std:r n:i mid:r')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(reduce.right_closed_bin(F.col("o_totalprice"), 50000.0).alias("bin"), (F.col("o_orderkey") % 101).alias("r"))
    return o.groupBy("bin").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("*").alias("n"),
                                ((F.col("bin") - 0.5) * 50000.0).alias("mid"))


@query("A32_pivot", f"""WITH x AS (SELECT l_suppkey, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS "F", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS "O" FROM lineitem GROUP BY 1)
SELECT {sel('l_suppkey:i F:r O:r')} FROM x""")
def _(spark, sf):
    return items(spark, sf).groupBy("l_suppkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("A33_value_counts_share", f"""WITH x AS (SELECT o_orderpriority, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1) SELECT {sel('o_orderpriority:s n:i share:r')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.count("*").alias("t"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total.scalar())


@query("A34_dedupe_then_sum", f"""WITH d AS (SELECT DISTINCT o_custkey, o_totalprice, o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
x AS (SELECT l_suppkey, sum(o_totalprice) / {SCALE} AS total, count(*) AS n FROM d GROUP BY 1) SELECT {sel('l_suppkey:i total:r n:i')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    l = items(spark, sf).select("l_orderkey", "l_suppkey").dropDuplicates()
    return (l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey")
            .agg((F.sum("o_totalprice") / SCALE).alias("total"), F.count("*").alias("n")))


@query("A35_ensemble_mean_spread", f"""WITH {A}, {B}, e AS (SELECT unit_id, month, value AS v FROM a UNION ALL SELECT unit_id, month, value FROM b UNION ALL SELECT unit_id, month, qty FROM b),
x AS (SELECT unit_id, month, avg(v) AS mean, max(v) - min(v) AS spread, count(v) AS n_models FROM e GROUP BY 1, 2) SELECT {sel('unit_id:i month:m mean:r spread:r n_models:i')} FROM x""")
def _(spark, sf):
    b = shipped(spark, sf)
    e = (totals(spark, sf).select("unit_id", "month", F.col("value").alias("v"))
         .unionByName(b.select("unit_id", "month", F.col("value").alias("v"))).unionByName(b.select("unit_id", "month", F.col("qty").alias("v"))))
    return e.groupBy("unit_id", "month").agg(F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("spread"), F.count("v").alias("n_models"))


@query("A36_area_weighted_column_mean", f"""WITH {A}, {U}, x AS (SELECT month, sum(value * area_km2) / sum(area_km2) AS mean, sum(value * area_km2) * 1e-6 AS volume FROM a JOIN u USING (unit_id) GROUP BY 1)
SELECT {sel('month:m mean:r volume:r')} FROM x""")
def _(spark, sf):
    j = totals(spark, sf).join(units(spark, sf).select("unit_id", "area_km2"), "unit_id")
    return j.groupBy("month").agg(reduce.weighted_mean(F.col("value"), F.col("area_km2")).alias("mean"),
                                  (F.sum(F.col("value") * F.col("area_km2")) * 1e-6).alias("volume"))


@query("A37_regional_uncertainty", f"""WITH {B}, x AS (SELECT month, avg(value) AS mean, (avg(disc) + avg(qty)) / sqrt(count(*) / least(22, count(*))) AS uncertainty FROM b GROUP BY 1) SELECT {sel('month:m mean:r uncertainty:r')} FROM x""")
def _(spark, sf):
    return shipped(spark, sf).groupBy("month").agg(F.avg("value").alias("mean"), reduce.regional_uncertainty(F.col("disc"), F.col("qty")).alias("uncertainty"))


@query("A38_global_mean_series", f"""WITH {A}, {U}, x AS (SELECT parent_id, month, sum(value * area_km2) / sum(area_km2) AS mean, count(*) AS units FROM a JOIN u USING (unit_id) GROUP BY 1, 2)
SELECT {sel('parent_id:i month:m mean:r units:i')} FROM x""")
def _(spark, sf):
    j = totals(spark, sf).join(units(spark, sf).select("unit_id", "parent_id", "area_km2"), "unit_id")
    return j.groupBy("parent_id", "month").agg(reduce.weighted_mean(F.col("value"), F.col("area_km2")).alias("mean"), F.count("*").alias("units"))


LEVELS = f"""{A}, {U}, c AS (SELECT unit_id, avg(value) AS v FROM a GROUP BY 1),
m AS (SELECT u.unit_id, parent_id, area_km2 AS w, v FROM c JOIN u USING (unit_id)),
pm AS (SELECT parent_id, sum(v * w) / sum(w) AS pv FROM m GROUP BY 1)"""


@query("A39_parent_explained_share", f"""WITH {LEVELS}, d AS (SELECT v, w, v - pv AS gap, sum(v * w) OVER () / sum(w) OVER () AS g FROM m JOIN pm USING (parent_id)),
x AS (SELECT count(*) AS n, 1 - (sum(w * gap * gap) / sum(w)) / (sum(w * (v - g) * (v - g)) / sum(w)) AS explained, median(abs(gap)) AS median_gap, quantile_cont(abs(gap), 0.9) AS p90_gap FROM d)
SELECT {sel('n:i explained:r median_gap:r p90_gap:r')} FROM x""")
def _(spark, sf):
    # One row for each unit, read by the parents, the moments and the quantiles.
    m = cut_lineage(totals(spark, sf).groupBy("unit_id").agg(F.avg("value").alias("v"))
                    .join(units(spark, sf).select("unit_id", "parent_id", F.col("area_km2").alias("w")), "unit_id"))
    p = m.groupBy("parent_id").agg(reduce.weighted_mean(F.col("v"), F.col("w")).alias("pv"))
    d = cut_lineage(m.join(p, "parent_id").withColumn("gap", F.col("v") - F.col("pv")).withColumn("size", F.abs("gap")))
    grand = m.agg(reduce.weighted_mean(F.col("v"), F.col("w")).alias("g"))
    q = order.quantiles(d, "size", [0.5, 0.9])
    moments = d.withColumn("g", grand.scalar()).agg(
        F.count("*").alias("n"),
        (1 - F.sum(F.col("w") * F.col("gap") * F.col("gap")) / F.sum(F.col("w") * F.pow(F.col("v") - F.col("g"), 2))).alias("explained"))
    wide = q.agg(F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median_gap"),
                 F.max(F.when(F.col("prob") == 0.9, F.col("quantile"))).alias("p90_gap"))
    return moments.withColumn("_q", wide.select(F.struct("median_gap", "p90_gap")).scalar()).select("n", "explained", "_q.*")


@query("A40_eta_squared", f"""WITH d AS (SELECT c_acctbal AS y, c_mktsegment AS g FROM customer), gm AS (SELECT g, avg(y) AS m, count(*) AS n FROM d GROUP BY 1),
x AS (SELECT (SELECT sum(n * (m - (SELECT avg(y) FROM d)) ** 2) FROM gm) / (SELECT sum((y - (SELECT avg(y) FROM d)) ** 2) FROM d) AS eta_squared, (SELECT count(*) FROM gm) AS groups)
SELECT {sel('eta_squared:r groups:i')} FROM x""")
def _(spark, sf):
    return reduce.eta_squared(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")


@query("A41_simple_regression", f"""WITH {AB}, r AS (SELECT unit_id, regr_slope(a, b) AS slope, regr_r2(a, b) AS r2, regr_count(a, b) AS n FROM ab GROUP BY 1),
s AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) AS t FROM r), x AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM s)
SELECT {sel('unit_id:i slope:r r2:r n:i t:r p:r')} FROM x""")
def _(spark, sf):
    return simple_regression(products(spark, sf), K, "a", "b")


@query("A42_validation_totals", f"""WITH {AB}, l AS (SELECT 'b' AS variable, a AS x, b AS y FROM ab UNION ALL SELECT 'qty', a, qty FROM ab),
x AS (SELECT variable, 100 * (sum(x) / sum(y) - 1) AS bias_pct, corr(x, y) AS r, 100 * median(abs(x - y) / abs(y)) AS median_rel_pct FROM l GROUP BY 1)
SELECT {sel('variable:s bias_pct:r r:r median_rel_pct:r')} FROM x""")
def _(spark, sf):
    long = products(spark, sf).unpivot(["unit_id", "month", "a"], ["b", "qty"], "variable", "y")
    base = long.groupBy("variable").agg((100 * (F.sum("a") / F.sum("y") - 1)).alias("bias_pct"), F.corr("a", "y").alias("r"))
    err = order.quantiles(long.withColumn("e", F.abs(F.col("a") - F.col("y")) / F.abs("y")), "e", [0.5], ["variable"])
    return base.join(err.select("variable", (100 * F.col("quantile")).alias("median_rel_pct")), "variable")


@query("A43_sign_disagreement", f"""WITH {AB}, d AS (SELECT unit_id, a - avg(a) OVER w AS da, b - avg(b) OVER w AS db FROM ab WINDOW w AS (PARTITION BY unit_id)),
x AS (SELECT unit_id, count(CASE WHEN (da < 0) <> (db < 0) THEN 1 END) AS flips, count(*) AS n FROM d GROUP BY 1) SELECT {sel('unit_id:i flips:i n:i')} FROM x""")
def _(spark, sf):
    d = timeops.recentre(timeops.recentre(products(spark, sf), K, "a", "da"), K, "b", "db")
    return d.groupBy("unit_id").agg(F.count_if((F.col("da") < 0) != (F.col("db") < 0)).alias("flips"), F.count("*").alias("n"))


@query("A44_column_profile_identities", f"""WITH x AS (SELECT count(*) AS n, count(*) - count(l_partkey) AS nulls, count(DISTINCT l_orderkey) AS orders, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
max(abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - l_extendedprice * l_discount))) AS residual,
(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys FROM lineitem)
SELECT {sel('n:i nulls:i orders:i low:r high:r residual:r repeated_keys:i')} FROM x""")
def _(spark, sf):
    l = items(spark, sf)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) - (F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount"))
    twice = l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("r"))
    return l.agg(F.count("*").alias("n"), F.count_if(F.col("l_partkey").isNull()).alias("nulls"), F.countDistinct("l_orderkey").alias("orders"),
                 F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.max(F.abs(net)).alias("residual")
                 ).withColumn("repeated_keys", twice.scalar())


@query("A45_signal_to_noise", f"""WITH {B}, v AS (SELECT unit_id, var_pop(value) AS sv, avg((disc / 2) ** 2) AS nv, stddev_pop(value) AS sd, avg(disc) / 2 AS nsd FROM b GROUP BY 1),
x AS (SELECT unit_id, (sv - nv) / nv AS var_snr, sd / nsd AS sd_over_noise FROM v) SELECT {sel('unit_id:i var_snr:r sd_over_noise:r')} FROM x""")
def _(spark, sf):
    noise = F.avg(F.pow(F.col("disc") / 2, 2))
    return shipped(spark, sf).groupBy("unit_id").agg(((F.var_pop("value") - noise) / noise).alias("var_snr"),
                                                     (F.stddev_pop("value") / (F.avg("disc") / 2)).alias("sd_over_noise"))


@query("A46_class_statistics", f"""WITH d AS (SELECT c_mktsegment AS class, abs(c_acctbal) AS area, c_acctbal AS v, c_acctbal > 5000 AS hit FROM customer WHERE c_acctbal > -500),
x AS (SELECT class, count(*) AS n, avg(CAST(hit AS DOUBLE)) AS share, sum(CASE WHEN hit THEN area ELSE 0 END) / sum(area) AS area_share, median(v) AS median_v FROM d GROUP BY 1)
SELECT {sel('class:s n:i share:r area_share:r median_v:r')} FROM x""")
def _(spark, sf):
    d = table(spark, sf, "customer").where("c_acctbal > -500").select(
        F.col("c_mktsegment").alias("class"), F.abs("c_acctbal").alias("area"), F.col("c_acctbal").alias("v"), (F.col("c_acctbal") > 5000).alias("hit"))
    base = d.groupBy("class").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("share"),
                                  (F.sum(F.when(F.col("hit"), F.col("area")).otherwise(0.0)) / F.sum("area")).alias("area_share"))
    med = order.quantiles(d, "v", [0.5], ["class"]).select("class", F.col("quantile").alias("median_v"))
    return base.join(med, "class")


@query("A47_annual_total_and_cv", f"""WITH {B}, y AS (SELECT unit_id, year(month) AS y, sum(qty) AS s FROM b GROUP BY 1, 2),
x AS (SELECT unit_id, avg(s) AS mean_annual, stddev_samp(s) / avg(s) AS cv FROM y GROUP BY 1), z AS (SELECT unit_id, avg(qty) * 12 AS monthly_x12 FROM b GROUP BY 1)
SELECT {sel('unit_id:i mean_annual:r cv:r monthly_x12:r')} FROM x JOIN z USING (unit_id)""")
def _(spark, sf):
    years = shipped(spark, sf).groupBy("unit_id", F.year("month").alias("y")).agg(F.sum("qty").alias("s"), F.count("qty").alias("c"))
    return years.groupBy("unit_id").agg(F.avg("s").alias("mean_annual"), (F.stddev_samp("s") / F.avg("s")).alias("cv"),
                                        (F.sum("s") / F.sum("c") * 12).alias("monthly_x12"))


@query("A48_epoch_level_drawdown", f"""WITH {A}, x AS (SELECT unit_id, avg(CASE WHEN month BETWEEN DATE '1995-01-01' AND DATE '1996-12-01' THEN value END) AS early,
avg(CASE WHEN month BETWEEN DATE '2000-01-01' AND DATE '2001-08-01' THEN value END) AS late FROM a GROUP BY 1), z AS (SELECT *, late - early AS drawdown FROM x)
SELECT {sel('unit_id:i early:r late:r drawdown:r')} FROM z""")
def _(spark, sf):
    x = totals(spark, sf).groupBy("unit_id").agg(reduce.window_mean(F.col("value"), F.col("month"), "1995-01-01", "1996-12-01").alias("early"),
                                                 reduce.window_mean(F.col("value"), F.col("month"), "2000-01-01", "2001-08-01").alias("late"))
    return x.withColumn("drawdown", F.col("late") - F.col("early"))


@query("A49_baseline_and_id_checks", f"""WITH {A}, d AS (SELECT unit_id, month, value - avg(CASE WHEN month < DATE '1998-01-01' THEN value END) OVER (PARTITION BY unit_id) AS v FROM a),
m AS (SELECT unit_id, avg(CASE WHEN month < DATE '1998-01-01' THEN v END) AS bm FROM d GROUP BY 1),
x AS (SELECT max(abs(bm)) AS worst_baseline, max(unit_id) - min(unit_id) + 1 = count(DISTINCT unit_id) AS contiguous, count(*) AS units FROM m)
SELECT {sel('worst_baseline:r contiguous:i units:i')} FROM x""")
def _(spark, sf):
    d = timeops.rereference(totals(spark, sf), K, "month", "value", "1900-01-01", "1997-12-31", "v")
    m = d.groupBy("unit_id").agg(F.avg(F.when(F.col("month") < F.lit("1998-01-01").cast("date"), F.col("v"))).alias("bm"))
    return m.agg(F.max(F.abs("bm")).alias("worst_baseline"),
                 (F.max("unit_id") - F.min("unit_id") + 1 == F.countDistinct("unit_id")).alias("contiguous"), F.count("*").alias("units"))


@query("A50_always_complete_members", f"""WITH {B}, {U}, j AS (SELECT parent_id, unit_id, month, CASE WHEN NOT (unit_id % 7 = 3 AND month = DATE '1999-05-01') THEN value END AS v, area_km2 AS w FROM b JOIN u USING (unit_id)),
nm AS (SELECT count(DISTINCT month) AS n FROM j), ok AS (SELECT unit_id FROM j GROUP BY 1 HAVING count(v) = (SELECT n FROM nm)),
x AS (SELECT parent_id, month, sum(v * w) / sum(w) AS v, count(DISTINCT unit_id) AS members FROM j WHERE unit_id IN (SELECT unit_id FROM ok) GROUP BY 1, 2)
SELECT {sel('parent_id:i month:m v:r members:i')} FROM x""")
def _(spark, sf):
    j = shipped(spark, sf).join(units(spark, sf).select("unit_id", "parent_id", F.col("area_km2").alias("w")), "unit_id")
    gone = (F.col("unit_id") % 7 == 3) & (F.col("month") == F.lit("1999-05-01").cast("date"))
    j = j.select("parent_id", "unit_id", "month", F.when(~gone, F.col("value")).alias("v"), "w")
    return reduce.always_complete_mean(j, ["parent_id"], "unit_id", "month", "v", "w")


@query("A51_box_mean_modes", f"""WITH {P}, {U}, j AS (SELECT u.unit_id, v, w, CASE WHEN point_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS land FROM p JOIN u ON p.lat >= lat_min AND p.lat < lat_max
AND CASE WHEN lon_min < lon_max THEN p.lon >= lon_min AND p.lon < lon_max ELSE p.lon >= lon_min OR p.lon < lon_max END),
x AS (SELECT unit_id, avg(v) AS plain, sum(v * w) / sum(w) AS coslat, sum(v * w * land) / sum(w * land) AS coslat_land, count(*) AS cells FROM j GROUP BY 1)
SELECT {sel('unit_id:i plain:r coslat:r coslat_land:r cells:i')} FROM x""")
def _(spark, sf):
    j = overlay.box_pairs(points(spark, sf), units(spark, sf), "unit_id").withColumn(
        "land", F.when(F.col("point_id") % 3 == 0, 0.5).otherwise(1.0))
    return j.groupBy("unit_id").agg(F.avg("v").alias("plain"), reduce.weighted_mean(F.col("v"), F.col("w")).alias("coslat"),
                                    reduce.weighted_mean(F.col("v"), F.col("w") * F.col("land")).alias("coslat_land"), F.count("*").alias("cells"))


@query("A52_climatology_peak", f"""WITH {B}, c AS (SELECT unit_id, month(month) AS moy, avg(qty) AS m FROM b GROUP BY 1, 2),
x AS (SELECT unit_id, arg_max(moy, (m, moy)) AS peak_month, max(m) AS peak, arg_min(moy, (m, moy)) AS low_month FROM c GROUP BY 1) SELECT {sel('unit_id:i peak_month:i peak:r low_month:i')} FROM x""")
def _(spark, sf):
    c = shipped(spark, sf).groupBy("unit_id", F.month("month").alias("moy")).agg(F.avg("qty").alias("m"))
    return c.groupBy("unit_id").agg(F.max_by("moy", F.struct("m", "moy")).alias("peak_month"), F.max("m").alias("peak"), F.min_by("moy", F.struct("m", "moy")).alias("low_month"))


@query("A53_neighbour_cell_comparison", f"""WITH cell AS (SELECT c_custkey // 40 AS i, c_custkey % 40 AS j, CAST(c_custkey % 4 AS BIGINT) AS class, CAST(year(o_orderdate) AS BIGINT) AS t, round(sum(o_totalprice) / 1e6, 1) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
pr AS (SELECT 'east' AS side, a.i, a.j, a.class AS c1, b.class AS c2, abs(a.v - b.v) AS d FROM cell a JOIN cell b ON a.i = b.i AND a.j + 1 = b.j AND a.t = b.t
UNION ALL SELECT 'north', a.i, a.j, a.class, b.class, abs(a.v - b.v) FROM cell a JOIN cell b ON a.i + 1 = b.i AND a.j = b.j AND a.t = b.t),
m AS (SELECT side, median(d) AS median_diff FROM pr GROUP BY 1), g AS (SELECT side, i, j, max(d) AS md, max(CASE WHEN c1 <> c2 THEN 1 ELSE 0 END) AS mixed FROM pr GROUP BY 1, 2, 3),
x AS (SELECT side, count(*) AS pairs, avg(CASE WHEN md = 0 THEN 1.0 ELSE 0.0 END) AS identical_share, sum(mixed) AS mixed_pairs FROM g GROUP BY 1)
SELECT {sel('side:s median_diff:r pairs:i identical_share:r mixed_pairs:i')} FROM m JOIN x USING (side)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cell = (o.groupBy((F.floor(F.col("o_custkey") / 40)).alias("i"), (F.col("o_custkey") % 40).alias("j"), (F.col("o_custkey") % 4).alias("class"),
                      F.year("o_orderdate").alias("t")).agg(F.round(F.sum("o_totalprice") / 1e6, 1).alias("v")))
    steps = F.array(F.struct(F.lit("east").alias("side"), F.lit(0).alias("di"), F.lit(1).alias("dj")),
                    F.struct(F.lit("north").alias("side"), F.lit(1).alias("di"), F.lit(0).alias("dj")))
    left = cell.withColumn("s", F.explode(steps)).select(
        F.col("s.side").alias("side"), F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("class").alias("c1"), "t", F.col("v").alias("v1"),
        (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"))
    pr = left.join(cell, ["i", "j", "t"]).withColumn("d", F.abs(F.col("v1") - F.col("v")))
    med = order.quantiles(pr, "d", [0.5], ["side"]).select("side", F.col("quantile").alias("median_diff"))
    per = pr.groupBy("side", "i0", "j0").agg(F.max("d").alias("md"), F.max((F.col("c1") != F.col("class")).cast("int")).alias("mixed"))
    return per.groupBy("side").agg(F.count("*").alias("pairs"), F.avg((F.col("md") == 0).cast("double")).alias("identical_share"),
                                   F.sum("mixed").alias("mixed_pairs")).join(med, "side")


@query("A54_above_uncertainty_floor", f"""WITH {A}, {U}, x AS (SELECT parent_id, count(CASE WHEN abs(value - 150) > 40 THEN 1 END) AS above, count(CASE WHEN abs(value - 150) > 40 AND location = 80 THEN 1 END) AS above_inside, count(*) AS n
FROM a JOIN u USING (unit_id) GROUP BY 1) SELECT {sel('parent_id:i above:i above_inside:i n:i')} FROM x""")
def _(spark, sf):
    j = totals(spark, sf).join(units(spark, sf).select("unit_id", "parent_id", "location"), "unit_id")
    above = F.abs(F.col("value") - 150) > 40
    return j.groupBy("parent_id").agg(F.count_if(above).alias("above"), F.count_if(above & (F.col("location") == 80)).alias("above_inside"), F.count("*").alias("n"))
