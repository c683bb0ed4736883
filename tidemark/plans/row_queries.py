"""Row filters P, sort and limit T, set operations U, scalar functions F."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, geo, stats, text
from tidemark.functions import units as conv
from tidemark.operators import filters, flags, order, timeops
from tidemark.plans.flag_metrics import METRIC, metrics
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import (A, AB, B, G, P, U, gappy_totals, great_circle_sql, haversine_sql, points, products, shipped,
                                  t_p_sql, table, totals, units)

K = ["unit_id"]


# --- projections, filters, predicates ---------------------------------------------

@query("P01_rename_prefix_tag", "SELECT 'c:' || c_name || '|' || c_mktsegment AS site, c_acctbal AS level, 'customer' AS source FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(text.site_key("c", F.col("c_name"), F.col("c_mktsegment")).alias("site"), F.col("c_acctbal").alias("level"),
                    F.lit("customer").alias("source"))


@query("P02_surface_filters", f"""WITH {P}, x AS (SELECT point_id, point_id % 4 <> 0 AS not_ocean, point_id % 4 > 1 AS land FROM p) SELECT {sel('point_id:i not_ocean:i land:i')} FROM x""")
def _(spark, sf):
    code = F.when(F.col("point_id") % 4 == 0, 90.0).when(F.col("point_id") % 4 == 1, 1.0).otherwise(80.0)
    return points(spark, sf).withColumn("location", code).select(
        "point_id", filters.not_ocean(F.col("location")).alias("not_ocean"), filters.land_only(F.col("location")).alias("land"))


@query("P03_bbox_with_pad", f"""WITH {P} SELECT point_id FROM p WHERE lat BETWEEN -11 AND 31 AND lon BETWEEN 19 AND 91""")
def _(spark, sf):
    return points(spark, sf).where(filters.in_bbox(F.col("lat"), F.col("lon"), (-10, 30), (20, 90), 1.0)).select("point_id")


@query("P04_month_window", f"""WITH {A} SELECT {sel('unit_id:i month:m')} FROM a WHERE month BETWEEN DATE '1996-03-01' AND DATE '1997-02-01'""")
def _(spark, sf):
    return totals(spark, sf).where(filters.between_months(F.col("month"), "1996-03-01", "1997-02-01")).select("unit_id", "month")


@query("P05_epoch_split", f"""WITH {A}, x AS (SELECT unit_id, CASE WHEN year(month) < 1998 THEN 'before' ELSE 'from' END AS era, avg(value) AS mean, count(*) AS n FROM a GROUP BY 1, 2)
SELECT {sel('unit_id:i era:s mean:r n:i')} FROM x""")
def _(spark, sf):
    a = totals(spark, sf)
    early = a.where(F.year("month") < 1998).withColumn("era", F.lit("before"))
    late = a.where(F.year("month") >= 1998).withColumn("era", F.lit("from"))
    return early.unionByName(late).groupBy("unit_id", "era").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("P06_sentinel_to_null", f"""WITH x AS (SELECT c_custkey, CASE WHEN NOT (c_acctbal < 0) THEN c_acctbal END AS v FROM customer) SELECT {sel('c_custkey:i v:r')} FROM x""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", filters.sentinel_to_null(F.col("c_acctbal"), -9999.0, 0.0).alias("v"))


@query("P07_set_membership", f"""SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def _(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return (table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .join(rich, "o_custkey", "left_semi").select("o_orderkey"))


# Percentages and a status that is sometimes unknown, from the part table.
FIELD = """f AS (SELECT p_partkey, p_size * 2.0 AS pct_irr, CAST(p_partkey % 100 AS DOUBLE) AS pct_wet, p_partkey % 3 AS src,
CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 2 END AS status, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 2 = 0 END AS irr, p_type = 'ECONOMY' AS is_crop, p_brand FROM part)"""


def fields(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k, (F.col("p_size") * 2.0).alias("pct_irr"), (k % 100).cast("double").alias("pct_wet"), (k % 3).alias("src"),
        F.when(k % 7 != 0, k % 2).alias("status"), F.when(k % 5 != 0, k % 2 == 0).alias("irr"), (F.col("p_type") == "ECONOMY").alias("is_crop"), "p_brand")


@query("P08_three_valued_status", f"""WITH {FIELD}, x AS (SELECT (pct_irr > 40) OR (pct_wet > 40 AND src > 0 AND status <> 1) AS irrigated, count(*) AS n FROM f GROUP BY 1)
SELECT CASE WHEN irrigated IS NULL THEN 'unknown' WHEN irrigated THEN 'yes' ELSE 'no' END AS irrigated, CAST(n AS BIGINT) AS n FROM x""")
def _(spark, sf):
    f = fields(spark, sf).withColumn("i", filters.irrigated(F.col("pct_irr"), F.col("pct_wet"), F.col("src"), F.col("status")))
    label = F.when(F.col("i").isNull(), "unknown").when(F.col("i"), "yes").otherwise("no")
    return f.groupBy(label.alias("irrigated")).agg(F.count("*").alias("n"))


@query("P09_unknown_true_inside_class", f"""WITH {FIELD}, x AS (SELECT p_partkey, coalesce(irr, true) AND is_crop AS irrigated FROM f) SELECT {sel('p_partkey:i irrigated:i')} FROM x""")
def _(spark, sf):
    return fields(spark, sf).select("p_partkey", filters.irrigated_or_unknown(F.col("irr"), F.col("is_crop")).alias("irrigated"))


@query("P10_drop_any_all_null", f"""WITH {FIELD}, x AS (SELECT (SELECT count(*) FROM f WHERE status IS NOT NULL AND irr IS NOT NULL) AS any_null, (SELECT count(*) FROM f WHERE status IS NOT NULL OR irr IS NOT NULL) AS all_null)
SELECT {sel('any_null:i all_null:i')} FROM x""")
def _(spark, sf):
    f = fields(spark, sf)
    both = f.na.drop("any", subset=["status", "irr"]).agg(F.count("*").alias("any_null"))
    return both.withColumn("all_null", f.na.drop("all", subset=["status", "irr"]).agg(F.count("*")).scalar())


@query("P11_admission_mask", f"""WITH {AB}, {U}, m AS (SELECT *, CASE WHEN NOT (unit_id % 6 = 1 AND month = DATE '1996-05-01') THEN b END AS b2 FROM ab), nm AS (SELECT count(DISTINCT month) AS n FROM m),
x AS (SELECT unit_id, count(a) AS n_months FROM m GROUP BY 1 HAVING count(a) = (SELECT n FROM nm) AND count(b2) = (SELECT n FROM nm) AND count(a) >= 60)
SELECT {sel('unit_id:i n_months:i')} FROM x WHERE unit_id IN (SELECT unit_id FROM u WHERE lon_span / 80 >= 0.8)""")
def _(spark, sf):
    gone = (F.col("unit_id") % 6 == 1) & (F.col("month") == F.lit("1996-05-01").cast("date"))
    m = products(spark, sf).withColumn("b", F.when(~gone, F.col("b")))
    cover = units(spark, sf).select("unit_id", (F.col("lon_span") / 80).alias("coverage"))
    return filters.complete_units(m, "unit_id", ["a", "b"], cover, 0.8, 60)


@query("P12_minimum_history", f"""WITH x AS (SELECT o_custkey, count(o_totalprice) AS n FROM orders GROUP BY 1 HAVING count(o_totalprice) >= 10) SELECT {sel('o_custkey:i n:i')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    return filters.min_history(o, "o_custkey", "o_totalprice", 10).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("P13_fill_constants_and_zero", f"""WITH {FIELD}, has AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49),
x AS (SELECT p_partkey, coalesce(status, -1) AS status, CASE WHEN l_partkey IS NULL THEN 0.0 ELSE CASE WHEN src > 0 THEN pct_wet END END AS v FROM f LEFT JOIN has ON l_partkey = p_partkey)
SELECT {sel('p_partkey:i status:i v:r')} FROM x""")
def _(spark, sf):
    f = fields(spark, sf).withColumn("v", F.when(F.col("src") > 0, F.col("pct_wet"))).na.fill({"status": -1})
    has = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return filters.zero_without_contributors(f, "p_partkey", "v", has).select("p_partkey", "status", "v")


@query("P14_climatology_fill", f"""WITH {B}, d AS (SELECT unit_id, month, CASE WHEN month(month) <> 5 OR year(month) % 2 = 0 THEN qty END AS qty FROM b),
x AS (SELECT unit_id, month, qty IS NULL AS filled, coalesce(qty, avg(qty) OVER (PARTITION BY unit_id, month(month))) AS qty FROM d) SELECT {sel('unit_id:i month:m filled:i qty:r')} FROM x""")
def _(spark, sf):
    d = shipped(spark, sf).select("unit_id", "month", F.when((F.month("month") != 5) | (F.year("month") % 2 == 0), F.col("qty")).alias("qty"))
    return timeops.climatology_fill(d, K, "month", "qty")


@query("P15_paired_mask", f"""WITH {A}, {B}, x AS (SELECT b.unit_id, b.month, CASE WHEN a.value IS NOT NULL THEN b.value END AS v FROM b LEFT JOIN a ON a.unit_id = b.unit_id AND a.month = b.month) SELECT {sel('unit_id:i month:m v:r')} FROM x""")
def _(spark, sf):
    a = totals(spark, sf).withColumnRenamed("value", "a")
    return shipped(spark, sf).join(a, ["unit_id", "month"], "left").select("unit_id", "month", filters.paired(F.col("value"), F.col("a")).alias("v"))


@query("P16_clip", f"""WITH {FIELD}, x AS (SELECT p_partkey, CASE WHEN status IS NOT NULL THEN greatest(0, least(1, pct_irr / 50 - 0.5)) END AS v FROM f) SELECT {sel('p_partkey:i v:r')} FROM x""")
def _(spark, sf):
    v = F.when(F.col("status").isNotNull(), F.col("pct_irr") / 50 - 0.5)
    return fields(spark, sf).select("p_partkey", conv.clip(v, 0.0, 1.0).alias("v"))


@query("P17_withhold_low_coverage", f"""WITH {FIELD}, x AS (SELECT p_partkey, CASE WHEN NOT coalesce(pct_wet < 50 OR status = 1, false) THEN pct_irr END AS pct_irr FROM f) SELECT {sel('p_partkey:i pct_irr:r')} FROM x""")
def _(spark, sf):
    low = (F.col("pct_wet") < 50) | (F.col("status") == 1)
    return filters.withhold(fields(spark, sf), low, ["pct_irr"]).select("p_partkey", "pct_irr")


@query("P18_candidates", f"""WITH {A}, {U}, t AS (SELECT unit_id, regr_slope(value, epoch(CAST(month AS TIMESTAMP)) / 31557600.0) AS rate, avg(value) AS mean FROM a GROUP BY 1),
x AS (SELECT unit_id, rate * area_km2 * 1e-6 AS km3_yr, rate < 0 AND location = 80 AS is_candidate FROM t JOIN u USING (unit_id)) SELECT {sel('unit_id:i km3_yr:r is_candidate:i')} FROM x""")
def _(spark, sf):
    t = totals(spark, sf).groupBy("unit_id").agg(F.regr_slope(F.col("value"), dates.epoch_years(F.col("month"))).alias("rate"))
    j = t.join(units(spark, sf), "unit_id")
    return j.select("unit_id", conv.mm_yr_to_km3_yr(F.col("rate"), F.col("area_km2")).alias("km3_yr"),
                    ((F.col("rate") < 0) & filters.land_only(F.col("location"))).alias("is_candidate"))


@query("P19_coerce_numbers", f"""WITH x AS (SELECT o_orderkey, TRY_CAST(left(o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END) AS DOUBLE) AS v FROM orders) SELECT {sel('o_orderkey:i v:r')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", F.lit(1), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3)).alias("t"))
    return o.select("o_orderkey", F.expr("try_cast(t as double)").alias("v"))


@query("P20_code_to_label", "SELECT c_custkey, n_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, sf):
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return filters.decode(table(spark, sf, "customer"), "c_nationkey", labels).select("c_custkey", "label")


@query("P21_region_from_id", f"""WITH x AS (SELECT o_orderkey // 1000 AS region, count(*) AS n FROM orders GROUP BY 1) SELECT {sel('region:i n:i')} FROM x""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(filters.region_of_id(F.col("o_orderkey"), 1000.0).alias("region")).agg(F.count("*").alias("n"))


@query("P22_metrics", f"""WITH {METRIC} SELECT {sel('unit_id:i area:r n_cells_a:r n_cells_b:r frac_dominant:r var_ratio_a:r var_ratio_b:r pred_r2_a:r pred_r2_b:r r_ab:r rank_shift:r')}, round(trend_diff_ratio, 2) + 0.0 AS trend_diff_ratio FROM m""")
def _(spark, sf):
    # A slope of the parent near zero makes the ratio large, so fewer places of it are sure.
    return metrics(spark, sf).withColumn("trend_diff_ratio", F.round("trend_diff_ratio", 2))


@query("P22_flag_set", f"""WITH {METRIC}, f AS (SELECT unit_id,
coalesce(least(n_cells_a, n_cells_b) < 2, false) OR coalesce(frac_dominant > 0.95, false) AS geometry, coalesce(least(var_ratio_a, var_ratio_b) < 0.05, false) AS no_departure,
coalesce(greatest(pred_r2_a, pred_r2_b) > 0.8, false) AS predictor_derived, coalesce(r_ab < 0.5, false) OR coalesce(trend_diff_ratio > 1, false) AS disagreement,
coalesce(rank_shift > 20, false) AS rank_unstable, coalesce(n_cells_b < 2, false) OR coalesce(frac_dominant > 0.95, false) OR coalesce(var_ratio_b < 0.05, false) OR coalesce(pred_r2_b > 0.8, false) AS any_own_b FROM m),
x AS (SELECT *, geometry OR no_departure OR predictor_derived OR disagreement OR rank_unstable AS "any" FROM f)
SELECT {sel('unit_id:i geometry:i no_departure:i predictor_derived:i disagreement:i rank_unstable:i any_own_b:i')}, CAST("any" AS BIGINT) AS "any" FROM x""")
def _(spark, sf):
    return flags.with_flags(metrics(spark, sf)).select("unit_id", *flags.FLAGS, "any_own_b", "any")


@query("P23_legend_check", f"""WITH {P}, {U}, x AS (SELECT p.nation, count(*) AS n, avg(CASE WHEN p.lon BETWEEN u.lon_min - 90 AND u.lon_min + 200 AND p.lat BETWEEN -80 AND 85 THEN 0.0 ELSE 1.0 END) AS outside FROM p JOIN u ON u.unit_id = p.nation GROUP BY 1)
SELECT {sel('nation:i n:i outside:r')} FROM x""")
def _(spark, sf):
    boxes = units(spark, sf).select(F.col("unit_id").alias("nation"), (F.col("lon_min") - 90).alias("lon_min"), (F.col("lon_min") + 200).alias("lon_max"),
                                    F.lit(-80.0).alias("lat_min"), F.lit(85.0).alias("lat_max"))
    shares = filters.outside_share(points(spark, sf), boxes, "nation")
    return filters.checked(shares, F.col("outside") <= 0.9, "a label is outside its box too often")


@query("P24_resolved_and_ice_free_views", f"""WITH {METRIC}, x AS (SELECT unit_id FROM m WHERE pred_r2_a < 0.4 AND frac_dominant <= 0.5) SELECT {sel('unit_id:i')} FROM x""")
def _(spark, sf):
    return metrics(spark, sf).where((F.col("pred_r2_a") < 0.4) & (F.col("frac_dominant") <= 0.5)).select("unit_id")


@query("P25_box_reaches_past_region", f"""WITH {P}, x AS (SELECT point_id, lat - 5 < -60 OR lat + 5 > 60 OR lon - 5 < -150 OR lon + 5 > 150 AS crosses FROM p) SELECT {sel('point_id:i crosses:i')} FROM x""")
def _(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, sf).select("point_id", filters.reaches_past(lat - 5, lat + 5, lon - 5, lon + 5, (-60, 60), (-150, 150)).alias("crosses"))


# --- sort, limit, sampling ---------------------------------------------------------

@query("T01_sort", f"""WITH {A}, x AS (SELECT unit_id, avg(value) AS mean FROM a GROUP BY 1) SELECT {sel('unit_id:i mean:r')} FROM x ORDER BY mean DESC""")
def _(spark, sf):
    return totals(spark, sf).groupBy("unit_id").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"))


@query("T02_head_after_sort", f"SELECT {sel('o_orderkey:i o_totalprice:r')} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return order.top_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("T03_largest_under_filter", f"SELECT {sel('o_orderkey:i o_totalprice:r')} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return order.top_rows(o, 8, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("T04_both_extremes", f"""WITH x AS ((SELECT c_custkey, c_acctbal, 'low' AS "end" FROM customer WHERE abs(c_acctbal) >= 100 ORDER BY c_acctbal, c_custkey LIMIT 8)
UNION ALL (SELECT c_custkey, c_acctbal, 'high' FROM customer WHERE abs(c_acctbal) >= 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 8)) SELECT {sel('c_custkey:i c_acctbal:r')}, "end" FROM x""")
def _(spark, sf):
    c = table(spark, sf, "customer").where("abs(c_acctbal) >= 100").select("c_custkey", "c_acctbal")
    return order.both_ends(c, "c_acctbal", "c_custkey", 8)


@query("T05_default_picks", f"""WITH x AS (SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) AS loss, arg_max(c_custkey, (c_acctbal, c_custkey)) AS gain, arg_min(c_custkey, (abs(c_acctbal), c_custkey)) FILTER (WHERE c_mktsegment = 'BUILDING') AS flat FROM customer)
SELECT {sel('loss:i gain:i flat:i')} FROM x""")
def _(spark, sf):
    return table(spark, sf, "customer").agg(
        F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("loss"),
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("gain"),
        F.min_by("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.struct(F.abs("c_acctbal"), "c_custkey"))).alias("flat"))


@query("T06_seeded_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('20260916' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 30")
def _(spark, sf):
    return order.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 30, "20260916")


@query("T07_top_clusters", f"""WITH x AS (SELECT p_brand, sum(p_retailprice) AS area, count(*) AS units FROM part GROUP BY 1 HAVING sum(p_retailprice) >= 1000 ORDER BY area DESC, p_brand LIMIT 12) SELECT {sel('p_brand:s area:r units:i')} FROM x""")
def _(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("area"), F.count("*").alias("units")).where("area >= 1000")
    return order.top_rows(g, 12, F.desc("area"), F.asc("p_brand"))


# --- set operations ------------------------------------------------------------------

@query("U01_concat_with_tag", f"""WITH {A}, {B}, x AS (SELECT unit_id, month, value, 'orders' AS source FROM a UNION ALL SELECT unit_id, month, value, 'items' FROM b) SELECT source, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) + 0.0 AS total FROM x GROUP BY 1""")
def _(spark, sf):
    a = totals(spark, sf).withColumn("source", F.lit("orders"))
    b = shipped(spark, sf).select("unit_id", "month", "value", F.lit("items").alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("U02_month_intersection", f"""WITH {A}, {B}, x AS (SELECT month FROM a INTERSECT SELECT month FROM b) SELECT {sel('month:m')} FROM x""")
def _(spark, sf):
    return totals(spark, sf).select("month").intersect(shipped(spark, sf).select("month"))


@query("U03_month_difference", f"""WITH {G}, {B}, x AS (SELECT month FROM b EXCEPT SELECT month FROM a) SELECT {sel('month:m')} FROM x""")
def _(spark, sf):
    return shipped(spark, sf).select("month").subtract(gappy_totals(spark, sf).select("month"))


@query("U04_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("U05_common_keys", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT p_partkey FROM part")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return c.intersect(table(spark, sf, "orders").select("o_custkey")).intersect(table(spark, sf, "part").select("p_partkey"))


# --- scalar functions ----------------------------------------------------------------------

WRAP = "CASE WHEN {x} % 360 < 0 THEN ({x} % 360 + 360) % 360 ELSE {x} % 360 END"


@query("F01_wrap_longitude", f"""WITH {P}, d AS (SELECT point_id, lon * 3 AS l FROM p), x AS (SELECT point_id, {WRAP.format(x='(l + 180)')} - 180 AS lon180, {WRAP.format(x='l')} AS lon360 FROM d)
SELECT {sel('point_id:i lon180:r lon360:r')} FROM x""")
def _(spark, sf):
    lon = F.col("lon") * 3
    return points(spark, sf).select("point_id", geo.wrap180(lon).alias("lon180"), geo.wrap360(lon).alias("lon360"))


@query("F02_box_edges", f"""WITH {P}, x AS (SELECT point_id, lat - 0.25 AS lo, lat + 0.25 AS hi FROM p) SELECT {sel('point_id:i lo:r hi:r')} FROM x""")
def _(spark, sf):
    lo, hi = geo.box_edges(F.col("lat"), F.lit(0.5))
    return points(spark, sf).select("point_id", lo.alias("lo"), hi.alias("hi"))


@query("F03_cos_lat_weight", f"""WITH {P} SELECT {sel('point_id:i w:r')} FROM p""")
def _(spark, sf):
    return points(spark, sf).select("point_id", geo.cos_lat(F.col("lat")).alias("w"))


@query("F04_cell_area", f"""WITH {P}, x AS (SELECT point_id, 6371.0088 ** 2 * radians(0.5) * (sin(radians(lat + 0.25)) - sin(radians(lat - 0.25))) AS area FROM p) SELECT {sel('point_id:i area:r')} FROM x""")
def _(spark, sf):
    return points(spark, sf).select("point_id", geo.cell_area_km2(F.col("lat"), 0.5, 0.5).alias("area"))


@query("F05_haversine", f"""WITH {P}, o AS (SELECT 25.0 AS lat, -100.0 AS lon), x AS (SELECT point_id, {haversine_sql('p', 'o')} AS km FROM p, o) SELECT {sel('point_id:i km:r')} FROM x""")
def _(spark, sf):
    return points(spark, sf).select("point_id", geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(25.0), F.lit(-100.0)).alias("km"))


@query("F06_great_circle", f"""WITH {P}, o AS (SELECT 25.0 AS lat, -100.0 AS lon), x AS (SELECT point_id, {great_circle_sql('p', 'o')} AS km FROM p, o) SELECT {sel('point_id:i km:r')} FROM x""")
def _(spark, sf):
    return points(spark, sf).select("point_id", geo.great_circle_km(F.col("lat"), F.col("lon"), F.lit(25.0), F.lit(-100.0)).alias("km"))


@query("F07_planar_distance", f"""WITH {P}, x AS (SELECT point_id, sqrt(((lat - 25) * 111) ** 2 + ((lon + 100) * 111 * cos(radians(25))) ** 2) AS km FROM p) SELECT {sel('point_id:i km:r')} FROM x""")
def _(spark, sf):
    return points(spark, sf).select("point_id", geo.planar_km(F.col("lat"), F.col("lon"), F.lit(25.0), F.lit(-100.0)).alias("km"))


def _dates_sql(exprs: str, names: str) -> str:
    return f"WITH x AS (SELECT o_orderkey, {exprs} FROM orders) SELECT {sel('o_orderkey:i ' + names)} FROM x"


@query("F08_year_doy", _dates_sql("make_date(year(o_orderdate), 1, 1) + CAST(o_orderkey % 365 AS INTEGER) AS d", "d:m"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.from_year_doy(F.year("o_orderdate"), F.col("o_orderkey") % 365 + 1).alias("d"))


@query("F09_modified_julian", _dates_sql("DATE '1858-11-17' + CAST(floor(50000 + o_orderkey * 0.25) AS INTEGER) AS d", "d:m"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.from_mjd(50000 + F.col("o_orderkey") * 0.25).alias("d"))


@query("F10_decimal_year_month", _dates_sql("make_date(CAST(floor(2000 + o_orderkey / 240.0) AS BIGINT), greatest(1, least(12, CAST(floor((o_orderkey / 240.0 + 2000 - floor(2000 + o_orderkey / 240.0)) * 12) AS BIGINT) + 1)), 1) AS d", "d:m"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.month_from_decimal_year(F.col("o_orderkey") / 240.0 + 2000).alias("d"))


@query("F11_days_since_text_epoch", _dates_sql("CASE WHEN o_orderkey % 2 = 0 THEN DATE '2002-01-01' ELSE DATE '1990-06-15' END + CAST(floor(o_orderkey * 0.5) AS INTEGER) AS d", "d:m"))
def _(spark, sf):
    k = F.col("o_orderkey")
    unit = F.when(k % 2 == 0, F.lit("days")).otherwise(F.lit("days since 1990-06-15T00:00:00"))
    return table(spark, sf, "orders").select("o_orderkey", dates.from_days_since(k * 0.5, unit).alias("d"))


@query("F12_months_since_1960", _dates_sql("CAST(DATE '1960-01-01' + to_months(CAST(floor(o_orderkey % 700 + 0.5) AS INTEGER)) AS DATE) AS d", "d:m"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.from_months_since_1960(F.col("o_orderkey") % 700 + 0.5).alias("d"))


@query("F13_ref_day", _dates_sql("DATE '2002-01-01' + CAST(o_orderkey % 8000 AS INTEGER) AS d", "d:m"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.from_ref_day(F.col("o_orderkey") % 8000 + 1).alias("d"))


@query("F14_month_truncation_label", _dates_sql("strftime(o_orderdate, '%Y-%m-01') AS label", "label:s"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.month_label(dates.month_of(F.col("o_orderdate"))).alias("label"))


@query("F15_days_in_month", _dates_sql("day(last_day(CAST(o_orderdate AS DATE))) AS n", "n:i"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.days_in_month(F.col("o_orderdate")).alias("n"))


@query("F16_decimal_years", _dates_sql("year(o_orderdate) + (dayofyear(o_orderdate) - 1.0) / dayofyear(make_date(year(o_orderdate), 12, 31)) AS leap_aware, epoch(o_orderdate) / 31557600.0 AS epoch_years", "leap_aware:r epoch_years:r"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.decimal_year(F.to_date("o_orderdate")).alias("leap_aware"), dates.epoch_years(F.col("o_orderdate")).alias("epoch_years"))


@query("F17_water_year", f"""WITH y AS (SELECT o_orderkey, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS wy FROM orders),
x AS (SELECT o_orderkey, wy, make_date(wy - 1, 11, 1) AS first_month, make_date(wy, 10, 1) AS last_month FROM y) SELECT {sel('o_orderkey:i wy:i first_month:m last_month:m')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", dates.water_year(F.to_date("o_orderdate")).alias("wy")).withColumn("_m", dates.water_year_months(F.col("wy")))
    return o.select("o_orderkey", "wy", F.element_at("_m", 1).alias("first_month"), F.element_at("_m", 12).alias("last_month"))


@query("F18_month_sequence", f"""WITH b AS (SELECT o_custkey, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS z FROM orders GROUP BY 1),
x AS (SELECT o_custkey, unnest(range(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month FROM b) SELECT {sel('o_custkey:i month:m')} FROM x""")
def _(spark, sf):
    b = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.trunc("o_orderdate", "MM")).alias("a"), F.max(F.trunc("o_orderdate", "MM")).alias("z"))
    return b.select("o_custkey", F.explode(dates.month_sequence(F.col("a"), F.col("z"))).alias("month"))


@query("F19_unit_conversions", f"""WITH d AS (SELECT p_partkey, p_retailprice / 9.973 AS v, 1000.0 + p_size AS area FROM part),
x AS (SELECT p_partkey, v * 10 AS mm, v * 1e-6 * 86400 * 30 AS rate_mm, v * 1233.48184 / (area * 1e6) * 1e3 AS af_mm, v * 1e3 * 1233.48184 / (area * 1e6) * 1e3 AS taf_mm, v * 1000 / area AS hm3_mm,
v * 0.0040468564224 AS km2, v * 304.8 AS depth_mm, v * area * 1e-6 AS km3_yr, v / 2000 * 1000 AS vol_mm, 100 * v / area AS pct FROM d)
SELECT {sel('p_partkey:i mm:r rate_mm:r af_mm:r taf_mm:r hm3_mm:r km2:r depth_mm:r km3_yr:r vol_mm:r pct:r')} FROM x""")
def _(spark, sf):
    v, area = F.col("p_retailprice") / 9.973, F.col("p_size") + 1000.0
    return table(spark, sf, "part").select(
        "p_partkey", conv.cm_to_mm(v).alias("mm"), conv.rate_to_mm_month(v * 1e-6, F.lit(30)).alias("rate_mm"), conv.acre_feet_to_mm(v, area).alias("af_mm"),
        conv.thousand_acre_feet_to_mm(v, area).alias("taf_mm"), conv.hm3_to_mm(v, area).alias("hm3_mm"), conv.acres_to_km2(v).alias("km2"),
        conv.acre_feet_per_acre_to_mm(v).alias("depth_mm"), conv.mm_yr_to_km3_yr(v, area).alias("km3_yr"), conv.volumetric_to_mm(v / 2000).alias("vol_mm"), conv.percent_of(v, area).alias("pct"))


@query("F20_harmonic_basis", _dates_sql("cos(2 * pi() * (epoch(o_orderdate) / 31557600.0)) AS c1, sin(2 * pi() * (epoch(o_orderdate) / 31557600.0)) AS s1, cos(4 * pi() * (epoch(o_orderdate) / 31557600.0)) AS c2, sin(4 * pi() * (epoch(o_orderdate) / 31557600.0)) AS s2", "c1:r s1:r c2:r s2:r"))
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in stats.harmonics(dates.epoch_years(F.col("o_orderdate"))).items()])


@query("F21_effective_n", f"""WITH d AS (SELECT p_partkey, p_size + 10 AS n, (p_partkey % 300) / 100.0 - 1.5 AS r FROM part), c AS (SELECT *, greatest(-0.99, least(0.99, r)) AS rc FROM d),
x AS (SELECT p_partkey, greatest(3, least(n, n * (1 - rc) / (1 + rc))) AS bounded, n * (1 - rc) / (1 + rc) AS unbounded FROM c) SELECT {sel('p_partkey:i bounded:r unbounded:r')} FROM x""")
def _(spark, sf):
    n, r = F.col("p_size") + 10, F.col("p_partkey") % 300 / 100.0 - 1.5
    return table(spark, sf, "part").select("p_partkey", stats.n_effective_bounded(n, r).alias("bounded"), stats.n_effective(n, stats.clamp_r(r)).alias("unbounded"))


@query("F22_student_t_p", f"""WITH d AS (SELECT p_partkey, (p_partkey % 800) / 100.0 - 4 AS t, 2.5 + p_size * 1.7 AS df FROM part), x AS (SELECT p_partkey, t, df, {t_p_sql('t', 'df')} AS p FROM d)
SELECT {sel('p_partkey:i t:r df:r p:r')} FROM x""")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 800 / 100.0 - 4).alias("t"), (F.col("p_size") * 1.7 + 2.5).alias("df"))
    return d.withColumn("p", stats.t_pvalue("t", "df"))


@query("F23_binomial_p", f"""WITH d AS (SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal > 4500 THEN 1 END) AS k FROM customer GROUP BY 1),
x AS (SELECT c_nationkey, k, n, CASE WHEN 2 * least(k, n - k) = n THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))) END AS p FROM d)
SELECT {sel('c_nationkey:i k:i n:i p:r')} FROM x""")
def _(spark, sf):
    d = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    return d.withColumn("p", stats.binomial_pvalue("k", "n"))


@query("F24_harmonic_sum", f"""WITH x AS (SELECT p_partkey, ln(p_partkey + 1) + 0.5772156649 + 1.0 / (2 * (p_partkey + 1)) AS c FROM part) SELECT {sel('p_partkey:i c:r')} FROM x""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", stats.harmonic_sum(F.col("p_partkey") + 1).alias("c"))


@query("F25_string_keys", f"""WITH {P} SELECT point_id, printf('%.2f', lat + 0.001) || '_' || printf('%.2f', lon + 0.001) AS key, 'S:' || segment || '|' || CAST(nation AS VARCHAR) AS site, split_part('S:' || segment || '|' || CAST(nation AS VARCHAR), '|', 2) AS code,
trim(replace(segment || ' *', '*', '')) AS clean FROM p""")
def _(spark, sf):
    p = points(spark, sf)
    site = text.site_key("S", F.col("segment"), F.col("nation").cast("string"))
    return p.select("point_id", text.position_key(F.col("lat") + 0.001, F.col("lon") + 0.001).alias("key"), site.alias("site"),
                    F.element_at(F.split(site, r"\|"), 2).alias("code"), text.strip_marks(F.concat("segment", F.lit(" *"))).alias("clean"))


@query("F26_regex_on_names", f"""WITH d AS (SELECT o_orderkey, 'balance WY ' || CAST(year(o_orderdate) AS VARCHAR) || '.zip' AS a, 'PNE_' || CAST(year(o_orderdate) AS VARCHAR) AS b FROM orders),
x AS (SELECT o_orderkey, CAST(regexp_extract(a, 'WY\\s*(\\d{{4}})', 1) AS BIGINT) AS wy, CAST(regexp_extract(b, '(\\d{{4}})$', 1) AS BIGINT) AS yr FROM d) SELECT {sel('o_orderkey:i wy:i yr:i')} FROM x""")
def _(spark, sf):
    y = F.year("o_orderdate").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", text.water_year_in_name(F.concat(F.lit("balance WY "), y, F.lit(".zip"))).alias("wy"),
                                             text.year_suffix(F.concat(F.lit("PNE_"), y)).alias("yr"))


@query("F27_json_parse_render", f"""WITH x AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT event_id, k, '{{"id":' || event_id || ',"k":' || k || '}}' AS rendered FROM x""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")
    return e.withColumn("rendered", text.as_json(F.struct(F.col("event_id").alias("id"), "k")))


@query("F28_rounding_and_logs", f"""WITH x AS (SELECT p_partkey, round(p_retailprice, 1) AS r1, log10(p_retailprice) AS lg, sqrt(p_retailprice) AS sq, ln(p_retailprice) AS ln1, exp(-p_size / 10.0) AS ex, floor(p_retailprice / 7) AS fl FROM part)
SELECT {sel('p_partkey:i r1:r lg:r sq:r ln1:r ex:r fl:i')} FROM x""")
def _(spark, sf):
    v = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.round(v, 1).alias("r1"), F.log10(v).alias("lg"), F.sqrt(v).alias("sq"), F.ln(v).alias("ln1"),
                                           F.exp(-F.col("p_size") / 10.0).alias("ex"), F.floor(v / 7).alias("fl"))


@query("F29_safe_division", f"""WITH x AS (SELECT c_custkey, 100.0 / CASE WHEN c_acctbal > 0 THEN c_acctbal END AS q FROM customer) SELECT {sel('c_custkey:i q:r')} FROM x""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", conv.safe_div(F.lit(100.0), F.col("c_acctbal")).alias("q"))


@query("F30_series_fingerprint", """WITH d AS (SELECT c_custkey, [] || list((k, s) ORDER BY k) AS l FROM (SELECT c_custkey, o_orderpriority AS k, min(o_orderstatus) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT c_custkey, sha256('[' || array_to_string(list_transform(l, lambda t: '{"k":"' || t[1] || '","s":"' || t[2] || '"}'), ',') || ']') AS fp FROM d) SELECT c_custkey, fp FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("k")).agg(F.min("o_orderstatus").alias("s"))
    return o.groupBy("c_custkey").agg(text.series_fingerprint(F.collect_list(F.struct("k", "s"))).alias("fp"))


