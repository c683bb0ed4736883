"""Time-axis operators W01-W18 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.dates import water_year
from tidemark.functions.stats import harmonic_sum
from tidemark.operators import order, timeops
from tidemark.operators.joins import on_common_months
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import B, G, gappy_totals, shipped, table

K = ["unit_id"]


@query("W01_deseasonalise", f"""WITH {G}, d AS (SELECT *, value - avg(value) OVER (PARTITION BY unit_id, month(month)) AS des FROM a)
SELECT {sel('unit_id:i month:m des:r')} FROM d""")
def _(spark, sf):
    return timeops.deseasonalise(gappy_totals(spark, sf), K, "month", "value", "des").select("unit_id", "month", "des")


@query("W02_recentre_common_months", f"""WITH {G}, {B}, c AS (SELECT month FROM a INTERSECT SELECT month FROM b),
x AS (SELECT unit_id, month, value FROM a WHERE month IN (SELECT month FROM c)),
d AS (SELECT *, value - avg(value) OVER (PARTITION BY unit_id) AS centred FROM x)
SELECT {sel('unit_id:i month:m centred:r')} FROM d""")
def _(spark, sf):
    a, _b = on_common_months([gappy_totals(spark, sf), shipped(spark, sf)])
    return timeops.recentre(a, K, "value", "centred").select("unit_id", "month", "centred")


@query("W03_rereference_baseline", f"""WITH {G}, d AS (SELECT *, value - avg(CASE WHEN month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01'
THEN value END) OVER (PARTITION BY unit_id) AS anomaly FROM a) SELECT {sel('unit_id:i month:m anomaly:r')} FROM d""")
def _(spark, sf):
    return timeops.rereference(gappy_totals(spark, sf), K, "month", "value", "1996-01-01", "1997-12-01", "anomaly").select(
        "unit_id", "month", "anomaly")


@query("W04_zscore", f"""WITH {G}, d AS (SELECT unit_id, month, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z
FROM a WINDOW w AS (PARTITION BY unit_id)) SELECT {sel('unit_id:i month:m z:r')} FROM d""")
def _(spark, sf):
    return timeops.zscore(gappy_totals(spark, sf), K, "value", "z").select("unit_id", "month", "z")


@query("W05_accumulated_anomaly", f"""WITH {B}, d AS (SELECT *, qty - avg(qty) OVER (PARTITION BY unit_id) AS an,
qty - avg(qty) OVER (PARTITION BY unit_id, month(month)) AS ac FROM b),
r AS (SELECT *, sum(an) OVER w AS c1, sum(ac) OVER w AS c2 FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY month
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT unit_id, month, c1 - avg(c1) OVER (PARTITION BY unit_id) AS plain,
c2 - avg(c2) OVER (PARTITION BY unit_id) AS climatology FROM r) SELECT {sel('unit_id:i month:m plain:r climatology:r')} FROM x""")
def _(spark, sf):
    b = shipped(spark, sf)
    one = timeops.accumulated_anomaly(b, K, "month", "qty", "plain")
    return timeops.accumulated_anomaly(one, K, "month", "qty", "climatology", climatology=True, nulls_as_zero=True).select(
        "unit_id", "month", "plain", "climatology")


@query("W06_lags", f"""WITH {G}, d AS (SELECT unit_id, month, lag(value, 1) OVER w AS lag1, lag(value, 3) OVER w AS lag3 FROM a
WINDOW w AS (PARTITION BY unit_id ORDER BY month)) SELECT {sel('unit_id:i month:m lag1:r lag3:r')} FROM d""")
def _(spark, sf):
    return timeops.lagged(gappy_totals(spark, sf), K, "month", "value", [1, 3], "lag").select("unit_id", "month", "lag1", "lag3")


@query("W07_average_and_percentile_rank", f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity,
rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank, count(*) OVER () AS n FROM lineitem),
x AS (SELECT l_quantity, min(rank) AS rank, min(100.0 * (rank - 1) / (n - 1)) AS pct_rank, count(*) AS n FROM d GROUP BY 1)
SELECT {sel('l_quantity:r rank:r pct_rank:r n:i')} FROM x""")
def _(spark, sf):
    ranked = order.average_rank(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")
    return ranked.groupBy("l_quantity").agg(F.min("rank").alias("rank"), F.min("pct_rank").alias("pct_rank"), F.count("*").alias("n"))


@query("W08_year_on_year", f"""WITH {G}, y AS (SELECT unit_id, year(month) AS year, avg(value) AS m FROM a GROUP BY 1, 2),
d AS (SELECT unit_id, year, m - lag(m) OVER w AS delta, year - lag(year) OVER w AS gap FROM y WINDOW w AS (PARTITION BY unit_id ORDER BY year)),
x AS (SELECT unit_id, year, CASE WHEN gap = 1 THEN delta END AS delta FROM d) SELECT {sel('unit_id:i year:i delta:r')} FROM x""")
def _(spark, sf):
    years = gappy_totals(spark, sf).groupBy("unit_id", F.year("month").alias("year")).agg(F.avg("value").alias("m"))
    return timeops.year_on_year(years, K, "year", "m", "delta").select("unit_id", "year", "delta")


@query("W09_share_of_water_year", f"""WITH {B}, d AS (SELECT unit_id, month, CAST(year(month + INTERVAL 3 MONTH) AS BIGINT) AS wy, qty FROM b),
x AS (SELECT unit_id, month, wy, qty / nullif(sum(qty) OVER (PARTITION BY unit_id, wy), 0) AS weight FROM d)
SELECT {sel('unit_id:i month:m wy:i weight:r')} FROM x""")
def _(spark, sf):
    b = shipped(spark, sf).withColumn("wy", water_year(F.col("month")))
    return timeops.share_of_group(b, ["unit_id", "wy"], "qty", "weight").select("unit_id", "month", "wy", "weight")


NEIGH = """d AS (SELECT unit_id, month, value, year(month) * 12 + month(month) AS ix, lag(value) OVER w AS v0, lead(value) OVER w AS v1,
lag(year(month) * 12 + month(month)) OVER w AS i0, lead(year(month) * 12 + month(month)) OVER w AS i1,
lag(month) OVER w AS m0, lead(month) OVER w AS m1 FROM a WINDOW w AS (PARTITION BY unit_id ORDER BY month))"""


@query("W10_centred_difference", f"""WITH {G}, {NEIGH}, x AS (SELECT unit_id, month,
CASE WHEN i1 - ix = 1 AND ix - i0 = 1 THEN (v1 - v0) / 2 END AS dsdt FROM d) SELECT {sel('unit_id:i month:m dsdt:r')} FROM x""")
def _(spark, sf):
    return timeops.centred_difference(gappy_totals(spark, sf), K, "month", "value", "dsdt").select("unit_id", "month", "dsdt")


@query("W11_timed_derivative", f"""WITH {G}, {NEIGH}, x AS (SELECT unit_id, month,
CASE WHEN i1 - ix = 1 AND ix - i0 = 1 AND date_diff('day', m0, m1) <= 80 THEN (v1 - v0) / (date_diff('day', m0, m1) / 365.25) END AS calendar,
CASE WHEN date_diff('day', m0, month) <= 80 AND date_diff('day', month, m1) <= 80 THEN (v1 - v0) / (date_diff('day', m0, m1) / 365.25) END AS observed
FROM d) SELECT {sel('unit_id:i month:m calendar:r observed:r')} FROM x""")
def _(spark, sf):
    a = gappy_totals(spark, sf).withColumn("day", F.datediff("month", F.lit("1970-01-01").cast("date")))
    a = timeops.timed_derivative(a, K, "month", "value", "day", "calendar")
    return timeops.timed_derivative(a, K, "month", "value", "day", "observed", calendar=False).select(
        "unit_id", "month", "calendar", "observed")


@query("W12_noise_floor", f"""WITH {G}, {NEIGH}, x AS (SELECT unit_id, CASE WHEN i1 - ix = 1 AND ix - i0 = 1 THEN v0 - 2 * value + v1 END AS d2 FROM d),
y AS (SELECT unit_id, stddev_samp(d2) / sqrt(6) AS noise_floor, count(d2) AS triplets FROM x GROUP BY 1)
SELECT {sel('unit_id:i noise_floor:r triplets:i')} FROM y""")
def _(spark, sf):
    return timeops.noise_floor(gappy_totals(spark, sf), K, "month", "value")


@query("W13_rolling_mean", f"""WITH {G}, d AS (SELECT unit_id, month, avg(value) OVER w7 AS m7, count(value) OVER w7 AS n7,
avg(value) OVER w13 AS m13, count(value) OVER w13 AS n13 FROM a
WINDOW w7 AS (PARTITION BY unit_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
w13 AS (PARTITION BY unit_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
x AS (SELECT unit_id, month, CASE WHEN n7 >= 4 THEN m7 END AS smooth7, CASE WHEN n13 >= 7 THEN m13 END AS smooth13 FROM d)
SELECT {sel('unit_id:i month:m smooth7:r smooth13:r')} FROM x""")
def _(spark, sf):
    a = timeops.rolling_mean(gappy_totals(spark, sf), K, "month", "value", 7, "smooth7")
    return timeops.rolling_mean(a, K, "month", "value", 13, "smooth13").select("unit_id", "month", "smooth7", "smooth13")


@query("W14_gap_runs_segments_eras", f"""WITH {G}, d AS (SELECT unit_id, month, year(month) * 12 + month(month) AS ix,
(year(month) * 12 + month(month)) - lag(year(month) * 12 + month(month)) OVER w AS step FROM a WINDOW w AS (PARTITION BY unit_id ORDER BY month)),
g AS (SELECT *, sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY month) AS segment FROM d),
big AS (SELECT unit_id, max(step) - 1 AS largest_gap, min(CASE WHEN step = mx THEN month END) AS resumes
FROM (SELECT *, max(step) OVER (PARTITION BY unit_id) AS mx FROM d) GROUP BY 1),
x AS (SELECT g.unit_id, segment, min(month) AS first_month, count(*) AS n, max(largest_gap) AS largest_gap,
max(CASE WHEN month < resumes THEN 'before' ELSE 'after' END) AS era FROM g JOIN big USING (unit_id) GROUP BY 1, 2)
SELECT {sel('unit_id:i segment:i first_month:m n:i largest_gap:i era:s')} FROM x""")
def _(spark, sf):
    a = gappy_totals(spark, sf)
    eras = timeops.era_by_largest_gap(timeops.segments(a, K, "month", "segment"), K, "month", "era", ("before", "after"))
    runs = timeops.gap_runs(a, K, "month").groupBy("unit_id").agg(F.max("n_missing").alias("largest_gap"))
    return (eras.groupBy("unit_id", "segment").agg(F.min("month").alias("first_month"), F.count("*").alias("n"), F.max("era").alias("era"))
            .join(runs, "unit_id").select("unit_id", "segment", "first_month", "n", "largest_gap", "era"))


@query("W15_first_row_per_key", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM x WHERE rn = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return order.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("W16_dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def _(spark, sf):
    return order.dense_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("W17_threshold_walk", f"""WITH p AS (SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) * 20 FROM orders) AS p FROM orders),
r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p),
x AS (SELECT 0.05 AS alpha, max(m) AS m, max(CASE WHEN p <= 0.05 * i / m THEN i END) AS accepted, max(CASE WHEN p <= 0.05 * i / m THEN p END) AS cut,
max(CASE WHEN p <= 0.05 * i / (m * (ln(m) + 0.5772156649 + 1.0 / (2 * m))) THEN i END) AS accepted_dependent FROM r)
SELECT {sel('m:i accepted:i cut:r accepted_dependent:i')} FROM x""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    top = o.agg((F.max("o_totalprice") * 20).alias("t")).scalar()
    walk = order.value_counts(o.select((F.col("o_totalprice") / top).alias("p")), "p")
    rank, m = F.col("before") + F.col("n"), F.col("total")
    hit = F.col("p") <= 0.05 * rank / m
    return walk.agg(F.max(m).alias("m"), F.max(F.when(hit, rank)).alias("accepted"), F.max(F.when(hit, F.col("p"))).alias("cut"),
                    F.max(F.when(F.col("p") <= 0.05 * rank / (m * harmonic_sum(m)), rank)).alias("accepted_dependent"))


@query("W18_trough_and_recovery", f"""WITH {G}, t AS (SELECT unit_id, avg(CASE WHEN month <= DATE '1997-12-01' THEN value END) AS pre,
min(CASE WHEN month >= DATE '1998-01-01' THEN value END) AS trough FROM a GROUP BY 1),
tm AS (SELECT a.unit_id, min(month) AS trough_month FROM a JOIN t ON a.unit_id = t.unit_id AND value = trough AND month >= DATE '1998-01-01' GROUP BY 1),
po AS (SELECT a.unit_id, avg(CASE WHEN month > trough_month THEN value END) AS post, count(CASE WHEN month > trough_month THEN value END) AS n_post
FROM a JOIN tm USING (unit_id) GROUP BY 1),
x AS (SELECT *, 100 * (post - trough) / nullif(pre - trough, 0) AS recovered_pct FROM t JOIN tm USING (unit_id) JOIN po USING (unit_id))
SELECT {sel('unit_id:i pre:r trough:r trough_month:m post:r n_post:i recovered_pct:r')} FROM x""")
def _(spark, sf):
    return timeops.trough_recovery(gappy_totals(spark, sf), K, "month", "value", "1997-12-01", "1998-01-01")


