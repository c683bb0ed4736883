"""Joins and spatial overlays J01-J39 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.dates import water_year
from tidemark.operators import filters, joins, overlay, reduce, timeops
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import (A, AB, B, CROSS, E, G, P, S, SCALE, U, gappy_totals, haversine_sql, outlines, points, products, shipped, sites, table, totals, units)

K = ["unit_id"]
INBOX = """p.lat >= u.lat_min AND p.lat < u.lat_max AND CASE WHEN u.lon_min < u.lon_max THEN p.lon >= u.lon_min AND p.lon < u.lon_max
ELSE p.lon >= u.lon_min OR p.lon < u.lon_max END"""
WRAPX = "CASE WHEN {x} % 360 < 0 THEN ({x} % 360 + 360) % 360 ELSE {x} % 360 END"


@query("J01_inner_equi", f"""WITH {AB} SELECT {sel('unit_id:i month:m a:r b:r')} FROM ab""")
def _(spark, sf):
    return products(spark, sf).select("unit_id", "month", "a", "b")


@query("J02_left_attributes", f"""WITH x AS (SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0) SELECT {sel('c_custkey:i n_name:s r_name:s')} FROM x""")
def _(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, sf, "region").where("r_regionkey > 0").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf, "customer").join(n, "c_nationkey", "left").join(r, "n_regionkey", "left").select("c_custkey", "n_name", "r_name")


@query("J03_full_outer_zero_fill", f"""WITH {A}, {B}, x AS (SELECT unit_id, month, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM a FULL JOIN b USING (unit_id, month)) SELECT {sel('unit_id:i month:m a:r b:r')} FROM x""")
def _(spark, sf):
    a = totals(spark, sf).withColumnRenamed("value", "a")
    b = shipped(spark, sf).select("unit_id", "month", F.col("value").alias("b"))
    return a.join(b, ["unit_id", "month"], "full_outer").na.fill(0.0, ["a", "b"])


@query("J04_join_using", "SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) USING (o_custkey)")
def _(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("tidemark_orders")
    table(spark, sf, "customer").createOrReplaceTempView("tidemark_customer")
    return spark.sql("""SELECT o_orderkey, c_mktsegment, o_orderstatus FROM tidemark_orders
                        JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM tidemark_customer) USING (o_custkey)""")


GRID = f"""{P}, g AS (SELECT *, CAST(floor((lat + 90) / 10) AS BIGINT) AS ci, CAST(floor((lon + 180) / 10) AS BIGINT) AS cj FROM p)"""


def gridded(spark, sf, d=10.0):
    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, d)
    return points(spark, sf).withColumn("ci", ci).withColumn("cj", cj)


@query("J05_composite_key", f"""WITH {GRID}, c AS (SELECT ci, cj, avg(v) AS cell_mean FROM g GROUP BY 1, 2), x AS (SELECT point_id, cell_mean FROM g JOIN c USING (ci, cj)) SELECT {sel('point_id:i cell_mean:r')} FROM x""")
def _(spark, sf):
    g = gridded(spark, sf)
    c = g.groupBy("ci", "cj").agg(F.avg("v").alias("cell_mean"))
    return g.join(c, ["ci", "cj"]).select("point_id", "cell_mean")


@query("J06_common_months", f"""WITH {A}, {B}, e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT month FROM a INTERSECT SELECT month FROM b INTERSECT SELECT month FROM e) SELECT {sel('month:m')} FROM x""")
def _(spark, sf):
    third = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.trunc("o_orderdate", "MM").alias("month"))
    return joins.common_months([totals(spark, sf), shipped(spark, sf), third])


@query("J07_union_of_months", f"""WITH {A}, {B}, ma AS (SELECT month, sum(value) AS a FROM a GROUP BY 1), mb AS (SELECT month, sum(value) AS b FROM b GROUP BY 1), x AS (SELECT month, a, b FROM ma FULL JOIN mb USING (month)) SELECT {sel('month:m a:r b:r')} FROM x""")
def _(spark, sf):
    a = totals(spark, sf).groupBy("month").agg(F.sum("value").alias("a"))
    b = shipped(spark, sf).groupBy("month").agg(F.sum("value").alias("b"))
    return a.join(b, "month", "full_outer")


@query("J08_lookup_map", f"""WITH x AS (SELECT c_custkey, coalesce(f, 0.0) AS fraction FROM customer LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS f FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey) SELECT {sel('c_custkey:i fraction:r')} FROM x""")
def _(spark, sf):
    f = table(spark, sf, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("f"))
    return table(spark, sf, "customer").join(f, "c_nationkey", "left").select("c_custkey", F.coalesce("f", F.lit(0.0)).alias("fraction"))


@query("J09_cell_semi_join", f"""WITH {GRID}, h AS (SELECT ci, cj FROM g WHERE v > 9000) SELECT point_id FROM g WHERE (ci, cj) IN (SELECT (ci, cj) FROM h)""")
def _(spark, sf):
    g = gridded(spark, sf)
    return g.join(g.where("v > 9000").select("ci", "cj"), ["ci", "cj"], "left_semi").select("point_id")


@query("J10_missing_months", f"""WITH {G}, ax AS (SELECT CAST(unnest(range(CAST((SELECT min(month) FROM a) AS TIMESTAMP), CAST((SELECT max(month) FROM a) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month),
x AS (SELECT month FROM ax WHERE month NOT IN (SELECT month FROM a)) SELECT {sel('month:m')} FROM x""")
def _(spark, sf):
    return timeops.missing_months(gappy_totals(spark, sf), "month")


@query("J11_complete_axis", f"""WITH {G}, ax AS (SELECT CAST(unnest(range(CAST((SELECT min(month) FROM a) AS TIMESTAMP), CAST((SELECT max(month) FROM a) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month),
k AS (SELECT unit_id, month FROM (SELECT DISTINCT unit_id FROM a), ax), x AS (SELECT k.unit_id, k.month, value, value IS NOT NULL AS observed FROM k LEFT JOIN a ON a.unit_id = k.unit_id AND a.month = k.month)
SELECT {sel('unit_id:i month:m value:r observed:i')} FROM x""")
def _(spark, sf):
    return timeops.complete_axis(gappy_totals(spark, sf), K, "month").select("unit_id", "month", "value", "observed")


@query("J12_override_source", f"""WITH {A}, {B}, x AS (SELECT a.unit_id, a.month, CASE WHEN a.unit_id IN (3, 7) THEN b.value ELSE a.value END AS value, a.unit_id IN (3, 7) AS overridden FROM a LEFT JOIN b ON a.unit_id = b.unit_id AND a.month = b.month)
SELECT {sel('unit_id:i month:m value:r overridden:i')} FROM x""")
def _(spark, sf):
    listed = units(spark, sf).where(F.col("unit_id").isin(3, 7)).select("unit_id")
    return joins.override(totals(spark, sf), shipped(spark, sf), listed, ["unit_id", "month"], "unit_id", "value")


@query("J13_fallback_source", f"""WITH {A}, {B}, s AS (SELECT * FROM a WHERE unit_id % 4 > 0 OR year(month) = 1996), good AS (SELECT unit_id FROM s GROUP BY 1 HAVING count(value) > 12),
x AS (SELECT unit_id, month, value, 'a' AS source FROM s WHERE unit_id IN (SELECT unit_id FROM good) UNION ALL SELECT unit_id, month, value, 'b' FROM b WHERE unit_id NOT IN (SELECT unit_id FROM good))
SELECT {sel('unit_id:i month:m value:r source:s')} FROM x""")
def _(spark, sf):
    a = totals(spark, sf).where((F.col("unit_id") % 4 > 0) | (F.year("month") == 1996))
    return joins.fallback_source(a, shipped(spark, sf), "unit_id", "month", "value")


@query("J14_unordered_pairs_within_distance", f"""WITH {S}, x AS (SELECT a.unit_id AS a, b.unit_id AS b, {haversine_sql('a', 'b')} AS km FROM s a JOIN s b ON a.unit_id < b.unit_id)
SELECT {sel('a:i b:i km:r')} FROM x WHERE km <= 1500""")
def _(spark, sf):
    s = sites(spark, sf)
    left = s.select(F.col("unit_id").alias("a"), "lat", "lon")
    return overlay.within_radius(left, s.select(F.col("unit_id").alias("b"), "lat", "lon"), 1500.0).where("a < b")


@query("J15_point_in_box_first", f"""WITH {P}, {U}, x AS (SELECT point_id, coalesce(min(u.unit_id), -1) AS unit_id FROM p LEFT JOIN u ON {INBOX} GROUP BY 1) SELECT {sel('point_id:i unit_id:i')} FROM x""")
def _(spark, sf):
    return overlay.first_box(points(spark, sf), units(spark, sf), "point_id", "unit_id")


@query("J16_wrapped_box_members", f"""WITH {P}, {U}, x AS (SELECT point_id, u.unit_id FROM p JOIN u ON {INBOX} WHERE u.lon_min > u.lon_max) SELECT {sel('point_id:i unit_id:i')} FROM x""")
def _(spark, sf):
    seam = units(spark, sf).where("lon_min > lon_max")
    return overlay.box_pairs(points(spark, sf).select("point_id", "lat", "lon"), seam, "unit_id").select("point_id", "unit_id")


@query("J17_banded_lookup", f"""WITH {P}, {U}, bd AS (SELECT DISTINCT lat_min FROM u), pb AS (SELECT point_id, {WRAPX.format(x='lon')} AS l, coalesce((SELECT max(lat_min) FROM bd WHERE lat_min <= lat), (SELECT min(lat_min) FROM bd)) AS band FROM p),
c AS (SELECT unit_id, lat_min, {WRAPX.format(x='lon_min')} AS west FROM u),
x AS (SELECT pb.point_id, coalesce(arg_max(unit_id, west) FILTER (WHERE west <= l), arg_min(unit_id, west)) AS unit_id FROM pb JOIN c ON c.lat_min = band GROUP BY 1) SELECT {sel('point_id:i unit_id:i')} FROM x""")
def _(spark, sf):
    cells = units(spark, sf).withColumn("lon_min", geo.wrap360(F.col("lon_min")))
    p = points(spark, sf).withColumn("lon", geo.wrap360(F.col("lon")))
    return overlay.first_box(p, overlay.banded_boxes(cells, "unit_id"), "point_id", "unit_id")


@query("J18_grid_cell_index", f"""WITH {P}, x AS (SELECT point_id, CAST(floor((lat + 90) / 0.5) AS BIGINT) AS i, 359 - CAST(floor((lat + 90) / 0.5) AS BIGINT) AS i_down, CAST(floor({WRAPX.format(x='(lon - 0.25)')} / 0.5) AS BIGINT) AS j,
lat < -60 OR lat >= 60 AS outside FROM p) SELECT {sel('point_id:i i:i i_down:i j:i outside:i')} FROM x""")
def _(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    i, _j = overlay.grid_index(lat, lon, -90.0, -180.0, 0.5)
    down, j = overlay.grid_index(lat, lon, -90.0, 0.25, 0.5, descending=True, n_lat=360)
    return points(spark, sf).select("point_id", i.alias("i"), down.alias("i_down"), j.alias("j"), ((lat < -60) | (lat >= 60)).alias("outside"))


RASTER = f"""{E}, m AS (SELECT i, j, CAST(-90.0 + (i + 0.5) * 2.5 AS DOUBLE) AS lat, CAST(-180.0 + (j + 0.5) * 2.5 AS DOUBLE) AS lon FROM (SELECT unnest(range(72)) AS i), (SELECT unnest(range(144)) AS j)),
hit AS (SELECT i, j, lat, lon, unit_id FROM m JOIN e ON {CROSS} GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1),
r AS (SELECT m.i, m.j, m.lat, m.lon, min(unit_id) AS unit_id FROM m LEFT JOIN hit USING (i, j) GROUP BY 1, 2, 3, 4)"""
AREA = "(6371.0088 ** 2 * radians(2.5) * (sin(radians(lat + 1.25)) - sin(radians(lat - 1.25))))"


def raster(spark, sf):
    return overlay.unit_raster(outlines(spark, sf), 2.5)


@query("J19_nested_grid_overlap", f"""WITH {RASTER}, x AS (SELECT unit_id, CAST(floor((lat + 90) / 5) AS BIGINT) AS ci, CAST(floor((lon + 180) / 10) AS BIGINT) AS cj, sum({AREA}) AS weight FROM r WHERE unit_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT {sel('unit_id:i ci:i cj:i weight:r')} FROM x""")
def _(spark, sf):
    return overlay.nested_overlap(raster(spark, sf).where("unit_id is not null"), 2.5, 5.0, 10.0)


@query("J19_regional_north_down", f"""WITH {RASTER}, f AS (SELECT unit_id, {AREA} AS area, CAST(floor((lat + 40) / 5) AS BIGINT) AS up, CAST(floor(((lon + 60 + 360) % 360) / 10) AS BIGINT) AS ac FROM r WHERE unit_id IS NOT NULL),
x AS (SELECT unit_id, 15 - up AS ci, least(ac, 23) AS cj, sum(area) AS weight FROM f WHERE up BETWEEN 0 AND 15 GROUP BY 1, 2, 3) SELECT {sel('unit_id:i ci:i cj:i weight:r')} FROM x""")
def _(spark, sf):
    return overlay.nested_overlap(raster(spark, sf).where("unit_id is not null"), 2.5, 5.0, 10.0, -40.0, -60.0, 16, 24, True)


@query("J19_west_running", f"""WITH {RASTER}, f AS (SELECT unit_id, {AREA} AS area, CAST(floor((lat + 90) / 5) AS BIGINT) AS ci, CAST(floor((lon + 180) / 10) AS BIGINT) AS ac FROM r WHERE unit_id IS NOT NULL),
x AS (SELECT unit_id, ci, 35 - ac AS cj, sum(area) AS weight FROM f GROUP BY 1, 2, 3) SELECT {sel('unit_id:i ci:i cj:i weight:r')} FROM x""")
def _(spark, sf):
    return overlay.nested_overlap(raster(spark, sf).where("unit_id is not null"), 2.5, 5.0, 10.0, westward=True)


PIP = f"""{P}, {E}, hit AS (SELECT point_id, unit_id FROM p JOIN e ON {CROSS} GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query("J20_point_in_polygon", f"WITH {PIP} SELECT {sel('point_id:i unit_id:i')} FROM hit")
def _(spark, sf):
    return overlay.points_in_polygons(points(spark, sf), outlines(spark, sf), "point_id")


@query("J21_point_in_polygon_left_first", f"""WITH {PIP}, x AS (SELECT p.point_id, coalesce(min(unit_id), -1) AS unit_id FROM p LEFT JOIN hit USING (point_id) GROUP BY 1) SELECT {sel('point_id:i unit_id:i')} FROM x""")
def _(spark, sf):
    return overlay.first_polygon(points(spark, sf), outlines(spark, sf), "point_id").na.fill(-1, ["unit_id"])


@query("J22_unit_raster", f"""WITH {RASTER} SELECT {sel('i:i j:i')}, CAST(coalesce(unit_id, -1) AS BIGINT) AS unit_id FROM r""")
def _(spark, sf):
    return raster(spark, sf).select("i", "j", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


CONTACT = """nb AS (SELECT a.unit_id AS u, b.unit_id AS v FROM r a JOIN r b ON b.i = a.i AND b.j = (a.j + 1) % 144 WHERE a.unit_id <> b.unit_id
UNION ALL SELECT a.unit_id, b.unit_id FROM r a JOIN r b ON b.i = a.i + 1 AND b.j = a.j WHERE a.unit_id <> b.unit_id),
pairs AS (SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM nb)"""


@query("J23_contiguity", f"""WITH {RASTER}, {CONTACT} SELECT {sel('src:i dst:i')} FROM pairs""")
def _(spark, sf):
    return overlay.contiguity(raster(spark, sf), 144)


@query("J24_inside_fraction", f"""WITH {RASTER}, {U}, c AS (SELECT r.i, r.j, r.lat, r.unit_id AS poly, u.unit_id AS box FROM r JOIN u ON {INBOX.replace('p.', 'r.')}),
x AS (SELECT box, sum(CASE WHEN poly IS NOT NULL THEN {AREA} ELSE 0 END) / sum({AREA}) AS fraction, count(*) AS cells FROM c GROUP BY 1) SELECT {sel('box:i fraction:r cells:i')} FROM x""")
def _(spark, sf):
    cells = raster(spark, sf).withColumnRenamed("unit_id", "poly")
    both = overlay.box_pairs(cells, units(spark, sf).withColumnRenamed("unit_id", "box"), "box")
    return overlay.inside_fraction(both, 2.5, "box", "poly")


@query("J25_land_fraction", f"""WITH {P}, f AS (SELECT *, CASE WHEN v > 0 THEN v END AS v0 FROM p), x AS (SELECT CAST(floor((lat + 90) / 15) AS BIGINT) AS ci, CAST(floor((lon + 180) / 15) AS BIGINT) AS cj, avg(CASE WHEN v0 IS NOT NULL THEN 1.0 ELSE 0.0 END) AS land_fraction, count(*) AS cells FROM f GROUP BY 1, 2)
SELECT {sel('ci:i cj:i land_fraction:r cells:i')} FROM x""")
def _(spark, sf):
    return overlay.land_fraction(points(spark, sf).withColumn("v0", F.when(F.col("v") > 0, F.col("v"))), "v0", -90.0, -180.0, 15.0)


@query("J26_nearest_cell_fallback", f"""WITH {S}, ov AS (SELECT unit_id, CAST(floor((lat + 90) / 10) AS BIGINT) AS ci, CAST(floor((lon + 180) / 10) AS BIGINT) AS cj, area AS weight FROM s WHERE x > 2),
x AS (SELECT unit_id, ci, cj, weight, false AS fallback FROM ov UNION ALL SELECT unit_id, CAST(floor((lat + 90) / 10) AS BIGINT), CAST(floor((lon + 180) / 10) AS BIGINT), 1.0, true FROM s WHERE unit_id NOT IN (SELECT unit_id FROM ov))
SELECT {sel('unit_id:i ci:i cj:i weight:r fallback:i')} FROM x""")
def _(spark, sf):
    s = sites(spark, sf)
    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, 10.0)
    ov = s.where("x > 2").select("unit_id", ci.alias("ci"), cj.alias("cj"), F.col("area").alias("weight"))
    return overlay.with_fallback(s.select("unit_id", "lat", "lon"), ov, "unit_id", -90.0, -180.0, 10.0)


@query("J27_nearest_neighbours", f"""WITH {S}, d AS (SELECT a.unit_id AS a, b.unit_id AS b, {haversine_sql('a', 'b')} AS km FROM s a JOIN s b ON a.unit_id <> b.unit_id WHERE a.x < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY km, b) AS rn FROM d), e AS (SELECT a AS src, b AS dst FROM r WHERE rn <= 4), x AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT {sel('src:i dst:i')} FROM x""")
def _(spark, sf):
    s = sites(spark, sf)
    near = overlay.nearest_k(s.where("x < 3"), s, 4)
    return overlay.both_ways(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("J28_radius_footprint", f"""WITH {S}, {P}, x AS (SELECT s.unit_id, p.point_id, {haversine_sql('s', 'p')} AS km FROM s, p) SELECT {sel('unit_id:i point_id:i km:r')} FROM x WHERE km <= 800""")
def _(spark, sf):
    left = sites(spark, sf).select(F.col("unit_id").alias("a"), "lat", "lon")
    near = overlay.within_radius(left, points(spark, sf).select(F.col("point_id").alias("b"), "lat", "lon"), 800.0)
    return near.select(F.col("a").alias("unit_id"), F.col("b").alias("point_id"), "km")


@query("J29_nearest_point", f"""WITH {S}, {P}, h AS (SELECT unit_id, lat + 2.3 AS lat, lon + 1.7 AS lon FROM s), d AS (SELECT h.unit_id, p.point_id, {haversine_sql('h', 'p')} AS km FROM h, p), x AS (SELECT unit_id, arg_min(point_id, (km, point_id)) AS point_id, min(km) AS km FROM d WHERE km <= 150 GROUP BY 1) SELECT {sel('unit_id:i point_id:i km:r')} FROM x""")
def _(spark, sf):
    left = sites(spark, sf).select(F.col("unit_id").alias("a"), (F.col("lat") + 2.3).alias("lat"), (F.col("lon") + 1.7).alias("lon"))
    near = overlay.nearest_within(left, points(spark, sf).select(F.col("point_id").alias("b"), "lat", "lon"), 150.0)
    return near.select(F.col("a").alias("unit_id"), F.col("b").alias("point_id"), "km")


@query("J30_reference_unit", f"""WITH {S} SELECT {sel('unit_id:i lat:r lon:r')} FROM s ORDER BY abs(lat - (SELECT avg(lat) FROM s)) + abs(lon - (SELECT avg(lon) FROM s)), unit_id LIMIT 1""")
def _(spark, sf):
    return joins.reference_unit(sites(spark, sf), "unit_id").select("unit_id", "lat", "lon")


@query("J31_subcell_stencil", f"""WITH {P}, x AS (SELECT CAST(floor((lat + 90) / 20) AS BIGINT) AS ci, CAST(floor((lon + 180) / 20) AS BIGINT) AS cj, sum(w * v) / sum(w) AS mean, count(*) AS cells FROM p WHERE lat < 80 GROUP BY 1, 2) SELECT {sel('ci:i cj:i mean:r cells:i')} FROM x""")
def _(spark, sf):
    fine = gridded(spark, sf, 20.0).where("lat < 80")
    return fine.groupBy("ci", "cj").agg(reduce.weighted_mean(F.col("v"), F.col("w")).alias("mean"), F.count("*").alias("cells"))


@query("J32_product_at_point", f"""WITH {GRID}, ob AS (SELECT ci, cj, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(CASE WHEN o_totalprice < 300000 THEN o_totalprice END) / {SCALE} AS v FROM orders JOIN g ON o_custkey = point_id GROUP BY 1, 2, 3),
st AS (SELECT s_suppkey, CAST(floor((CAST((s_suppkey * 53) % 1700 AS DOUBLE) / 10 + 5) / 10) AS BIGINT) AS ci, CAST(floor((CAST((s_suppkey * 37) % 3600 AS DOUBLE) / 10) / 10) AS BIGINT) AS cj FROM supplier),
x AS (SELECT s_suppkey AS unit_id, month, v - avg(v) OVER (PARTITION BY s_suppkey) AS anomaly FROM st JOIN ob USING (ci, cj) WHERE v IS NOT NULL) SELECT {sel('unit_id:i month:m anomaly:r')} FROM x""")
def _(spark, sf):
    cell = gridded(spark, sf).select("point_id", "ci", "cj")
    good = filters.sentinel_to_null(F.when(F.col("o_totalprice") < 300000, F.col("o_totalprice")))
    obs = (table(spark, sf, "orders").join(cell, F.col("o_custkey") == F.col("point_id"))
           .groupBy("ci", "cj", F.trunc("o_orderdate", "MM").alias("month")).agg((F.avg(good) / SCALE).alias("v")).where("v is not null"))
    ci, cj = overlay.grid_index(F.col("lat"), F.col("lon"), -90.0, -180.0, 10.0)
    at = sites(spark, sf).select("unit_id", ci.alias("ci"), cj.alias("cj")).join(obs, ["ci", "cj"])
    return timeops.recentre(at, K, "v", "anomaly").select("unit_id", "month", "anomaly")


@query("J33_child_to_parent", f"""WITH c AS (SELECT p_partkey, p_retailprice AS v, p_partkey // 10 AS parent FROM part), g AS (SELECT parent, avg(v) AS pv FROM c GROUP BY 1), x AS (SELECT p_partkey, v - pv AS gap FROM c JOIN g USING (parent)) SELECT {sel('p_partkey:i gap:r')} FROM x""")
def _(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"), filters.region_of_id(F.col("p_partkey"), 10.0).alias("parent"))
    g = c.groupBy("parent").agg(F.avg("v").alias("pv"))
    return c.join(g, "parent").select("p_partkey", (F.col("v") - F.col("pv")).alias("gap"))


@query("J34_annual_to_months", f"""WITH {B}, d AS (SELECT unit_id, month, year(month + INTERVAL 3 MONTH) AS wy, qty, value FROM b), an AS (SELECT unit_id, wy, sum(value) AS total FROM d GROUP BY 1, 2),
w AS (SELECT unit_id, month, wy, qty / nullif(sum(qty) OVER (PARTITION BY unit_id, wy), 0) AS weight FROM d), x AS (SELECT unit_id, month, total * weight AS monthly FROM w JOIN an USING (unit_id, wy)) SELECT {sel('unit_id:i month:m monthly:r')} FROM x""")
def _(spark, sf):
    d = shipped(spark, sf).withColumn("wy", water_year(F.col("month")))
    annual = d.groupBy("unit_id", "wy").agg(F.sum("value").alias("total"))
    w = timeops.share_of_group(d, ["unit_id", "wy"], "qty", "weight").select("unit_id", "month", "wy", "weight")
    return joins.spread_annual(annual, w, ["unit_id", "wy"], "total", "weight").select("unit_id", "month", "monthly")


@query("J35_product_and_parent", f"""WITH {AB}, l AS (SELECT unit_id, month, 'fine' AS product, a AS v FROM ab UNION ALL SELECT unit_id, month, 'coarse', b FROM ab UNION ALL SELECT unit_id, month, 'other', qty FROM ab),
x AS (SELECT c.product, c.unit_id, c.month, c.v - p.v AS departure FROM l c JOIN l p ON c.unit_id = p.unit_id AND c.month = p.month AND ((c.product = 'fine' AND p.product = 'coarse') OR (c.product = 'other' AND p.product = 'fine')))
SELECT {sel('product:s unit_id:i month:m departure:r')} FROM x""")
def _(spark, sf):
    wide = products(spark, sf).select("unit_id", "month", F.col("a").alias("fine"), F.col("b").alias("coarse"), F.col("qty").alias("other"))
    long = wide.unpivot(["unit_id", "month"], ["fine", "coarse", "other"], "product", "v")
    pairs = joins.parent_pairs(long, {"fine": "coarse", "other": "fine"}, "product", ["unit_id", "month"], "v")
    return pairs.select("product", "unit_id", "month", (F.col("v") - F.col("parent_value")).alias("departure"))


@query("J36_two_implementations", f"""WITH {AB}, d AS (SELECT unit_id, abs(a - b) AS d FROM ab), x AS (SELECT count(*) AS n, avg(d) AS mean_diff, max(d) AS max_diff, arg_max(unit_id, d) AS worst FROM d) SELECT {sel('n:i mean_diff:r max_diff:r worst:i')} FROM x""")
def _(spark, sf):
    ab = products(spark, sf)
    return joins.agreement(ab.select("unit_id", "month", F.col("a").alias("v")), ab.select("unit_id", "month", F.col("b").alias("v")), ["unit_id", "month"], "unit_id", "v")


@query("J37_region_registry", f"""WITH {P}, rg AS (SELECT CAST(r_regionkey AS BIGINT) AS region, -90.0 + 30 * r_regionkey AS lat_min, -45.0 + 30 * r_regionkey AS lat_max, -180.0 AS lon_min, 100.0 AS lon_max FROM region),
x AS (SELECT region, count(*) AS n, avg(v) AS mean FROM p JOIN rg ON lat >= lat_min AND lat < lat_max AND lon >= lon_min AND lon < lon_max GROUP BY 1) SELECT {sel('region:i n:i mean:r')} FROM x""")
def _(spark, sf):
    k = F.col("r_regionkey")
    boxes = table(spark, sf, "region").select(k.cast("bigint").alias("region"), (k * 30.0 - 90).alias("lat_min"), (k * 30.0 - 45).alias("lat_max"),
                                              F.lit(-180.0).alias("lon_min"), F.lit(100.0).alias("lon_max"))
    return overlay.box_pairs(points(spark, sf), boxes, "region").groupBy("region").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


XY = ("6371.0088 * radians({x}) * cos(radians(30))", "6371.0088 * sin(radians({y})) / cos(radians(30))")


@query("J38_area_and_centroid", f"""WITH {E}, t AS (SELECT unit_id, {XY[0].format(x='x1')} AS x1, {XY[1].format(y='y1')} AS y1, {XY[0].format(x='x2')} AS x2, {XY[1].format(y='y2')} AS y2 FROM e),
a AS (SELECT unit_id, sum(x1 * y2 - x2 * y1) AS a2, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy FROM t GROUP BY 1),
x AS (SELECT unit_id, abs(a2) / 2 / 1000 AS area_1000_km2, degrees(sx / (3 * a2) / (6371.0088 * cos(radians(30)))) AS lon, degrees(asin(sy / (3 * a2) * cos(radians(30)) / 6371.0088)) AS lat FROM a) SELECT {sel('unit_id:i area_1000_km2:r lon:r lat:r')} FROM x""")
def _(spark, sf):
    return overlay.outline_measures(outlines(spark, sf)).select("unit_id", (F.col("area_km2") / 1000).alias("area_1000_km2"), "lon", "lat")


@query("J39_nearest_to_wanted_distances", f"""WITH {P}, o AS (SELECT 25.0 AS lat, -100.0 AS lon), d AS (SELECT point_id, {haversine_sql('p', 'o')} AS km FROM p, o), w AS (SELECT unnest([0.0, 150.0, 300.0, 600.0, 1200.0, 5000.0]) AS wanted),
b AS (SELECT wanted, arg_min(point_id, (abs(km - wanted), point_id)) AS point_id FROM w, d GROUP BY 1), x AS (SELECT point_id, min(b.wanted) AS wanted, any_value(km) AS km FROM b JOIN d USING (point_id) GROUP BY 1) SELECT {sel('point_id:i wanted:r km:r')} FROM x""")
def _(spark, sf):
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(25.0), F.lit(-100.0))
    return joins.nearest_to_wanted(points(spark, sf), "point_id", d, [0, 150, 300, 600, 1200, 5000])


