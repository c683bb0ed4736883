"""What the test tables stand for: units, series, points, outlines, wells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import cos_lat

GAP = ("1998-03-01", "1999-02-01")  # absent block of eleven months
# Money is scaled by a prime, so that no result ends on a digit 5 that two
# engines may round apart.
SCALE = 9973.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def booked(month):
    """Month under which a late report stands: GAP goes to the year before, every 17th month to the next one.

    So the series has gaps of one and of eleven months, and yet every order counts.
    """
    early = F.when((month >= F.lit(GAP[0]).cast("date")) & (month < F.lit(GAP[1]).cast("date")), F.add_months(month, -12)).otherwise(month)
    return F.when((F.year(early) * 12 + F.month(early)) % 17 == 0, F.add_months(early, 1)).otherwise(early)


def _totals(spark: SparkSession, sf: str, month) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("bigint").alias("unit_id"), month.alias("month"))
            .agg((F.sum("o_totalprice") / SCALE).alias("value")))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series a per unit: scaled order totals by the customer's nation."""
    return _totals(spark, sf, F.trunc("o_orderdate", "MM"))


def gappy_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The series a with absent months, for operators whose feature is gaps."""
    return _totals(spark, sf, booked(F.trunc("o_orderdate", "MM")))


A = f"""a AS (
  SELECT CAST(c_nationkey AS BIGINT) AS unit_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         sum(o_totalprice) / {SCALE} AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

G = f"""a AS (
  SELECT CAST(c_nationkey AS BIGINT) AS unit_id,
         CAST(CASE WHEN (year(early) * 12 + month(early)) % 17 = 0 THEN early + INTERVAL 1 MONTH ELSE early END AS DATE) AS month,
         sum(o_totalprice) / {SCALE} AS value
  FROM (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '{GAP[0]}' AND o_orderdate < TIMESTAMP '{GAP[1]}'
                       THEN date_trunc('month', o_orderdate) - INTERVAL 1 YEAR ELSE date_trunc('month', o_orderdate) END AS early
        FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly series b and its covariates: line items by the supplier's nation and ship month."""
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").cast("bigint").alias("unit_id"),
                     F.trunc("l_shipdate", "MM").alias("month"))
            .agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("value"),
                 (F.sum("l_quantity") / 1e3).alias("qty"), F.avg("l_discount").alias("disc"),
                 F.count("*").alias("cnt")))


B = """b AS (
  SELECT CAST(s_nationkey AS BIGINT) AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_extendedprice * (1 - l_discount)) / 1e6 AS value, sum(l_quantity) / 1e3 AS qty,
         avg(l_discount) AS disc, count(*) AS cnt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def products(spark: SparkSession, sf: str) -> DataFrame:
    """a and b side by side on the months and units both have."""
    a = totals(spark, sf).withColumnRenamed("value", "a")
    b = shipped(spark, sf).withColumnRenamed("value", "b")
    return a.join(b, ["unit_id", "month"])


def gappy_products(spark: SparkSession, sf: str) -> DataFrame:
    """products with the absent months of a."""
    a = gappy_totals(spark, sf).withColumnRenamed("value", "a")
    b = shipped(spark, sf).withColumnRenamed("value", "b")
    return a.join(b, ["unit_id", "month"])


SIDE = """ab AS (
  SELECT a.unit_id, a.month, a.value AS a, b.value AS b, b.qty, b.disc, b.cnt
  FROM a JOIN b ON a.unit_id = b.unit_id AND a.month = b.month)"""
AB = f"{A}, {B}, {SIDE}"
GB = f"{G}, {B}, {SIDE}"


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Nations on a 5 x 5 lattice of boxes, some overlapping, the last column over the seam."""
    n = F.col("n_nationkey").cast("bigint")
    area = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sum(F.abs("s_acctbal")).alias("_area"))
    lon_min = -180.0 + 72.0 * (n % 5)
    width = 60.0 + 8.0 * (n % 3)
    lat_min = -85.0 + 34.0 * F.floor(n / 5)
    raw_max = lon_min + width
    return (table(spark, sf, "nation").join(area, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        n.alias("unit_id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_name").alias("name"),
        (F.coalesce("_area", F.lit(0.0)) + 1000.0).alias("area_km2"),
        (lat_min + 15.0).alias("lat"), (lon_min + width / 2).alias("lon"),
        F.lit(30.0).alias("lat_span"), width.alias("lon_span"), lat_min.alias("lat_min"),
        (lat_min + 30.0).alias("lat_max"), lon_min.alias("lon_min"),
        F.when(raw_max > 180, raw_max - 360).otherwise(raw_max).alias("lon_max"),
        F.when(n % 4 == 0, 90.0).when(n % 4 == 1, 1.0).otherwise(80.0).alias("location")))


U = """u AS (
  SELECT *, CASE WHEN raw_max > 180 THEN raw_max - 360 ELSE raw_max END AS lon_max,
         lat_min + 30.0 AS lat_max, lat_min + 15.0 AS lat, lon_min + lon_span / 2 AS lon, 30.0 AS lat_span
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(n_regionkey AS BIGINT) AS parent_id, n_name AS name,
               coalesce(area, 0.0) + 1000.0 AS area_km2, CAST(-180.0 + 72.0 * (n_nationkey % 5) AS DOUBLE) AS lon_min,
               CAST(60.0 + 8.0 * (n_nationkey % 3) AS DOUBLE) AS lon_span,
               CAST(-85.0 + 34.0 * (n_nationkey // 5) AS DOUBLE) AS lat_min,
               CAST(-180.0 + 72.0 * (n_nationkey % 5) + 60.0 + 8.0 * (n_nationkey % 3) AS DOUBLE) AS raw_max,
               CAST(CASE n_nationkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 1 ELSE 80 END AS DOUBLE) AS location
        FROM nation LEFT JOIN (SELECT s_nationkey, sum(abs(s_acctbal)) AS area FROM supplier GROUP BY 1)
        ON n_nationkey = s_nationkey))"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as points and grid cells."""
    k = F.col("c_custkey")
    lat = (k * 53) % 1700 / 10 - 85.0
    return table(spark, sf, "customer").select(
        k.alias("point_id"), lat.alias("lat"), ((k * 37) % 3600 / 10 - 180.0).alias("lon"),
        cos_lat(lat).alias("w"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("bigint").alias("nation"))


P = """p AS (
  SELECT c_custkey AS point_id, CAST((c_custkey * 53) % 1700 AS DOUBLE) / 10 - 85.0 AS lat,
         CAST((c_custkey * 37) % 3600 AS DOUBLE) / 10 - 180.0 AS lon,
         cos(radians(CAST((c_custkey * 53) % 1700 AS DOUBLE) / 10 - 85.0)) AS w, c_acctbal AS v,
         c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer)"""


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a skewed quadrilateral around each supplier; some pass the seam, many overlap."""
    x, y = F.col("lon"), F.col("lat")
    corner = [(x - 9, y - 6), (x + 10, y - 4), (x + 8, y + 6), (x - 10, y + 5)]
    edges = F.array(*[F.struct(corner[i][0].alias("x1"), corner[i][1].alias("y1"),
                               corner[(i + 1) % 4][0].alias("x2"), corner[(i + 1) % 4][1].alias("y2")) for i in range(4)])
    return (sites(spark, sf).select("unit_id", F.explode(edges).alias("e"))
            .select("unit_id", F.lit(0).alias("ring"), "e.*"))


E = """q AS (SELECT s_suppkey AS unit_id, CAST((s_suppkey * 37) % 3600 AS DOUBLE) / 10 - 180.0 AS x,
             CAST((s_suppkey * 53) % 1700 AS DOUBLE) / 10 - 85.0 AS y FROM supplier),
e AS (SELECT unit_id, x - 10 AS x0, x - 9 AS x1, y - 6 AS y1, x + 10 AS x2, y - 4 AS y2 FROM q
      UNION ALL SELECT unit_id, x - 10, x + 10, y - 4, x + 8, y + 6 FROM q
      UNION ALL SELECT unit_id, x - 10, x + 8, y + 6, x - 10, y + 5 FROM q
      UNION ALL SELECT unit_id, x - 10, x - 10, y + 5, x - 9, y - 6 FROM q)"""
EAST = "(CASE WHEN lon < x0 THEN lon + 360 WHEN lon >= x0 + 360 THEN lon - 360 ELSE lon END)"
CROSS = f"(y1 > lat) <> (y2 > lat) AND {EAST} < (x2 - x1) * (lat - y1) / (y2 - y1) + x1"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as units of the spatial statistics."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("unit_id"), ((k * 53) % 1700 / 10 - 85.0).alias("lat"), ((k * 37) % 3600 / 10 - 180.0).alias("lon"),
        (F.col("s_acctbal") / 1000).alias("x"), (F.abs("s_acctbal") + 100.0).alias("area"),
        F.col("s_nationkey").cast("bigint").alias("nation"))


S = """s AS (
  SELECT s_suppkey AS unit_id, CAST((s_suppkey * 53) % 1700 AS DOUBLE) / 10 - 85.0 AS lat,
         CAST((s_suppkey * 37) % 3600 AS DOUBLE) / 10 - 180.0 AS lon, s_acctbal / 1000 AS x,
         abs(s_acctbal) + 100.0 AS area, CAST(s_nationkey AS BIGINT) AS nation FROM supplier)"""


def wells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as wells: yearly level from orders, with predictors; the nation is the block."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_custkey").alias("unit_id"), F.year("o_orderdate").cast("bigint").alias("year"),
                     F.col("c_nationkey").cast("bigint").alias("block_id"), F.col("c_mktsegment").alias("class"))
            .agg((F.sum("o_totalprice") / 1e6).alias("y"), F.count("*").cast("double").alias("x1"),
                 F.avg(F.month("o_orderdate").cast("double")).alias("x2"),
                 (F.max("o_totalprice") / 1e6).alias("x3"), F.avg((F.col("o_orderkey") % 97).cast("double")).alias("x4")))


WELL = """w AS (
  SELECT c_custkey AS unit_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(c_nationkey AS BIGINT) AS block_id,
         c_mktsegment AS class, sum(o_totalprice) / 1e6 AS y, CAST(count(*) AS DOUBLE) AS x1,
         avg(CAST(month(o_orderdate) AS DOUBLE)) AS x2, max(o_totalprice) / 1e6 AS x3,
         avg(CAST(o_orderkey % 97 AS DOUBLE)) AS x4
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def haversine_sql(a: str, b: str, radius: float = 6371.0) -> str:
    return (f"2 * {radius} * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) "
            f"* cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))")


def great_circle_sql(a: str, b: str) -> str:
    return (f"6371.0088 * acos(greatest(-1.0, least(1.0, sin(radians({a}.lat)) * sin(radians({b}.lat)) + cos(radians({a}.lat)) "
            f"* cos(radians({b}.lat)) * cos(radians({a}.lon) - radians({b}.lon)))))")


def t_p_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided t probability by Simpson's rule on cos(x)^(df-1)."""
    def area(top: str) -> str:
        return (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1.0 "
                f"WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(greatest(cos({top} * i / {steps}), 0.0), {df} - 1))) "
                f"* {top} / {3 * steps}")
    return f"(1 - ({area(f'atan(abs({t}) / sqrt({df}))')}) / ({area('(pi() / 2)')}))"


def ols_sql(base: str, keys: str, y: str, xs: list[str], order: str, name: str = "g", min_rows: int | None = None) -> str:
    """CTEs that orthogonalise xs in turn; the last column's coefficient and the residuals come out.

    Gives {name}_fit(keys, n, b, q, rss, num, den, corr, ssy) where b is the last column's
    coefficient, q the sum of its squares after orthogonalisation. Groups below min_rows are left out.
    """
    k, prev, parts = len(xs), f"{name}_0", []
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    notnull = " AND ".join(f"({c}) IS NOT NULL" for c in [y, *xs])
    parts.append(f"{prev} AS (SELECT {keys}, {order} AS ord, {y} AS y, {y} AS y0, {cols} FROM {base} WHERE {notnull} "
                 f"QUALIFY count(*) OVER (PARTITION BY {keys}) >= {min_rows or k + 1})")
    for j in range(k):
        rest = "".join(f", x{m} - x{j} * sum(x{m} * x{j}) OVER w / nullif(sum(x{j} * x{j}) OVER w, 0) AS x{m}"
                       for m in range(j + 1, k))
        keep = f", x{j} AS xl, y AS yl" if j == k - 1 else ""
        cur = f"{name}_{j + 1}"
        parts.append(f"{cur} AS (SELECT {keys}, ord, y0, y - x{j} * sum(y * x{j}) OVER w / nullif(sum(x{j} * x{j}) OVER w, 0) AS y"
                     f"{rest}{keep} FROM {prev} WINDOW w AS (PARTITION BY {keys}))")
        prev = cur
    parts.append(f"{name}_e AS (SELECT *, y AS e, lag(y) OVER (PARTITION BY {keys} ORDER BY ord) AS e1 FROM {prev})")
    parts.append(f"{name}_fit AS (SELECT {keys}, count(*) AS n, sum(yl * xl) / sum(xl * xl) AS b, sum(xl * xl) AS q, "
                 f"sum(e * e) AS rss, sum(e * e1) AS num, sum(e1 * e1) AS den, corr(CASE WHEN e1 IS NOT NULL THEN e END, e1) AS rc, "
                 f"var_pop(y0) * count(*) AS ssy, sqrt(sum(e * e) / count(*)) AS resid_std FROM {name}_e GROUP BY {keys})")
    return ",\n".join(parts)


YEARS = "(epoch(CAST({m} AS TIMESTAMP)) / 31557600.0)"


def trend_xs(month: str = "month", last: str = "t") -> list[str]:
    """Columns of the trend design, the wanted one last."""
    p = YEARS.format(m=month)
    cols = {"one": "1.0", "t": f"({p} - 30.0)", "c1": f"cos(2 * pi() * {p})", "s1": f"sin(2 * pi() * {p})",
            "c2": f"cos(4 * pi() * {p})", "s2": f"sin(4 * pi() * {p})"}
    return [v for c, v in cols.items() if c != last] + [cols[last]]
