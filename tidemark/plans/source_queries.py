"""Sources S01-S17 and sinks K01-K07: tables written in each format and read back."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import units as conv
from tidemark.operators import filters
from tidemark.plans.registry import query, sel
from tidemark.plans.roles import A, B, G, P, SCALE, gappy_totals, points, shipped, table, totals
from tidemark.session import shared_folder
from tidemark.sources import documents, sinks, tables
from tidemark.streaming import incremental


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


@query("S01_csv_scan", f"""WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, sum(o_totalprice) / {SCALE} AS total FROM orders GROUP BY 1) SELECT {sel('month:m n:i total:r')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "csv")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    sinks.write_table(o, path, "csv")
    back = tables.read_csv(spark, path, "o_orderkey bigint, day date, o_totalprice double")
    return back.groupBy(F.trunc("day", "MM").alias("month")).agg(F.count("*").alias("n"), (F.sum("o_totalprice") / SCALE).alias("total"))


@query("S02_commented_csv_daily_to_monthly", f"""WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS mean, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT {sel('month:m mean:r n:i')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "commented")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string"))
    mark = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("# "), line)).otherwise(line)
    table(spark, sf, "orders").select(mark.alias("value")).write.mode("overwrite").text(path)
    back = spark.read.schema("date date, storage double").option("comment", "#").csv(path)
    return back.groupBy(F.trunc("date", "MM").alias("month")).agg(F.avg("storage").alias("mean"), F.count("*").alias("n"))


@query("S03_parquet_scan_or_absent", f"""WITH {A} SELECT {sel('unit_id:i month:m value:r')} FROM a""")
def _(spark, sf):
    path = scratch(spark, "series")
    schema = "unit_id bigint, month date, value double"
    sinks.write_table(totals(spark, sf), f"{path}/present")
    found = [tables.read_if_present(spark, f"{path}/{n}", schema) for n in ("present", "absent")]
    assert found[1] is None
    return found[0]


@query("S04_csv_in_sql", f"""WITH x AS (SELECT p_brand, sum(p_retailprice) AS total FROM part GROUP BY 1) SELECT {sel('p_brand:s total:r')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "sqlcsv")
    sinks.write_table(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), path, "csv")
    tables.csv_view(spark, path, "p_partkey bigint, p_brand string, p_retailprice double", "tidemark_part_csv")
    return spark.sql("SELECT p_brand, sum(p_retailprice) AS total FROM tidemark_part_csv GROUP BY p_brand")


@query("S05_json_snapshots", f"""WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n, sum(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END) / {SCALE} AS storage FROM orders GROUP BY 1) SELECT {sel('date:m n:i storage:r')} FROM x""")
def _(spark, sf):
    # One array of objects for each file, the date in its path; a long month has several files.
    path = scratch(spark, "snapshots")
    value = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/d")).otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-01").alias("date"), F.expr("o_orderkey div 50000").alias("file"),
        F.to_json(F.struct(F.concat(F.lit("dam"), "o_custkey").alias("nombrecomun"), F.lit("25.1").alias("latitud"),
                           F.lit("-100.2").alias("longitud"), value.alias("almacenaactual"))).alias("json"))
    whole = rows.groupBy("date", "file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
    (whole.select("date", "value").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("date").text(path))
    back = documents.read_snapshots(spark, path, multi_line=True)
    return back.groupBy("date").agg(F.count("*").alias("n"), (F.sum("almacenaactual") / SCALE).alias("storage"))


@query("S06_geojson_year_columns", f"""WITH x AS (SELECT 'mx:' || c_name || '|' || c_custkey AS site, CAST(c_custkey * 53 % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice) - 200000, 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)
SELECT {sel('site:s lat:r year:i value:r')} FROM x WHERE value > 0""")
def _(spark, sf):
    path = scratch(spark, "geojson")
    o = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") - 200000).alias("v"))
    held = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("PNE_"), F.col("y")), F.format_string("%.2f", F.col("v"))))).alias("m"))
    c = table(spark, sf, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"))
    props = F.map_concat(F.create_map(F.lit("NOMBRE_POZ"), F.col("c_name"), F.lit("CLAVE_ACUI"), F.col("c_custkey").cast("string"),
                                      F.lit("PNE_1990"), F.lit("")), "m")
    lat, lon = (F.col("c_custkey") * 53) % 1700 / 10 - 85.0, (F.col("c_custkey") * 37) % 3600 / 10 - 180.0
    feature = F.struct(F.struct(F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties"))
    # One collection for each file, of at most a thousand features.
    files = c.groupBy(F.expr("c_custkey div 1000")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    files.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return documents.read_geojson_years(spark, path, "mx", "PNE_", "NOMBRE_POZ", "CLAVE_ACUI").select("site", "lat", "year", "value")


@query("S07_zipped_csv_members", f"""WITH x AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, sum(o_totalprice) / {SCALE} AS total FROM orders GROUP BY 1) SELECT {sel('year:i n:i total:r')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "zips")

    def pack(batches):
        for pdf in batches:
            for year, rows in pdf.groupby("year"):
                archive = io.BytesIO()
                with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("notes.txt", "not a table")
                    z.writestr("rows.csv", rows[["o_orderkey", "o_totalprice"]].to_csv(index=False))
                yield pd.DataFrame({"path": [f"balance WY {year} {uuid.uuid4().hex}.zip"], "content": [archive.getvalue()]})

    # Archives stand in a table of names and bytes, as the binary file source gives them.
    src = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    sinks.write_table(src.mapInPandas(pack, "path string, content binary"), path)
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType())])
    back = documents.zipped_csv_rows(spark.read.parquet(path), schema, r"WY(?:%20|\s)*(\d{4})")
    return back.groupBy("year").agg(F.count("*").alias("n"), (F.sum("o_totalprice") / SCALE).alias("total"))


@query("S08_grid_scan_pruned", f"""WITH {A}, x AS (SELECT unit_id, count(*) AS n, sum(value) AS total, min(month) AS first_month, max(month) AS last_month FROM a WHERE month BETWEEN DATE '1996-03-01' AND DATE '1997-10-01' GROUP BY 1) SELECT {sel('unit_id:i n:i total:r first_month:m last_month:m')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "grid")
    a = totals(spark, sf).withColumn("source", F.lit("orders"))
    b = shipped(spark, sf).select("unit_id", "month", "value", F.lit("items").alias("source"))
    # One folder for each month, as a cube comes; no date stands inside the files.
    both = a.unionByName(b).withColumns({"year": F.year("month"), "stamp": F.date_format("month", "yyyyMM")}).drop("month")
    both.repartition("source", "stamp").write.mode("overwrite").partitionBy("source", "year", "stamp").parquet(path)
    grid = tables.file_months(tables.scan_grid(spark, path, "orders", (1996, 1997)), r"stamp=(\d{6})/", "1996-03-01", "1997-10-01")
    return grid.groupBy("unit_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query("S09_native_geometry", f"""WITH {P}, x AS (SELECT point_id, lon AS lon_180, lat - 0.5 AS lat_min, lat + 0.5 AS lat_max, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END - 0.5 AS lon_min FROM p) SELECT {sel('point_id:i lon_180:r lat_min:r lat_max:r lon_min:r')} FROM x""")
def _(spark, sf):
    cells = points(spark, sf).select("point_id", F.col("lat").alias("lat_center"), F.pmod(F.col("lon"), F.lit(360.0)).alias("lon_center"),
                                     F.lit(1.0).alias("lat_span"), F.lit(1.0).alias("lon_span"))
    return tables.with_edges(cells).select("point_id", "lon_180", "lat_min", "lat_max", "lon_min")


@query("S10_region_scan", f"""WITH {P} SELECT point_id FROM p WHERE lat BETWEEN -31 AND 31 AND lon BETWEEN -61 AND 61 AND point_id % 2 = 0""")
def _(spark, sf):
    path = scratch(spark, "region")
    code = F.when(F.col("point_id") % 2 == 0, 80.0).otherwise(90.0)
    sinks.write_table(points(spark, sf).withColumn("location", code), path)
    return tables.scan_region(spark.read.parquet(path), (-30, 30), (-60, 60), True, 1.0).select("point_id")


@query("S11_melt_month_columns", f"""WITH d AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS "ET", CAST(count(*) AS DOUBLE) AS "CU" FROM orders GROUP BY 1, 2) SELECT {sel('o_custkey:i month:m ET:r CU:r')} FROM d""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.date_format("o_orderdate", "MM_yyyy"))
    # The columns are the months of the record: as many as the calendar has, not the table.
    names = sorted(r["m"] for r in o.select("m").distinct().collect())
    wide = o.groupBy("o_custkey").pivot("m", names).agg(F.sum("o_totalprice").alias("ET"), F.count(F.lit(1)).cast("double").alias("CU"))
    wide = wide.select("o_custkey", *[F.col(f"{n}_{v}").alias(f"{v}_VOLUME_{n}_acft") for n in names for v in ("ET", "CU")])
    tall = tables.melt_months(wide, ["o_custkey"], r"^([A-Z]+)_VOLUME_(\d{2})_(\d{4})_acft$", ["ET", "CU"])
    return tall.where("ET is not null or CU is not null")


@query("S12_melt_year_columns", f"""WITH x AS (SELECT l_suppkey, CAST(y AS BIGINT) AS year, sum(CASE WHEN year(l_shipdate) = y THEN l_quantity ELSE 0 END) AS "QTY", count(CASE WHEN year(l_shipdate) = y THEN 1 END) AS "N" FROM lineitem, (SELECT unnest(range((SELECT min(year(l_shipdate)) FROM lineitem), (SELECT max(year(l_shipdate)) + 1 FROM lineitem))) AS y) GROUP BY 1, 2) SELECT {sel('l_suppkey:i year:i QTY:r N:i')} FROM x""")
def _(spark, sf):
    ends = table(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("first"), F.max(F.year("l_shipdate")).alias("last")).first()
    years = list(range(ends["first"], ends["last"] + 1))
    at = {y: F.year("l_shipdate") == y for y in years}
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        *[F.sum(F.when(at[y], F.col("l_quantity")).otherwise(0.0)).alias(f"QTY_{y % 100:02d}") for y in years],
        *[F.count_if(at[y]).alias(f"N_{y % 100:02d}") for y in years])
    return tables.melt_years(wide, ["l_suppkey"], ["QTY", "N"], years)


@query("S13_harmonised_variants", """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998 THEN CASE o_orderstatus WHEN 'F' THEN 'field' WHEN 'O' THEN 'orchard' ELSE o_orderstatus END ELSE o_orderpriority END AS cls,
CASE WHEN year(o_orderdate) < 1998 THEN 'absent' ELSE o_orderstatus END AS irr FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where(F.year("o_orderdate") < 1998).select("o_orderkey", F.col("o_orderstatus").alias("CLASS1"))
    new = o.where(F.year("o_orderdate") >= 1998).select("o_orderkey", F.col("o_orderpriority").alias("cls"), F.col("o_orderstatus").alias("irr"))
    merged = tables.harmonise([old, new], {"CLASS1": "cls"}, {"F": "field", "O": "orchard"}, "cls")
    return merged.na.fill({"irr": "absent"}).select("o_orderkey", "cls", "irr")


@query("S14_concat_with_index", "WITH x AS (SELECT c_custkey * 2 AS k FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier) SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx FROM x")
def _(spark, sf):
    a = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("k"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("k"))
    return tables.concat_indexed([a, b], "k")


@query("S15_category_year_pivot", f"""WITH x AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS wy, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS applied, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS reuse FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
SELECT {sel('l_suppkey:i wy:i applied:r reuse:r')} FROM x""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("wy"), "l_returnflag", "l_quantity")
    return tables.category_pivot(l, ["l_suppkey", "wy"], "l_returnflag", {"A": "applied", "R": "reuse"}, "l_quantity")


@query("S16_resumable_ingest", f"""WITH x AS (SELECT user_id AS unit_id, CAST(ts AS DATE) AS day, sum(value) AS total, count(value) AS n FROM events GROUP BY 1, 2) SELECT {sel('unit_id:i day:m total:r n:i')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "ingest")
    events = table(spark, sf, "events").select("user_id", "ts", "value")
    day = F.to_date("ts")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")

    def send(rows):
        # A file holds whole days, so a stored day is complete.
        rows.repartitionByRange(8, day).write.mode("append").parquet(f"{path}/in")

    def run() -> int:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        return incremental.ingest(stream, lambda b: incremental.daily_partials(b, "user_id", "ts", "value"), f"{path}/out", f"{path}/ck", ["day"])

    send(events.where(~late))
    run()
    send(events.where(late))
    run()
    # Days that come again in a new file are stored already and do not count twice.
    send(events.where(F.dayofmonth("ts") <= 3))
    run()
    assert run() == 0
    return incremental.merged(spark, f"{path}/out")


@query("S17_unit_assertion", f"""WITH {A}, x AS (SELECT unit_id, month, value * 10 AS mm FROM a) SELECT {sel('unit_id:i month:m mm:r')} FROM x""")
def _(spark, sf):
    declared = totals(spark, sf).withColumn("units", F.lit("cm"))
    return tables.assert_units(declared, F.col("units"), "cm").select("unit_id", "month", conv.cm_to_mm(F.col("value")).alias("mm"))


@query("K01_series_sink", f"""WITH x AS (SELECT o_custkey AS unit_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2) SELECT {sel('unit_id:i month:m value:r')}, 'orders' AS series FROM x""")
def _(spark, sf):
    path = scratch(spark, "k01")
    sinks.write_series(table(spark, sf, "orders"), path, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    return spark.read.parquet(path)


@query("K02_table_sinks", f"SELECT {sel('c_custkey:i c_acctbal:r')}, c_mktsegment, 'csv' AS kind FROM customer UNION ALL SELECT {sel('c_custkey:i c_acctbal:r')}, c_mktsegment, 'parquet' FROM customer")
def _(spark, sf):
    path = scratch(spark, "k02")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    sinks.write_table(c, f"{path}/csv", "csv")
    sinks.write_table(c, f"{path}/parquet")
    back = tables.read_csv(spark, f"{path}/csv", "c_custkey bigint, c_acctbal double, c_mktsegment string")
    return sinks.keyed_stack({"csv": back, "parquet": spark.read.parquet(f"{path}/parquet")}, "kind")


@query("K03_nested_summary", """WITH g AS (SELECT c_mktsegment AS class, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1)
SELECT (SELECT count(*) FROM customer) AS units, string_agg(class || '=' || n || ':' || printf('%.2f', top), ',' ORDER BY class) AS classes FROM g""")
def _(spark, sf):
    path = scratch(spark, "k03")
    c = table(spark, sf, "customer")
    g = c.groupBy(F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))
    doc = g.agg(F.struct(F.sum("n").alias("units")).alias("totals"), F.array_sort(F.collect_list(F.struct("class", "n", "top"))).alias("classes"))
    sinks.write_document(doc, path)
    back = spark.read.schema("totals struct<units:bigint>, classes array<struct<class:string,n:bigint,top:double>>").json(path)
    text = F.transform("classes", lambda s: F.concat(s["class"], F.lit("="), s["n"].cast("string"), F.lit(":"), F.format_string("%.2f", s["top"])))
    return back.select("totals.units", F.array_join(text, ",").alias("classes"))


@query("K04_keyed_stack", f"""WITH {A}, {B}, x AS (SELECT 'orders' AS footprint, unit_id, month, value FROM a UNION ALL SELECT 'items', unit_id, month, value FROM b), y AS (SELECT footprint, unit_id, count(*) AS n FROM x GROUP BY 1, 2) SELECT {sel('footprint:s unit_id:i n:i')} FROM y""")
def _(spark, sf):
    stack = sinks.keyed_stack({"orders": totals(spark, sf), "items": shipped(spark, sf).select("unit_id", "month", "value")}, "footprint")
    return stack.groupBy("footprint", "unit_id").agg(F.count("*").alias("n"))


@query("K05_payload_arrays", f"""WITH {G}, ax AS (SELECT CAST(unnest(range(CAST((SELECT min(month) FROM a) AS TIMESTAMP), CAST((SELECT max(month) FROM a) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month), k AS (SELECT unit_id, month FROM (SELECT DISTINCT unit_id FROM a), ax),
j AS (SELECT k.unit_id, k.month, CASE WHEN value IS NULL THEN 'null' ELSE CAST(CAST(round(value * 10) AS BIGINT) AS VARCHAR) END AS v FROM k LEFT JOIN a ON a.unit_id = k.unit_id AND a.month = k.month)
SELECT unit_id, '[' || string_agg(v, ',' ORDER BY month) || ']' AS payload FROM j GROUP BY 1""")
def _(spark, sf):
    series = gappy_totals(spark, sf)
    ends = series.agg(F.min("month").alias("first"), F.max("month").alias("last")).first()
    rows = sinks.payload_arrays(series, "unit_id", "month", "value", F.lit(ends["first"]), F.lit(ends["last"]))
    return rows.select("unit_id", F.to_json("values", {"ignoreNullFields": "false"}).alias("payload"))


@query("K06_provenance", f"""WITH {A}, {B}, x AS (SELECT 'orders' AS source, count(*) AS rows, count(DISTINCT unit_id) AS units, min(month) AS first_month, max(month) AS last_month FROM a
UNION ALL SELECT 'items', count(*), count(DISTINCT unit_id), min(month), max(month) FROM b) SELECT {sel('source:s rows:i units:i first_month:m last_month:m')} FROM x""")
def _(spark, sf):
    path = scratch(spark, "k06")
    both = sinks.provenance(totals(spark, sf), "orders", "unit_id", "month").unionByName(sinks.provenance(shipped(spark, sf), "items", "unit_id", "month"))
    sinks.write_document(both, path)
    return spark.read.schema("source string, rows bigint, units bigint, first_month date, last_month date").json(path)


@query("K07_split_by_membership", f"""WITH {P}, x AS (SELECT CASE WHEN lat BETWEEN 0 AND 40 AND lon BETWEEN 0 AND 60 THEN 'in' ELSE 'out' END AS side, count(*) AS n, sum(v) AS total FROM p GROUP BY 1) SELECT {sel('side:s n:i total:r')} FROM x""")
def _(spark, sf):
    inside, outside = sinks.split_by_membership(points(spark, sf), filters.in_bbox(F.col("lat"), F.col("lon"), (0, 40), (0, 60)))
    both = sinks.keyed_stack({"in": inside, "out": outside}, "side")
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


