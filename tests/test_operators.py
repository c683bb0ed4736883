"""Properties and edge cases of the operators against brute force."""

import datetime as dt
import json
import math
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import stats
from tidemark.operators import filters, fit, joins, order, overlay, panel, reduce, spatial, timeops
from tidemark.session import shared_folder
from tidemark.sources import documents, sinks, tables
from tidemark.streaming import incremental


def month(i: int) -> dt.date:
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def series(spark, values, unit=1):
    return spark.createDataFrame([(unit, month(i), v) for i, v in values], "unit_id bigint, month date, v double")


# --- weighted means --------------------------------------------------------------------

def test_weighted_mean_rules_differ_on_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 3.0), (2, None, 1.0), (3, 4.0, 0.0)], "u int, v double, w double")
    v, w = F.col("v"), F.col("w")
    got = {r["u"]: r for r in df.groupBy("u").agg(
        reduce.weighted_mean(v, w).alias("free"), reduce.covered_mean(v, w, 0.9).alias("covered"), reduce.strict_mean(v, w).alias("strict"),
        reduce.fixed_weight_mean(v, w).alias("fixed")).collect()}
    assert (got[1]["free"], got[1]["covered"], got[1]["strict"], got[1]["fixed"]) == (2.0, None, None, 0.5)
    assert tuple(got[2])[1:] == (None, None, None, None)
    assert got[3]["free"] is None


def test_weighted_mean_ignores_row_order_and_split_weights(spark):
    rng = np.random.default_rng(1)
    cells = [(int(c), float(w)) for c, w in enumerate(rng.uniform(0.1, 1, 50))]
    obs = spark.createDataFrame([(c, month(0), float(rng.normal())) for c, _ in cells], "cell int, month date, v double")
    whole = spark.createDataFrame([(1, c, w) for c, w in cells], "unit_id int, cell int, w double")
    split = spark.createDataFrame([(1, c, w * s) for c, w in reversed(cells) for s in (0.25, 0.75)], "unit_id int, cell int, w double")
    a, b = (reduce.overlay_means(o, obs, ["cell"], "unit_id", "month", "v", "w").first()["v"] for o in (whole, split))
    assert a == pytest.approx(b, abs=1e-12)


# --- time axis -----------------------------------------------------------------------------

GAPPY = [(i, float(i % 12) + 0.1 * i) for i in range(48) if i not in (5, 20, 21, 22)]


def test_deseasonalised_month_means_are_zero(spark):
    d = timeops.deseasonalise(series(spark, GAPPY), ["unit_id"], "month", "v", "d")
    assert max(abs(r[0]) for r in d.groupBy(F.month("month")).agg(F.avg("d").alias("m")).select("m").collect()) < 1e-12


def test_centred_difference_needs_both_calendar_neighbours(spark):
    d = timeops.centred_difference(series(spark, GAPPY), ["unit_id"], "month", "v", "d").collect()
    got = {r["month"]: r["d"] for r in d}
    assert got[month(4)] is None and got[month(6)] is None and got[month(0)] is None
    assert got[month(2)] == pytest.approx((dict(GAPPY)[3] - dict(GAPPY)[1]) / 2)


def test_gap_runs_and_segments(spark):
    s = series(spark, GAPPY)
    runs = [(r["first_missing"], r["n_missing"]) for r in timeops.gap_runs(s, ["unit_id"], "month").orderBy("first_missing").collect()]
    assert runs == [(month(5), 1), (month(20), 3)]
    assert timeops.segments(s, ["unit_id"], "month", "seg").agg(F.max("seg")).first()[0] == 2
    missing = {r[0] for r in timeops.missing_months(s, "month").collect()}
    assert missing == {month(i) for i in (5, 20, 21, 22)}


def test_rolling_mean_counts_rows_not_months(spark):
    d = {r["month"]: r["m"] for r in timeops.rolling_mean(series(spark, GAPPY), ["unit_id"], "month", "v", 7, "m").collect()}
    vals = [v for _, v in GAPPY]
    assert d[month(0)] == pytest.approx(np.mean(vals[:4]))
    assert d[month(6)] == pytest.approx(np.mean(vals[2:9]))


def test_noise_floor_of_a_parabola(spark):
    s = series(spark, [(i, float(i * i)) for i in range(20)])
    assert timeops.noise_floor(s, ["unit_id"], "month", "v").first()["noise_floor"] == pytest.approx(0.0, abs=1e-9)


def test_constant_series_give_nulls_not_errors(spark):
    s = series(spark, [(i, 5.0) for i in range(60)])
    assert timeops.zscore(s, ["unit_id"], "v", "z").where("z is not null").count() == 0
    two = s.withColumn("w", F.lit(1.0))
    assert two.groupBy("unit_id").agg(reduce.paired_r(F.col("v"), F.col("w")).alias("r")).first()["r"] is None
    assert two.groupBy("unit_id").agg(reduce.variance_ratio(F.col("v"), F.col("w")).alias("r")).first()["r"] is None
    fit.corr_effective(two, ["unit_id"], "month", "v", "w").collect()
    assert fit.trend(s, ["unit_id"], "month", "v").first()["b_t"] == pytest.approx(0.0, abs=1e-9)


def test_fewer_rows_than_the_minimum_give_no_fit(spark):
    assert fit.trend(series(spark, GAPPY[:20]), ["unit_id"], "month", "v").count() == 0


def test_zero_and_missing_stay_apart(spark):
    s = series(spark, [(0, None), (1, 2.0)]).unionByName(series(spark, [(0, None), (1, None)], 2))
    got = filters.zero_without_contributors(s, "unit_id", "v", spark.createDataFrame([(1,)], "unit_id bigint")).orderBy("unit_id", "month")
    assert [r["v"] for r in got.collect()] == [None, 2.0, 0.0, 0.0]


def test_two_solutions_in_a_month_weigh_by_days(spark):
    rows = [(1, month(10), 10.0, 1.0, 10, "2000-11-05"), (1, month(10), 20.0, 3.0, 30, "2000-11-20")]
    df = spark.createDataFrame(rows, "u int, month date, v double, noise double, days int, d string").withColumn("d", F.to_date("d"))
    df = df.withColumn("e", F.col("d"))
    r = reduce.collapse_by_days(df, ["u"], "month", "v", "noise", "days", "d", "e", "d").first()
    assert (r["v"], r["noise"], r["days"]) == (17.5, 2.5, 40)


# --- order -----------------------------------------------------------------------------------

def skewed(n=4000, seed=2):
    """A third of all rows share one value and one key."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.normal(size=n), 3))
    k = np.where(rng.random(n) < 0.34, 0, rng.integers(0, 9, n))
    return pd.DataFrame({"id": np.arange(n), "k": k, "v": v})


def test_quantiles_are_exact(spark):
    pdf = skewed()
    for ranges in (8, 400):
        got = order.quantiles(spark.createDataFrame(pdf), "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["k"], ranges).toPandas()
        for r in got.itertuples():
            assert r.quantile == pytest.approx(np.quantile(pdf[pdf.k == r.k].v, r.prob), abs=1e-12)
        assert len(got) == 5 * pdf.k.nunique()


def test_counts_below_do_not_depend_on_the_ranges(spark):
    pdf = skewed()
    frames = [order.value_counts(spark.createDataFrame(pdf), "v", None, r).orderBy("v").toPandas() for r in (1, 64, 3000)]
    want = pdf["v"].value_counts().sort_index()
    for f in frames:
        assert list(f["n"]) == list(want) and list(f["before"]) == list(want.cumsum() - want)


def test_ranks_match_pandas_and_keep_every_row(spark):
    pdf = skewed()
    got = order.average_rank(spark.createDataFrame(pdf), "v").toPandas().sort_values("id")
    assert len(got) == len(pdf)
    assert np.allclose(got["rank"], pdf["v"].rank())
    one = order.average_rank(spark.createDataFrame(pdf), "v", ["k"]).toPandas().sort_values("id")
    assert np.allclose(one["rank"], pdf.groupby("k")["v"].rank())


def test_dense_index_is_consecutive(spark):
    ids = spark.range(0, 50_000, 7).withColumnRenamed("id", "k")
    got = order.dense_index(ids, "k")
    assert got.where(F.col("idx") * 7 != F.col("k")).count() == 0


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame(skewed()[["id", "k"]])
    small = spark.createDataFrame([(i, i * 10) for i in range(5)], "k bigint, x int")
    for how in ("inner", "left"):
        a, b = (sorted(map(tuple, d.select("id", "k", "x").collect()), key=repr)
                for d in (order.salted_join(big, small, ["k"], how), big.join(small, "k", how)))
        assert a == b


# --- fits ---------------------------------------------------------------------------------------

def numpy_trend(months, y):
    t = np.array([(dt.datetime(m.year, m.month, 1) - dt.datetime(1970, 1, 1)).total_seconds() for m in months]) / (365.25 * 86400)
    x = np.column_stack([np.ones_like(t), t - t.mean()] + [f(k * math.pi * t) for k in (2, 4) for f in (np.cos, np.sin)])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    n, k = len(y), 6
    r1 = (e[1:] * e[:-1]).sum() / (e[:-1] ** 2).sum()
    n_eff = n * (1 - r1) / (1 + r1)
    return beta[1], math.sqrt((e ** 2).sum() / (n - k) * np.linalg.inv(x.T @ x)[1, 1] * n / n_eff), r1


def test_trend_equals_least_squares_on_gappy_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 50 + 0.2 * i + 4 * math.sin(i) + rng.normal()) for i in range(120) if i % 13]
    r = fit.trend(series(spark, rows), ["unit_id"], "month", "v").first()
    slope, se, r1 = numpy_trend([month(i) for i, _ in rows], np.array([v for _, v in rows]))
    assert r["b_t"] == pytest.approx(slope, rel=1e-9)
    assert r["se_t"] == pytest.approx(se, rel=1e-9)
    assert r["r1"] == pytest.approx(r1, rel=1e-8)


def test_collinear_columns_give_no_row(spark):
    df = series(spark, [(i, float(i % 7)) for i in range(60)]).withColumns({"one": F.lit(1.0), "x": F.lit(2.0)})
    assert fit.fit(df, ["unit_id"], "v", ["one", "x"], "month").count() == 0


def test_signed_rank_small_samples():
    assert stats.signed_rank_two_sided(0, 5, False, 0.0) == pytest.approx(2 / 32)
    assert stats.signed_rank_two_sided(7.5, 5, True, 6.0) == pytest.approx(1.0)


# --- panel -------------------------------------------------------------------------------------

def test_leave_one_block_out_equals_a_refit(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "b": np.where(rng.random(n) < 0.34, 0, rng.integers(0, 12, n)), "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    pdf["y"] = 0.5 * pdf.x1 + 0.1 * pdf.b + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    solved = panel.held_out(panel.block_grams(df, [], "b", "y", ["x1", "x2"]), [], "b", 3)
    x = np.column_stack([np.ones(n), pdf.x1, pdf.x2])
    pred = np.empty(n)
    for b in pdf.b.unique():
        out = (pdf.b == b).to_numpy()
        pred[out] = x[out] @ np.linalg.lstsq(x[~out], pdf.y[~out], rcond=None)[0]
    want = 1 - ((pdf.y - pred) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum()
    assert panel.pooled_r2(solved, [], 3).first()["oos_r2"] == pytest.approx(want, abs=1e-10)
    rows = panel.predictions(df, solved, "b", ["x1", "x2"]).toPandas().sort_values("id")
    assert len(rows) == n and np.allclose(rows.pred, pred)


# --- overlays -------------------------------------------------------------------------------------

def brute_inside(lon, lat, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_points_in_polygons_equal_brute_force_over_the_seam(spark):
    rng = np.random.default_rng(5)
    rings = {}
    for u in range(12):
        cx, cy = rng.uniform(-178, 178), rng.uniform(-70, 70)
        ang = np.sort(rng.uniform(0, 2 * math.pi, 9))
        rad = rng.uniform(3, 14, 9)
        rings[u] = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a, r in zip(ang, rad)]
    rings[12] = [(170.0, -10.0), (195.0, -12.0), (190.0, 15.0), (172.0, 12.0)]
    edges = [(u, x1, y1, x2, y2) for u, ring in rings.items() for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])]
    pts = [(i, float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for i in range(1500)]
    pts += [(1500, 0.0, -175.0), (1501, 0.0, 175.0), (1502, 0.0, -150.0)]
    got = {tuple(r) for r in overlay.points_in_polygons(
        spark.createDataFrame(pts, "p int, lat double, lon double"), spark.createDataFrame(edges, "unit_id int, x1 double, y1 double, x2 double, y2 double"), "p").collect()}
    want = set()
    for i, lat, lon in pts:
        for u, ring in rings.items():
            west = min(x for x, _ in ring)
            east = lon + 360 if lon < west else lon - 360 if lon >= west + 360 else lon
            if brute_inside(east, lat, ring):
                want.add((i, u))
    assert got == want and {(1500, 12), (1501, 12)} <= got and (1502, 12) not in got


def test_boxes_are_half_open_first_id_wins_and_outside_is_minus_one(spark):
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0), (2, 0.0, 10.0, 10.0, 20.0), (3, 0.0, 10.0, 5.0, 15.0), (4, 20.0, 30.0, 170.0, -170.0)],
                                  "unit_id bigint, lat_min double, lat_max double, lon_min double, lon_max double")
    pts = spark.createDataFrame([(1, 5.0, 10.0), (2, 10.0, 5.0), (3, 5.0, 4.0), (4, 25.0, 175.0), (5, 25.0, -175.0), (6, 25.0, -170.0), (7, 5.0, 12.0)],
                                "p bigint, lat double, lon double")
    got = dict(map(tuple, overlay.first_box(pts, boxes, "p", "unit_id").collect()))
    assert got == {1: 2, 2: -1, 3: 1, 4: 4, 5: 4, 6: -1, 7: 2}


def test_every_centre_maps_to_its_own_cell(spark):
    rows, i = [], 0
    for lat, width in ((-60.0, 30.0), (-20.0, 15.0), (20.0, 20.0)):
        for j in range(int(360 / width)):
            rows.append((i, lat, j * width, lat + 20, (j + 0.5) * width))
            i += 1
    cells = spark.createDataFrame(rows, "unit_id bigint, lat_min double, lon_min double, lat double, lon double")
    pts = cells.select(F.col("unit_id").alias("p"), "lat", "lon")
    hit = overlay.first_box(pts, overlay.banded_boxes(cells, "unit_id"), "p", "unit_id")
    assert hit.where("p <> unit_id").count() == 0 and hit.count() == i
    far = spark.createDataFrame([(0, 89.9, 5.0), (1, -89.9, 359.0)], "p bigint, lat double, lon double")
    got = dict(map(tuple, overlay.first_box(far, overlay.banded_boxes(cells, "unit_id"), "p", "unit_id").collect()))
    assert got == {0: 36, 1: 11}


def test_radius_join_equals_all_pairs_near_pole_and_seam(spark):
    rng = np.random.default_rng(6)
    pts = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(300)] + [(300, 89.5, 10.0), (301, 89.5, -170.0), (302, 0.0, 179.9), (303, 0.0, -179.9)]
    df = spark.createDataFrame(pts, "id bigint, lat double, lon double")
    got = {(r["a"], r["b"]) for r in overlay.within_radius(df.select(F.col("id").alias("a"), "lat", "lon"), df.select(F.col("id").alias("b"), "lat", "lon"), 900.0).collect()}
    lat, lon = np.radians([p[1] for p in pts]), np.radians([p[2] for p in pts])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    d = 2 * 6371.0 * np.arcsin(np.sqrt(h))
    assert got == {(int(a), int(b)) for a, b in zip(*np.where(d <= 900.0))}


def test_nested_grid_must_be_a_multiple(spark):
    with pytest.raises(ValueError):
        overlay.nested_overlap(spark.range(1), 0.25, 0.6, 0.5)


def test_outline_area_of_a_cap_cell(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 30.0), (0.0, 30.0)]
    edges = [(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    r = overlay.outline_measures(spark.createDataFrame(edges, "unit_id int, x1 double, y1 double, x2 double, y2 double")).first()
    assert r["area_km2"] == pytest.approx(6371.0088 ** 2 * math.radians(10) * 0.5)
    assert r["lon"] == pytest.approx(5.0) and r["lat"] == pytest.approx(math.degrees(math.asin(0.25)))


# --- spatial statistics ---------------------------------------------------------------------------

def test_components_equal_union_find_on_star_and_chain(spark):
    star = [(0, i) for i in range(1, 400)]                     # one node on most edges
    chain = [(1000 + i, 1001 + i) for i in range(150)]         # long diameter
    loose = [(3000, 3001), (3001, 3002), (3002, 3000)]
    nodes = sorted({x for e in star + chain + loose for x in e} | {9999})
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in star + chain + loose:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = spatial.components(spark.createDataFrame([(x,) for x in nodes], "unit_id bigint"),
                             spark.createDataFrame([(b, a) for a, b in star + chain + loose], "src bigint, dst bigint"))
    assert dict(map(tuple, got.collect())) == {x: root(x) for x in nodes}


def site_frame(spark, n=70, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"unit_id": np.arange(n) * 3, "lat": rng.uniform(-60, 60, n), "lon": rng.uniform(-180, 180, n), "x": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def test_tiles_do_not_change_the_answer(spark):
    pdf, df = site_frame(spark)
    one, many = (spatial.band_moran(df, 9, min_pairs=5, tile=t).orderBy("band").toPandas() for t in (512, 16))
    pd.testing.assert_frame_equal(one, many)
    a, b = (spatial.effective_n(df, spark.createDataFrame([(900.0,)], "range_km double"), t).first() for t in (512, 16))
    lat, lon = np.radians(pdf.lat.to_numpy()), np.radians(pdf.lon.to_numpy())
    dot = np.sin(lat)[:, None] * np.sin(lat) + np.cos(lat)[:, None] * np.cos(lat) * np.cos(lon[:, None] - lon)
    d = 6371.0088 * np.arccos(np.clip(dot, -1, 1))
    np.fill_diagonal(d, 0)
    want = len(pdf) ** 2 / np.exp(-d / 900.0).sum()
    assert a["n_eff"] == pytest.approx(want) and b["n_eff"] == pytest.approx(want)


def test_pair_correlations_with_missing_months(spark):
    rng = np.random.default_rng(8)
    pdf, _ = site_frame(spark, 40)
    v = rng.normal(size=(40, 30)) + rng.normal(size=30)
    v[rng.random(v.shape) < 0.1] = np.nan
    pdf["vec"] = list(v)
    df = spark.createDataFrame([(int(r.unit_id), r.lat, r.lon, list(map(float, r.vec))) for r in pdf.itertuples()], "unit_id bigint, lat double, lon double, vec array<double>")
    got = spatial.pair_decorrelation(df, 2000.0, 1500.0, 24, tile=16).toPandas().set_index("bin")
    full = np.isfinite(v).sum(axis=1) > 24
    assert 0 < full.sum() < 40
    c = pd.DataFrame(v.T).corr().where(np.outer(full, full)).to_numpy()
    lat, lon = np.radians(pdf.lat.to_numpy()), np.radians(pdf.lon.to_numpy())
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    d = 2 * 6371.0 * np.arcsin(np.sqrt(h))
    i, j = np.triu_indices(40, 1)
    pairs = pd.DataFrame({"km": d[i, j], "bin": np.ceil(d[i, j] / 2000).astype(int), "r": c[i, j]}).dropna()
    want = pairs.groupby("bin").r.agg(["mean", "std", "size"])
    for b, w in want.iterrows():
        assert got.loc[b, "n"] == w["size"] and got.loc[b, "mean_r"] == pytest.approx(w["mean"])
        assert w["size"] < 2 or got.loc[b, "std_r"] == pytest.approx(w["std"])
    assert got.loc[0, "n"] == (pairs.km < 1500).sum()
    near = spatial.pair_decorrelation(df, 2000.0, 1500.0, 24, 3000.0, tile=4).toPandas().set_index("bin")
    assert near.loc[1, "n"] == got.loc[1, "n"] and near.loc[2, "n"] == ((pairs.km > 2000) & (pairs.km <= 3000)).sum() and near.index.max() == 2


def test_tiles_beyond_the_reach_do_not_meet(spark):
    rng = np.random.default_rng(21)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 900))), rng.uniform(-180, 180, 900)
    # A third of all units at one place, some at the poles and on the seam.
    lat[:300], lon[:300] = 40.0, 179.99
    lat[300:304], lon[300:304] = [90, -90, 0, 0], [0, 0, 180, -180]
    pdf = pd.DataFrame({"unit_id": np.arange(900), "lat": lat, "lon": lon, "x": rng.normal(size=900)})
    df = spark.createDataFrame(pdf)
    placed = spatial.placed_units(df, 16)
    tile_of = placed.toPandas().set_index("unit_id").mine.sort_index()
    assert len(tile_of) == 900 and tile_of.value_counts().max() <= 64
    listed = [tuple(r) for r in spatial.near_tiles(placed, 1500.0).collect()]
    every = spatial.near_tiles(placed).count()
    # The tiles of the crowded place always meet each other; of the rest most pairs are left out.
    assert len(set(listed)) == len(listed) < every / 2
    p, l = np.radians(lat), np.radians(lon)
    d = 6371.0088 * np.arccos(np.clip(np.sin(p)[:, None] * np.sin(p) + np.cos(p)[:, None] * np.cos(p) * np.cos(l[:, None] - l), -1, 1))
    t = tile_of.to_numpy()
    i, j = np.nonzero(d <= 1500)
    assert set(zip(np.minimum(t[i], t[j]), np.maximum(t[i], t[j]))) <= set(listed)
    bands = [(0, 400), (400, 1500)]
    one, many = (spatial.band_moran(df, 5, bands=bands, tile=k).orderBy("band").toPandas() for k in (512, 16))
    pd.testing.assert_frame_equal(one, many)
    upper = np.triu(np.ones_like(d, dtype=bool), 1)
    assert many.pairs.tolist() == [int(((d > lo) & (d <= hi) & upper).sum()) for lo, hi in bands]
    blank = df.unionByName(spark.createDataFrame([(900, None, 1.0, 0.0)], "unit_id bigint, lat double, lon double, x double"))
    assert spatial.placed_units(blank, 16).count() == 900
    assert spatial.placed_units(df.where("false"), 16).count() == spatial.near_tiles(spatial.placed_units(df.where("false")), 100.0).count() == 0


def test_modes_equal_singular_values(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 12)) @ rng.normal(size=(12, 12))
    x -= x.mean(axis=0)
    s = np.linalg.svd(x, compute_uv=False) ** 2
    share = s / s.sum()
    rows = [(u, month(m), float(x[m, u])) for m in range(30) for u in range(12)]
    dev = spark.createDataFrame(rows, "unit_id bigint, month date, z double")
    got = spatial.variance_modes(dev, "unit_id", "month", "z").orderBy("mode").limit(12).toPandas()
    assert np.allclose(got["share"], share)
    assert spatial.effective_modes(dev, "unit_id", "month", "z").first()["effective_dof"] == pytest.approx(1 / (share ** 2).sum())


def test_permutation_deals_every_value_once(spark):
    _, df = site_frame(spark, 25)
    z = spatial.centred(df.select("unit_id", "x"))
    want = sorted(z.toPandas()["z"].round(12))
    orders = []
    for batch in (3, 10):
        rows = sorted(spatial.shuffles(z, 4, "seed", batch).collect(), key=lambda r: (r["part"], r["unit_id"]))
        deals = [[] for _ in want]
        for i, r in enumerate(rows):
            deals[i % len(want)] += [round(x, 12) for x in r["deal"]]
        orders.append(deals)
        assert all(sorted(d) == want for d in zip(*deals)) and len(set(zip(*deals))) == 4
        rows = sorted(spatial.shuffles(z, 4, "seed", batch, copied=0).collect(), key=lambda r: (r["part"], r["unit_id"]))
        assert [round(x, 12) for i in range(len(want)) for r in rows[i::len(want)] for x in r["deal"]] == sum(deals, [])
    assert orders[0] == orders[1]


def test_places_are_dealt_evenly():
    for n in (1, 2, 7, 30):
        keys = spatial.round_keys("even", 4000)
        got = spatial.dealt_places(np.arange(n), n, keys)
        assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all()
        for k in range(n):
            assert (np.abs(np.bincount(got[k], minlength=n) - 4000 / n) < 6 * np.sqrt(4000 / n)).all()
    # Two neighbours land side by side as often as any two would, and in either order.
    step = (got[5] - got[4]) % 30
    assert (np.abs(np.bincount(step, minlength=30)[1:] - 4000 / 29) < 6 * np.sqrt(4000 / 29)).all() and (step > 0).all()
    # The spread of a statistic over links is that of permutations drawn at random.
    rng = np.random.default_rng(4)
    z, links = rng.normal(size=30), rng.integers(0, 30, (60, 2))
    ours = (z[got][links[:, 0]] * z[got][links[:, 1]]).sum(axis=0)
    drawn = np.array([(p[links[:, 0]] * p[links[:, 1]]).sum() for p in (rng.permutation(z) for _ in range(4000))])
    assert ours.std() == pytest.approx(drawn.std(), rel=0.08) and abs(ours.mean() - drawn.mean()) < 0.1 * drawn.std()


def test_moran_permutation_batches_agree(spark):
    _, df = site_frame(spark, 30)
    ring = [(i, (i + k) % 30, 0.5) for i in range(30) for k in (1, 29)]
    edges = spark.createDataFrame(ring, "src bigint, dst bigint, w double")
    ids = sorted(r["unit_id"] for r in df.select("unit_id").collect())
    edges = edges.select(*[F.element_at(F.array(*[F.lit(i) for i in ids]), F.col(c).cast("int") + 1).alias(c) for c in ("src", "dst")], "w")
    units = df.select("unit_id", "x")
    got = [spatial.moran_permutation(units, edges, 40, "s", b, c).first() for b, c in ((7, 100), (100, 100), (7, 0))]
    for other in got[1:]:
        assert got[0]["n_perm"] == other["n_perm"] == 40 and got[0]["p_perm"] == other["p_perm"]
        assert got[0]["sd_perm"] == pytest.approx(other["sd_perm"], rel=1e-12)


def test_mode_counts(spark):
    shares = spark.createDataFrame([(i, s) for i, s in enumerate([0.6, 0.31, 0.05, 0.03, 0.01])], "mode int, share double")
    row = spatial.mode_counts(shares, [0.9, 0.95, 0.99], 5).first()
    assert (row["modes_90"], row["modes_95"], row["modes_99"], row["n_months"]) == (2, 3, 4, 5)
    assert spatial.mode_counts(shares, [0.9], 6).collect() == []


def test_scan_lines_agree_with_points_in_polygons(spark):
    rng = np.random.default_rng(12)
    rows = []
    for u in range(30):
        x, y, n = rng.uniform(-180, 180), rng.uniform(-80, 80), rng.integers(3, 9)
        ring = [(x + rng.uniform(-25, 25), y + rng.uniform(-9, 9)) for _ in range(n)]
        rows += [(u, 0, *ring[k], *ring[(k + 1) % n]) for k in range(n)]
    rows += [(90, 0, 0.0, 0.0, 10.0, 0.0), (90, 0, 10.0, 0.0, 10.0, 7.5), (90, 0, 10.0, 7.5, 0.0, 7.5), (90, 0, 0.0, 7.5, 0.0, 0.0)]
    edges = spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], "unit_id bigint, ring int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["i"], r["j"]): r["unit_id"] for r in overlay.unit_raster(edges, 2.5).collect()}
    grid = overlay.master_grid(spark, 2.5)
    want = {r["cell_id"]: r["unit_id"] for r in overlay.first_polygon(grid, edges, "cell_id").collect()}
    assert len(got) == 72 * 144 and all(want[i * 144 + j] == u for (i, j), u in got.items())


def test_contiguity_graph_links_lone_units(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 5, 3), (0, 8, None)], "i bigint, j bigint, unit_id bigint")
    units = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 5.0), (4, 0.0, 179.0), (5, 1.0, -179.0)], "unit_id bigint, lat double, lon double")
    got = {(r["src"], r["dst"]) for r in overlay.contiguity_graph(cells, units, 360, 1).collect()}
    assert got == {(1, 2), (2, 1), (3, 2), (2, 3), (4, 5), (5, 4)}


# --- sources and sinks ---------------------------------------------------------------------------

def test_snapshots_take_the_date_from_the_name_and_skip_empty_arrays(spark, tmp_path):
    one = [{"nombrecomun": "A", "latitud": "25.5", "longitud": "-100.1", "namoalmac": "n/d", "almacenaactual": "12.5"}]
    for day, rows in (("2020-01-01", one), ("2020-01-02", []), ("2020-01-03", one * 2)):
        (tmp_path / f"dams_{day}.json").write_text(json.dumps(rows, indent=1))
    got = documents.read_snapshots(spark, str(tmp_path)).collect()
    assert sorted(str(r["date"]) for r in got) == ["2020-01-01", "2020-01-03", "2020-01-03"]
    assert {r["almacenaactual"] for r in got} == {12.5} and {r["namoalmac"] for r in got} == {None}


def test_geojson_years(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"geometry": {"coordinates": [-100.0, 25.0]}, "properties": {"NAME": "P 1 ", "CODE": "77", "PNE_2001": 3.5, "PNE_2002": None, "PNE_2003": -1, "OTHER_2001": 9}}]}
    (tmp_path / "wells.json").write_text(json.dumps(doc, indent=1))
    got = documents.read_geojson_years(spark, str(tmp_path), "mx", "PNE_", "NAME", "CODE").collect()
    assert [tuple(r) for r in got] == [("mx:P 1|77", 25.0, -100.0, 2001, 3.5)]


def test_zipped_members(spark, tmp_path):
    for wy in (2001, 2002):
        with zipfile.ZipFile(tmp_path / f"Balance WY {wy}.zip", "w") as z:
            z.writestr("a.csv", "k,v\n1,2.5\n")
            z.writestr("b.csv", "k,v\n2,3.5\n")
            z.writestr("readme.md", "x")
    schema = StructType([StructField("k", LongType()), StructField("v", DoubleType())])
    got = documents.read_zipped_csv(spark, str(tmp_path), schema, r"WY(?:%20|\s)*(\d{4})").collect()
    assert sorted((r["year"], r["k"], r["v"]) for r in got) == [(2001, 1, 2.5), (2001, 2, 3.5), (2002, 1, 2.5), (2002, 2, 3.5)]


def test_unit_assertion_and_unknown_code_fail(spark):
    df = spark.createDataFrame([(1, "cm"), (2, "mm")], "c int, units string")
    with pytest.raises(Exception, match="expected cm"):
        tables.assert_units(df, F.col("units"), "cm").collect()
    with pytest.raises(Exception, match="no label"):
        filters.decode(df, "c", spark.createDataFrame([(1, "x")], "c int, label string")).collect()


def test_payload_keeps_gaps(spark):
    s = series(spark, [(0, 1.26), (2, -0.04)])
    first, last = F.lit(month(0)), F.lit(month(3))
    assert sinks.payload_arrays(s, "unit_id", "month", "v", first, last).first()["values"] == [13, None, 0, None]


def test_ingest_resumes_and_repeats_change_nothing(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + h // 5, h), float(h)) for h in range(10)], "user_id bigint, ts timestamp, value double")

    def run():
        stream = spark.readStream.schema(ev.schema).parquet(src)
        return incremental.ingest(stream, lambda b: incremental.daily_partials(b, "user_id", "ts", "value"), out, ck, ["day"])

    def stored():
        return sorted(tuple(r) for r in incremental.merged(spark, out).select("total", "n").collect())
    ev.where("value < 5").coalesce(1).write.parquet(src)
    assert run() == 1 and run() == 0
    ev.where("value >= 5").coalesce(1).write.mode("append").parquet(src)
    assert run() == 1
    assert stored() == [(10.0, 5), (35.0, 5)]
    # The first day sent again under another name is stored already.
    ev.where("value < 5").coalesce(1).write.mode("append").parquet(src)
    assert run() == 1 and stored() == [(10.0, 5), (35.0, 5)]
    assert incremental.new_keys(ev, ev.where("value < 9"), ["user_id", "ts"]).count() == 1


def test_shared_folder_is_read_from_the_session(spark):
    assert spark.sparkContext.master.startswith("local")
    assert os.path.isdir(shared_folder(spark).replace("file:", ""))


def test_override_takes_missing_values_too(spark):
    base = series(spark, [(0, 1.0), (1, 2.0)])
    over = series(spark, [(0, 9.0)])
    got = joins.override(base, over, base.select("unit_id"), ["unit_id", "month"], "unit_id", "v").orderBy("month").collect()
    assert [r["v"] for r in got] == [9.0, None]


# --- skew --------------------------------------------------------------------------------------

SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3", "spark.sql.shuffle.partitions": "40"}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_points(spark, n=200_000):
    """A third of the points in one bucket."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(F.col("id").alias("p"), F.when(hot, 1.0 + F.rand(1)).otherwise(F.rand(2) * 160 - 80).alias("lat"),
                                 F.when(hot, 1.0 + F.rand(3)).otherwise(F.rand(4) * 360 - 180).alias("lon"))


def split_by_spark(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_bucket_is_split_over_tasks(spark, small_limits):
    corner = spark.range(400).select(F.col("id").alias("unit_id"), (F.rand(5) * 150 - 80).alias("y"), (F.rand(6) * 340 - 180).alias("x"))
    boxes = corner.select("unit_id", F.col("y").alias("lat_min"), (F.col("y") + 9).alias("lat_max"), F.col("x").alias("lon_min"), (F.col("x") + 9).alias("lon_max"))
    ring = [(0, 0), (12, 1), (11, 9), (1, 8)]
    edges = corner.select("unit_id", F.explode(F.array(*[F.struct(
        (F.col("x") + a[0]).alias("x1"), (F.col("y") + a[1]).alias("y1"), (F.col("x") + b[0]).alias("x2"), (F.col("y") + b[1]).alias("y2"))
        for a, b in zip(ring, ring[1:] + ring[:1])])).alias("e")).select("unit_id", "e.*")
    pts = hot_points(spark)
    assert split_by_spark(overlay.first_box(pts, boxes, "p", "unit_id"))
    assert split_by_spark(overlay.points_in_polygons(pts, edges, "p"))


def test_a_hot_cell_is_split_over_tasks(spark, small_limits):
    obs = hot_points(spark).select(F.when(F.col("p") % 3 == 0, 0).otherwise(F.col("p") % 2000).alias("cell"), F.lit(1).alias("month"), F.col("lat").alias("v"))
    over = spark.range(2000).select(F.lit(1).alias("unit_id"), F.col("id").alias("cell"), F.lit(1.0).alias("w"))
    assert split_by_spark(reduce.overlay_means(over, obs, ["cell"], "unit_id", "month", "v", "w"))


def test_legend_check_fails_on_a_wrong_label(spark):
    from tidemark.operators import filters

    cells = spark.createDataFrame([(1, 0.0, 0.0)] * 3 + [(1, 50.0, 90.0)] + [(2, 50.0, 90.0)] * 9 + [(2, 0.0, 0.0)], "name bigint, lat double, lon double")
    boxes = spark.createDataFrame([(1, -5.0, 5.0, -5.0, 5.0), (2, -5.0, 5.0, -5.0, 5.0)], "name bigint, lat_min double, lat_max double, lon_min double, lon_max double")
    shares = filters.outside_share(cells, boxes, "name")
    assert {r["name"]: r["outside"] for r in shares.collect()} == {1: 0.25, 2: 0.9}
    assert filters.checked(shares, F.col("outside") <= 0.9, "label").count() == 2
    with pytest.raises(Exception, match="label"):
        filters.checked(shares, F.col("outside") <= 0.5, "label").collect()


def test_one_pass_fits_equal_two_pass_fits(spark):
    """Several right-hand sides from lagged sums, on large, small and gappy series, beside the fits by residuals."""
    import numpy as np
    from tidemark.operators import fit

    rng = np.random.default_rng(5)
    rows = []
    for u in range(12):
        e = 0.0
        for m in range(90):
            e = 0.6 * e + rng.standard_normal()
            if rng.random() > 0.1:
                rows.append((u, m, 1.0, m / 12 + 50.0 * (u == 3), float(rng.standard_normal()), 1e6 + 1e3 * u + 0.3 * m + e, 1e-6 * e, None if u == 4 and m % 2 else e))
    df = spark.createDataFrame(rows, "u int, m int, one double, t double, x double, big double, small double, gap double")
    xs = ["one", "t", "x"]
    for kind in ("trend", "flux", "inflated", "plain"):
        many = {r["u"]: r for r in fit.fits(df, ["u"], ["big", "small", "gap"], xs, "m", kind, 10).collect()}
        for y in ("big", "small", "gap"):
            for r in fit.fit(df.where("gap is not null"), ["u"], y, xs, "m", kind, 10, p_values=False).collect():
                own = many[r["u"]][y]
                assert many[r["u"]]["n"] == r["n"]
                for c in ("rss", "resid_std", "r1", "n_eff", "df", "r2", "b_t", "se_t", "b_x", "se_x", "t_x"):
                    assert abs(own[c] - r[c]) <= 1e-5 * abs(r[c]) + 1e-12, (kind, y, r["u"], c, own[c], r[c])


def test_months_from_file_paths(spark, tmp_path):
    from tidemark.sources import tables
    for stamp, value in (("199912", 1.0), ("200001", 2.0), ("200002", 3.0), ("notes", 4.0)):
        spark.createDataFrame([(value,)], "value double").write.parquet(f"{tmp_path}/gw_{stamp}.parquet")
    # A file of another month is not opened, so it may be unreadable.
    for part in (tmp_path / "gw_200002.parquet").glob("part-*"):
        part.write_bytes(b"no table")
    df = spark.read.schema("value double").parquet(f"{tmp_path}/gw_*.parquet")
    got = tables.file_months(df, r"gw_(\d{6})\.parquet", "1999-12-01", "2000-01-01").orderBy("month").collect()
    assert [(str(r.month), r.value) for r in got] == [("1999-12-01", 1.0), ("2000-01-01", 2.0)]
