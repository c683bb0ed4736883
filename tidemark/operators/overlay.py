"""Spatial overlays (J14-J32, J38, J39) as equi-joins on grid buckets.

Spark has no range or spatial join, and a range condition alone is a nested
loop. Both sides get the key of a regular lat/lon bucket instead; boxes and
polygons are listed under every bucket they may touch, and the exact test stays
as the join's residual condition. Radius joins and point-in-polygon tests deal a
bucket's rows to parts of bounded size, so that a crowded bucket is many tasks;
listed rows are never broadcast, as Spark takes them for as few as the rows they
come from.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.geo import (R_HAVERSINE, cell_area_km2, equal_area_x, equal_area_y, haversine_km)
from tidemark.session import cut_lineage

#: Points and edges of a bucket that meet in one task at a time, and crossings that it tests at once.
POINT_TILE, EDGE_TILE, TESTED_AT_ONCE = 2048, 2048, 1 << 19
#: Right rows of a radius join that one part of a bucket holds, and the widths of its buckets in degrees.
NEAR_TILE, NEAR_STEPS = 4096, (1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 18, 20, 24, 30)


def _columns(step: float) -> int:
    n = 360.0 / step
    if abs(n - round(n)) > 1e-9:
        raise ValueError("the bucket size must divide 360")
    return int(round(n))


def bucket(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    return (F.floor(lat / step).cast("int"),
            F.pmod(F.floor(lon / step).cast("int"), F.lit(_columns(step))))


def buckets_of_box(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column,
                   step: float) -> Column:
    """Array of every bucket the box touches; lon_hi may pass 180 for boxes over the seam."""
    cols = _columns(step)
    rows = F.sequence(F.floor(lat_lo / step).cast("int"), F.floor(lat_hi / step).cast("int"))
    j0 = F.floor(lon_lo / step).cast("int")
    j1 = F.least(F.floor(lon_hi / step).cast("int"), j0 + cols - 1)
    across = F.sequence(j0, j1)
    return F.flatten(F.transform(rows, lambda i: F.transform(
        across, lambda j: F.struct(i.alias("bi"), F.pmod(j, F.lit(cols)).alias("bj")))))


def in_box(lat: Column, lon: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column,
           lon_hi: Column) -> Column:
    """Half-open on both axes; lo > hi means the box wraps around the seam."""
    across = F.when(lon_lo < lon_hi, (lon >= lon_lo) & (lon < lon_hi)).otherwise(
        (lon >= lon_lo) | (lon < lon_hi))
    return (lat >= lat_lo) & (lat < lat_hi) & across


def box_pairs(points: DataFrame, boxes: DataFrame, box_id: str, how: str = "inner",
              step: float = 5.0) -> DataFrame:
    """points(lat, lon, ...) with every box (lat_min.. lon_max) that holds them."""
    hi = F.when(F.col("lon_min") < F.col("lon_max"), F.col("lon_max")).otherwise(
        F.col("lon_max") + 360.0)
    listed = boxes.select(
        box_id, *[F.col(c).alias("_" + c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")],
        F.explode(buckets_of_box(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), hi, step))
        .alias("_b")).select("*", F.col("_b.bi").alias("_bi"), F.col("_b.bj").alias("_bj")).drop("_b")
    bi, bj = bucket(F.col("lat"), F.col("lon"), step)
    p = points.withColumn("_pi", bi).withColumn("_pj", bj)
    on = ((F.col("_pi") == F.col("_bi")) & (F.col("_pj") == F.col("_bj"))
          & in_box(F.col("lat"), F.col("lon"), F.col("_lat_min"), F.col("_lat_max"),
                   F.col("_lon_min"), F.col("_lon_max")))
    return p.join(listed, on, how).drop("_pi", "_pj", "_bi", "_bj", "_lat_min", "_lat_max",
                                        "_lon_min", "_lon_max")


def first_box(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str,
              step: float = 5.0) -> DataFrame:
    """Lowest box id per point, -1 when none. All hits of a point meet before the shuffle."""
    hits = box_pairs(points, boxes, box_id, "left", step)
    return hits.groupBy(point_id).agg(F.coalesce(F.min(box_id), F.lit(-1)).alias(box_id))


def banded_boxes(cells: DataFrame, cell_id: str) -> DataFrame:
    """Boxes that make a floor search over latitude bands and then longitude edges.

    A band runs to the next band's lower edge and a cell to the next cell's west
    edge; the first and the last catch what lies beyond, as a clipped search does.
    Longitudes are 0 to 360. The windows hold the bands, and the cells of one band.
    """
    from pyspark.sql import Window as W
    bands = cells.select("lat_min").distinct()
    up = W.partitionBy(F.lit(1)).orderBy("lat_min")
    bands = (bands.withColumn("_hi", F.coalesce(F.lead("lat_min").over(up), F.lit(91.0)))
             .withColumn("_lo", F.when(F.lag("lat_min").over(up).isNull(), -90.0)
                         .otherwise(F.col("lat_min"))))
    along = W.partitionBy("lat_min").orderBy("lon_min")
    rows = (cells.select(cell_id, "lat_min", "lon_min")
            .withColumn("_east", F.coalesce(F.lead("lon_min").over(along), F.lit(360.0)))
            .withColumn("_west", F.when(F.lag("lon_min").over(along).isNull(), 0.0)
                        .otherwise(F.col("lon_min"))))
    return rows.join(bands, "lat_min").select(
        cell_id, F.col("_lo").alias("lat_min"), F.col("_hi").alias("lat_max"),
        F.col("_west").alias("lon_min"), F.col("_east").alias("lon_max"))


def grid_index(lat: Column, lon: Column, lat0: float, lon0: float, d: float,
               descending: bool = False, n_lat: int | None = None) -> tuple[Column, Column]:
    """Row and column of the cell holding a point, by floor from the grid's lower corner.

    Rows count from the top when the grid runs north to south.
    """
    i = F.floor((lat - lat0) / d).cast("bigint")
    if descending:
        i = F.lit(n_lat - 1) - i
    return i, F.floor(F.pmod(lon - lon0, F.lit(360.0)) / d).cast("bigint")


def nested_overlap(cell_unit: DataFrame, fine: float, coarse_lat: float, coarse_lon: float,
                   lat0: float = -90.0, lon0: float = -180.0, n_lat: int | None = None, n_lon: int | None = None,
                   descending: bool = False, westward: bool = False) -> DataFrame:
    """(unit_id, ci, cj, weight km2) of a coarse grid from fine cells with their unit.

    lat0 and lon0 are the outer edges of the coarse grid, n_lat and n_lon its size. Fine cells
    north or south of a regional grid give no rows; east and west of it they count to its last column.
    Rows are numbered from the north if the grid descends, columns from the east if it runs westward.
    """
    for d in (coarse_lat, coarse_lon):
        if abs(d / fine - round(d / fine)) > 1e-6:
            raise ValueError(f"{d} is no whole number of fine cells of {fine}")
    n_lat = n_lat or round(180 / coarse_lat)
    up = F.floor((F.col("lat") - lat0) / coarse_lat).cast("bigint")
    across = F.floor(F.pmod(F.col("lon") - lon0, F.lit(360.0)) / coarse_lon).cast("bigint")
    area = cell_area_km2(F.col("lat"), fine, fine)
    rows = cell_unit.where((up >= 0) & (up < n_lat))
    ci = F.lit(n_lat - 1) - up if descending else up
    cj = F.least(across, F.lit(n_lon - 1)) if n_lon else across
    if westward:
        cj = F.lit((n_lon or round(360 / coarse_lon)) - 1) - cj
    return rows.groupBy("unit_id", ci.alias("ci"), cj.alias("cj")).agg(F.sum(area).alias("weight"))


def crosses(lat: Column, lon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A ray to the east from the point meets the edge."""
    return ((y1 > lat) != (y2 > lat)) & (lon < F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions that are not merged: small rows with much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _listed_edges(edges: DataFrame, step: float) -> DataFrame:
    """Edges under their latitude rows, in every bucket of their polygon's box that is not wholly east of them."""
    box = edges.groupBy("unit_id").agg(F.min(F.least("x1", "x2")).alias("_x0"))
    lat_lo, lat_hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.where("y1 <> y2").join(box, "unit_id").select(
        "unit_id", "x1", "y1", "x2", "y2", "_x0",
        F.inline(buckets_of_box(lat_lo, lat_hi, F.col("_x0"), F.greatest("x1", "x2"), step)).alias("_bi", "_bj"))


def _holding(points: pa.Table, edges: pa.Table):
    """(units, point rows, unit places) by the even-odd rule, a tile of points at a time.

    With points in the order of latitude, those whose ray may meet an edge are one range.
    """
    code = edges["unit_id"].combine_chunks().dictionary_encode()
    place, units = code.indices.to_numpy(zero_copy_only=False), code.dictionary
    x1, y1, x2, y2, x0 = (edges[c].to_numpy() for c in ("x1", "y1", "x2", "y2", "_x0"))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    all_lat, all_lon = points["lat"].to_numpy(), points["lon"].to_numpy()
    order = np.argsort(all_lat, kind="stable")
    for at in range(0, len(order) if len(low) else 0, POINT_TILE):
        rows = order[at:at + POINT_TILE]
        lat, lon = all_lat[rows], all_lon[rows]
        first = np.searchsorted(lat, low)
        n = np.searchsorted(lat, high) - first
        met = np.zeros(len(units) * len(rows), dtype=np.int64)
        upto = np.cumsum(n)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + TESTED_AT_ONCE, TESTED_AT_ONCE)))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(n))):
            size = n[lo:hi]
            e = np.repeat(np.arange(lo, hi), size)
            k = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size) + first[e]
            east, west = lon[k], x0[e]
            east = np.where(east < west, east + 360, np.where(east >= west + 360, east - 360, east))
            crossed = east < (x2[e] - x1[e]) * (lat[k] - y1[e]) / (y2[e] - y1[e]) + x1[e]
            met += np.bincount(place[e[crossed]] * len(rows) + k[crossed], minlength=len(met))
        held = np.flatnonzero(met & 1)
        yield units, rows[held % len(rows)], held // len(rows)


def _pairs(point_id: str, points: pa.Table, edges: pa.Table) -> pa.Table:
    got = [pa.table({point_id: points[point_id].slice(0, 0), "unit_id": edges["unit_id"].slice(0, 0)})]
    for units, k, u in _holding(points, edges):
        got.append(pa.table({point_id: points[point_id].take(pa.array(k)), "unit_id": units.take(pa.array(u))}))
    return pa.concat_tables(got)


def _lowest(point_id: str, points: pa.Table, edges: pa.Table) -> pa.Table:
    """The lowest unit of each point."""
    got = [pa.table({point_id: points[point_id].slice(0, 0), "unit_id": edges["unit_id"].slice(0, 0)})]
    for units, k, u in _holding(points, edges):
        order = pc.sort_indices(units)
        place = np.empty(len(units), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(units))
        by = np.lexsort((place[u], k))
        one = by[np.diff(k[by], prepend=-1) > 0]
        got.append(pa.table({point_id: points[point_id].take(pa.array(k[one])), "unit_id": units.take(pa.array(u[one]))}))
    return pa.concat_tables(got)


def _totals(by: list[str], sums: list[str], points: pa.Table, edges: pa.Table) -> pa.Table:
    """For each unit and group of points their number and sums."""
    code = np.zeros(points.num_rows, dtype=np.int64)
    for c in by:
        own = points[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(1, len(own.dictionary)) + own.indices.to_numpy(zero_copy_only=False)
    _, sample, code = np.unique(code, return_index=True, return_inverse=True)
    values = [np.nan_to_num(points[c].to_numpy()) for c in sums]
    got = [pa.table({"unit_id": edges["unit_id"].slice(0, 0), **{c: points[c].slice(0, 0) for c in by}, "n": pa.array([], pa.int64()),
                     **{c: pa.array([], pa.float64()) for c in sums}})]
    for units, k, u in _holding(points, edges):
        at = u * len(sample) + code[k]
        n = np.bincount(at, minlength=len(units) * len(sample))
        cell = np.flatnonzero(n)
        rows = pa.array(sample[cell % len(sample)])
        got.append(pa.table({"unit_id": units.take(pa.array(cell // len(sample))), **{c: points[c].take(rows) for c in by}, "n": n[cell],
                             **{c: np.bincount(at, v[k], len(n)).astype("float64")[cell] for c, v in zip(sums, values)}}))
    return pa.concat_tables(got)


def _meet(points: DataFrame, edges: DataFrame, carried: list[str], kernel, schema: str, step: float) -> DataFrame:
    """kernel(points, edges) on every tile of points and edges of one bucket.

    A bucket's points are dealt to parts by a hash, its edges by their unit; each part of the one meets each of the other.
    """
    at, lit = ["_bi", "_bj"], F.lit(0).cast("bigint")
    listed = _listed_edges(edges, step)
    bi, bj = bucket(F.col("lat"), F.col("lon"), step)
    p = points.select(*carried, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), bi.alias("_bi"), bj.alias("_bj"))
    # One row for each bucket of the globe at most. Points find theirs by a number of the bucket, which deals them for this join
    # alone: where Spark does not copy the parts to all tasks, it splits hot buckets here.
    cell = F.col("_bi") * _columns(step) + F.col("_bj")
    parts = p.groupBy(*at).agg(F.ceil(F.count("*") / POINT_TILE).alias("_np")).join(
        listed.groupBy(*at).agg(F.ceil(F.count("*") / EDGE_TILE).alias("_ne")), at)
    p = (p.withColumn("_cell", cell).join(parts.select(cell.alias("_cell"), "_np", "_ne"), "_cell").drop("_cell")
         .withColumn("_p", F.pmod(F.xxhash64(*carried, "lat", "lon"), "_np"))
         .withColumn("_e", F.explode(F.sequence(lit, F.col("_ne") - 1))).drop("_np", "_ne"))
    listed = (listed.join(F.broadcast(parts), at).withColumn("_e", F.pmod(F.xxhash64("unit_id"), "_ne"))
              .withColumn("_p", F.explode(F.sequence(lit, F.col("_np") - 1))).drop("_np", "_ne"))
    key = [*at, "_p", "_e"]
    return _spread(p, *key).groupBy(*key).cogroup(_spread(listed, *key).groupBy(*key)).applyInArrow(kernel, schema)


def _by_number(points: DataFrame, point_id: str) -> tuple[DataFrame, DataFrame | None]:
    """Points whose id is theirs alone, and those that share one, if any."""
    again = points.groupBy(F.col(point_id).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if again.isEmpty():
        return points, None
    same = F.col(point_id).eqNullSafe(F.col("_id"))
    return points.join(again, same, "left_anti"), points.join(again, same, "left_semi")


def _kind(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _odd_pairs(points: DataFrame, edges: DataFrame, point_id: str, step: float) -> DataFrame:
    """Pairs whose rows of one id meet an odd number of edges together."""
    met = _meet(points, edges, [point_id], functools.partial(_pairs, point_id), f"{_kind(points, point_id)}, {_kind(edges, 'unit_id')}", step)
    return met.groupBy(point_id, "unit_id").agg(F.count("*").alias("_c")).where("_c % 2 = 1").select(point_id, "unit_id")


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, step: float = 5.0,
                       by: list[str] | None = None, sums: list[str] | None = None) -> DataFrame:
    """(point_id, unit_id) pairs by the even-odd rule; with ``by`` or ``sums`` totals of them instead.

    An edge is listed under its latitude rows, in every bucket of its polygon's box that is not wholly
    east of it, so a point's own bucket holds all edges that its ray may meet. Tiles of points and edges
    of one bucket are tested together. Outlines may pass the seam: longitudes are read from the polygon's
    west end on. Rows that share a point_id count as one, inside if they meet an odd number of edges.

    Totals are (unit_id, by, n, sums): pairs are counted in the tiles and never listed. n counts pairs; with
    groups or sums, the rows of the points in them. Nulls add nothing to a sum.
    """
    alone, shared = _by_number(points, point_id)
    unit = _kind(edges, "unit_id")
    if by is None and sums is None:
        out = _meet(alone, edges, [point_id], functools.partial(_pairs, point_id), f"{_kind(points, point_id)}, {unit}", step)
        return out if shared is None else out.unionByName(_odd_pairs(shared, edges, point_id, step))
    by, sums = by or [], sums or []
    rows = alone.select("lat", "lon", *by, *[F.col(c).cast("double").alias(c) for c in sums])
    kinds = [unit, *([_kind(points, *by)] if by else []), "n bigint", *[f"`{c}` double" for c in sums]]
    out = _meet(rows, edges, [*by, *sums], functools.partial(_totals, by, sums), ", ".join(kinds), step)
    total = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums]
    if shared is not None:
        odd = _odd_pairs(shared, edges, point_id, step)
        odd = odd.join(shared, point_id) if by or sums else odd
        out = out.unionByName(odd.groupBy("unit_id", *by).agg(F.count("*").alias("n"), *total))
    return out.groupBy("unit_id", *by).agg(F.sum("n").alias("n"), *total)


def first_polygon(points: DataFrame, edges: DataFrame, point_id: str,
                  step: float = 5.0) -> DataFrame:
    """Every point with the lowest unit that holds it, null when none. A tile lists only the lowest of its units for a point."""
    alone, shared = _by_number(points, point_id)
    kind = f"{_kind(points, point_id)}, {_kind(edges, 'unit_id')}"
    hits = _meet(alone, edges, [point_id], functools.partial(_lowest, point_id), kind, step)
    if shared is not None:
        hits = hits.unionByName(_odd_pairs(shared, edges, point_id, step))
    one = hits.groupBy(point_id).agg(F.min("unit_id").alias("unit_id"))
    return points.select(point_id).join(one, point_id, "left")


def master_grid(spark, d: float, lat0: float = -90.0, lat1: float = 90.0) -> DataFrame:
    """Cell centres of a regular global grid, generated in the tasks."""
    rows, cols = int(round((lat1 - lat0) / d)), int(round(360 / d))
    return spark.range(rows * cols).select(
        F.col("id").alias("cell_id"), F.floor(F.col("id") / cols).alias("i"),
        (F.col("id") % cols).alias("j")).select(
        "cell_id", "i", "j", (F.lit(lat0) + (F.col("i") + 0.5) * d).alias("lat"),
        (F.lit(-180.0) + (F.col("j") + 0.5) * d).alias("lon"))


def unit_raster(edges: DataFrame, d: float, lat0: float = -90.0, lat1: float = 90.0) -> DataFrame:
    """cell_id, i, j, lat, lon, unit_id: each centre of the global grid gets the lowest unit that holds it, or none.

    Scan lines: an edge meets each row of centres between its ends once, where it crosses the row. The crossings of an
    outline in a row, in order, are the ends of its covered spans, and only covered cells are listed. The work follows the
    outlines' heights and the cells inside, not cells times edges. Even-odd rule and seam as in points_in_polygons.
    """
    rows, cols = int(round((lat1 - lat0) / d)), int(round(360 / d))
    box = edges.groupBy("unit_id").agg(F.min(F.least("x1", "x2")).alias("_x0"))
    lat = F.lit(lat0) + (F.col("i") + 0.5) * d
    first = F.greatest(F.floor((F.least("y1", "y2") - lat0) / d - 0.5), F.lit(0))
    last = F.least(F.ceil((F.greatest("y1", "y2") - lat0) / d - 0.5), F.lit(rows - 1))
    met = (edges.where("y1 <> y2").join(box, "unit_id").where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
           .where((F.col("y1") > lat) != (F.col("y2") > lat)))
    cross = F.try_divide((F.col("x2") - F.col("x1")) * (lat - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    ends = met.groupBy("unit_id", "_x0", "i").agg(F.sort_array(F.collect_list(cross)).alias("_c"))
    span = F.transform(F.sequence(F.lit(1), F.size("_c") - 1, F.lit(2)),
                       lambda k: F.struct(F.element_at("_c", k).alias("lo"), F.element_at("_c", k + 1).alias("hi")))
    spans = ends.where(F.size("_c") > 1).select("unit_id", "_x0", "i", F.inline(span))
    left, right = F.floor((F.col("lo") + 180.0) / d - 0.5), F.ceil((F.col("hi") + 180.0) / d - 0.5)
    cells = spans.withColumn("j", F.explode(F.sequence(left, right))).withColumn("j", F.pmod("j", F.lit(cols)))
    lon = F.lit(-180.0) + (F.col("j") + 0.5) * d
    east = F.when(lon < F.col("_x0"), lon + 360).when(lon >= F.col("_x0") + 360, lon - 360).otherwise(lon)
    held = cells.where((east >= F.col("lo")) & (east < F.col("hi"))).groupBy("i", "j").agg(F.min("unit_id").alias("unit_id"))
    return master_grid(edges.sparkSession, d, lat0, lat1).join(held, ["i", "j"], "left")


def contiguity(cell_unit: DataFrame, n_cols: int) -> DataFrame:
    """Unordered unit pairs whose cells touch, at the raster's resolution."""
    have = cell_unit.where("unit_id is not null").select("i", "j", "unit_id")
    steps = F.array(F.struct(F.lit(0).alias("di"), F.lit(1).alias("dj")),
                    F.struct(F.lit(1).alias("di"), F.lit(0).alias("dj")))
    wanted = have.select(F.col("unit_id").alias("u"), "i", "j", F.explode(steps).alias("s")).select(
        "u", (F.col("i") + F.col("s.di")).alias("i"),
        F.pmod(F.col("j") + F.col("s.dj"), F.lit(n_cols)).cast("bigint").alias("j"))
    pairs = wanted.join(have, ["i", "j"]).where("u <> unit_id")
    return pairs.select(F.least("u", "unit_id").alias("src"),
                        F.greatest("u", "unit_id").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def contiguity_graph(cell_unit: DataFrame, units: DataFrame, n_cols: int, k: int = 4) -> DataFrame:
    """(src, dst), both ways: touching units, and the k nearest of each unit that touches none.

    Degrees are those of a map, so links grow in line with the units.
    """
    touching = both_ways(contiguity(cell_unit, n_cols))
    lone = units.join(touching.select(F.col("src").alias("unit_id")).distinct(), "unit_id", "left_anti")
    near = nearest_k(lone, units, k)
    return touching.unionByName(both_ways(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))).distinct()


def inside_fraction(cells: DataFrame, fine: float, member: str, inside: str) -> DataFrame:
    """Area share of each member's fine cells that carry the other membership."""
    area = cell_area_km2(F.col("lat"), fine, fine)
    hit = F.when(F.col(inside).isNotNull(), area).otherwise(0.0)
    return cells.where(F.col(member).isNotNull()).groupBy(member).agg(
        F.try_divide(F.sum(hit), F.sum(area)).alias("fraction"), F.count("*").alias("cells"))


def land_fraction(fine_cells: DataFrame, value: str, lat0: float, lon0: float,
                  coarse: float) -> DataFrame:
    """Share of fine cells with a value in each coarse cell."""
    ci, cj = grid_index(F.col("lat"), F.col("lon"), lat0, lon0, coarse)
    return fine_cells.groupBy(ci.alias("ci"), cj.alias("cj")).agg(
        F.avg(F.col(value).isNotNull().cast("double")).alias("land_fraction"),
        F.count("*").alias("cells"))


def with_fallback(units: DataFrame, overlap: DataFrame, unit: str, lat0: float, lon0: float,
                  d: float) -> DataFrame:
    """Overlap rows plus, for units with none, the cell their centre lies in."""
    ci, cj = grid_index(F.col("lat"), F.col("lon"), lat0, lon0, d)
    lone = units.join(overlap.select(unit).distinct(), unit, "left_anti").select(
        unit, ci.alias("ci"), cj.alias("cj"), F.lit(1.0).alias("weight"),
        F.lit(True).alias("fallback"))
    return overlap.select(unit, "ci", "cj", "weight", F.lit(False).alias("fallback")).unionByName(lone)


def within_radius(left: DataFrame, right: DataFrame, km: float, step: float | None = None) -> DataFrame:
    """Pairs (a, b, km) of left(a, lat, lon) and right(b, lat, lon) no further than km.

    The left side is listed under the buckets its circle may touch, so candidates
    are bounded by the circle. Buckets are about as wide as km, and crowded ones are dealt to parts.
    """
    return _near(left, right, km, step, F.col("km") <= km).select("a", "b", "km")


def _near(left: DataFrame, right: DataFrame, km: float, step: float | None, fits: Column) -> DataFrame:
    """left(a, lat, lon, ...) beside right(b, lat, lon) within km, where ``fits`` holds."""
    step = step or float(max((s for s in NEAR_STEPS if s <= km / 100), default=1))
    more = [c for c in left.columns if c not in ("a", "lat", "lon")]
    at, far = ["_bi", "_bj"], F.lit(km / 111.0)
    spread = F.when(F.abs("lat") + far >= 89.0, F.lit(180.0)).otherwise(
        far / F.cos(F.radians(F.abs(F.col("lat")) + far)))
    spread = F.least(spread, F.lit(180.0))

    def ends(side: int) -> list[Column]:
        p, l = F.radians("lat"), F.radians("lon")
        vector = (F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))
        return [F.col(c).alias(f"_{c}{side}") for c in ("lat", "lon")] + [v.alias(f"_{c}{side}") for c, v in zip("xyz", vector)]

    bi, bj = bucket(F.col("lat"), F.col("lon"), step)
    rb = right.select("b", *ends(2), bi.alias("_bi"), bj.alias("_bj"))
    # One row for each bucket of the globe at most.
    parts = F.broadcast(rb.groupBy(*at).agg(F.ceil(F.count("*") / NEAR_TILE).alias("_n")))
    rb = rb.join(parts, at).withColumn("_part", F.pmod(F.xxhash64("b", "_lat2", "_lon2"), "_n")).drop("_n")
    la = left.select("a", *more, *ends(1), F.inline(buckets_of_box(
        F.col("lat") - far, F.col("lat") + far, F.col("lon") - spread, F.col("lon") + spread, step)).alias("_bi", "_bj"))
    la = la.join(parts, at).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
    key = [*at, "_part"]
    # The straight line through the Earth costs a few products; it drops most candidates before the distance is worked out.
    line = F.lit(0.0)
    for c in "xyz":
        line = line + (F.col(f"_{c}1") - F.col(f"_{c}2")) * (F.col(f"_{c}1") - F.col(f"_{c}2"))
    limit = (2 * math.sin(min(km / R_HAVERSINE, math.pi) / 2)) ** 2 * (1 + 1e-9) + 1e-12
    d = haversine_km(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2"))
    # Listed rows are many more than Spark takes them for, so none are broadcast.
    met = _spread(la, *key).hint("merge").join(_spread(rb, *key), key).where(line <= limit)
    return met.withColumn("km", d).where((F.col("km") <= km) & fits).select("a", "b", "km", *more)


def nearest_within(left: DataFrame, right: DataFrame, km: float, step: float | None = None) -> DataFrame:
    """The nearest row of right (the lowest b of several) for each a within km.

    First the least distance of every a, a number that tasks keep up to date without sorting pairs; then only the rows at it.
    """
    least = within_radius(left, right, km, step).groupBy("a").agg(F.min("km").alias("_least"))
    told = least.withColumnRenamed("a", "_a")
    known = left.join(told, F.col("a").eqNullSafe(F.col("_a"))).select("a", "lat", "lon", "_least")
    near = _near(known, right, km, step, F.col("km") <= F.col("_least"))
    return near.groupBy("a").agg(F.min(F.struct("km", "b")).alias("_m")).select(
        "a", F.col("_m.b").alias("b"), F.col("_m.km").alias("km"))


def nearest_k(lone: DataFrame, units: DataFrame, k: int,
              reach_km: tuple[float, ...] = (300.0, 1200.0, 5000.0, 20100.0)) -> DataFrame:
    """k nearest units (other than itself) of each lone unit.

    The search widens only for units that found fewer than k; the last reach is
    half the globe, so the answer is complete. Buckets grow with the reach.
    """
    right = units.select(F.col("unit_id").alias("b"), "lat", "lon")
    found, open_ = None, cut_lineage(lone.select(F.col("unit_id").alias("a"), "lat", "lon"))
    place = F.row_number().over(W.partitionBy("a").orderBy("km", "b"))
    for km in reach_km:
        near = within_radius(open_, right, km, min(30.0, max(1.0, km / 100))).where("a <> b")
        near = cut_lineage(near.withColumn("_r", place).where(F.col("_r") <= k).drop("_r"))
        enough = near.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("a")
        if km < reach_km[-1]:
            open_ = cut_lineage(open_.join(enough, "a", "left_anti"))
            done = open_.isEmpty()
            near = near.join(enough, "a", "left_semi")
        else:
            done = True
        found = near if found is None else found.unionByName(near)
        if done:
            return found
    return found


def outline_measures(edges: DataFrame) -> DataFrame:
    """Area and centroid from shoelace sums on equal-area coordinates."""
    p = edges.select("unit_id", equal_area_x(F.col("x1")).alias("x1"), equal_area_y(F.col("y1")).alias("y1"),
                     equal_area_x(F.col("x2")).alias("x2"), equal_area_y(F.col("y2")).alias("y2"))
    turn = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    s = p.groupBy("unit_id").agg(F.sum(turn).alias("a2"),
                                 F.sum((F.col("x1") + F.col("x2")) * turn).alias("sx"),
                                 F.sum((F.col("y1") + F.col("y2")) * turn).alias("sy"))
    cx, cy = F.try_divide(F.col("sx"), 3 * F.col("a2")), F.try_divide(F.col("sy"), 3 * F.col("a2"))
    unit_x = equal_area_x(F.lit(1.0))
    unit_y = equal_area_y(F.lit(90.0))
    return s.select("unit_id", (F.abs("a2") / 2).alias("area_km2"), (cx / unit_x).alias("lon"),
                    F.degrees(F.asin(cy / unit_y)).alias("lat"))
