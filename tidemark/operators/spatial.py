"""Spatial statistics.

Values live in units(unit_id, x), links in edges(src, dst, w). Statistics over
all pairs of units never emit the pairs: units are cut into tiles of about the
same number along a space-filling curve, and each task takes one pair of tiles
and returns sums. A tile is bounded by construction, so there is no hot group,
and pairs of tiles that lie farther apart than a statistic reaches are not built.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geo import R_HAVERSINE, R_MEAN
from tidemark.functions.stats import harmonic_sum
from tidemark.operators.order import dense_index, salted_join, value_counts
from tidemark.session import cut_lineage

# Distance bands in km.
BANDS = [(0, 250), (250, 500), (500, 750), (750, 1000), (1000, 1500), (1500, 2000),
         (2000, 3000), (3000, 4000), (4000, 6000)]
TILE = 512
#: Steps of the space-filling curve on each axis (powers of two), and the least width of a bucket of tiles in Earth radii.
CURVE_BITS, BUCKET = 12, 0.25
#: Rounds of a permutation, and the multiplier and width of the hash that decides in them.
ROUNDS, MIX, MASK = 24, 73244475, (1 << 32) - 1
#: Up to this many values (16 MB) are copied to every task to be dealt; more are joined by place.
COPIED_VALUES = 1 << 21
#: Dealt values that a task holds at once.
DEALT_AT_ONCE = 1 << 17


def spread(df: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    """Hash partitions of a fixed number. Small rows with much work each would else be merged into few tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(parts, groups or parts), *keys)


# --- multiple testing -----------------------------------------------------------

def multiple_testing(df: DataFrame, p: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Counts and largest accepted p: raw, Bonferroni, step-up, step-up under dependence."""
    keys = keys or []
    counts = value_counts(df, p, keys)
    rank, m = F.col("before") + F.col("n"), F.col("total")

    def accepted(limit: Column) -> tuple[Column, Column]:
        return (F.coalesce(F.max(F.when(F.col(p) <= limit, rank)), F.lit(0)),
                F.max(F.when(F.col(p) <= limit, F.col(p))))

    c = harmonic_sum(m)
    bh_n, bh_p = accepted(alpha * rank / m)
    by_n, by_p = accepted(alpha * rank / (m * c))
    bonf_n, _ = accepted(alpha / m)
    return counts.groupBy(*keys).agg(
        F.max(m).alias("n_tested"), F.max(c).alias("c_m"), F.max(alpha / m).alias("bonferroni_cut"),
        F.coalesce(F.sum(F.when(F.col(p) < alpha, F.col("n"))), F.lit(0)).alias("n_raw"),
        bonf_n.alias("n_bonferroni"), bh_n.alias("n_bh"), bh_p.alias("bh_cut"),
        by_n.alias("n_by"), by_p.alias("by_cut"))


def accept_mask(df: DataFrame, p: str, alpha: float = 0.05, out: str = "accepted",
                keys: list[str] | None = None) -> DataFrame:
    """True where p is at or below the step-up cut that holds under dependence."""
    cuts = multiple_testing(df, p, alpha, keys)
    if keys:
        cut = F.col("_cut")
        df = df.join(cuts.select(*keys, F.col("by_cut").alias("_cut")), keys, "left")
    else:
        cut = cuts.select("by_cut").scalar()
    return df.withColumn(out, F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_cut")


# --- Moran's I --------------------------------------------------------------------

def row_standardise(edges: DataFrame) -> DataFrame:
    """Every unit's outgoing weights sum to one."""
    total = edges.groupBy("src").agg(F.sum("w").alias("_t"))
    return salted_join(edges, total, ["src"]).select("src", "dst", F.try_divide(F.col("w"), F.col("_t")).alias("w"))


def centred(units: DataFrame, *carried: Column) -> DataFrame:
    mean = units.agg(F.avg("x").alias("m")).select("m").scalar()
    return units.where("x is not null").select("unit_id", (F.col("x") - mean).alias("z"), *carried)


def _linked(z: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    a = z.select(*keys, F.col("unit_id").alias("src"), F.col("z").alias("z1"))
    b = z.select(*keys, F.col("unit_id").alias("dst"), F.col("z").alias("z2"))
    return edges.join(a, "src").join(b, ["dst", *keys])


def morans_i(units: DataFrame, edges: DataFrame) -> DataFrame:
    """I = n / S0 * sum(w z z) / sum(z z), one row."""
    z = centred(units)
    size = z.agg(F.array(F.count("*").cast("double"), F.sum(F.col("z") * F.col("z"))).alias("s"))
    sums = _linked(z, edges, []).agg(F.sum(F.col("w") * F.col("z1") * F.col("z2")).alias("num"),
                                     F.sum("w").alias("s0"), F.count("*").alias("links"))
    return (sums.withColumn("_s", size.scalar()).withColumn("n", F.col("_s")[0].cast("bigint")).withColumn("_zz", F.col("_s")[1])
            .select("n", "links", F.try_divide(F.col("n") * F.col("num"), F.col("s0") * F.col("_zz")).alias("i"),
                    F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("e_i")))


@functools.lru_cache(maxsize=2)
def round_keys(seed: str, n_perm: int) -> np.ndarray:
    """(permutation, round, [pivot, a, b]) from the md5 of seed, permutation and round; permutations count from 1."""
    def keys(perm: int, r: int) -> tuple[int, int, int]:
        mark = hashlib.md5(f"{seed}|{perm}|{r}".encode()).hexdigest()
        return int(mark[:13], 16), int(mark[13:20], 16), int(mark[20:27], 16)

    return np.array([[keys(k, r) for r in range(ROUNDS)] for k in range(1, n_perm + 1)], "int64").reshape(n_perm, ROUNDS, 3)


def dealt_places(place: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The place whose value each given place gets, one column a permutation.

    A swap-or-not shuffle: in each round a place and its mirror about the pivot change over or stay, as
    a keyed hash of the larger of the two says. That permutes 0..n-1 for every n below 2^31, and one
    place is worked out without the others, so nothing is sorted and no permutation is held.
    """
    size = np.uint32(n)
    x = np.repeat(place.astype("uint32")[:, None], len(keys), axis=1)
    pivots, first, second = (keys[:, :, 0] % n).astype("uint32"), keys[:, :, 1].astype("uint32"), keys[:, :, 2].astype("uint32")
    for r in range(ROUNDS):
        # Arithmetic wraps at 32 bits, so of mirror and mirror + n the right one is the smaller.
        mirror = pivots[:, r] - x
        np.minimum(mirror, mirror + size, out=mirror)
        t = np.maximum(x, mirror)
        t += first[:, r]
        t ^= t >> np.uint32(16)
        t *= np.uint32(MIX)
        t += second[:, r]
        t ^= t >> np.uint32(16)
        t *= np.uint32(MIX)
        np.copyto(x, mirror, where=t > np.uint32(MASK >> 1))
    return x.astype("int64")


def _copied(placed: DataFrame, n: int):
    """The values by place, for every task; the caller has checked their number."""
    pdf = placed.select("idx", "z").toPandas()
    values = np.empty(n)
    values[pdf["idx"].to_numpy("int64")] = pdf["z"].to_numpy("float64")
    return placed.sparkSession.sparkContext.broadcast(values)


def _numbered(z: DataFrame) -> tuple[DataFrame, int]:
    placed = cut_lineage(dense_index(z, "unit_id").select("unit_id", "idx", *[c for c in z.columns if c != "unit_id"]))
    return placed, placed.count()


def shuffles(z: DataFrame, n_perm: int, seed: str, batch: int, copied: int = COPIED_VALUES) -> DataFrame:
    """(part, unit_id, deal): one array of dealt values for each unit and ``batch`` permutations.

    The deal follows from seed, permutation and the unit's place alone (dealt_places). Up to ``copied``
    values are copied to the tasks; more are joined by place, which deals the same.
    """
    return _shuffled(*_numbered(z), n_perm, seed, batch, copied)


def _shuffled(placed: DataFrame, n: int, n_perm: int, seed: str, batch: int, copied: int) -> DataFrame:
    values = _copied(placed, n) if n <= copied else None
    kind = "bigint" if values is None else "double"

    def deal(batches):
        keys = round_keys(seed, n_perm)
        for pdf in batches:
            for part, rows in pdf.groupby("part"):
                own = keys[part * batch:(part + 1) * batch]
                step = max(1, DEALT_AT_ONCE // len(own))
                for k in range(0, len(rows), step):
                    some = rows.iloc[k:k + step]
                    got = dealt_places(some["idx"].to_numpy(), n, own)
                    yield pd.DataFrame({"part": part, "unit_id": some["unit_id"], "deal": list(got if values is None else values.value[got])})

    parts = F.sequence(F.lit(0), F.lit((n_perm - 1) // batch))
    unit = placed.schema["unit_id"].dataType.simpleString()
    dealt = (spread(placed.select("unit_id", "idx", F.explode(parts).alias("part")), "unit_id", "part")
             .mapInPandas(deal, f"part int, unit_id {unit}, deal array<{kind}>"))
    if values is not None:
        return dealt
    asked = dealt.select("part", "unit_id", F.posexplode("deal").alias("perm", "idx"))
    told = asked.join(placed.select("idx", "z"), "idx")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("perm", "z"))), lambda x: x["z"])
    return told.groupBy("part", "unit_id").agg(in_order.alias("deal"))


def moran_permutation(units: DataFrame, edges: DataFrame, n_perm: int, seed: str = "20260916",
                      batch: int = 250, copied: int = COPIED_VALUES) -> DataFrame:
    """Moran's I with its permutation spread, z and one-sided p, one row.

    An edge carries the places of its ends, and a task deals to the ends of its edges, ``batch``
    permutations at a time; the products add up in the task, and one number for each permutation and
    task goes on. Edges go to tasks in the order of their sources, along a space-filling curve if units
    have lat and lon, so that edges dealt together share most of their ends; any order gives the same
    sums. Beyond ``copied`` units the dealt values travel to the edges as arrays.
    """
    somewhere = {"lat", "lon"} <= set(units.columns)
    at = curve_key(unit_vector(F.col("lat"), F.col("lon"))) if somewhere else F.lit(0)
    z, n = _numbered(centred(units, at.alias("at")))
    obs = morans_i(units, edges)
    if n <= copied:
        values = _copied(z, n)
        linked = edges.join(z.select(F.col("unit_id").alias("src"), F.col("idx").alias("i1"), "at"), "src").join(
            z.select(F.col("unit_id").alias("dst"), F.col("idx").alias("i2")), "dst")

        def dealt_products(batches):
            keys, num, s0, seen = round_keys(seed, n_perm), np.zeros(n_perm), 0.0, False
            for pdf in batches:
                w = pdf["w"].to_numpy("float64")
                if not len(w):
                    continue
                ends, at = np.unique(pdf[["i1", "i2"]].to_numpy("int64"), return_inverse=True)
                at = at.reshape(-1, 2)
                step = max(1, min(batch, DEALT_AT_ONCE // max(len(ends), len(w))))
                for k in range(0, n_perm, step):
                    dealt = values.value[dealt_places(ends, n, keys[k:k + step])]
                    num[k:k + step] += np.einsum("e,ep,ep->p", w, dealt[at[:, 0]], dealt[at[:, 1]])
                s0, seen = s0 + w.sum(), True
            if seen:
                yield pd.DataFrame({"perm": np.arange(n_perm), "num": num, "s0": s0})

        order, parts = ["at", "i1", "i2"], int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sums = (linked.select("w", *order).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("w", "i1", "i2")
                .mapInPandas(dealt_products, "perm int, num double, s0 double")
                .groupBy("perm").agg(F.sum("num").alias("num"), F.sum("s0").alias("s0")))
    else:
        dealt = _shuffled(z, n, n_perm, seed, batch, copied)
        a = dealt.select("part", F.col("unit_id").alias("src"), F.col("deal").alias("d1"))
        b = dealt.select("part", F.col("unit_id").alias("dst"), F.col("deal").alias("d2"))

        def products(batches):
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for part, own in pdf.groupby("part"):
                    w = own["w"].to_numpy("float64")
                    more = np.append((w[:, None] * np.array(own["d1"].tolist()) * np.array(own["d2"].tolist())).sum(axis=0), w.sum())
                    sums[part] = sums.get(part, 0.0) + more
            for part, total in sums.items():
                yield pd.DataFrame({"part": part, "perm": np.arange(len(total) - 1), "num": total[:-1], "s0": total[-1]})

        sums = (edges.join(a, "src").join(b, ["part", "dst"]).select("part", "w", "d1", "d2")
                .mapInPandas(products, "part int, perm int, num double, s0 double")
                .groupBy("part", "perm").agg(F.sum("num").alias("num"), F.sum("s0").alias("s0")))
    size = z.agg(F.array(F.count("*").cast("double"), F.sum(F.col("z") * F.col("z"))).alias("s"))
    sims = (sums.withColumn("_s", size.scalar()).withColumn("n", F.col("_s")[0].cast("bigint")).withColumn("_zz", F.col("_s")[1])
            .withColumn("i_obs", obs.select("i").scalar())
            .withColumn("sim", F.try_divide(F.col("n") * F.col("num"), F.col("s0") * F.col("_zz"))))
    # Sums in another order differ in the last digits, so equality needs a tolerance.
    reached = F.count_if(F.col("sim") >= F.col("i_obs") - 1e-12)
    sd = F.stddev_pop("sim")
    return sims.agg(F.max("n").alias("n"), F.max("i_obs").alias("i"), sd.alias("sd_perm"),
                    F.try_divide(F.max("i_obs") - F.avg("sim"), sd).alias("z_perm"),
                    ((reached + 1) / (F.count("*") + 1)).alias("p_perm"), F.count("*").alias("n_perm"))


# --- all pairs by tiles --------------------------------------------------------------

def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """x, y, z on the unit sphere. Without a seam or poles, unlike degrees."""
    p, l = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)]


def curve_key(xyz: list[Column], bits: int = CURVE_BITS) -> Column:
    """Place along a Z-order curve through the cube around the sphere."""
    steps = [F.least(F.floor((c + 1) * (1 << (bits - 1))), F.lit((1 << bits) - 1)) for c in xyz]
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for axis, step in enumerate(steps):
            key = key + F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)), 3 * bit + axis)
    return key


def placed_units(units: DataFrame, tile: int = TILE) -> DataFrame:
    """(unit_id, lat, lon, x, y, z, mine): the tile of every unit along the curve.

    Units of one curve cell that are more than a tile are dealt to several tiles by a hash, so a tile
    has at most about three times ``tile`` units wherever they crowd. Units without a place have no pairs.
    """
    rows = units.select("unit_id", "lat", "lon", *[c.alias(a) for a, c in zip("xyz", unit_vector(F.col("lat"), F.col("lon")))])
    rows = rows.where("x is not null and y is not null and not isnan(x + y + z)").withColumn("_key", curve_key([F.col(a) for a in "xyz"]))
    counts = value_counts(rows.select("_key"), "_key").select("_key", "n", "before")
    part = F.pmod(F.xxhash64("unit_id"), F.ceil(F.col("n") / tile))
    mine = (F.floor(F.col("before") / tile) + part).cast("bigint")
    return salted_join(rows, counts, ["_key"]).withColumn("mine", mine).drop("_key", "n", "before")


def near_tiles(placed: DataFrame, reach_km: float | None = None) -> DataFrame:
    """(ta, tb), ta <= tb: pairs of tiles that may hold units within reach_km of each other; all pairs without a reach.

    A tile is known by its box in x, y, z, and two tiles meet in the buckets that one box and the other,
    widened by the reach, both touch; the first common bucket lists the pair.
    """
    ends = [f(a).alias(f"{a}_{name}") for a in "xyz" for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("mine").agg(*ends)
    if reach_km is None:
        last = boxes.agg(F.max("mine")).scalar()
        return boxes.select(F.col("mine").alias("ta"), F.explode(F.sequence(F.col("mine"), last)).alias("tb"))
    # The straight line through the Earth, a little more for rounding.
    chord = 2 * np.sin(min(reach_km / min(R_MEAN, R_HAVERSINE), np.pi) / 2) + 1e-9
    side = max(chord, BUCKET)

    def listed(t: str, widen: float) -> DataFrame:
        rows = boxes.select(F.col("mine").alias(t), *[F.col(f"{a}_{e}").alias(f"{t}_{a}_{e}") for a in "xyz" for e in ("lo", "hi")])
        for a in "xyz":
            first, final = (F.floor((F.col(f"{t}_{a}_{e}") + w) / side) for e, w in (("lo", -widen), ("hi", widen)))
            rows = rows.withColumn(f"{t}_{a}_first", first).withColumn(f"_{a}", F.explode(F.sequence(first, final)))
        return rows

    met = listed("ta", 0.0).join(listed("tb", chord), ["_x", "_y", "_z"]).where("ta <= tb")
    gap = F.lit(0.0)
    for a in "xyz":
        met = met.where(F.col(f"_{a}") == F.greatest(f"ta_{a}_first", f"tb_{a}_first"))
        apart = F.greatest(F.lit(0.0), F.col(f"ta_{a}_lo") - F.col(f"tb_{a}_hi"), F.col(f"tb_{a}_lo") - F.col(f"ta_{a}_hi"))
        gap = gap + apart * apart
    return met.where(gap <= float(chord * chord)).select("ta", "tb")


def tile_pairs(units: DataFrame, tile: int = TILE, reach_km: float | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Every unit once for each pair of tiles it takes part in: ``ta``, ``tb``, ``mine``.

    units(unit_id, lat, lon); further columns come by unit_id from ``carried``, after the tiles are known.
    """
    # Read by the boxes and by the rows: stored once, so that the units are worked out once.
    placed = cut_lineage(placed_units(units, tile))
    pairs = near_tiles(placed, reach_km)
    sides = pairs.select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("mine"))
    rows = placed.drop("x", "y", "z")
    if carried is not None:
        rows = rows.join(carried, "unit_id")
    return spread(rows.join(sides, "mine"), "ta", "tb")


def _split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    ta, tb = int(pdf["ta"].iloc[0]), int(pdf["tb"].iloc[0])
    pdf = pdf.sort_values("unit_id")
    a = pdf[pdf["mine"] == ta]
    return a, (a if ta == tb else pdf[pdf["mine"] == tb]), ta == tb


def _haversine(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    p1, p2 = np.radians(a["lat"].to_numpy())[:, None], np.radians(b["lat"].to_numpy())[None, :]
    dl = np.radians(b["lon"].to_numpy())[None, :] - np.radians(a["lon"].to_numpy())[:, None]
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    return 2 * R_HAVERSINE * np.arcsin(np.sqrt(h))


def _great_circle(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    p1, p2 = np.radians(a["lat"].to_numpy())[:, None], np.radians(b["lat"].to_numpy())[None, :]
    dl = np.radians(a["lon"].to_numpy())[:, None] - np.radians(b["lon"].to_numpy())[None, :]
    dot = np.sin(p1) * np.sin(p2) + np.cos(p1) * np.cos(p2) * np.cos(dl)
    return R_MEAN * np.arccos(np.clip(dot, -1, 1))


def _pairwise_r(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson r of every row of a with every row of b over their common months."""
    ma, mb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    xa, xb = np.nan_to_num(a), np.nan_to_num(b)
    n = ma @ mb.T
    with np.errstate(invalid="ignore", divide="ignore"):
        sa, sb = (xa @ mb.T) / n, (ma @ xb.T) / n
        cov = (xa @ xb.T) / n - sa * sb
        va, vb = ((xa ** 2) @ mb.T) / n - sa ** 2, (ma @ (xb ** 2).T) / n - sb ** 2
        return np.where((va > 0) & (vb > 0), cov / np.sqrt(va * vb), np.nan)


def pair_decorrelation(vectors: DataFrame, width: float = 50.0, adjacent_km: float = 130.0,
                       min_months: int = 100, reach_km: float | None = None, tile: int = TILE) -> DataFrame:
    """Correlation of every pair of units against distance, in right-closed bins.

    vectors(unit_id, lat, lon, vec): deseasonalised values on one month axis. Only units with more
    than ``min_months`` values take part. Adds the adjacent pairs as bin 0 with their mean and lowest r.
    With ``reach_km``, pairs farther apart are left out, and tiles of them never meet.
    """
    observed = F.size(F.filter("vec", lambda v: v.isNotNull() & ~F.isnan(v)))
    vectors = cut_lineage(vectors.where(observed > min_months))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _split(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["bin", "n", "s", "q", "low"])
        r = _pairwise_r(np.array(a["vec"].tolist(), dtype=float), np.array(b["vec"].tolist(), dtype=float))
        d = _haversine(a, b)
        keep = np.triu(np.ones_like(d, dtype=bool), 1) if same else np.ones_like(d, dtype=bool)
        keep &= np.isfinite(r) if reach_km is None else np.isfinite(r) & (d <= reach_km)
        d, r = d[keep], r[keep]
        bins = pd.DataFrame({"bin": np.ceil(d / width).astype("int64"), "r": r})
        near = pd.DataFrame({"bin": np.zeros(int((d < adjacent_km).sum()), "int64"), "r": r[d < adjacent_km]})
        both = pd.concat([bins[bins["bin"] > 0], near])
        both["q"] = both["r"] ** 2
        return both.groupby("bin", as_index=False).agg(n=("r", "size"), s=("r", "sum"), q=("q", "sum"),
                                                       low=("r", "min"))

    sums = tile_pairs(vectors, tile, reach_km, vectors.select("unit_id", "vec")).groupBy("ta", "tb").applyInPandas(
        kernel, "bin bigint, n bigint, s double, q double, low double")
    t = sums.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
                                F.min("low").alias("min_r"))
    var = F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)
    return t.select("bin", "n", (F.col("s") / F.col("n")).alias("mean_r"),
                    F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_r"), "min_r",
                    ((F.col("bin") - 0.5) * width).alias("dist_mid"))


def crossing_distance(bins: DataFrame, level: float) -> Column:
    return F.min(F.when((F.col("bin") > 0) & (F.col("mean_r") < level), F.col("dist_mid")))


def effective_modes(dev: DataFrame, unit: str, month: str, v: str) -> DataFrame:
    """Effective degrees of freedom (tr C)^2 / tr(C C) from centred complete values.

    Both traces are the same for the month-by-month products, whose size is the record length
    whatever the number of units.
    """
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    trace, square = F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))), F.sum(F.col("c") * F.col("c") * twice)
    return month_products(dev, unit, month, v).agg(F.try_divide(trace * trace, square).alias("effective_dof"), trace.alias("total_variance"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mode_shares(upper: pd.Series) -> pd.Series:
    """Shares of variance by mode, largest first, from the upper triangle of one covariance."""
    out = []
    for row in upper:
        k = int((np.sqrt(8 * len(row) + 1) - 1) / 2)
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = np.asarray(row, dtype=float)
        vals = np.clip(np.linalg.eigvalsh(m, UPLO="U")[::-1], 0, None)
        out.append((vals / vals.sum()).tolist())
    return pd.Series(out)


def month_products(dev: DataFrame, unit: str, month: str, v: str) -> DataFrame:
    """(i, j, c): sums over units of the products of months i <= j. dev holds centred values, complete on every month."""
    # One vector per unit: bounded by the record length.
    vec = dev.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct(month, v))),
                                            lambda s: s[v]).alias("vec"))

    def partial(batches):
        total, k = None, 0
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vec"].tolist(), dtype=float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(total.shape[0])
            yield pd.DataFrame({"i": i, "j": j, "c": total[i, j]})

    return vec.mapInPandas(partial, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c"))


def variance_modes(dev: DataFrame, unit: str, month: str, v: str) -> DataFrame:
    """Shares of variance by mode from the months x months products.

    The non-zero eigenvalues of the unit covariance are those of the month-by-
    month one, whose size is the record length whatever the number of units.
    dev holds centred values, complete on every month.
    """
    cells = month_products(dev, unit, month, v)
    listed = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "c"))),
                                   lambda s: s["c"]).alias("u"))
    return listed.select(F.posexplode(mode_shares("u")).alias("mode", "share"))


def mode_counts(shares: DataFrame, levels: list[float], min_rows: int = 25) -> DataFrame:
    """Modes needed for each share of variance; nothing for records of fewer than ``min_rows`` months.

    One row for each month of the record, so the window over all modes is bounded by the calendar.
    """
    upto = F.sum("share").over(W.partitionBy(F.lit(1)).orderBy(F.desc("share"), "mode"))
    rows = shares.withColumn("_upto", upto - F.col("share"))
    counts = [F.count_if(F.col("_upto") < level - 1e-12).alias(f"modes_{round(level * 100)}") for level in levels]
    return rows.agg(F.count("*").alias("n_months"), F.sum("share").alias("total_share"),
                    F.sum(F.col("share") * F.col("share")).alias("square_sum"), *counts).where(F.col("n_months") >= min_rows)


def band_moran(units: DataFrame, n_perm: int, seed: str = "20260916", bands=None,
               min_pairs: int = 50, tile: int = TILE) -> DataFrame:
    """Moran's I per distance band (lo, hi] with its permutation spread and p.

    units(unit_id, lat, lon, x). A unit carries its value and its value in every
    permutation; tiles multiply the band's 0/1 weights with them, and tiles farther
    apart than the last band do not meet. With n_perm 0 only the observed value is worked out.
    """
    bands = bands or BANDS
    z = centred(units)
    rows = z.select("unit_id", F.array("z").alias("vec"))
    if n_perm:
        dealt = shuffles(z, n_perm, seed, n_perm).select("unit_id", "deal")
        rows = rows.join(dealt, "unit_id").withColumn("vec", F.concat("vec", "deal")).drop("deal")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _split(pdf)
        out = []
        if len(a) and len(b):
            d = _great_circle(a, b)
            za, zb = np.array(a["vec"].tolist(), dtype=float), np.array(b["vec"].tolist(), dtype=float)
            keep = np.triu(np.ones_like(d, dtype=bool), 1) if same else np.ones_like(d, dtype=bool)
            for i, (lo, hi) in enumerate(bands):
                w = ((d > lo) & (d <= hi) & keep).astype(float)
                if w.any():
                    out.append((i, int(w.sum()), (za * (w @ zb)).sum(axis=0).tolist()))
        return pd.DataFrame(out, columns=["band", "pairs", "sums"])

    reach = float(max(hi for _, hi in bands))
    parts = tile_pairs(units, tile, reach, rows).groupBy("ta", "tb").applyInPandas(
        kernel, "band int, pairs bigint, sums array<double>")
    # One branch, so that the kernel runs once: pairs come along with every permutation.
    sims = (parts.select("band", "pairs", F.posexplode("sums").alias("perm", "s")).groupBy("band", "perm")
            .agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs")).where(F.col("pairs") >= min_pairs))
    size = z.agg(F.array(F.count("*").cast("double"), F.sum(F.col("z") * F.col("z"))).alias("s"))
    i = F.try_divide(F.col("_s")[0] * F.col("s"), F.col("pairs") * F.col("_s")[1])
    sims = sims.withColumn("_s", size.scalar()).withColumn("i", i)
    # A band has one row per permutation.
    sims = sims.withColumn("i_obs", F.max(F.when(F.col("perm") == 0, F.col("i"))).over(W.partitionBy("band")))
    sim = F.when(F.col("perm") > 0, F.col("i"))
    lo = F.element_at(F.array(*[F.lit(float(x)) for x, _ in bands]), F.col("band") + 1)
    hi = F.element_at(F.array(*[F.lit(float(x)) for _, x in bands]), F.col("band") + 1)
    return (sims.groupBy("band").agg(
        F.first("pairs").alias("pairs"), F.first("i_obs").alias("i"), F.stddev_pop(sim).alias("sd_perm"),
        ((F.count_if(sim >= F.col("i_obs") - 1e-12) + 1) / (F.count(sim) + 1)).alias("p_perm"))
        .select(F.col("band").cast("bigint").alias("band"), lo.alias("lo_km"), hi.alias("hi_km"),
                "pairs", "i", "sd_perm", "p_perm"))


def range_km(bands: DataFrame) -> DataFrame:
    """Decay length: weighted log fit through the origin over bands with I above 0.01."""
    mid = (F.col("lo_km") + F.col("hi_km")) / 2
    w = F.col("pairs")
    fit = F.try_divide(-F.sum(w * mid * mid), F.sum(w * mid * F.ln("i")))
    return bands.where("i > 0.01").agg(F.when(F.count("*") >= 2, fit).alias("range_km"))


def effective_n(units: DataFrame, range_table: DataFrame, tile: int = TILE) -> DataFrame:
    """n^2 over the sum of exp(-d / a) over all ordered pairs, the diagonal included."""
    length = range_table.select("range_km").scalar()
    rows = tile_pairs(units, tile).withColumn("a", length)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _split(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame({"s": [0.0], "n": [0], "a": [None]}).astype({"a": "float64"})
        d, length = _great_circle(a, b), a["a"].iloc[0]
        if same:
            np.fill_diagonal(d, 0.0)
        if length is None or not np.isfinite(length):
            total = float(len(a)) if same else 0.0
        else:
            total = float(np.exp(-d / length).sum()) * (1 if same else 2)
        return pd.DataFrame({"s": [total], "n": [len(a) if same else 0], "a": [length]}).astype({"a": "float64"})

    sums = rows.groupBy("ta", "tb").applyInPandas(kernel, "s double, n bigint, a double")
    n = F.sum("n")
    return sums.agg(n.alias("n"), F.max("a").alias("range_km"), F.try_divide(n * n, F.sum("s")).alias("n_eff"),
                    F.try_divide(n, F.sum("s")).alias("n_eff_share"))


# --- connected regions -------------------------------------------------------------------

def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()


def _star(edges: DataFrame, large: bool, salts: int) -> DataFrame:
    """One star step. The lowest neighbour per node combines before its shuffle."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        near = near.where("v <= u")
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = salted_join(near.where("v > u") if large else near, low, ["u"], salts=salts)
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(nodes: DataFrame, edges: DataFrame, salts: int = 8, max_rounds: int = 60) -> DataFrame:
    """(unit_id, component): lowest unit id reachable, by alternating star contraction.

    The number of rounds grows with the logarithm of the region size, not with
    its diameter. Lineage is cut by a reliable checkpoint each round; a node that
    most edges meet is spread over ``salts`` tasks.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut_lineage(e.where("u <> v").distinct())
    mark = _fingerprint(e)
    for _ in range(max_rounds):
        e = cut_lineage(_star(_star(e, True, salts), False, salts))
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "unit_id")
    return (nodes.select("unit_id").join(label, "unit_id", "left")
            .withColumn("component", F.coalesce("component", "unit_id")))


def component_summary(members: DataFrame, boxes: DataFrame, min_area: float) -> DataFrame:
    """members(component, unit_id, lat, lon, area, trend) -> one row per large component.

    The label is the box with the largest area share, if at least half.
    """
    from tidemark.operators.order import quantiles
    base = members.groupBy("component").agg(
        F.count("*").alias("units"), F.sum("area").alias("area"), F.min("lon").alias("lon_lo"),
        F.max("lon").alias("lon_hi"), F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi")
    ).where(F.col("area") >= min_area)
    median = quantiles(members, "trend", [0.5], ["component"]).select(
        "component", F.col("quantile").alias("median_trend"))
    on = (F.col("lon").between(F.col("b.lon_min"), F.col("b.lon_max"))
          & F.col("lat").between(F.col("b.lat_min"), F.col("b.lat_max")))
    # Boxes are a short list of names, held in one array beside each unit.
    listed = boxes.agg(F.collect_list(F.struct("name", "lon_min", "lon_max", "lat_min", "lat_max")).alias("b"))
    held = (members.withColumn("b", F.explode(listed.scalar())).where(on)
            .groupBy("component", F.col("b.name").alias("name")).agg(F.sum("area").alias("inside")))
    best = held.groupBy("component").agg(F.max_by(F.struct("name", "inside"), F.struct("inside", "name")).alias("_b"))
    share = F.coalesce(F.try_divide(F.col("_b.inside"), F.col("area")), F.lit(0.0))
    return (base.join(median, "component").join(best, "component", "left")
            .withColumn("label", F.when(share >= 0.5, F.col("_b.name")))
            .withColumn("share_inside", share).drop("_b"))


def identical_series(series: DataFrame, keys: list[str], month: str, v: str, area: str) -> DataFrame:
    """Cells with the same values in every month, grouped by their digest."""
    from tidemark.functions.text import series_fingerprint
    marks = series.groupBy(*keys).agg(series_fingerprint(F.collect_list(F.struct(month, v))).alias("fp"),
                                      F.first(area).alias("area"))
    return marks.groupBy("fp").agg(F.count("*").alias("cells"), F.sum("area").alias("area"))
