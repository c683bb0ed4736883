"""Near-duplicate vectors by a subspace pigeonhole join (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import partitions
from tidemark.operators.spatial import components
from tidemark.session import cut_lineage

#: Dimensions of a block; vectors of the sample from which cells are cut; vectors in a cell and in a side of a tile, about.
BLOCK_DIMS, SAMPLE, CELL, TILE = 8, 20_000, 2048, 8192
#: Rounding allowance on squared distances in single precision; candidates are verified in double precision.
SLACK = 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """Random orthogonal matrix: spreads a difference evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Cells:
    """Cuts a block's space into 2**depth boxes by medians of a sample; node i has the children 2i and 2i + 1."""

    def __init__(self, points: np.ndarray, depth: int, budget: float):
        self.depth, self.budget = depth, budget
        self.dim, self.cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        held = {1: points}
        for node in range(1, 1 << depth):
            p = held.pop(node)
            if len(p):
                self.dim[node] = int(np.argmax(p.std(axis=0)))
                self.cut[node] = float(np.median(p[:, self.dim[node]]))
            right = p[:, self.dim[node]] > self.cut[node]
            held[2 * node], held[2 * node + 1] = p[~right], p[right]

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.cut[node])
        return node - (1 << self.depth)

    def reach(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every box that the ball of the budget around a point meets."""
        row, node = np.arange(len(points)), np.ones(len(points), dtype=np.int64)
        off = np.zeros_like(points)
        for _ in range(self.depth):
            d = self.dim[node]
            side = points[row, d] - self.cut[node]
            right = side > 0
            far = off.copy()
            far[np.arange(len(row)), d] = side * side
            met = far.sum(axis=1) <= self.budget
            node, row = np.concatenate([2 * node + right, (2 * node + ~right)[met]]), np.concatenate([row, row[met]])
            off = np.concatenate([off, far[met]])
        return row, node - (1 << self.depth)


def usable(v: Column) -> Column:
    """Vectors without nulls and with finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _candidates(nodes: DataFrame, dims: int, n: int, cosine: float) -> DataFrame:
    """(a, b), a < b: pairs that are near in at least one block. nodes(nid, v), all of ``dims`` components."""
    blocks = [range(at, min(at + BLOCK_DIMS, dims)) for at in range(0, dims, BLOCK_DIMS)]
    budget = 2 * (1 - cosine) / len(blocks) + SLACK
    depth = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    share = min(1.0, SAMPLE / max(n, 1))
    picked = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else nodes
    sample = picked.select("v").toPandas()["v"]
    turn = rotation(dims)
    seen = _units(sample) @ turn if len(sample) else np.zeros((0, dims))
    cells, tiles = [], []
    for b in blocks:
        c = Cells(seen[:, b], depth, budget)
        scale = n / max(1, len(seen)) / TILE
        tiles.append([np.maximum(1, np.ceil(scale * np.bincount(x, minlength=1 << depth))).astype(np.int64)
                      for x in (c.home(seen[:, b]), c.reach(seen[:, b])[1])])
        cells.append(c)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, nid = _units(pdf["v"]) @ turn, pdf["nid"].to_numpy()
            for k, (b, c, (homes, asks)) in enumerate(zip(blocks, cells, tiles)):
                p = x[:, b].astype(np.float32)
                for home in (True, False):
                    row, cell = (np.arange(len(p)), c.home(x[:, b])) if home else c.reach(x[:, b])
                    own, other = (homes, asks) if home else (asks, homes)
                    # Its own part of the cell by id, and every part of the other side.
                    times = other[cell]
                    at = np.repeat(np.arange(len(row)), times)
                    turnwise = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    mine = (nid[row] % own[cell])[at]
                    yield pd.DataFrame({"block": k, "cell": cell[at], "home_part": mine if home else turnwise,
                                        "ask_part": turnwise if home else mine, "home": home, "nid": nid[row][at],
                                        "p": [r.tobytes() for r in p[row][at]]})

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.frombuffer(b"".join(pdf["p"]), dtype=np.float32).reshape(len(pdf), -1)
        home, nid = pdf["home"].to_numpy(dtype=bool), pdf["nid"].to_numpy()
        one = lambda q: np.ones((len(q), 1), dtype=np.float32)
        h, q = p[home], p[~home]
        right = np.hstack([-2 * q, one(q), (q * q).sum(axis=1, keepdims=True)]).T.copy()
        left = np.hstack([h, (h * h).sum(axis=1, keepdims=True), one(h)])
        a, b = [], []
        for at in range(0, len(h), 256):
            i, j = np.nonzero(left[at:at + 256] @ right <= budget)
            lo, hi = nid[~home][j], nid[home][at + i]
            a.append(lo[lo < hi])
            b.append(hi[lo < hi])
        return pd.DataFrame({"a": np.concatenate(a or [nid[:0]]), "b": np.concatenate(b or [nid[:0]])})

    keys = ["block", "cell", "home_part", "ask_part"]
    placed = nodes.mapInPandas(place, "block int, cell long, home_part long, ask_part long, home boolean, nid long, p binary")
    return placed.groupBy(*keys).applyInPandas(near, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Unit vectors at cosine c differ by 2 - 2c in squared distance. A rotation spreads it over blocks of BLOCK_DIMS
    dimensions; in some block a linked pair has at most its share (pigeonhole). Each block is a range join: its space is cut
    into cells by medians of a bounded sample, a vector stays in its home cell and asks in every cell that its budget reaches,
    so no pair is lost whatever the sample. A crowded cell is cut into tiles by id, which separate tasks compare. The union of
    the candidates is verified over all components in double precision.

    Equal vectors are one node with a count. Vectors that are null, zero, or hold null or non-finite components link with
    nothing; vectors of different lengths do not link. The component is the smallest vec_id reachable; a null vec_id takes
    part and is kept only if it is alone.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    good = rows.where(usable(F.col("v")))
    nodes = cut_lineage(good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
                        .withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v")))))
    nodes = nodes.withColumn("nid", F.monotonically_increasing_id())
    pairs = None
    for r in nodes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect():
        some = _candidates(nodes.where(F.size("v") == r["dims"]).select("nid", "v"), r["dims"], r["n"], cosine)
        pairs = some if pairs is None else pairs.unionByName(some)
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"),
                           F.lit(True).alias("kept"))
    full = nodes.select("nid", "v", "norm", "n")
    left, right = (full.select(F.col("nid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("v", "norm", "n"))) for k in ("a", "b"))
    cos = _dot(F.col("a_v"), F.col("b_v")) / (F.col("a_norm") * F.col("b_norm"))
    linked = cut_lineage(pairs.join(left, "a").join(right, "b").where(cos >= cosine).select("a", "b", "a_n", "b_n"))
    ends = linked.select(F.col("a").alias("nid"), F.col("b_n").alias("n")).unionByName(linked.select(F.col("b").alias("nid"), F.col("a_n").alias("n")))
    links = ends.groupBy("nid").agg(F.sum("n").alias("links"))
    label = components(nodes.select(F.col("nid").alias("unit_id")), linked.select(F.col("a").alias("src"), F.col("b").alias("dst")),
                       salts=max(8, partitions(vectors) // 8)).withColumnRenamed("unit_id", "nid")
    label = label.join(nodes.select("nid", "first", "n"), "nid").join(links, "nid", "left")
    lowest = label.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = label.join(lowest, "component").select("nid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    of_node = of_node.join(nodes.select("nid", "v"), "nid").select("v", "component_id", "n_links")
    out = good.join(of_node, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(usable(F.col("v")), F.lit(False))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (out.unionByName(rest).withColumn("component_id", F.col("component_id").cast("bigint"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
