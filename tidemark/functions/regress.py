"""Least squares from sums of products at lag zero and one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def symmetric(upper: np.ndarray, k: int) -> np.ndarray:
    """Matrices from their upper triangles, listed by rows."""
    i, j = np.triu_indices(k)
    m = np.zeros((len(upper), k, k))
    m[:, i, j] = m[:, j, i] = upper
    return m


def normal_solutions(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, inverse, solvable) of stacked normal equations xx (n, k, k), xy (n, k, number of right-hand sides).

    Columns are scaled to unit norm before the one inversion that all right-hand sides share.
    """
    scale = np.sqrt(np.maximum(np.einsum("ijj->ij", xx), 0.0))
    good = (scale > 0).all(axis=1) & np.isfinite(xx).all(axis=(1, 2))
    safe = np.where(scale > 0, scale, 1.0)
    corr = np.where(good[:, None, None], xx / safe[:, :, None] / safe[:, None, :], np.eye(xx.shape[1]))
    good &= np.linalg.eigvalsh(corr)[:, 0] > 1e-13
    corr[~good] = np.eye(xx.shape[1])
    inverse = np.linalg.inv(corr)
    beta = np.linalg.solve(corr, xy / safe[:, :, None]) / safe[:, :, None]
    return beta, inverse / safe[:, :, None] / safe[:, None, :], good


SUMS = ("xx", "ll", "xy", "ly", "yy", "yl", "sx", "sy", "mx", "my", "ends")


def lagged_sums(k: int, n: int, centred: list[bool]):
    """A pandas UDF from the rows of a unit (in order, flattened, k columns and then n - k right-hand sides) to its sums.

    xx, xy, yy: products of one row; ll, ly, yl: products of a row and the one before, both ways added; sx, sy sums; mx,
    my what was taken off; ends: first and last row.
    """
    i, j = np.triu_indices(k)

    @F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in SUMS]))
    def sums(flat: pd.Series) -> pd.DataFrame:
        out = []
        for values in flat:
            v = np.array(values, dtype="float64").reshape(-1, n)
            mean = np.where(centred, v.mean(axis=0), 0.0)
            v = v - mean
            now, lag = v.T @ v, v[1:].T @ v[:-1]
            lag = lag + lag.T
            total = v.sum(axis=0)
            out.append((now[i, j], lag[i, j], now[k:, :k].ravel(), lag[k:, :k].ravel(), np.diag(now)[k:], np.diag(lag)[k:] / 2,
                        total[:k], total[k:], mean[:k], mean[k:], np.concatenate([v[0], v[-1]])))
        return pd.DataFrame(out, columns=SUMS)
    return sums


def solve_lagged(k: int, centre: int | None):
    """A pandas UDF of the sums that ``fit.lagged_gram`` names, for k columns; ``centre`` is the place of the constant.

    For each right-hand side: k coefficients, k diagonal terms of the inverse, then rss, the sum of products of consecutive
    residuals, first, last and summed residual. Null if the system is singular.
    """
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def solve(sums: pd.DataFrame) -> pd.Series:
        wide = {c: np.array(sums[c].tolist(), dtype="float64") for c in SUMS}
        rows, ys = len(sums), wide["yy"].shape[1] if len(sums) else 0
        if not rows:
            return pd.Series([], dtype=object)
        xx, lag = symmetric(wide["xx"], k), symmetric(np.nan_to_num(wide["ll"]), k) / 2
        xy, ly = (np.nan_to_num(wide[c]).reshape(rows, ys, k).transpose(0, 2, 1) for c in ("xy", "ly"))
        beta, inverse, good = normal_solutions(xx, xy)
        quad = lambda m: np.einsum("iky,ikl,ily->iy", beta, m, beta)
        rss = np.maximum(wide["yy"] - 2 * np.einsum("iky,iky->iy", beta, xy) + quad(xx), 0.0)
        num = np.nan_to_num(wide["yl"]) - np.einsum("iky,iky->iy", beta, ly) + quad(lag)
        ends = wide["ends"].reshape(rows, 2, k + ys)
        edge = ends[:, :, k:] - np.einsum("iek,iky->iey", ends[:, :, :k], beta)
        total = wide["sy"] - np.einsum("ik,iky->iy", wide["sx"], beta)
        spread = np.einsum("ijj->ij", inverse).copy()
        if centre is not None:  # back to columns that are not centred
            back = -wide["mx"]
            back[:, centre] = 1.0
            beta[:, centre] = wide["my"] + np.einsum("ik,iky->iy", back, beta)
            spread[:, centre] = np.einsum("ik,ikl,il->i", back, inverse, back)
        out = np.concatenate([beta.transpose(0, 2, 1), np.repeat(spread[:, None, :], ys, axis=1), rss[:, :, None], num[:, :, None],
                              edge.transpose(0, 2, 1), total[:, :, None]], axis=2)
        return pd.Series([v if ok else None for v, ok in zip(out.tolist(), good)], dtype=object)
    return solve
