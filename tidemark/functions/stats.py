"""Effective sample size, p-values and the small linear solves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER_GAMMA = 0.5772156649


def harmonics(t: Column) -> dict[str, Column]:
    """Annual and semi-annual cosine and sine of a time in years."""
    return {"c1": F.cos(2 * math.pi * t), "s1": F.sin(2 * math.pi * t),
            "c2": F.cos(4 * math.pi * t), "s2": F.sin(4 * math.pi * t)}


def clamp_r(r: Column, limit: float = 0.99) -> Column:
    return F.when(r.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), r)))


def n_effective(n: Column, r: Column) -> Column:
    return F.try_divide(n * (1 - r), 1 + r)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate r over rows that have both; null for a constant side, where corr would fail."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def n_effective_bounded(n: Column, r: Column, low: float = 3.0) -> Column:
    r = clamp_r(r)
    return F.when(r.isNotNull(),
                  F.greatest(F.lit(low), F.least(n.cast("double"), n_effective(n, r))))


def harmonic_sum(m: Column) -> Column:
    return F.ln(m) + EULER_GAMMA + 1 / (2 * m)


def _beta_fraction(a, b, x):
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


#: The published method counts all sign patterns up to this many pairs and takes the normal limit above.
EXACT_RANKS = 50


def log_gamma(x):
    """Stirling's series from 10 up; smaller arguments are shifted there."""
    x = np.asarray(x, dtype="float64")
    small = x < 10
    z = np.where(small, x + 10, x)
    out = ((z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3)
           + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7) + 1 / (1188 * z ** 9))
    steps = np.where(small, x, 1.0)[..., None] + np.arange(10)
    return np.where(small, out - np.log(steps).sum(axis=-1), out)


def regularised_beta(a, b, x):
    """I_x(a, b) for arrays, by the continued fraction on the side that converges."""
    a, b, x = (np.asarray(v, dtype="float64") for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = (xx > 0) & (xx < 1)
    xs = np.where(inner, xx, 0.5)
    front = np.exp(log_gamma(aa + bb) - log_gamma(aa) - log_gamma(bb)
                   + aa * np.log(xs) + bb * np.log1p(-xs)) / aa
    value = np.where(inner, front * _beta_fraction(aa, bb, xs), np.where(xx <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype="float64"), np.asarray(df, dtype="float64")
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        out[ok] = regularised_beta(df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t probability, degrees of freedom need not be whole."""
    p = t_two_sided(t.to_numpy("float64"), df.to_numpy("float64"))
    return pd.Series(p).astype(object).where(np.isfinite(p), None)


def binomial_two_sided(k, n):
    """Exact two-sided tests of k successes in n at one half, for arrays; not a number where n is 0."""
    k, n = np.asarray(k, dtype="float64"), np.asarray(n, dtype="float64")
    low = np.minimum(k, n - k)
    ok = np.isfinite(low) & (n > 0)
    some = np.where(ok, low, 0.0)
    tail = regularised_beta(np.where(ok, n, 1.0) - some, some + 1, 0.5)
    return np.where(ok, np.where(2 * low == n, 1.0, np.minimum(1.0, 2 * tail)), np.nan)


@F.pandas_udf(T.DoubleType())
def binomial_pvalue(k: pd.Series, n: pd.Series) -> pd.Series:
    p = binomial_two_sided(k.to_numpy("float64"), n.to_numpy("float64"))
    return pd.Series(p).astype(object).where(np.isfinite(p), None)


def signed_rank_two_sided(w_plus: float, n: int, ties: bool, tie_term: float) -> float | None:
    """Wilcoxon signed-rank probability: exact up to EXACT_RANKS without ties or zeros, else normal."""
    if n == 0:
        return None
    w = min(w_plus, n * (n + 1) / 2 - w_plus)
    if n <= EXACT_RANKS and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for rank in range(1, n + 1):
            shifted = np.zeros_like(ways)
            shifted[rank:] = ways[:-rank]
            ways = ways + shifted
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0 ** n))
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
    if sd == 0:
        return None
    z = (w - n * (n + 1) / 4) / sd
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def signed_rank_pvalue(w: pd.Series, n: pd.Series, ties: pd.Series,
                       tie_term: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_two_sided(float(a), int(b), bool(c), float(d))
                      if a == a and b == b else None
                      for a, b, c, d in zip(w, n, ties, tie_term)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """Coefficients then diagonal of the inverse, from one Gram matrix per row.

    ``xx`` is the upper triangle by rows. Columns are scaled to unit norm before
    the solve. A singular system gives null.
    """
    out: list = [None] * len(xx)
    sizes: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(xx, xy)):
        if a is not None and b is not None and not any(v is None or v != v for v in a):
            sizes.setdefault(len(b), []).append(i)
    for k, rows in sizes.items():
        upper = np.triu_indices(k)
        m = np.zeros((len(rows), k, k))
        m[:, upper[0], upper[1]] = np.array([list(xx[i]) for i in rows], dtype="float64")
        m = m + np.triu(m, 1).transpose(0, 2, 1)
        v = np.array([list(xy[i]) for i in rows], dtype="float64")
        scale = np.sqrt(np.einsum("ijj->ij", m))
        good = (scale > 0).all(axis=1)
        safe = np.where(scale > 0, scale, 1.0)
        corr = m / safe[:, :, None] / safe[:, None, :]
        good &= np.linalg.eigvalsh(corr)[:, 0] > 1e-13
        some = np.flatnonzero(good)
        inv = np.linalg.inv(corr[some])
        beta = np.linalg.solve(corr[some], (v / safe)[some, :, None])[:, :, 0] / safe[some]
        spread = np.einsum("ijj->ij", inv) / safe[some] ** 2
        for j, values in zip(some, np.hstack([beta, spread]).tolist()):
            out[rows[j]] = values
    return pd.Series(out)
