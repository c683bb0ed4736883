"""Round 3: edges are dealt in order, so that neighbours share their ends; the permutations stay those of the seed."""

import numpy as np
import pytest

from tidemark.operators import spatial


def test_edges_are_dealt_along_the_curve(spark):
    rng = np.random.default_rng(3)
    n, n_perm = 120, 30
    lat, lon, x = rng.uniform(-80, 80, n), rng.uniform(-180, 180, n), rng.normal(size=n)
    ids = [7 * k for k in range(n)]  # all places are those of the ids in order
    place = [(None, None) if k % 40 == 0 else (float(lat[k]), float(lon[k])) for k in range(n)]
    units = spark.createDataFrame([(ids[k], float(x[k]), *place[k]) for k in range(n)], "unit_id long, x double, lat double, lon double")
    ends = [(a, b) for a in range(n) for b in rng.integers(0, n, 3) if a != b] + [(5, b) for b in range(n) if b != 5]
    edges = spark.createDataFrame([(ids[a], ids[b], 1.0 + a % 3) for a, b in ends], "src long, dst long, w double")
    z = x - x.mean()
    a, b = np.array(ends).T
    w = 1.0 + a % 3
    dealt = z[spatial.dealt_places(np.arange(n), n, spatial.round_keys("s", n_perm))]
    sims = n * (w[:, None] * dealt[a] * dealt[b]).sum(axis=0) / w.sum() / (z * z).sum()
    i = n * (w * z[a] * z[b]).sum() / w.sum() / (z * z).sum()
    want = [n, i, sims.std(), (i - sims.mean()) / sims.std(), ((sims >= i - 1e-12).sum() + 1) / (n_perm + 1), n_perm]
    found = spatial.moran_permutation(units, edges, n_perm, "s")
    assert list(found.first()) == pytest.approx(want, rel=1e-9)
    assert list(spatial.moran_permutation(units.drop("lat", "lon"), edges, n_perm, "s").first()) == pytest.approx(want, rel=1e-9)
    assert list(spatial.moran_permutation(units, edges, n_perm, "s", copied=0).first()) == pytest.approx(want, rel=1e-9)
    assert "rangepartitioning(at" in found._jdf.queryExecution().toString()
