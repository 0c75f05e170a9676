"""The nearest other profile against all pairs, in one product and block by block."""

import numpy as np
import pytest

from skylattice.operators import profiles


def made(seed, n):
    r = np.random.default_rng(seed)
    x = r.gamma(0.4, size=(n, 8)) * (r.random((n, 8)) < 0.6)
    x[: n // 3] = r.dirichlet(np.ones(8) * 50, n // 3)  # a crowd in one place
    x[x.sum(1) == 0, 0] = 1.0
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("few", [10_000, 10])
def test_nearest_equals_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(profiles, "PACK", 128)
    v = made(3, 900)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    got = {r.id: r for r in profiles.nearest_profiles(df, 8, few).collect()}
    s = v @ v.T
    np.fill_diagonal(s, -1)
    assert len(got) == len(v) and np.allclose([got[k].s for k in range(len(v))], s.max(1))
    if few == 10:  # most pairs of a profile and a block are skipped
        assert np.mean([r.blocks_seen / r.blocks for r in got.values()]) < 0.5 and got[0].blocks > 20
    one = profiles.nearest_profiles(df.where("id = 3"), 8, 0 if few == 10 else few).collect()
    assert [(r.id, r.s) for r in one] == [(3, -1.0)]
    assert profiles.nearest_profiles(df.where("false"), 8, few).count() == 0
