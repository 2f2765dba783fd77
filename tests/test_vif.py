import numpy as np
import pytest

from wardspark.operators import prep


def by_rounds(x, max_vif, drop):
    """Elimination with the VIFs computed anew from the eigenvalues in each round."""
    idx = [i for i in range(x.shape[1]) if x[:, i].any()]
    while idx:
        v = prep.vif_of(x[:, idx].T @ x[:, idx])
        if v.max() < max_vif:
            return dict(zip(idx, v, strict=True))
        bad = np.flatnonzero(v >= max_vif) if drop == "all" else np.flatnonzero(v >= v.max() * (1 - 1e-9))[-1:]
        idx = [i for n, i in enumerate(idx) if n not in set(bad.tolist())]
    return {}


@pytest.mark.parametrize("drop", ["largest", "all"])
def test_sweeps_and_stripes_equal_rounds_of_eigenvalues(spark, drop):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, 12))
    x[:, 4] = x[:, 1] + 0.1 * r.normal(0, 1, 300)   # nearly the same
    x[:, 7] = x[:, 2] - 2 * x[:, 3]                 # dependent
    x[:, 9] = 0                                     # empty
    x[:, 11] = x[:, 0] + x[:, 5] + 0.4 * r.normal(0, 1, 300)
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], names)
    whole = {(g["i"], g["j"]): g["g"] for g in prep.gram_matrix(df, names).collect()}
    parts = {(g["i"], g["j"]): g["g"] for g in prep.gram_matrix(df, names, stripe=5).collect()}
    assert parts.keys() == whole.keys() and len(whole) == 78
    assert all(parts[k] == pytest.approx(whole[k]) == pytest.approx(x[:, k[0]] @ x[:, k[1]]) for k in whole)
    kept, vifs = prep.vif_eliminate(df, names, drop=drop)
    want = by_rounds(x, 5.0, drop)
    assert kept == [names[i] for i in want]
    assert all(vifs[names[i]] == pytest.approx(v, rel=1e-6) for i, v in want.items())
