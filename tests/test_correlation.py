"""Correlations from blocks of features and chunks of samples against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.functions.columns import SERIES, _series, two_sided_t
from sigstab.operators import stats


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12)) + 1000
    x[:, 5] = 3
    x[:, 6] = -2 * x[:, 7]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 11] = np.nan
    rows = [(k, i, f"f{j:02}", 12 - j, None if np.isnan(v) else float(v)) for k in (0, 1) for i, r in enumerate(x) for j, v in enumerate(r) if not (k == 1 and j == 0)]
    return x, spark.createDataFrame(rows, "fold int, sample_id long, feature string, feature_pos int, value double").cache()


@pytest.mark.parametrize(("columns", "samples"), [(256, 4096), (4, 4096), (256, 20), (3, 25)])
@pytest.mark.parametrize("least", [None, 0.3])
def test_pairs_equal_numpy(data, monkeypatch, columns, samples, least):
    monkeypatch.setattr(stats, "COLUMNS", columns)
    monkeypatch.setattr(stats, "SAMPLES", samples)
    x, obs = data
    got = {(r["fold"], r["a"], r["b"]): (r["r"], r["n"]) for r in stats.pearson_pairs(obs, ("fold",), least).collect()}
    want = {}
    for fold in (0, 1):
        for i in range(12):  # positions fall with the name, so b has the smaller number
            for j in range(fold, i):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                if both.any():
                    flat = min(np.ptp(x[both, i]), np.ptp(x[both, j])) < 1e-9
                    want[fold, f"f{i:02}", f"f{j:02}"] = (None if flat else np.corrcoef(x[both, i], x[both, j])[0, 1], both.sum())
    if least is not None:
        want = {k: v for k, v in want.items() if v[0] is not None and abs(v[0]) > least}
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if r is None else got[k][0] == pytest.approx(r, abs=1e-9)), (k, got[k], r)


def test_an_empty_matrix_has_no_pairs(data):
    assert stats.pearson_pairs(data[1].limit(0)).count() == 0


def test_the_tail_by_a_continued_fraction_equals_the_series(spark):
    rows = [(float(t), df) for df in (SERIES + 1, 62, 63, 100, 101, 377, 998, 1999, 2000) for t in (0.0, 0.01, -0.3, 1, 1.97, 3, 5, 30)]
    d = spark.createDataFrame(rows, "t double, df int").select(two_sided_t(F.col("t"), F.col("df")).alias("p"), _series(F.col("t"), F.col("df")).alias("q"))
    assert all(abs(r["p"] - r["q"]) < 1e-11 for r in d.collect())
