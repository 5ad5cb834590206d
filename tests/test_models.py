"""Fitted models and tests of single features against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.functions.columns import two_sided_t
from sigstab.operators import models, resample, scaling, stats, trees
from sigstab.sources import matrix

SCHEMA = "sample_id long, label string, y int, feature string, feature_pos int, value double"


def obs_of(spark, x, y):
    rows = [(i, "abc"[y[i]], int(y[i]), f"f{j}", j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def apart():
    """Two classes four deviations apart in f0, noise in f1 and f2."""
    rng = np.random.default_rng(1)
    y = np.arange(80) % 2
    return np.stack([rng.normal(size=80) + 4 * y, rng.normal(size=80), rng.normal(size=80)], axis=1), y


@pytest.fixture(scope="module")
def embedded(spark, small):
    """The whole matrix of the small embeddings, as a frame and as arrays."""
    obs = matrix.embeddings(spark, small, 3).cache()
    pdf = obs.toPandas()
    x = pdf.pivot(index="sample_id", columns="feature", values="value")
    return obs, x.to_numpy(), pdf.drop_duplicates("sample_id").set_index("sample_id")["y"].loc[x.index].to_numpy(), list(x.columns)


def test_a_test_of_one_class_is_scaled_by_the_training_rows(spark, apart):
    x, y = apart
    obs = obs_of(spark, x, y)
    got = models.kernel_classifier(obs.where("sample_id < 60"), obs.where("sample_id >= 60 and y = 1")).collect()
    assert len(got) == 10 and sum(r["y_pred"] == 1 for r in got) >= 9
    fit, held = models.train_and_test(obs.withColumn("is_test", (F.col("sample_id") >= 60) & (F.col("y") == 1)).where("sample_id < 60 or is_test"), ["f0", "f1", "f2"])
    mean, sd = x[:60].mean(axis=0), x[:60].std(axis=0)
    for r in held.collect():
        assert np.allclose(r["features"].toArray(), (x[r["sample_id"]] - mean) / sd)
    assert fit.count() == 60


def test_addition_by_cross_validation(spark, apart):
    got = {r["features"]: r["score"] for r in models.addition_cv(obs_of(spark, *apart), 2).collect()}
    assert sorted(got) == [1, 2, 3] and got[1] > 0.9


def test_grid_search_scales_within_folds(spark, apart):
    x, y = apart
    got = {r["c"]: r["score"] for r in models.grid_search(obs_of(spark, x, y), grid=(0.01, 1.0), k=2).collect()}
    assert sorted(got) == [0.01, 1.0] and min(got.values()) > 0.9


def test_linear_discriminants(embedded):
    obs, x, y, names = embedded
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    means = [z[y == c].mean(axis=0) for c in range(3)]
    scatter = sum((z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in range(3)) / (len(z) - 3)
    want = np.abs(np.mean([np.linalg.solve(scatter + 1e-3 * np.eye(z.shape[1]), m) for m in means], axis=0))
    got = {r["feature"]: r["score"] for r in models.lda_rank(obs).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-9)


def test_nearest_neighbour_information(spark):
    rng = np.random.default_rng(4)
    y = np.arange(60) % 3
    x = np.stack([rng.normal(size=60) + 2 * y, rng.normal(size=60)], axis=1)

    def digamma(n):
        return -0.5772156649015329 + sum(1 / k for k in range(1, n))

    def estimate(v, k=3):
        """Every pair compared: the distance to the kth neighbour of the class, and all that are nearer."""
        total = 0.0
        for i in range(len(v)):
            own = sorted(abs(v[j] - v[i]) for j in range(len(v)) if j != i and y[j] == y[i])
            within = sum(abs(v[j] - v[i]) < own[k - 1] for j in range(len(v)))
            total += digamma(k) - digamma(int((y == y[i]).sum())) - digamma(max(within, 1))
        return max(0.0, digamma(len(v)) + total / len(v))

    got = {r["feature"]: r["score"] for r in models.neighbour_information(obs_of(spark, x, y)).collect()}
    for j in range(2):
        assert abs(got[f"f{j}"] - estimate(x[:, j])) < 2e-2
    assert got["f0"] > got["f1"] + 0.2


def test_stability_selection_finds_the_feature(spark, apart):
    got = {r["feature"]: r["score"] for r in models.stability_selection(obs_of(spark, *apart)).collect()}
    assert got["f0"] == 1.0 and max(got["f1"], got["f2"]) < 0.8


def test_weights_and_eliminations_agree_on_the_feature(spark, apart):
    obs = obs_of(spark, *apart)
    for rank in (lambda: models.weight_rank(obs, "ridge"), lambda: models.weight_rank(obs, "lasso"), lambda: models.weight_rank(obs, "forest"), lambda: models.elimination_rank(obs), lambda: models.addition_rank(obs)):
        got = {r["feature"]: r["score"] for r in rank().collect()}
        assert len(got) == 3 and max(got, key=got.get) == "f0"


def test_votes(spark, apart):
    x, y = apart
    obs = obs_of(spark, x, y)
    splits = resample.stratified_folds(resample.samples_of(obs), 4).selectExpr("0 as split", "sample_id", "label", "fold = 0 as is_test")
    bags = models.bagged_centroids(obs, splits).collect()
    assert len(bags) == 20
    soft = models.soft_vote(obs).collect()
    assert len(soft) == 80 and np.mean([r["y_true"] == r["y_pred"] for r in soft]) > 0.95
    assert all(0 <= r["true_probability"] <= 1 for r in soft)


def test_trees_of_neighbours(spark, apart):
    got = trees.feature_trees(obs_of(spark, *apart)).collect()
    assert len(got) == 3


def test_t_tails_at_any_degrees_of_freedom(spark):
    def tail(t, df):
        """By Simpson's rule over the density."""
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        xs = np.linspace(0, t, 20_001)
        f = c * np.exp(-(df + 1) / 2 * np.log1p(xs**2 / df))
        w = np.ones(len(xs))
        w[1:-1:2], w[2:-1:2] = 4, 2
        return 1 - 2 * (w * f).sum() * (xs[1] - xs[0]) / 3

    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 4.0) for df in (1, 2, 7, 30, 400, 1999, 2000, 2001, 2002, 5000)]
    rows = spark.createDataFrame([(t, df) for t, df in cases], "t double, df long").withColumn("p", two_sided_t(F.col("t"), F.col("df"))).collect()
    for r in rows:
        assert abs(r["p"] - tail(r["t"], r["df"])) < 1e-6, r
    big = spark.createDataFrame([(1.96, 10**12), (1.96, 10**7)], "t double, df long").withColumn("p", two_sided_t(F.col("t"), F.col("df"))).collect()
    assert all(abs(r["p"] - 0.0499958) < 1e-6 for r in big)


def test_ranks_in_cells_are_ranks_in_one_window(spark):
    rng = np.random.default_rng(2)
    values = [*np.round(rng.normal(size=300), 1), float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 0.0, 0.0]
    rows = [(i, "abc"[i % 3], i % 3, f"f{i % 2}", i % 2, float(v)) for i, v in enumerate(values)]
    obs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r["sample_id"], r["ties"], r["rank"])
    assert sorted(map(key, stats.average_ranks(obs, wide=True).collect())) == sorted(map(key, stats.average_ranks(obs).collect()))
    plain, cut = ({r["feature"]: r["h"] for r in stats.kruskal(obs, wide=c).collect()} for c in (False, True))
    assert plain == pytest.approx(cut)


def test_scaling_by_joined_moments(spark):
    rows = [(i, "a", 0, f, 0, v) for i, (f, v) in enumerate([("x", 1.0), ("x", 3.0), ("x", None), ("c", 5.0), ("c", 5.0)])]
    got = {r["sample_id"]: r["value"] for r in scaling.zscore(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: -1.0, 1: 1.0, 2: None, 3: 0.0, 4: 0.0}
    assert scaling.min_max(spark.createDataFrame(rows, SCHEMA)).count() == 5


def test_packing_deals_the_matrix_once_and_fits_read_few_parts(spark, small):
    obs = matrix.embeddings(spark, small, 3)
    names = models.names_of(obs)
    rows = models.pack(obs, names)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # not by feature as well
    few = models.in_few_parts(rows.repartition(40), 1)
    assert few.rdd.getNumPartitions() == min(40, spark.sparkContext.defaultParallelism)
    x = np.stack([r["features"].toArray() for r in rows.orderBy("sample_id").collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1, atol=1e-9)
