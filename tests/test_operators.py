"""Operators on nine samples of three classes, against answers worked out apart from Spark."""

import math

import pytest
from pyspark.sql import functions as F

from sigstab.operators import resample, scaling, signatures, stats

VALUES = {"g1": [1, 2, 3, 4, 5, 6, 7, 8, 9], "g2": [2, 2, 5, 2, 5, 7, 5, 7, 9], "g3": [3, 1, 2, 3, 1, 2, 3, 1, 2]}


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(s, "ABC"[s // 3], s // 3, f, k, float(v)) for k, (f, vs) in enumerate(VALUES.items()) for s, v in enumerate(vs)]
    return spark.createDataFrame(rows, "sample_id long, label string, y int, feature string, feature_pos int, value double").cache()


def by_feature(df, *columns):
    return {r["feature"]: tuple(r[c] for c in columns) for r in df.collect()}


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6), k


def test_kruskal(obs):
    near(by_feature(stats.kruskal(obs), "h", "p"), {"g1": (7.2, 0.027324), "g2": (3.771772, 0.151695), "g3": (0.0, 1.0)})


def test_wilcoxon(obs):
    near(by_feature(stats.wilcoxon(obs), "z", "p"), {"g1": (-1.963961, 0.049535), "g2": (-0.872872, 0.382733), "g3": (0.0, 1.0)})


def test_t_anova_chi2(obs):
    near(by_feature(stats.t_test(obs), "t"), {"g1": (-3.674235,), "g2": (-0.944911,), "g3": (0.0,)})
    near(by_feature(stats.anova_f(obs), "score"), {"g1": (27.0,), "g2": (2.725,), "g3": (0.0,)})
    near(by_feature(stats.chi2(obs), "score"), {"g1": (10.8,), "g2": (4.954545,), "g3": (0.0,)})


def test_log_ratio(obs):
    near(by_feature(stats.class_log_ratio(obs), "r01"), {"g1": (-1.321928,), "g2": (-0.637430,), "g3": (0.0,)})


def test_average_ranks(obs):
    ranks = stats.average_ranks(obs).where("feature = 'g2'").orderBy("sample_id").collect()
    assert [r["rank"] for r in ranks] == [2, 2, 5, 2, 5, 7.5, 5, 7.5, 9]


def test_false_discovery_rate(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "feature string, p double")
    got = {r["feature"]: r["q"] for r in stats.benjamini_hochberg(tests).collect()}
    assert got.pop("e") is None
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.5})


def test_pearson_and_groups(obs):
    r = {(x["a"], x["b"]): x["r"] for x in stats.pearson_pairs(obs).collect()}
    assert r[("g1", "g2")] == pytest.approx(0.868669, abs=1e-6) and r[("g1", "g3")] == pytest.approx(-0.158114, abs=1e-6)
    groups = stats.correlation_groups(stats.pearson_tests(stats.pearson_pairs(obs)), 0.8).collect()
    assert [tuple(g) for g in groups] == [("g1", ["g2"])]


def test_variance_inflation(obs):
    got = {(x["a"], x["b"]): x["vif"] for x in stats.variance_inflation(stats.pearson_pairs(obs)).collect()}
    assert got[("g1", "g2")] == pytest.approx(1 / (1 - 0.868669**2), rel=1e-4)


def test_scaling(obs):
    z = [r["value"] for r in scaling.zscore(obs).where("feature = 'g1'").orderBy("sample_id").collect()]
    assert z == pytest.approx([(v - 5) / math.sqrt(60 / 9) for v in range(1, 10)])
    lo, hi = scaling.min_max(obs).groupBy().agg(F.min("value"), F.max("value")).first()
    assert (lo, hi) == pytest.approx((1e-8, 1.0))
    norms = scaling.l2_normalise(obs).groupBy("sample_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert [r["n"] for r in norms] == pytest.approx([1.0] * 9)
    assert [r["value"] for r in scaling.robust(obs).where("feature = 'g1'").orderBy("sample_id").collect()] == pytest.approx([(v - 5) / 4 for v in range(1, 10)])


def test_strict_projection_names_what_is_missing(spark, obs):
    with pytest.raises(KeyError, match="nope"):
        scaling.strict_project(obs, spark.createDataFrame([("nope", 0)], "feature string, place int"))


def test_folds(spark):
    samples = spark.createDataFrame([(k, "A") for k in range(10)], "sample_id long, label string")
    sizes = resample.stratified_folds(samples, 4).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    tests = resample.holdout(samples, 0.25).where("is_test").count()
    assert tests == 3


def test_signature_identity_and_expansion(spark):
    both = signatures.with_id(spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "genes array<string>")).select("sig_id").distinct().collect()
    assert [r["sig_id"] for r in both] == ["a|b"]
    one = signatures.with_id(spark.createDataFrame([(["a", "b"],)], "genes array<string>"))
    groups = spark.createDataFrame([("a", ["x", "y"])], "kept string, dropped array<string>")
    made = signatures.expand_correlates(one, groups).collect()
    assert sorted(r["genes"] for r in made) == [["a", "b"], ["b", "x"], ["b", "y"]]


def test_tests_of_equal_values_and_of_an_empty_matrix(spark, obs):
    flat = obs.withColumn("value", F.lit(1.0))
    assert {r["h"] for r in stats.kruskal(flat).collect()} == {None}
    assert {r["t"] for r in stats.t_test(flat).collect()} == {None}
    for f in (stats.kruskal, stats.wilcoxon, stats.t_test, stats.anova_f, stats.chi2, stats.pearson_pairs, scaling.zscore):
        assert f(obs.limit(0)).count() == 0
