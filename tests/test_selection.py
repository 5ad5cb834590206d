"""Selections of samples and features, and signatures with features that had been dropped."""

from sigstab.operators import scaling, signatures

from .test_models import obs_of


def test_samples_and_features_are_selected(spark):
    obs = obs_of(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [0, 1, 0])
    twice = spark.createDataFrame([(0,), (2,), (2,), (9,)], "sample_id long")
    assert sorted(r["value"] for r in scaling.select_samples(obs, twice).collect()) == [1.0, 2.0, 5.0, 6.0]
    assert scaling.select_samples(obs, twice.limit(0)).count() == 0
    gone = spark.createDataFrame([("f1",), ("f7",)], "feature string")
    assert sorted(r["value"] for r in scaling.drop_features(obs, gone).collect()) == [1.0, 3.0, 5.0]
    assert scaling.drop_features(obs, gone.limit(0)).count() == 6


def test_signatures_with_dropped_features_are_tagged(spark):
    some = signatures.with_id(spark.createDataFrame([(["a", "b"],), (["c"],), (["d", "c"],)], "genes array<string>"))
    gone = spark.createDataFrame([("b",), ("d",)], "feature string")
    assert {r["sig_id"]: r["correlated"] for r in signatures.tag_correlated(some, gone).collect()} == {"a|b": True, "c": False, "c|d": True}
    assert not any(r["correlated"] for r in signatures.tag_correlated(some, gone.limit(0)).collect())
