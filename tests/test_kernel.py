"""Kernel machines against a brute optimum of the dual, and recursive addition as a saved model."""

import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sigstab.operators import addition, kernel, models

from .test_models import obs_of


def rings(n, seed=0):
    """Two classes that no line parts: a disk and a ring around it."""
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(y, rng.uniform(2, 3, n), rng.uniform(0, 1.3, n))
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), y


def objective(q, a):
    return a.sum() - 0.5 * a @ q @ a


@pytest.mark.parametrize("c", [0.1, 1.0, 50.0])
def test_the_dual_is_solved(c, monkeypatch):
    x, y = rings(60)
    x, t = x + np.random.default_rng(1).normal(size=x.shape), np.where(y, 1.0, -1.0)
    q = np.outer(t, t) * (kernel.gaussian(x, x, 0.5) + 1)
    best = np.zeros(60)
    for _ in range(400_000 // 60):  # projected gradient, with the step of the largest eigenvalue
        best = np.clip(best + (1 - q @ best) / np.linalg.eigvalsh(q)[-1], 0, c)
    got = kernel.dual(x, t, 0.5, c, near=1e-8, rounds=20_000)
    assert ((got >= 0) & (got <= c)).all() and objective(q, got) >= objective(q, best) - 1e-6 * abs(objective(q, best))
    slope = q @ got - 1
    assert (slope[got <= 0] > -1e-6).all() and (slope[got >= c] < 1e-6).all() and np.abs(slope[(got > 0) & (got < c)]).max(initial=0) < 1e-6
    monkeypatch.setattr(kernel, "KEPT", 8 * 60 * 3)  # only three kernel rows are kept
    assert np.allclose(kernel.dual(x, t, 0.5, c, near=1e-8, rounds=20_000), got, atol=1e-5 * max(1, c))


@pytest.mark.parametrize("most", [5000, 10])
def test_rings_are_told_apart_by_both_ways(spark, most):
    x, y = rings(240)
    obs = obs_of(spark, x, y)
    got = models.kernel_classifier(obs.where("sample_id < 160"), obs.where("sample_id >= 160"), gamma=0.7, c=10.0, most=most).collect()
    assert len(got) == 80 and np.mean([r["y_true"] == r["y_pred"] for r in got]) > 0.95


def vectors(spark):
    rng = np.random.default_rng(6)
    y = np.arange(120) % 3
    x = rng.normal(size=(120, 7))
    x[:, 4] += 3 * (y == 1)
    x[:, 1] -= 4 * (y == 2)
    return spark.createDataFrame([(i, float(c), Vectors.dense(r)) for i, (r, c) in enumerate(zip(x, y, strict=True))], ["id", "target", "v"]).cache()


@pytest.mark.parametrize("classifier", ["ridge", "forest"])
def test_the_model_predicts_as_its_classifier_on_the_chosen_features(spark, tmp_path, classifier):
    df = vectors(spark)
    model = addition.RecursiveAddition(featuresCol="v", labelCol="target", select=2, classifier=classifier).fit(df)
    assert model.chosen == [1, 4] and set(model.order[:2]) == {1, 4} and sorted(model.order) == list(range(7))
    sliced = VectorSlicer(inputCol="v", outputCol="features", indices=[1, 4]).transform(df)
    inner = models.estimator(classifier, rows=120)
    want = inner.copy({inner.labelCol: "target"}).fit(sliced).transform(sliced).orderBy("id").collect()
    model.write().overwrite().save(f"file://{tmp_path}/model")
    again = addition.RecursiveAdditionModel.load(f"file://{tmp_path}/model")
    for m in (model, again):
        got = m.transform(df)
        assert got.columns == [*df.columns, "rawPrediction", "probability", "prediction"]
        for a, b in zip(got.orderBy("id").collect(), want, strict=True):
            assert a["prediction"] == b["prediction"] and np.allclose(a["probability"].toArray(), b["probability"].toArray()) and np.allclose(a["rawPrediction"].toArray(), b["rawPrediction"].toArray())
        assert m.score(df) == pytest.approx(np.mean([r["prediction"] == r["target"] for r in want]))
    assert again.uid == model.uid and again.order == model.order and again.getOrDefault("select") == 2


def test_folds_choose_the_number_of_features(spark, tmp_path):
    maker = addition.RecursiveAddition(featuresCol="v", labelCol="target", folds=3)
    maker.write().overwrite().save(f"file://{tmp_path}/maker")
    model = addition.RecursiveAddition.load(f"file://{tmp_path}/maker").fit(vectors(spark))
    assert {1, 4} <= set(model.chosen)


def test_packing_thousands_of_features_takes_seconds(spark):
    obs = spark.range(20 * 8000).select((F.col("id") % 20).alias("sample_id"), F.lit("a").alias("label"), F.lit(0).alias("y"), F.format_string("f%05d", F.floor(F.col("id") / 20)).alias("feature"), F.rand(1).alias("value"))
    names = [f"f{k:05}" for k in range(8000)]
    began = time.time()
    rows = models.pack(obs, names, scaled=False).collect()
    assert len(rows) == 20 and all(len(r["features"]) == 8000 for r in rows) and time.time() - began < 20
    some = models.pack(obs.where("feature <> 'f00002'"), names[:5][::-1], scaled=False).collect()
    assert all(r["features"][2] == 0 and r["features"][0] > 0 for r in some)


def test_rows_are_stored_before_they_are_lifted(spark, monkeypatch):
    """What the passes over Fourier features read is as wide as the matrix, not as the features."""
    kept, whole = [], kernel.stored

    def seen(df):
        kept.append(df.columns)
        if "sample_id" in df.columns:
            kept.append({len(r["x"]) for r in df.select("x").collect()})
        return whole(df)

    monkeypatch.setattr(kernel, "stored", seen)
    x, y = rings(60)
    obs = obs_of(spark, x, y)
    models.kernel_classifier(obs, obs, gamma=0.7, c=10.0, most=10).collect()
    assert {2} in kept and all("pos" not in k for k in kept)
