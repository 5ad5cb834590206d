"""Batched models of signatures against fits to the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.operators import bagged, evaluate, linear, signatures

from .test_linear import numpy_weights, scaled, targets


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 6)) * 3 + 2
    x[:, 0] += 4 * y
    x[:, 2] -= 3 * y
    rows = [(i, "abc"[y[i]], int(y[i]), f"f{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    obs = spark.createDataFrame(rows, "sample_id long, label string, y int, feature string, value double").cache()
    test = {(f, s): rng.random(90) < 0.3 for f in (0, 1) for s in (0, 1)}
    splits = spark.createDataFrame([(f, s, i, bool(t)) for (f, s), some in test.items() for i, t in enumerate(some) if i % 10 or f], "fold int, split int, sample_id long, is_test boolean")
    test = {k: (v & (np.arange(90) % 10 > 0) if k[0] == 0 else v) for k, v in test.items()}
    train = {k: ~v & ((np.arange(90) % 10 > 0) | (k[0] == 1)) for k, v in test.items()}
    genes = [(f, g) for f in (0, 1) for g in (["f0"], ["f2", "f5"], ["f0", "f2"], ["f1", "f3", "f4"], ["f0", "f1", "f2", "f3", "f4"])]
    some = signatures.with_id(spark.createDataFrame(genes, "fold int, genes array<string>"))
    return x, y, obs, splits, some, train, test


def predicted(name, x, y, train, test, w=None):
    """Predictions of least squares or the discriminant fitted to the rows; w: how often each feature counts."""
    w = np.ones(x.shape[1], int) if w is None else w.astype(int)
    cols = np.repeat(np.arange(x.shape[1]), w)
    xs, xt = x[train][:, cols], x[test][:, cols]
    z = (xt - xs.mean(axis=0)) / xs.std(axis=0)
    b = numpy_weights(name, xs, y[train])
    if name == "ridge":
        return (z @ b.T + targets(y[train]).mean(axis=0)).argmax(axis=1)
    means = np.stack([scaled(xs)[y[train] == c].mean(axis=0) for c in range(3)])
    return (z @ b.T - 0.5 * (b * means).sum(axis=1) + np.log(np.bincount(y[train]) / train.sum())).argmax(axis=1)


@pytest.mark.parametrize(("bags", "blocks", "chunk", "batch"), [(0, 1, 4096, 4_000_000), (0, 3, 2, 50), (7, 1, 4096, 4_000_000), (7, 2, 3, 500)])
def test_counts_equal_fits_to_the_rows(data, monkeypatch, bags, blocks, chunk, batch):
    monkeypatch.setattr(evaluate, "SIGNATURES", chunk)
    monkeypatch.setattr(bagged, "BATCH", batch)
    x, y, obs, splits, some, train, test = data
    got = {}
    for r in bagged.confusion(obs, splits, some, bags, blocks=blocks).collect():
        got[r["fold"], r["split"], r["estimator"], r["sig_id"], r["y_true"], r["y_pred"]] = r["n"]
    want = {}
    for s in some.collect():
        genes = [int(g[1]) for g in s["genes"]]
        weights = bagged.drawn(s["sig_id"], len(genes), bags) if bags else [None]
        for split in (0, 1):
            key = (s["fold"], split)
            for name in bagged.ESTIMATORS:
                votes = np.zeros((test[key].sum(), 3))
                for w in weights:
                    votes[np.arange(len(votes)), predicted(name, x[:, genes], y, train[key], test[key], w)] += 1
                for t, p in zip(y[test[key]], votes.argmax(axis=1), strict=True):
                    k = (*key, name, s["sig_id"], int(t), int(p))
                    want[k] = want.get(k, 0) + 1
    assert got == want


def test_bags_of_rows_and_features(data):
    _, y, obs, splits, some, _, test = data
    got = bagged.confusion(obs, splits, some, 9, rows=True).collect()
    n = {}
    for r in got:
        n[r["fold"], r["split"], r["estimator"], r["sig_id"]] = n.get((r["fold"], r["split"], r["estimator"], r["sig_id"]), 0) + r["n"]
    assert len(n) == 2 * 2 * 2 * 5 and all(v == test[k[:2]].sum() for k, v in n.items())
    hit = sum(r["n"] for r in got if r["y_true"] == r["y_pred"] and r["sig_id"] == "f0|f2")
    assert hit > 0.6 * sum(r["n"] for r in got if r["sig_id"] == "f0|f2")


def test_a_bag_draws_as_many_features_as_there_are():
    w = bagged.drawn("f0|f1|f2", 3, 50)
    assert (w.sum(axis=1) == 3).all() and w.max() > 1 and (w == bagged.drawn("f0|f1|f2", 3, 50)).all()


def test_scores_of_plain_and_bagged_models(data):
    _, _, obs, splits, some, _, _ = data
    got = bagged.scores(obs, some, splits, 5).collect()
    assert {r["estimator"] for r in got} == {"ridge", "lda", "bag_ridge", "bag_lda"} and len(got) == 2 * 5 * 4
    assert all(r["cv_mean"] > 0.55 for r in got if r["sig_id"] == "f0|f2")
    assert linear.WHOLE == 0 and not some.where(F.size("genes") == 0).count()


def test_final_evaluation_of_linear_models(spark, data):
    """Outside, the counts are those of a fit to the fold's training rows; all metrics come from them."""
    from sigstab.plans import search as plan

    x, y, obs, _, some, _, _ = data
    ranks, config = plan.RankConfig(outer_folds=3), plan.SignatureConfig(final_splits=2, bags=3)
    chosen = some.where("size > 1").select("fold", "sig_id", "genes")
    got = plan.model_evaluation(obs, chosen, config, ranks).collect()
    assert len(got) == 2 * 4 * 4 * 2 and {r["part"] for r in got} == {"cv", "test"}
    folds = {r["sample_id"] for r in plan.folds(obs, 3).where("fold = 0 and outer").collect()}
    test = np.isin(np.arange(90), list(folds))
    for r in got:
        if (r["fold"], r["part"], r["estimator"]) == (0, "test", "ridge"):
            genes = [int(g[1]) for g in r["sig_id"].split("|")]
            assert r["accuracy"] == pytest.approx((predicted("ridge", x[:, genes], y, ~test, test) == y[test]).mean())


def test_final_evaluation_with_balanced_training_rows(spark, data):
    from sigstab.plans import search as plan

    _, _, obs, _, some, _, _ = data
    uneven = obs.where("not (y = 2 and sample_id % 3 > 0)")
    chosen = some.where("size > 1").select("fold", "sig_id", "genes")
    got = plan.final_evaluation(uneven, chosen, plan.SignatureConfig(final_splits=2), plan.RankConfig(outer_folds=3), oversample=True).collect()
    assert {r["part"] for r in got} == {"cv", "test", "test_smote"}
    one = {(r["part"], r["fold"], r["estimator"]): r for r in got if r["sig_id"] == "f0|f2"}
    assert len(one) == 3 * 2 * 3 and all(one["test_smote", f, "centroid"]["accuracy"] > 0.6 for f in (0, 1))
    assert any(one["test_smote", f, e]["log_loss"] != one["test", f, e]["log_loss"] for f in (0, 1) for e in evaluate.ESTIMATORS)
