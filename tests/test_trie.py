"""Signatures scored as a trie against one prediction for each signature and sample."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.operators import evaluate, resample, signatures
from sigstab.sources import matrix

from .test_models import obs_of


def counted(predictions, keys):
    return sorted(tuple(r) for r in predictions.groupBy(*keys, "y_true", "y_pred").count().collect())


@pytest.fixture(scope="module")
def losses(spark, small):
    obs = matrix.embeddings(spark, small, 3).where("feature < 'f12'")
    splits = resample.shuffle_splits(resample.samples_of(obs), 3, 0.3)
    return evaluate.feature_distances(obs, splits).cache()


def some_signatures(spark, n, seed=0, features=12):
    rng = np.random.default_rng(seed)
    made = {tuple(sorted(rng.choice(features, rng.integers(1, 6), replace=False))) for _ in range(n)}
    return signatures.with_id(spark.createDataFrame([([f"f{j:02}" for j in g],) for g in made], "genes array<string>"))


@pytest.mark.parametrize(("blocks", "chunk"), [(1, 10_000), (3, 7)])
def test_counts_equal_predictions(spark, losses, monkeypatch, blocks, chunk):
    monkeypatch.setattr(evaluate, "SIGNATURES", chunk)
    some = some_signatures(spark, 60)
    got = evaluate.trie_confusion(losses, some, ("split",), (), blocks).select("split", "sig_id", "y_true", "y_pred", "n")
    assert sorted(tuple(r) for r in got.collect()) == counted(evaluate.predict(losses, some), ("split", "sig_id"))
    assert evaluate.trie_confusion(losses, some.limit(0)).count() == 0


def test_folds_have_their_own_signatures_and_missing_losses_are_left_out(spark, losses):
    some = some_signatures(spark, 40, 1).withColumn("fold", F.pmod(F.hash("sig_id"), F.lit(2)))
    d = losses.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).where("not (feature = 'f03' and c = 1) and not (feature = 'f05' and sample_id % 3 = 0) and not (fold = 1 and split = 2)")
    keys = ("fold", "split")
    got = evaluate.trie_confusion(d, some, keys, ("fold",), 2).select(*keys, "sig_id", "y_true", "y_pred", "n")
    assert sorted(tuple(r) for r in got.collect()) == counted(evaluate.predict(d, some, keys, ("fold",)), (*keys, "sig_id"))
    plain = evaluate.cv_summary(evaluate.predict(d, some, keys, ("fold",)), ("fold", "sig_id"))
    fast = evaluate.counted_summary(evaluate.trie_confusion(d, some, keys, ("fold",)), ("fold", "sig_id"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fast.select(plain.columns).collect()))


def test_a_whole_search_of_one_ranking(spark):
    """8415 signatures of up to 20 features, 32 splits and 50 samples."""
    rng = np.random.default_rng(4)
    y = np.arange(50) % 2
    obs = obs_of(spark, rng.normal(size=(50, 20)) + y[:, None] * 0.3, y).withColumn("feature", F.format_string("f%02d", F.col("feature_pos")))
    d = evaluate.feature_distances(obs, resample.shuffle_splits(resample.samples_of(obs), 32, 0.2))
    made = {tuple(sorted(rng.choice(20, rng.integers(1, 7), replace=False))) for _ in range(22_000)}
    some = signatures.with_id(spark.createDataFrame([([f"f{j:02}" for j in g],) for g in sorted(made)[:8415]], "genes array<string>")).cache()
    assert some.count() == 8415
    began = time.time()
    counts = evaluate.trie_confusion(d, some).cache()
    assert counts.agg(F.sum("n")).first()[0] == 8415 * 32 * 10 and time.time() - began < 90
    part = some.where("sig_id like 'f00|%'").limit(40)
    want = counted(evaluate.predict(d, part), ("split", "sig_id"))
    got = counts.join(part.select("sig_id"), "sig_id", "left_semi").select("split", "sig_id", "y_true", "y_pred", "n")
    assert sorted(tuple(r) for r in got.collect()) == want
