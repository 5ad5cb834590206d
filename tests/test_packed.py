"""Signatures scored from packed samples give the counts of the joined losses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.operators import evaluate, resample
from sigstab.plans import search as plan


def _matrix(spark, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(n):
        y = s % 3
        for f in range(6):
            v = float(rng.normal() + 1000 + y * (f == 1) + 2 * y * (f == 4))
            v = 0.1 if f == 5 else None if (s, f) in {(4, 2), (7, 4)} else v
            if (s, f) not in {(9, 1), (10, 0)} and not (f == 3 and y == 2):
                rows += [(s, f"c{y}", y, f"f{f}", f, v)] * (2 if (s, f) == (11, 2) else 1)
    return spark.createDataFrame(rows, "sample_id long, label string, y int, feature string, feature_pos int, value double")


def test_packed_samples_give_the_joined_counts(spark):
    obs = _matrix(spark)
    samples = resample.samples_of(obs)
    splits = resample.fold_splits(samples, 3).withColumn("fold", F.lit(0))
    splits = splits.unionByName(resample.shuffle_splits(samples, 3, 0.3).withColumn("fold", F.lit(1)))
    found = [(0, "f0|f1", ["f0", "f1"]), (0, "f3", ["f3"]), (1, "f1|f2|f4", ["f1", "f2", "f4"]), (1, "f5", ["f5"]), (1, "f0|f9", ["f0", "f9"]), (0, "f2", ["f2"])]
    found = spark.createDataFrame(found, "fold int, sig_id string, genes array<string>")
    d = evaluate.estimator_distances(obs, splits, ("fold", "split"))
    keys = ("estimator", "fold", "split")
    columns = [*keys, "sig_id", "y_true", "y_pred", "n"]
    want = {tuple(r) for r in evaluate.trie_confusion(d, found, keys, ("fold",), 2).select(*columns).collect()}
    got = {tuple(r) for r in evaluate.packed_confusion(obs, splits, found, ("fold", "split"), ("fold",), blocks=2).select(*columns).collect()}
    assert got == want and len(want) > 50



@pytest.mark.parametrize("blocks", [1, 3])
def test_packed_shares_give_the_metrics_of_the_joined_losses(spark, blocks):
    obs = _matrix(spark)
    samples = resample.samples_of(obs)
    splits = resample.fold_splits(samples, 3).withColumn("fold", F.lit(0)).unionByName(resample.shuffle_splits(samples, 3, 0.3).withColumn("fold", F.lit(1)))
    found = [(0, "f0|f1", ["f0", "f1"]), (0, "f3", ["f3"]), (1, "f1|f2|f4", ["f1", "f2", "f4"]), (1, "f5", ["f5"]), (1, "f0|f9", ["f0", "f9"])]
    found = spark.createDataFrame(found, "fold int, sig_id string, genes array<string>")
    of = ("estimator", "fold", "split")
    by = (*of, "sig_id")
    sums = evaluate.loss_sums(evaluate.estimator_distances(obs, splits, ("fold", "split")), found, of, ("fold",))
    want = evaluate.metrics(evaluate.confusion(evaluate.nearest(sums, by), by), by).join(evaluate.probability_metrics(evaluate.probabilities(sums, by), by), list(by))
    shares = evaluate.packed_shares(obs, splits, found, ("fold", "split"), ("fold",), blocks=blocks)
    got = evaluate.shares_metrics(shares, by).select(*want.columns)
    table = lambda df: {tuple(r)[:4]: pytest.approx(tuple(r)[4:], abs=1e-7, nan_ok=True) for r in df.collect()}
    want = table(want)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want and len(want) == 45


def test_the_final_evaluation_has_no_row_for_a_sample_and_a_signature(spark):
    obs = _matrix(spark).where("feature <> 'f3' and value is not null")
    chosen = spark.createDataFrame([(f, "f1|f4", ["f1", "f4"]) for f in range(2)], "fold int, sig_id string, genes array<string>")
    out = plan.final_evaluation(obs, chosen, plan.SignatureConfig(final_splits=2), plan.RankConfig(outer_folds=2))
    assert out.count() == 12 and out.where("best").count() == 4
    shares = evaluate.packed_shares(obs, resample.fold_splits(resample.samples_of(obs), 2).withColumnRenamed("split", "fold"), chosen, ("fold",), ("fold",))
    assert shares.count() == 6 and shares.agg(F.sum(F.size("y"))).first()[0] == 180
