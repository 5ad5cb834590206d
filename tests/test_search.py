"""Guards, probability metrics and oversampled folds on small tables."""

import pytest

from sigstab.operators import evaluate, resample, signatures


def rows(spark, classes):
    made = [(k, c, y, f, float(k * (j + 1))) for y, (c, n) in enumerate(classes) for k in range(100 * y, 100 * y + n) for j, f in enumerate("ab")]
    return spark.createDataFrame(made, "sample_id long, label string, y int, feature string, value double")


def test_guards(spark):
    resample.check_classes(rows(spark, [("A", 4), ("B", 3)]), 3)
    with pytest.raises(ValueError, match="folds need"):
        resample.check_classes(rows(spark, [("A", 4), ("B", 2)]), 3)
    with pytest.raises(ValueError, match="not 1"):
        resample.check_classes(rows(spark, [("A", 4)]))
    with pytest.raises(ValueError, match="classes are needed"):
        resample.check_classes(rows(spark, [(c, 2) for c in "ABCDE"]))
    assert resample.feature_limit(rows(spark, [("A", 4), ("B", 3)])) == 2


def test_points_fill_each_fold(spark):
    train = rows(spark, [("A", 5), ("B", 3)]).crossJoin(spark.range(2).selectExpr("cast(id as int) as fold"))
    got = resample.smote_by_fold(train, [0, 1]).groupBy("fold", "y").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 4), (1, 1, 4)]  # two points of two features
    assert resample.smote_by_fold(train.where("sample_id < 5 or sample_id = 100"), [0]).count() == 0


def test_substitutes_leave_out_the_chosen(spark):
    chosen = spark.createDataFrame([(0, "a|b", ["a", "b"], ["m"], 0.5), (0, "b|x", ["b", "x"], ["m"], 0.5)], "fold int, sig_id string, genes array<string>, methods array<string>, mean_freq double")
    groups = spark.createDataFrame([("a", ["x", "y"])], "kept string, dropped array<string>")
    assert [tuple(r) for r in signatures.substitutes(chosen, groups).select("sig_id", "origin", "cv_mean").collect()] == [("b|y", "a|b", -5.0)]


def test_probability_metrics_with_ties(spark):
    p1 = [0.9, 0.6, 0.6, 0.2]
    y = [1, 1, 0, 0]
    table = [(0, k, y[k], c, p1[k] if c else 1 - p1[k]) for k in range(4) for c in (0, 1)]
    got = evaluate.probability_metrics(spark.createDataFrame(table, "split int, sample_id int, y int, c int, p double")).first()
    assert got["roc_auc"] == pytest.approx(3.5 / 4)
    assert got["average_precision"] == pytest.approx((0.5 + 0.5 * 2 / 3 + 0.5 + 0.5 * 2 / 3) / 2)
