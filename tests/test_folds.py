"""Trees of folds, the command line, and the settings of the ranking stage."""

import argparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab import __main__ as cli
from sigstab.operators import stats
from sigstab.plans import search as plan
from sigstab.sources import folds, matrix


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(9)
    y = np.arange(48) % 3
    x = rng.normal(size=(48, 9))
    x[:, 2] += 2 * y
    x[:, 4] -= 3 * (y == 1)
    x[:, 7] = x[:, 4] * 2 + rng.normal(size=48) * 0.01
    rows = [(f"s{i:02}", "abc"[y[i]], int(y[i]), f"g{j}", j, round(float(v), 6)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "sample_id string, label string, y int, feature string, feature_pos int, value double").cache()


def cells(df, *more):
    return sorted(tuple(r) for r in df.select(*more, "sample_id", "label", "feature", "value").collect())


def test_a_tree_of_folders_reads_as_one_table(spark, obs, tmp_path):
    split = obs.join(plan.folds(obs, 3).withColumnRenamed("outer", "is_test"), "sample_id")
    path = f"file://{tmp_path}/tree"
    folds.write_folds(split, path)
    folds.write_folds(split.where("fold < 2").withColumn("value", F.lit(0.0)), path, "noFilter")
    folds.write_folds(split.where("fold = 0").withColumn("fold", F.lit(9)), path, "noFilter")
    for part, some in (("train", "not is_test"), ("test", "is_test")):
        got = folds.read_folds(spark, path, part)
        want = split.where(some).withColumn("fold", F.col("fold").cast("string"))
        want = want.unionByName(want.where("fold = '0'").withColumn("fold", F.lit("9")))
        assert cells(got, "fold") == cells(want, "fold")
        assert {(r["fold"], r["option"]) for r in got.select("fold", "option").distinct().collect()} == {("0", "filter"), ("1", "filter"), ("2", "filter"), ("9", "noFilter")}


def test_other_folds_are_left_unread(spark, obs, tmp_path):
    path = f"file://{tmp_path}/tree"
    folds.write_folds(obs.join(plan.folds(obs, 3).withColumnRenamed("outer", "is_test"), "sample_id"), path)
    one = folds.read_folds(spark, path).where("fold = '1'")
    assert {f.split("/tree/")[1].split("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"] if "/tree/" in f} <= {"1"}
    assert cells(one, "fold") == cells(folds.read_folds(spark, path, folds=("1",)), "fold")
    with pytest.raises(FileNotFoundError):
        folds.read_folds(spark, path, folds=("7",))


def test_filters_of_the_ranking_stage(spark, obs):
    names = lambda **k: {f: {r["feature"] for r in plan.train_rows(obs, plan.RankConfig(outer_folds=3, **k)).where(F.col("fold") == f).select("feature").distinct().collect()} for f in range(3)}
    every = {f"g{j}" for j in range(9)}
    assert names(p_value=None) == dict.fromkeys(range(3), every)
    assert all({"g2", "g4", "g7"} <= x < every for x in names(p_value=0.2).values())
    train = obs.join(plan.folds(obs, 3), "sample_id").where("not outer")
    passed = {(r["fold"], r["feature"]) for r in stats.benjamini_hochberg(stats.kruskal(train, ("fold",)), ("fold",)).where("q < 0.05").collect()}
    assert names(p_value=None, fdr=0.05, least_features=1) == {f: {g for k, g in passed if k == f} for f in range(3)} and passed
    assert names(p_value=None, fdr=0.05, least_features=8) == dict.fromkeys(range(3), every)  # too few pass: no filter by p here
    cut = names(p_value=None, correlation_cut=0.9)
    assert cut == dict.fromkeys(range(3), every - {"g7"})
    two = obs.where("y < 2")
    for test in ("wilcoxon", "t_test"):
        got = plan.train_rows(two, plan.RankConfig(outer_folds=3, p_value=0.01, test=test)).select("feature").distinct().collect()
        assert {"g4", "g7"} <= {r["feature"] for r in got}


def test_a_matrix_that_the_folds_do_not_fit_is_refused(obs):
    with pytest.raises(ValueError, match="folds"):
        plan.search(obs.where("sample_id < 's06'"), ranks=plan.RankConfig(outer_folds=4))


def test_settings_become_configurations():
    args = cli.parser().parse_args("search --train m --out o --fdr --min-fdr 2 --correlation --max-size-all-combinations 3 --max-size-random-combinations 5 --outer-k 5".split())
    ranks, found = cli.configs(args)
    assert (ranks.outer_folds, ranks.p_value, ranks.fdr, ranks.least_features, ranks.correlation_cut) == (5, 0.05, 0.05, 2, 0.9)
    assert found.combinations == (2, 3) and found.sampled == (4, 5) and found.most_features == 20
    none = cli.configs(argparse.Namespace(**vars(args) | {"no_filter": True}))[0]
    assert none.p_value is None and none.fdr is None


def test_the_command_line_writes_the_tables(spark, obs, tmp_path):
    matrix.write_csv(obs, f"file://{tmp_path}/m.csv")
    out = f"file://{tmp_path}/out"
    cli.main(["search", "--train", f"file://{tmp_path}/m.csv", "--out", out, "--p-value", "0.9", "--outer-k", "3", "--max-n-features", "4", "--max-size-all-combinations", "2", "--bags", "3"], spark)
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True)
    tests = stats.kruskal(obs.join(plan.folds(obs, 3), "sample_id").where("not outer"), ("fold",))
    assert read("tests").count() == tests.count()
    top = {r["feature"] for r in read("ranks").where("pos = 0 and method = 't1_kruskal'").collect()}
    assert top <= {"g2", "g4", "g7"} and read("stability").count() > 0
    assert read("double_cross_validation").count() == 4
    assert {"ridge", "lda", "bag_ridge", "bag_lda", "centroid"} <= {r["estimator"] for r in read("estimators").collect()}
    assert read("best_signatures").count() > 0 and read("final_evaluation").count() > 0 and read("stable_features").count() > 0
