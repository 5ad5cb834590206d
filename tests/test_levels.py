"""Numbering of labels without a shuffle of the rows by label."""

from pyspark.sql import functions as F

from sigstab.catalog import QUERIES
from sigstab.operators import stats


def test_rows_are_not_dealt_by_label(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size the plan can't tell
    try:
        for name, label in (("class_log_ratio", "label"), ("kruskal_h", "o_orderstatus")):
            plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            assert f"SortMergeJoin [{label}#" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_give_the_ratios_of_codes(spark):
    rows = [(x, f, float(v)) for x, f, v in [("a", "p", 1), ("a", "p", 3), ("b", "p", 8), ("c", "p", 0), ("a", "q", 2), ("b", "q", None), ("b", "q", 4), ("d", "q", 1)] if v is not None]
    obs = spark.createDataFrame(rows, "label string, feature string, value double")
    codes = obs.withColumn("y", F.ascii("label") - 97)
    want = {tuple(r) for r in stats.class_log_ratio(codes).collect()}
    assert {tuple(r) for r in stats.class_log_ratio_of_labels(obs).collect()} == want and len(want) == 2


def test_a_null_label_comes_last(spark):
    obs = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0), (None, "p", 4.0)], "label string, feature string, value double")
    r = stats.class_log_ratio_of_labels(obs).first()
    assert (r["r01"], r["r02"], r["r12"]) == (-1, -2, -1)
