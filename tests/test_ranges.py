"""Ranks and step-up through sampled ranges: equal to windows over whole keys, and no range with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from sigstab.operators import stats


@pytest.fixture
def ranges(spark):
    """As many ranges as partitions, however small they are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def odd_values(spark, n=4000):
    """Two features: an outlier far from all others with a value in half of the rows, and nulls, NaN and infinities."""
    rng, rows = random.Random(3), []
    for i in range(n):
        rows.append((i, "abc"[i % 3], i % 3, "f0", 1e300 if i == 7 else 0.25 if i % 2 else rng.random()))
        rows.append((i, "abc"[i % 3], i % 3, "f1", rng.choice([None, float("nan"), float("inf"), float("-inf"), rng.random(), 1.0])))
    return spark.createDataFrame(rows, "sample_id long, label string, y int, feature string, value double")


def test_ranks_and_sums_equal_windows(ranges):
    obs = odd_values(ranges)
    for f, columns in ((stats.average_ranks, ("feature", "sample_id", "ties", "rank")), (stats.kruskal, ("feature", "h", "p")), (stats.wilcoxon, ("feature", "z", "p"))):
        plain, wide = (sorted((repr(tuple(r)) for r in f(obs, wide=w).select(*columns).collect())) for w in (False, True))
        assert plain == wide


def test_no_range_holds_most_of_the_values(ranges):
    obs = odd_values(ranges, 20_000).where("feature = 'f0'").groupBy("feature", "value").count()
    sizes = [r["count"] for r in stats._in_ranges(obs, "feature", "value").groupBy("_cell").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("by", [(), ("fold",)])
def test_step_up_equals_windows(ranges, by):
    rng = random.Random(5)
    rows = [(k % 2, f"t{k}", rng.choice([None, 0.5, rng.random() ** 4, rng.random()])) for k in range(3000)]
    tests = ranges.createDataFrame(rows, "fold int, feature string, p double")
    plain, wide = (stats.benjamini_hochberg(tests, by, wide=w).orderBy("feature").collect() for w in (False, True))
    assert [r["feature"] for r in plain] == [r["feature"] for r in wide]
    assert all(a["q"] == pytest.approx(b["q"], abs=1e-12) if a["q"] is not None else b["q"] is None for a, b in zip(plain, wide, strict=True))
    assert stats.benjamini_hochberg(tests.limit(0), by, wide=True).count() == 0


def test_correlations_of_many_features_pass_through_ranges(ranges):
    x = ranges.range(0, 60 * 40).select((F.col("id") % 60).alias("sample_id"), F.floor(F.col("id") / 60).cast("int").alias("feature_pos"))
    obs = x.select("*", F.format_string("f%02d", "feature_pos").alias("feature"), (F.xxhash64("sample_id", "feature_pos") % 1000 / 7.0).alias("value"))
    pairs = stats.pearson_pairs(obs)
    plain, wide = (sorted((r["a"], r["b"], round(r["q"], 10)) for r in stats.pearson_tests(pairs, wide=w).collect()) for w in (False, True))
    assert plain == wide and len(plain) == 780
