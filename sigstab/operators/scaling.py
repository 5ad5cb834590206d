"""Scaling, masks and projections of the long matrix (sample_id, label, y, feature, feature_pos, value).

Constant features: z-scores divide by 1, min-max and robust scaling give the lower end and 0. Nulls stay null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_moments(obs: DataFrame, keys: tuple[str, ...], *moments: Column) -> DataFrame:
    """Join what is summed by ``keys``: partial sums are shuffled, the matrix isn't where their table is small."""
    found = obs.groupBy(*keys).agg(*moments)
    same = [F.col(f"_o.{k}").eqNullSafe(F.col(f"_f.{k}")) for k in keys]
    return obs.alias("_o").join(found.alias("_f"), reduce(Column.__and__, same)).select("_o.*", *[f"_f.{c}" for c in found.columns[len(keys) :]])


def _centred(obs: DataFrame, keys: tuple[str, ...], value: Column) -> DataFrame:
    z = _with_moments(obs, (*keys, "feature"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return z.withColumn("value", (F.col("value") - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).drop("_mean", "_sd")


def zscore(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Population z-score of each feature."""
    return _centred(obs, by, F.col("value"))


def zscore_by_train(obs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Z-score with the mean and deviation of the rows that aren't tests, for each of ``keys`` and feature."""
    return _centred(obs, keys, F.when(~F.col("is_test"), F.col("value")))


def l2_normalise(obs: DataFrame) -> DataFrame:
    """Unit length of each sample; a sample of zeros stays."""
    z = _with_moments(obs, ("sample_id",), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return z.withColumn("value", F.col("value") / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))).drop("_norm")


def min_max(obs: DataFrame, low: float = 1e-8, high: float = 1.0) -> DataFrame:
    z = _with_moments(obs, ("feature",), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return z.withColumn("value", low + (high - low) * (F.col("value") - F.col("_lo")) / span).drop("_lo", "_hi")


def robust(obs: DataFrame) -> DataFrame:
    """(value - median) / interquartile range; quartiles by linear interpolation, one group a feature."""
    q = obs.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return obs.join(q, "feature").withColumn("value", (F.col("value") - F.col("q")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)).drop("q")


def bands(obs: DataFrame, cut: float = 0.5) -> DataFrame:
    """band (null within the cut), up (null below it), down (null above its negative) of a scaled matrix."""
    v = F.col("value")
    return obs.withColumn("band", F.when((v > -cut) & (v < cut), None).otherwise(v)).withColumn("up", F.when(v >= cut, v)).withColumn("down", F.when(v <= -cut, v))


def project(obs: DataFrame, features: DataFrame) -> DataFrame:
    """The features of a list (feature, place), renumbered in its order; missing ones raise when ``strict_project`` is used."""
    return obs.drop("feature_pos").join(features.select("feature", F.col("place").alias("feature_pos")), "feature")


def strict_project(obs: DataFrame, features: DataFrame) -> DataFrame:
    missing = features.join(obs.select("feature").distinct(), "feature", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(", ".join(r["feature"] for r in missing))
    return project(obs, features)


def select_samples(obs: DataFrame, samples: DataFrame) -> DataFrame:
    return obs.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def drop_features(obs: DataFrame, dropped: DataFrame) -> DataFrame:
    return obs.join(dropped.select("feature"), "feature", "left_anti")


def with_class_column(obs: DataFrame, features: list[str]) -> DataFrame:
    """A row for each sample with a column for each feature, and its class."""
    return obs.groupBy("sample_id", F.col("label").alias("class")).pivot("feature", features).agg(F.first("value"))
