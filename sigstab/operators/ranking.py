"""Rankings: normalised scores and positions of features by (fold, method), and their tables across folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scaling, stats


def centroid_spread(train: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """score: sum over classes of the distance of the class mean from the whole mean, of z-scores."""
    z = scaling.zscore(train, by)
    return z.groupBy(*by, "feature", "y").agg(F.avg("value").alias("m")).groupBy(*by, "feature").agg(F.sum(F.abs("m")).alias("score"))


def scorers() -> dict:
    """Methods that need sums only, by name; each takes (train, by) and gives (by, feature, score)."""
    return {
        "t1_anova": stats.anova_f,
        "t1_chi2": lambda d, by: stats.chi2(d, by, shift=True),
        "t1_kruskal": lambda d, by: stats.kruskal(d, by).select(*by, "feature", F.col("h").alias("score")),
        "t1_mutual_information": stats.binned_mutual_information,
        "t3_centroid": centroid_spread,
    }


def score(train: DataFrame, by: tuple[str, ...] = ("fold",), methods: dict | None = None) -> DataFrame:
    """by, method, feature, score: all methods, stacked; one scan each of ``train``, which is worth caching."""
    made = [f(train, by).select(*by, F.lit(name).alias("method"), "feature", F.col("score").cast("double").alias("score")) for name, f in (methods or scorers()).items()]
    return reduce(DataFrame.unionByName, made)


def normalise(scores: DataFrame, by: tuple[str, ...] = ("fold",), inverse: bool = False) -> DataFrame:
    """Scores to 0..1 in each (by, method); unchanged where all are equal; ``inverse`` makes small ones best."""
    w = Window.partitionBy(*by, "method")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    s = F.when(hi == lo, F.col("score")).otherwise((F.col("score") - lo) / (hi - lo))
    return scores.withColumn("score", 1 - s if inverse else s)


def positions(scores: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Add pos (from 0): place in the method by falling score, rounded to eight digits; ties by name."""
    return scores.withColumn("pos", F.row_number().over(Window.partitionBy(*by, "method").orderBy(F.round("score", 8).desc(), "feature")) - 1)


def names_wide(ranked: DataFrame, methods: list[str], by: tuple[str, ...] = ("fold",)) -> DataFrame:
    return ranked.groupBy(*by, "pos").pivot("method", methods).agg(F.first("feature"))


def scores_wide(ranked: DataFrame, methods: list[str], value: str = "score", by: tuple[str, ...] = ("fold",)) -> DataFrame:
    return ranked.groupBy(*by, "feature").pivot("method", methods).agg(F.first(value))


def clamp(ranked: DataFrame, floor: float = 0.7, cap: int = 10) -> DataFrame:
    """score not under ``floor``; pos not over ``cap``."""
    return ranked.withColumn("score", F.greatest(F.lit(floor), "score")).withColumn("pos", F.least(F.lit(cap), F.col("pos")))


def top_report(ranked: DataFrame, groups: DataFrame, k: int = 10, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """method, least and greatest score of the top k, names, and the features that these stand for."""
    top = ranked.where(F.col("pos") < k).join(groups, ranked["feature"] == groups["kept"], "left")
    return top.groupBy(*by, "method").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.array_sort(F.collect_set("feature")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dropped")))).alias("correlates"))


# Tables across folds


def mean_std(ranked: DataFrame) -> DataFrame:
    """feature, method, mean, std (population) over the folds that have the feature."""
    return ranked.groupBy("feature", "method").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def lower_confidence(means: DataFrame) -> DataFrame:
    return means.withColumn("lower", F.greatest(F.lit(0.0), F.col("mean") - 2 * F.col("std")))


def _cells(ranked: DataFrame) -> DataFrame:
    """Every feature in every fold."""
    return ranked.select("feature").distinct().crossJoin(F.broadcast(ranked.select("fold").distinct()))


def top_half(ranked: DataFrame, of: Column, absent: float) -> DataFrame:
    """feature, fold, half: the mean of the best ``of`` scores of the feature in the fold; ``absent`` where it has none.

    ``of`` may name the column ``features``, the number of features of the fold.
    """
    order = Window.partitionBy("fold", "feature").orderBy(F.desc("score"), "method")
    counts = ranked.groupBy("fold").agg(F.count_distinct("feature").alias("features"))
    best = ranked.join(counts, "fold").withColumn("_of", of).withColumn("_r", F.row_number().over(order)).where("_r <= _of").groupBy("feature", "fold").agg(F.avg("score").alias("half"))
    return _cells(ranked).join(best, ["feature", "fold"], "left").na.fill(absent, ["half"])


def top_counts(ranked: DataFrame, k: int = 10) -> DataFrame:
    """fold, feature, n: in how many methods the feature is among the first k; zero too."""
    return ranked.groupBy("fold", "feature").agg(F.sum(F.when(F.col("pos") < k, 1).otherwise(0)).alias("n"))


def top_counts_wide(counts: DataFrame, folds: list[int]) -> DataFrame:
    wide = counts.groupBy("feature").pivot("fold", folds).agg(F.first("n")).na.fill(0)
    return wide.select("feature", *[F.col(str(f)).alias(f"fold_{f}") for f in folds])


def stable(counts: DataFrame, methods: int, folds: int) -> DataFrame:
    """feature, n over all folds, kept if over methods * folds / 3 (folds -1 lets everything pass)."""
    return counts.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("kept", F.col("n") > F.lit(methods / 3 * folds))


def value_lists(ranked: DataFrame) -> DataFrame:
    """feature, values: all its scores, and a growing penalty for each fold without it: -0.05, -0.051, ..., best first."""
    missing = _cells(ranked).join(ranked.select("feature", "fold").distinct(), ["feature", "fold"], "left_anti")
    k = F.row_number().over(Window.partitionBy("feature").orderBy("fold"))
    every = ranked.select("feature", "score").union(missing.select("feature", -0.05 - 0.001 * (k - 1)))
    return every.groupBy("feature").agg(F.sort_array(F.collect_list(F.round("score", 6)), asc=False).alias("values"))


def box_stats(ranked: DataFrame) -> DataFrame:
    """feature, q1, median, q3, and whiskers: the outermost scores within 1.5 interquartile ranges."""
    q = ranked.groupBy("feature").agg(F.percentile("score", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"))
    span = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col("score").between(F.col("q")[0] - span, F.col("q")[2] + span)
    return ranked.join(q, "feature").groupBy("feature").agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min(F.when(inside, F.col("score"))).alias("low"), F.max(F.when(inside, F.col("score"))).alias("high"))


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n: equal bins over the column's range; empty bins are absent."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    place = F.floor((F.col(column) - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / bins))
    return rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nonzero_limit(ranked: DataFrame, most: int) -> DataFrame:
    return ranked.groupBy("fold", "method").agg(F.least(F.sum(F.when(F.col("score") > 0, 1).otherwise(0)), F.lit(most)).cast("long").alias("n"))
