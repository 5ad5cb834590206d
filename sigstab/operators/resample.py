"""Folds, splits and synthetic samples. Random orders are md5 of seed and id, so any SQL engine draws the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_order


def samples_of(obs: DataFrame) -> DataFrame:
    return obs.select("sample_id", "label").distinct()


def check_classes(obs: DataFrame, folds: int = 1, most: int = 3) -> None:
    """Raise unless there are 2 to ``most`` classes, each with at least ``folds`` samples."""
    sizes = {r["label"]: r["count"] for r in samples_of(obs).groupBy("label").count().limit(most + 1).collect()}
    if not 2 <= len(sizes) <= most:
        raise ValueError(f"two to {most} classes are needed, not {len(sizes)}{'' if len(sizes) <= most else ' or more'}")
    if min(sizes.values()) < folds:
        raise ValueError(f"{folds} folds need as many samples in each class; the smallest has {min(sizes.values())}")


def feature_limit(obs: DataFrame, most: int = 20) -> int:
    """The longest signature to try: the least of ``most`` and the numbers of features and samples."""
    n = obs.agg(F.count_distinct("feature").alias("f"), F.count_distinct("sample_id").alias("s")).first()
    return min(most, n["f"], n["s"])


def stratified_folds(samples: DataFrame, k: int) -> DataFrame:
    """Add fold (from 0): contiguous parts of each class in order of id, the first ones larger."""
    return samples.withColumn("fold", F.ntile(k).over(Window.partitionBy("label").orderBy("sample_id")) - 1)


def fold_splits(samples: DataFrame, k: int) -> DataFrame:
    """sample_id, label, split, is_test for k folds."""
    folds = stratified_folds(samples, k)
    return folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("sample_id", "label", "split", (F.col("fold") == F.col("split")).alias("is_test"))


def holdout(samples: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Add is_test: of each class the first ceil(n * share) in random order; share 0 puts every row on both sides (null)."""
    w = Window.partitionBy("label")
    place = F.row_number().over(w.orderBy(hash_order(F.lit(seed), F.col("sample_id")), "sample_id"))
    return samples.withColumn("is_test", place <= F.ceil(F.count(F.lit(1)).over(w) * F.lit(share)) if share else F.lit(None).cast("boolean"))


def shuffle_splits(samples: DataFrame, n: int, share: float, seed: int = 0) -> DataFrame:
    """sample_id, label, split, is_test of n independent stratified splits."""
    w = Window.partitionBy("split", "label")
    many = samples.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.row_number().over(w.orderBy(hash_order(F.lit(seed), F.col("split"), F.col("sample_id")), "sample_id"))
    return many.withColumn("is_test", place <= F.ceil(F.count(F.lit(1)).over(w) * F.lit(share)))


def leave_one_out(samples: DataFrame) -> DataFrame:
    """A split for each sample; only for as few samples as make that sensible."""
    tests = samples.select(F.col("sample_id").alias("split"))
    return samples.crossJoin(F.broadcast(tests)).withColumn("is_test", F.col("sample_id") == F.col("split"))


def permute(rows: DataFrame, column: str, keys: tuple[str, ...] = (), seed: int = 0, into: str = "permuted") -> DataFrame:
    """Pair each row (by sample_id order) with the column's value of the row at that place in random order."""
    w = Window.partitionBy(*keys)
    at = rows.withColumn("_n", F.row_number().over(w.orderBy("sample_id")))
    drawn = w.orderBy(hash_order(F.lit(seed), *[F.col(k) for k in keys], F.col("sample_id")), "sample_id")
    other = rows.select(*keys, F.col(column).alias(into), F.row_number().over(drawn).alias("_n"))
    return at.join(other, [*keys, "_n"]).drop("_n")


def class_balance(samples: DataFrame) -> DataFrame:
    """n_min (least class size; ``reference_min`` is one less), ratio, unbalanced, test_size by the rule of thumb.

    With a class under 11: a sample of each class if balanced (ratio over .95), else a tenth, or a sample of each class if
    that is more; otherwise a fifth.
    """
    sizes = samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels"))
    ratio = F.col("n_min") / F.col("n_max")
    small = F.when(ratio > 0.95, F.col("levels").cast("double")).when(0.1 * F.col("n") < F.col("levels"), F.col("levels").cast("double")).otherwise(0.1)
    return each.select("n_min", (F.col("n_min") - 1).alias("reference_min"), ratio.alias("ratio"), (ratio <= 0.95).alias("unbalanced"), F.when(F.col("n_min") < 11, small).otherwise(0.2).alias("test_size"))


def smote(obs: DataFrame, minority: str, new: int | None = None, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic samples of the minority class: ``new`` points on the way from a sample to one of its k nearest of the class.

    Without ``new``, the class is filled to the size of the largest. Only samples that are drawn are compared with their class.
    """
    from .stats import nearest

    own = obs.where(F.col("label") == minority).select("sample_id", "feature", "value")
    base = own.select("sample_id").distinct().withColumn("n", F.row_number().over(Window.orderBy(hash_order(F.lit(seed), F.col("sample_id")), "sample_id")) - 1)
    if new is None:
        most = samples_of(obs).groupBy("label").count().agg(F.max("count")).first()[0] or 0
    m = base.count()
    new, k = most - m if new is None else new, min(k, m - 1)
    if new and m < 2:
        raise ValueError(f"class {minority} has {m} samples: no neighbours to go to")
    near = nearest(own, base.where(F.col("n") < new), max(1, k))
    number = lambda *parts: F.conv(F.substring(hash_order(F.lit(seed), *parts), 1, 8), 16, 10).cast("long")
    want = obs.sparkSession.range(new).select(F.col("id").alias("new_id"), (F.col("id") % max(1, m)).cast("int").alias("n"), (number(F.lit("k"), F.col("id")) % max(1, k) + 1).alias("r"), (number(F.lit("u"), F.col("id")) / F.lit(4294967296.0)).alias("u"))
    pick = want.join(base, "n").join(near.select(F.col("a").alias("sample_id"), "b", "r"), ["sample_id", "r"])
    x, y = own.withColumnRenamed("value", "x"), own.select(F.col("sample_id").alias("b"), "feature", F.col("value").alias("y"))
    return pick.join(x, "sample_id").join(y, ["b", "feature"]).select("new_id", F.lit(minority).alias("label"), "feature", (F.col("x") + F.col("u") * (F.col("y") - F.col("x"))).alias("value"))


def smote_to_majority(obs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic samples (new_id counts within a label) that fill every class to the size of the largest."""
    sizes = {r["label"]: r["count"] for r in samples_of(obs).groupBy("label").count().collect()}
    most = max(sizes.values(), default=0)
    parts = [smote(obs, c, most - n, k, seed) for c, n in sorted(sizes.items()) if n < most]
    return reduce(DataFrame.unionByName, parts) if parts else obs.limit(0).select(F.lit(0).cast("long").alias("new_id"), "label", "feature", "value")


def smote_by_fold(train: DataFrame, folds: list[int], k: int = 5, seed: int = 0) -> DataFrame:
    """fold, y, feature, value: the points that fill every class of a fold's training rows to the size of its largest.

    A class of one sample has no neighbours, so such a fold gets no points: it is scored as it is.
    """
    codes = train.select("label", "y").distinct()
    parts = []
    for f in folds:  # a plan for each of the few outer folds
        rows = train.where(F.col("fold") == f)
        sizes = [r["count"] for r in samples_of(rows).groupBy("label").count().collect()]
        if sizes and min(sizes) > 1:
            parts.append(smote_to_majority(rows, k, seed).withColumn("fold", F.lit(f)))
    made = reduce(DataFrame.unionByName, parts) if parts else train.limit(0)
    return made.select("fold", "label", "feature", "value").join(codes, "label").select("fold", "y", "feature", "value")
