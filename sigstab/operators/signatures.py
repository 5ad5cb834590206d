"""Signatures (sets of features): candidates, identity, membership, near-best filters, and tables over folds.

A signature's identity is its features in sorted order, joined by a bar; doubles, if any, are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_order


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("genes", F.array_sort("genes")).withColumn("sig_id", F.concat_ws("|", "genes")).withColumn("size", F.size("genes"))


def prefixes(ranked: DataFrame, most: int, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, method, genes, sig_id, size: the first 1..most features of each ranking."""
    w = Window.partitionBy(*by, "method").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = ranked.where(F.col("pos") < most)
    return with_id(top.select(*by, "method", F.collect_list("feature").over(w).alias("genes")))


def combinations(ranked: DataFrame, top: int, k: int, limit: int | None = None, seed: int = 0, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """All k-subsets of the ``top`` features of each ranking, or in each the ``limit`` first ones in random order."""
    base = ranked.where(F.col("pos") < top).select(*by, "method", "feature", "pos")
    out = base.select(*by, "method", F.array("feature").alias("genes"), F.col("pos").alias("_last"))
    for _ in range(k - 1):
        more = base.select(*by, "method", F.col("feature").alias("_f"), F.col("pos").alias("_p"))
        out = out.join(more, [*by, "method"]).where("_p > _last").select(*by, "method", F.concat("genes", F.array("_f")).alias("genes"), F.col("_p").alias("_last"))
    out = with_id(out.drop("_last")).withColumn("method", F.concat(F.lit("smallcomb_"), "method"))
    if limit is not None:
        w = Window.partitionBy(*by, "method").orderBy(hash_order(F.lit(seed), F.col("sig_id")), "sig_id")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return out


def catalogue(candidates: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """One row for each signature: genes, size, methods (sorted), owner (the first method by name)."""
    return candidates.groupBy(*by, "sig_id").agg(F.first("genes").alias("genes"), F.first("size").alias("size"), F.array_sort(F.collect_set("method")).alias("methods"), F.min("method").alias("owner"))


def not_scored(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    return candidates.join(scored.select("sig_id", "estimator"), ["sig_id", "estimator"], "left_anti")


def containment(signatures: DataFrame, ranked: DataFrame, top: int, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, sig_id, found_in: the methods whose top features hold the whole signature."""
    genes = signatures.select(*by, "sig_id", "size", F.explode("genes").alias("feature"))
    hits = genes.join(ranked.where(F.col("pos") < top).select(*by, "method", "feature"), [*by, "feature"]).groupBy(*by, "sig_id", "size", "method").agg(F.count(F.lit(1)).alias("c"))
    return hits.where("c = size").groupBy(*by, "sig_id").agg(F.array_sort(F.collect_set("method")).alias("found_in"))


#: Ways of a signature that one row stands for before they are made.
WAYS = 4096


def expand_correlates(signatures: DataFrame, groups: DataFrame) -> DataFrame:
    """sig_id (the origin), genes, new_id: every way to replace features by correlates that were dropped for them, the origin too.

    A way is a number whose digits, in the mixed radix of the features' choices, say which choice each feature takes. The
    numbers of a signature are cut into ranges, which are dealt to tasks, and each is made into a signature there.
    """
    alike = signatures.select("sig_id", F.posexplode("genes").alias("i", "kept")).join(groups, "kept", "left")
    choice = alike.groupBy("sig_id").agg(F.sort_array(F.collect_list(F.struct("i", F.concat(F.array("kept"), F.coalesce("dropped", F.array().cast("array<string>"))).alias("g")))).alias("c"))
    begin = F.struct(F.array().cast("array<bigint>").alias("units"), F.lit(1).cast("long").alias("ways"))
    weigh = lambda a, c: F.struct(F.concat(a["units"], F.array(a["ways"])).alias("units"), (a["ways"] * F.size(c["g"])).alias("ways"))
    numbered = choice.select("sig_id", "c", F.aggregate("c", begin, weigh).alias("r")).select("sig_id", "c", "r.units", "r.ways")
    ranges = numbered.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1, F.lit(WAYS).cast("long")))).repartition("sig_id", "begin")
    each = ranges.select("sig_id", "c", "units", F.explode(F.sequence("begin", F.least(F.col("begin") + WAYS, F.col("ways")) - 1)).alias("way"))
    digit = lambda c, k: F.call_function("div", F.col("way"), F.get("units", k)) % F.size(c["g"])
    genes = F.array_sort(F.transform("c", lambda c, k: F.element_at(c["g"], (digit(c, k) + 1).cast("int"))))
    made = each.select("sig_id", genes.alias("genes"))
    return made.withColumn("new_id", F.concat_ws("|", "genes")).dropDuplicates(["sig_id", "new_id"])


def tag_correlated(signatures: DataFrame, dropped: DataFrame) -> DataFrame:
    """Add correlated: whether any feature had been dropped for a correlate."""
    names = dropped.agg(F.collect_set("feature").alias("_all"))
    return signatures.crossJoin(F.broadcast(names)).withColumn("correlated", F.arrays_overlap("genes", "_all")).drop("_all")


# Selection


def near_best(scored: DataFrame, column: str = "cv_mean", delta: float = 0.10, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Rows whose score is over the best minus delta, compared in whole thousandths."""
    return _cascade(scored, [(column, "max", delta, 3, ">")], by)


def _cascade(rows: DataFrame, steps: list[tuple], by: tuple[str, ...], gate: int = 0) -> DataFrame:
    """Filters in turn, each against the best of what is left; with a gate, only while more rows than that are left."""
    w = Window.partitionBy(*by)
    for column, agg, tolerance, digits, sign in steps:
        unit = 10**max(digits, 3)
        x = F.round(F.bround(column, digits) * unit).cast("long")
        best = F.max if agg == "max" else F.min
        edge = best(x).over(w) + round((-tolerance if agg == "max" else tolerance) * unit)
        rows = rows.withColumn("_x", x).withColumn("_edge", edge).withColumn("_n", F.count(F.lit(1)).over(w))
        test = {">": F.col("_x") > F.col("_edge"), "<": F.col("_x") < F.col("_edge"), "<=": F.col("_x") <= F.col("_edge")}[sign]
        rows = rows.where(test | (F.col("_n") <= gate)).drop("_x", "_edge", "_n")
    return rows


def even_better(scored: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    return _cascade(scored, [("adjusted", "max", 0.05, 3, ">"), ("cv_mean", "max", 0.05, 3, ">")], by)


#: Column, best, tolerance, digits and comparison of the filters that follow while over ten rows are left.
BEST_STEPS = [("mean_p", "min", 0.05, 3, "<"), ("cv_mean", "max", 0.01, 3, ">"), ("cv_std", "min", 0.01, 3, "<"), ("mean_p", "min", 0.01, 2, "<="), ("mean_p", "min", 0.005, 3, "<="), ("mean_p", "min", 0.0025, 4, "<="), ("mean_p", "min", 0.0, 9, "<=")]


def best(scored: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    first = _cascade(scored, [("cv_std", "min", 0.025, 3, "<"), ("cv_mean", "max", 0.025, 3, ">")], by)
    return _cascade(first, BEST_STEPS, by, gate=10)


def pick_estimator(scored: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, estimator, score: the estimator with the highest mean score over all signatures; the first of ``order`` among equals."""
    means = scored.groupBy(*by, "estimator").agg(F.avg("cv_mean").alias("score"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("estimator"))
    return means.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), place))).where("_r = 1").drop("_r")


def catalogue_table(scored: DataFrame, estimators: tuple[str, ...], by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, sig_id and a column cv_<estimator> for each: the catalogue's layout."""
    wide = scored.groupBy(*by, "sig_id").pivot("estimator", list(estimators)).agg(F.first("cv_mean"))
    return wide.select(*by, "sig_id", *[F.col(e).alias(f"cv_{e}") for e in estimators])


def substitutes(chosen: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, sig_id, genes, origin, methods, mean_freq, cv_mean: chosen signatures with features replaced by their correlates.

    They inherit methods and mean frequency and have a score of -5 until they are scored. Signatures that are chosen
    themselves are left out, and of several origins the first by name counts.
    """
    ways = expand_correlates(chosen.select("sig_id", "genes").distinct(), groups)
    made = chosen.select(*by, F.col("sig_id").alias("origin"), "methods", "mean_freq").join(ways.select(F.col("sig_id").alias("origin"), F.col("new_id").alias("sig_id"), "genes"), "origin")
    new = made.join(chosen.select(*by, "sig_id"), [*by, "sig_id"], "left_anti")
    first = F.min_by(F.struct("genes", "origin", "methods", "mean_freq"), "origin").alias("x")
    return new.groupBy(*by, "sig_id").agg(first).select(*by, "sig_id", "x.*", F.lit(-5.0).alias("cv_mean"))


def best_estimators(scored: DataFrame) -> DataFrame:
    """The estimators with the highest score of each signature, ties kept."""
    return scored.withColumn("_r", F.rank().over(Window.partitionBy("sig_id").orderBy(F.desc("score")))).where("_r = 1").drop("_r")


def with_means(signatures: DataFrame, frequency: DataFrame, tests: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Add mean_freq and mean_p over the features, from (by, feature, freq) and (by, feature, p)."""
    genes = signatures.select(*by, "sig_id", F.explode("genes").alias("feature")).join(frequency, [*by, "feature"], "left").join(tests.select(*by, "feature", "p"), [*by, "feature"], "left")
    means = genes.groupBy(*by, "sig_id").agg(F.avg(F.coalesce(F.col("freq"), F.lit(0.0))).alias("mean_freq"), F.avg("p").alias("mean_p"))
    return signatures.join(means, [*by, "sig_id"])


def adjusted(df: DataFrame) -> DataFrame:
    """Add adjusted = round_half_even((mean_freq / 10 + 0.9) * (cv_mean - 2 cv_std), 3)."""
    return df.withColumn("adjusted", F.bround((F.col("mean_freq") / 10 + 0.9) * (F.col("cv_mean") - 2 * F.col("cv_std")), 3))


# Tables


def feature_frequency(signatures: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """by, feature, n, freq: in how many of the signatures a feature is, and the share."""
    total = signatures.groupBy(*by).agg(F.count(F.lit(1)).alias("_t"))
    n = signatures.select(*by, F.explode(F.array_distinct("genes")).alias("feature")).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, list(by)).select(*by, "feature", "n", (F.col("n") / F.col("_t")).alias("freq"))


def mean_frequency(frequency: DataFrame, folds: int) -> DataFrame:
    return frequency.groupBy("feature").agg((F.sum("freq") / folds).alias("mean_freq"))


def max_per_rank(candidates: DataFrame, scored: DataFrame, folds: list[int], first_owner: bool = False) -> DataFrame:
    """method, a column for each fold with the best cv_mean of its signatures, and their mean.

    With ``first_owner`` a signature counts for its first method by name only, as if each were scored once, in that order.
    """
    if first_owner:
        candidates = scored.select("fold", "sig_id", F.col("owner").alias("method"))
    each = candidates.join(scored.select("fold", "sig_id", "cv_mean"), ["fold", "sig_id"]).groupBy("method").pivot("fold", folds).agg(F.max("cv_mean"))
    mean = reduce(lambda a, b: a + b, [F.col(str(f)) for f in folds]) / len(folds)
    return each.select("method", *[F.col(str(f)).alias(f"fold_{f}") for f in folds], mean.alias("mean"))


def global_table(scored: DataFrame) -> DataFrame:
    """sig_id over all folds: folds, n, mean frequency, and means and deviations of the scores."""
    return scored.groupBy("sig_id").agg(
        F.array_sort(F.collect_set("fold")).alias("folds"), F.count(F.lit(1)).alias("n"), F.avg("mean_freq").alias("mean_freq"), F.avg("cv_mean").alias("cv_mean"), F.stddev_pop("cv_mean").alias("cv_mean_std"),
        F.avg("cv_std").alias("cv_std"), F.avg("adjusted").alias("adjusted"), F.stddev_pop("adjusted").alias("adjusted_std"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
    )


def incidence(signatures: DataFrame) -> DataFrame:
    """feature, sig_id, present (0 or 1), n (the feature's signatures): the matrix in long form."""
    has = signatures.select("sig_id", F.explode("genes").alias("feature")).distinct()
    n = has.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    grid = n.crossJoin(F.broadcast(signatures.select("sig_id").distinct()))
    return grid.join(has.withColumn("one", F.lit(1)), ["feature", "sig_id"], "left").select("feature", "sig_id", F.coalesce("one", F.lit(0)).alias("present"), "n")


def double_cv(outer: DataFrame) -> DataFrame:
    """fold (text), mean, std, n of the independent scores of each fold's best signatures; a last row "all" for the means of folds."""
    each = outer.groupBy(F.col("fold").cast("string").alias("fold")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n"))
    total = each.agg(F.lit("all").alias("fold"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("std"), F.sum("n").alias("n")).withColumnRenamed("m", "mean")
    return each.unionByName(total)
