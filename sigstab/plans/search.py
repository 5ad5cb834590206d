"""The whole search as one lazy plan: rank in each outer fold, propose signatures, score them inside, select, and test outside."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stored
from ..operators import bagged, evaluate, forest, linear, ranking, resample, signatures, stats


@dataclass(frozen=True)
class RankConfig:
    """Settings of the ranking stage; ``p_value`` None ranks all features ("no filter").

    ``test`` filters by kruskal (three classes), wilcoxon or t_test (two). With ``fdr``, a fold in which fewer than
    ``least_features`` pass is filtered by ``p_value`` instead. ``fitted`` adds the rankings of fitted estimators (linear
    ones and trees) to those that need sums only. ``check`` raises on matrices that the folds don't fit.
    """

    outer_folds: int = 4
    p_value: float | None = 0.5
    fdr: float | None = None
    least_features: int = 4
    correlation_cut: float | None = None
    test: str = "kruskal"
    check: bool = True
    fitted: bool = False
    inner_parts: int = 3
    subsamples: int = 8
    trees: int = forest.TREES


@dataclass(frozen=True)
class SignatureConfig:
    """Settings of the signature stage: the longest prefix of a ranking, sizes of which all combinations of its first
    ``most_features`` are tried, and sizes of which ``samples`` times the size are drawn by hash."""

    most_features: int = 5
    inner_splits: int = 3
    top_frequency: int = 10
    delta: float = 0.10
    combinations: tuple[int, ...] = ()
    sampled: tuple[int, ...] = ()
    samples: int = 200
    bags: int = 16
    candidate_splits: int = 5
    final_splits: int = 8


def folds(obs: DataFrame, k: int) -> DataFrame:
    """sample_id, fold, outer: every sample in every fold, and whether it is the fold's test."""
    return resample.fold_splits(resample.samples_of(obs), k).select("sample_id", F.col("split").alias("fold"), F.col("is_test").alias("outer"))


TESTS = {"kruskal": stats.kruskal, "wilcoxon": stats.wilcoxon, "t_test": stats.t_test}


def kruskal_by_fold(obs: DataFrame, config: RankConfig = RankConfig()) -> DataFrame:
    """fold, feature, h, p of every fold's training rows, stored: the filter, a ranking and the signatures' mean p read it."""
    return stored(stats.kruskal(obs.join(folds(obs, config.outer_folds), "sample_id").where("not outer"), ("fold",)))


def train_rows(obs: DataFrame, config: RankConfig = RankConfig(), tested: DataFrame | None = None) -> DataFrame:
    """The training rows of every fold, with the features that pass the fold's filter and aren't correlated."""
    train = obs.join(folds(obs, config.outer_folds), "sample_id").where("not outer").drop("outer")
    if config.p_value is not None or config.fdr is not None:
        each = tested if tested is not None and config.test == "kruskal" else TESTS[config.test](train, ("fold",))
        tests = stats.benjamini_hochberg(each, ("fold",))
        by_p = F.col("p") < config.p_value if config.p_value is not None else F.lit(True)
        if config.fdr is not None:
            enough = F.count_if(F.col("q") < config.fdr).over(Window.partitionBy("fold")) >= config.least_features
            by_p = F.when(enough, F.col("q") < config.fdr).otherwise(by_p)
        good = tests.withColumn("_good", by_p).where("_good")
        train = train.join(good.select("fold", "feature"), ["fold", "feature"], "left_semi")
    if config.correlation_cut is not None:
        pairs = stats.pearson_tests(stats.pearson_pairs(train, ("fold",)), ("fold",))
        gone = pairs.where((F.col("q") < 0.05) & (F.abs("r") > config.correlation_cut)).select("fold", F.col("b").alias("feature"))
        train = train.join(gone, ["fold", "feature"], "left_anti")
    return train


def rank(obs: DataFrame, config: RankConfig = RankConfig(), tested: DataFrame | None = None) -> DataFrame:
    """fold, method, feature, score, pos. The training rows are cached or stored, since each method scans them; the small result is stored.

    ``tested`` is ``kruskal_by_fold`` of the same rows, if the caller has it: a feature's rows in a fold all stay or all go,
    so the ranking by the test is that of the features left.
    """
    tested = kruskal_by_fold(obs, config) if tested is None else tested
    rows = stored(train_rows(obs, config, tested)) if config.fitted else train_rows(obs, config, tested).cache()
    left = rows.select("fold", "feature").distinct()
    known = {"t1_kruskal": lambda _, by: tested.join(left, ["fold", "feature"], "left_semi").select(*by, "feature", F.col("h").alias("score"))}
    scores = ranking.score(rows, methods=ranking.scorers() | known)
    if config.fitted:
        scores = scores.unionByName(linear.rank(rows, config.inner_parts, config.subsamples))
        scores = scores.unionByName(forest.rank(rows, config.inner_parts, config.subsamples, config.trees))
    out = stored(ranking.positions(ranking.normalise(scores)))
    rows.unpersist()
    return out


def inner_splits(obs: DataFrame, ranks: RankConfig, k: int) -> DataFrame:
    """sample_id, fold, split, is_test: k stratified folds inside the training part of each outer fold."""
    outer = folds(obs, ranks.outer_folds).where("not outer").join(resample.samples_of(obs), "sample_id")
    inner = resample.stratified_folds(outer.withColumn("label", F.concat_ws("/", F.col("fold"), "label")).withColumnRenamed("fold", "_f"), k)
    splits = inner.select("sample_id", F.col("_f").alias("outer_fold"), F.col("fold").alias("part")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return splits.select("sample_id", F.col("outer_fold").alias("fold"), "split", (F.col("part") == F.col("split")).alias("is_test"))


def blocks_of(obs: DataFrame) -> int:
    """In how many blocks a split's samples are scored."""
    return max(1, math.ceil(obs.select("sample_id").distinct().count() / evaluate.SAMPLES))


def search(obs: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig(), ranked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates by method, signatures scored): fold, sig_id, genes, size, methods, cv_mean, cv_std, mean_freq, mean_p, adjusted."""
    if ranks.check:
        resample.check_classes(obs, ranks.outer_folds)
    most = resample.feature_limit(obs, config.most_features)
    tested = kruskal_by_fold(obs, ranks)
    ranked = rank(obs, ranks, tested) if ranked is None else ranked
    found = signatures.prefixes(ranked, most)
    for k in (*config.combinations, *config.sampled):
        limit = config.samples * k if k in config.sampled else None
        found = found.unionByName(signatures.combinations(ranked, most, k, limit))
    unique = stored(signatures.catalogue(found))
    splits = inner_splits(obs, ranks, config.inner_splits)
    used = unique.select(F.explode("genes").alias("feature")).distinct()
    counts = evaluate.packed_confusion(obs.join(used, "feature", "left_semi"), splits, unique, ("fold", "split"), ("fold",), ("centroid",), blocks_of(obs))
    scored = evaluate.counted_summary(counts, ("fold", "sig_id"))
    freq = ranking.top_counts(ranked, config.top_frequency).join(ranked.groupBy("fold").agg(F.count_distinct("method").alias("m")), "fold").select("fold", "feature", (F.col("n") / F.col("m")).alias("freq"))
    full = signatures.with_means(unique, freq, tested)
    return found, stored(signatures.adjusted(full.join(scored, ["fold", "sig_id"])))


def rescore(obs: DataFrame, found: DataFrame, k: int, ranks: RankConfig = RankConfig()) -> DataFrame:
    """``found`` with cv_mean and cv_std of k inner splits instead of its own, and adjusted from these."""
    used, splits = found.select(F.explode("genes").alias("feature")).distinct(), inner_splits(obs, ranks, k)
    counts = evaluate.packed_confusion(obs.join(used, "feature", "left_semi"), splits, found, ("fold", "split"), ("fold",), ("centroid",), blocks_of(obs))
    scores = evaluate.counted_summary(counts, ("fold", "sig_id"))
    return signatures.adjusted(found.drop("cv_mean", "cv_std", "adjusted").join(scores, ["fold", "sig_id"]))


def candidates(obs: DataFrame, scored: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig()) -> DataFrame:
    """The signatures near their fold's best, scored again with more splits."""
    return stored(rescore(obs, signatures.near_best(scored, delta=config.delta), config.candidate_splits, ranks))


def with_correlates(obs: DataFrame, chosen: DataFrame, groups: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig()) -> DataFrame:
    """fold, sig_id, genes, methods, mean_freq, cv_mean, cv_std, adjusted, correlate: the chosen signatures, and of those made
    of them with correlates the ones that score over the fold's best chosen one less delta."""
    made = rescore(obs, stored(signatures.substitutes(chosen, stored(groups))), config.candidate_splits, ranks)
    columns = ["fold", "sig_id", "genes", "methods", "mean_freq", "cv_mean", "cv_std", "adjusted"]
    edge = chosen.groupBy("fold").agg((F.round(F.max("cv_mean") * 1000) - round(config.delta * 1000)).alias("edge"))
    near = made.join(edge, "fold").where(F.round(F.col("cv_mean") * 1000) > F.col("edge"))
    both = chosen.select(*columns, F.lit(False).alias("correlate")).unionByName(near.select(*columns, F.lit(True).alias("correlate")))
    return both.dropDuplicates(["fold", "sig_id"])


def estimator_scores(obs: DataFrame, found: DataFrame, k: int, ranks: RankConfig = RankConfig(), names: tuple[str, ...] = evaluate.ESTIMATORS) -> DataFrame:
    """fold, sig_id, estimator, cv_mean, cv_std of every estimator in k inner splits: one pass, with estimators as keys."""
    used, splits = found.select(F.explode("genes").alias("feature")).distinct(), inner_splits(obs, ranks, k)
    counts = evaluate.packed_confusion(obs.join(used, "feature", "left_semi"), splits, found, ("fold", "split"), ("fold",), names, blocks_of(obs))
    return evaluate.counted_summary(counts, ("fold", "sig_id", "estimator"))


def model_scores(obs: DataFrame, found: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig()) -> DataFrame:
    """fold, sig_id, estimator, cv_mean, cv_std of every estimator, additive, linear and bagged, in the same inner splits."""
    additive = estimator_scores(obs, found, config.inner_splits, ranks)
    linear_ = bagged.scores(obs, found, inner_splits(obs, ranks, config.inner_splits), config.bags, blocks_of(obs))
    return stored(additive.unionByName(linear_))


def final_evaluation(obs: DataFrame, chosen: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig(), oversample: bool = False) -> DataFrame:
    """fold, sig_id, estimator, part ("cv": means over inner splits, "test": fitted on the fold's training rows, scored outside),
    the metrics of predictions and of probabilities, and best: whether the estimator's f1 is the part's highest (the first of
    the catalogue among equals). ``oversample`` adds the part "test_smote": fitted on the training rows and the synthetic
    ones that balance their classes."""
    chosen = stored(chosen)
    used = chosen.select(F.explode("genes").alias("feature")).distinct()
    obs = obs.join(used, "feature", "left_semi")
    inside = inner_splits(obs, ranks, config.final_splits).withColumn("part", F.lit("cv"))
    outside = folds(obs, ranks.outer_folds).select("sample_id", "fold", F.lit(0).alias("split"), F.col("outer").alias("is_test"), F.lit("test").alias("part"))
    keys = ("part", "fold", "split")
    by = ("part", "estimator", "fold", "split", "sig_id")
    blocks = math.ceil(blocks_of(obs) / ranks.outer_folds)  # a split tests a fold's rows, or a part of the others
    shares = evaluate.packed_shares(obs, inside.unionByName(outside), chosen, keys, ("fold",), blocks=blocks)
    each = evaluate.shares_metrics(shares, by)
    if oversample:
        train = stored(obs.join(outside.where("not is_test").select("sample_id", "fold"), "sample_id"))
        extra = stored(resample.smote_by_fold(train, list(range(ranks.outer_folds)))).select("*", F.lit(0).alias("split"), F.lit("test_smote").alias("part"))
        splits = outside.withColumn("part", F.lit("test_smote"))
        sums = stored(evaluate.loss_sums(evaluate.estimator_distances(obs, splits, keys, extra=extra), chosen, by[:-1], ("fold",)))
        plain = evaluate.metrics(evaluate.confusion(evaluate.nearest(sums, by), by), by)
        each = each.unionByName(plain.join(evaluate.probability_metrics(evaluate.probabilities(sums, by), by), list(by)))
    names = [c for c in each.columns if c not in by]
    means = each.groupBy("fold", "sig_id", "estimator", "part").agg(*[F.avg(c).alias(c) for c in names])
    place = F.array_position(F.array(*map(F.lit, evaluate.ESTIMATORS)), F.col("estimator"))
    order = Window.partitionBy("fold", "sig_id", "part").orderBy(F.round("f1", 9).desc(), place)
    return means.withColumn("best", F.row_number().over(order) == 1)


#: The number of the split whose test rows are an outer fold's.
OUTSIDE = 1_000_000


def model_evaluation(obs: DataFrame, chosen: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig()) -> DataFrame:
    """``final_evaluation`` of the linear models and their bagged forms: metrics of predictions, inside (cv) and outside (test)."""
    chosen = stored(chosen.select("fold", "sig_id", "genes").distinct())
    outside = folds(obs, ranks.outer_folds).select("sample_id", "fold", F.lit(OUTSIDE).alias("split"), F.col("outer").alias("is_test"))
    splits = stored(inner_splits(obs, ranks, config.final_splits).unionByName(outside))
    counts = bagged.confusion(obs, splits, chosen, blocks=blocks_of(obs))
    if config.bags:
        bags = bagged.confusion(obs, splits, chosen, config.bags, blocks=blocks_of(obs))
        counts = counts.unionByName(bags.withColumn("estimator", F.concat(F.lit("bag_"), "estimator")))
    by = ("part", "estimator", "fold", "split", "sig_id")
    each = evaluate.metrics(stored(counts.withColumn("part", F.when(F.col("split") == OUTSIDE, "test").otherwise("cv"))), by)
    return each.groupBy("fold", "sig_id", "estimator", "part").agg(*[F.avg(c).alias(c) for c in each.columns if c not in by])


def outer_scores(obs: DataFrame, chosen: DataFrame, ranks: RankConfig = RankConfig(), oversample: bool = False) -> DataFrame:
    """fold, sig_id, score: accuracy of each chosen signature on its fold's test samples; ``oversample`` balances the training rows."""
    splits = folds(obs, ranks.outer_folds).withColumnRenamed("outer", "is_test")
    extra = stored(resample.smote_by_fold(stored(obs.join(splits, "sample_id").where("not is_test")), list(range(ranks.outer_folds)))) if oversample else None
    d = evaluate.feature_distances(obs, splits, ("fold",), extra)
    return evaluate.accuracy(evaluate.predict(d, chosen, ("fold",), ("fold",)), ("fold", "sig_id"))


def double_cross_validation(obs: DataFrame, config: SignatureConfig = SignatureConfig(), ranks: RankConfig = RankConfig()) -> DataFrame:
    """fold, mean, std, n of the outer scores of each fold's best signatures, and the row of all folds."""
    _, scored = search(obs, config, ranks)
    return signatures.double_cv(outer_scores(obs, stored(signatures.best(scored)), ranks))


def double_cross_validation_oversampled(obs: DataFrame, chosen: DataFrame, ranks: RankConfig = RankConfig()) -> DataFrame:
    """``double_cross_validation`` of chosen signatures, with mean_smote and std_smote of scores with balanced training rows."""
    chosen = stored(chosen)
    plain = signatures.double_cv(outer_scores(obs, chosen, ranks))
    even = signatures.double_cv(outer_scores(obs, chosen, ranks, oversample=True))
    return plain.join(even.select("fold", F.col("mean").alias("mean_smote"), F.col("std").alias("std_smote")), "fold")
