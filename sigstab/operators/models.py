"""Rankers and estimators that fit models: MLlib for rows at any scale, numpy on summed moments or on one small group.

Rankers return (feature, score), higher better; results depend on the optimiser, so their queries have no SQL twin.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier, DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..functions.storage import stored
from . import evaluate, kernel, linear, resample, scaling

TREES, SEED = 83, 0
#: Fits that the driver has running side by side.
AT_ONCE = 4
#: Values of packed rows in a part that a fit reads again and again, at most: 64 MB.
CELLS = 8_000_000


def pack(obs: DataFrame, names: list[str], scaled: bool = True) -> DataFrame:
    """sample_id, label (double), features (vector in the order of ``names``); missing features count as 0.

    Values are sorted by the place of their feature, so a complete sample costs no look-up.
    """
    moments = {r[0]: r[1:] for r in obs.groupBy("feature").agg(F.avg("value"), F.stddev_pop("value")).collect()} if scaled else {}
    places = obs.sparkSession.createDataFrame([(k, n, *moments.get(n, (None, None))) for k, n in enumerate(names)], "place int, feature string, mean double, sd double")
    value = (F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")) if scaled else F.col("value")
    cell = F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce(value, F.lit(0.0)).alias("value")))
    # the table has a row a feature and came from the driver, so it goes out and the matrix isn't shuffled by feature
    rows = obs.join(F.broadcast(places), "feature", "left").groupBy("sample_id", "y").agg(F.sort_array(F.collect_list(cell)).alias("m"))
    found = F.map_from_entries(F.col("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.coalesce(F.element_at(found, k), F.lit(0.0)))
    cells = F.when(F.size("m") == len(names), F.transform("m", lambda c: c["value"])).otherwise(filled)
    return rows.select("sample_id", F.col("y").cast("double").alias("label"), array_to_vector(cells).alias("features"))


def names_of(obs: DataFrame) -> list[str]:
    return [r[0] for r in obs.select("feature").distinct().orderBy("feature").collect()]


def estimator(name: str, c: float = 1.0, rows: int = 1, seed: int = SEED):
    """An estimator of the catalogue: lasso, ridge, svm, tree or forest."""
    penalty = 1 / (c * rows)
    return {
        "lasso": lambda: LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False),
        "ridge": lambda: LogisticRegression(elasticNetParam=0.0, regParam=penalty, standardization=False),
        "svm": lambda: OneVsRest(classifier=LinearSVC(regParam=penalty, standardization=False), parallelism=AT_ONCE),
        "tree": lambda: DecisionTreeClassifier(seed=seed),
        "forest": lambda: RandomForestClassifier(numTrees=TREES, seed=seed),
    }[name]()


def weights(model) -> np.ndarray:
    """Importance of each feature: of trees, or the absolute coefficient (of several classes, of their mean)."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "models"):
        return np.abs(np.mean([m.coefficients.toArray() for m in model.models], axis=0))
    w = model.coefficientMatrix.toArray()
    return np.abs(w[0] if len(w) == 1 else w.mean(axis=0))


def _frame(like: DataFrame, names: list[str], score) -> DataFrame:
    return like.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, score, strict=True)], "feature string, score double")


def in_few_parts(rows: DataFrame, cells: int) -> DataFrame:
    """Packed rows of so many cells, in a part for each core or CELLS: a fit passes over them hundreds of times, with a task a part."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS)))


def weight_rank(obs: DataFrame, name: str, c: float = 1.0) -> DataFrame:
    names = names_of(obs)
    rows = in_few_parts(pack(obs, names), obs.count()).cache()
    found = weights(estimator(name, c, rows.count()).fit(rows))
    rows.unpersist()
    return _frame(obs, names, found)


def train_and_test(obs: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Packed training and test rows of a matrix with is_test, both scaled by the training rows alone."""
    z = scaling.zscore_by_train(obs, ())
    return pack(z.where(~F.col("is_test")), names, scaled=False), pack(z.where("is_test"), names, scaled=False)


def _accuracy(predicted: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predicted)


def _squared_weights(rows: DataFrame, keep: list[int], name: str, n: int) -> np.ndarray:
    x = rows.select("label", array_to_vector(F.transform(F.array(*[F.lit(k + 1) for k in keep]), lambda k: F.element_at(vector_to_array("features"), k))).alias("features"))
    return weights(estimator(name, rows=n).fit(x)) ** 2


def _fitted(obs: DataFrame, kind: str, name: str) -> DataFrame:
    """feature, score of a rank type of ``linear`` for one matrix."""
    rows, places = linear.packed(obs.withColumn("fold", F.lit(0)), 1, 0)
    found = linear.fits(stored(rows), 1, (name,)).where(F.col("kind") == kind)
    return found.join(places, ["fold", "pos"]).select("feature", F.col("w").alias("score"))


def elimination_rank(obs: DataFrame, name: str = "ridge") -> DataFrame:
    """Recursive elimination to one feature: the score is the round in which a feature goes, so the last one is best.

    Linear estimators (``linear``) are solved from one set of cross products; trees are fitted anew in each round.
    """
    if name in linear.ESTIMATORS:
        return _fitted(obs, "t4_elimination", name)
    names = names_of(obs)
    rows, left, score = pack(obs, names).cache(), list(range(len(names))), np.zeros(len(names))
    n = rows.count()
    for step in range(len(names)):
        w = _squared_weights(rows, left, name, n) if len(left) > 1 else np.zeros(1)
        gone = left.pop(int(np.argmin(w)))
        score[gone] = step
    rows.unpersist()
    return _frame(obs, names, score)


def addition_rank(obs: DataFrame, name: str = "ridge") -> DataFrame:
    """Recursive addition: each round fits what is left and takes out its heaviest feature; the earlier, the better."""
    return _fitted(obs, "t7_addition", name)


def addition_cv(obs: DataFrame, k: int = 3, name: str = "ridge") -> DataFrame:
    """features, score: mean accuracy over folds of the first 1..n features of each fold's addition ranking.

    A fold's ranking and all its nested models come from its cross products; the held rows of all folds are scored in one pass.
    """
    split = resample.fold_splits(resample.samples_of(obs), k).select("sample_id", F.col("split").alias("fold"), "is_test")
    rows, _ = linear.packed(obs.join(split, "sample_id").drop("label"), 1, 0)
    rows = stored(rows.join(split, ["fold", "sample_id"]))
    fit = rows.where("not is_test").withColumn("sets", F.array(F.lit(linear.WHOLE)))
    sums = stored(linear.cross_products(fit))
    plain = sums.select("*", F.lit(False).alias("margin"))
    both = plain.unionByName(linear.margins(fit, sums).select("*", F.lit(True).alias("margin"))) if name == "svm" else plain

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, total = linear.stacked(pdf[~pdf["margin"]])
        margin = linear.stacked(pdf[pdf["margin"]])[1] if name == "svm" else None
        order = np.argsort(linear.System(name, total, margin, linear.PENALTY[name]).order(True), kind="stable")
        out = []
        for size in range(1, len(order) + 1):
            some = np.concatenate([[0], order[:size] + 1])
            inside = None if margin is None else margin[:, np.append(some, margin.shape[1] - 1)][:, :, np.append(some, margin.shape[1] - 1)]
            system = linear.System(name, total[:, some][:, :, some], inside, linear.PENALTY[name])
            raw, base = system.decision(system.weights())
            out += [(int(key[0]), size, int(c), float(b), order[:size].tolist(), w.tolist()) for c, b, w in zip(codes, base, raw, strict=True)]
        return pd.DataFrame(out, columns=["fold", "size", "c", "b", "at", "w"])

    models: dict[int, dict[int, list]] = {}
    for r in both.groupBy("fold").applyInPandas(solve, "fold int, size int, c int, b double, at array<int>, w array<double>").collect():
        models.setdefault(r["fold"], {}).setdefault(r["size"], []).append(r)

    def score(batches):
        for pdf in batches:
            for fold, some in pdf.groupby("fold"):
                x, y = linear.dense(some)[:, 1:], some["y"].to_numpy()
                for size, each in models[int(fold)].items():
                    each = sorted(each, key=lambda r: r["c"])
                    scores = np.stack([x[:, r["at"]] @ np.array(r["w"]) + r["b"] for r in each], axis=1)
                    hit = np.array([r["c"] for r in each])[np.round(scores, 9).argmax(axis=1)] == y
                    yield pd.DataFrame({"fold": [int(fold)], "features": [size], "hit": [int(hit.sum())], "n": [len(y)]})

    counts = rows.where("is_test").mapInPandas(score, "fold int, features int, hit long, n long")
    return counts.groupBy("fold", "features").agg((F.sum("hit") / F.sum("n")).alias("score")).groupBy("features").agg(F.avg("score").alias("score"))


def stability_selection(obs: DataFrame, bags: int = 8) -> DataFrame:
    """feature, score: in which share of subsamples (three quarters of the rows, by hash) and of a path of L1 penalties the
    feature is used. A whole path comes from the cross products of a subsample, which Spark adds up (``linear``)."""
    rows, places = linear.packed(obs.withColumn("fold", F.lit(0)), 1, bags)
    found = linear.fits(stored(rows), 1, ("lasso",)).where("kind = 't5_stability'").groupBy("fold", "pos").agg(F.avg("w").alias("score"))
    return found.join(places, ["fold", "pos"]).select("feature", "score")


def lda_rank(obs: DataFrame, shrink: float = 1e-3) -> DataFrame:
    """feature, score: absolute coefficient of the linear discriminant of two classes; of more, of the mean of one for each
    class. The cross products are summed on the cluster, and a task solves one system of features."""
    rows, places = linear.packed(obs.withColumn("fold", F.lit(0)), 1, 0)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = linear.System("lda", linear.stacked(pdf)[1], None, shrink).weights()
        score = np.abs(w[1] - w[0] if len(w) == 2 else w.mean(axis=0))
        return pd.DataFrame({"fold": 0, "pos": np.arange(len(score)), "score": score})

    sums = linear.cross_products(stored(rows)).where(F.col("set") == linear.WHOLE)
    return sums.groupBy("fold").applyInPandas(solve, "fold int, pos int, score double").join(places, ["fold", "pos"]).select("feature", "score")


def kernel_classifier(train: DataFrame, test: DataFrame, gamma: float | None = None, c: float = 1.0, most: int = kernel.MOST) -> DataFrame:
    """sample_id, y_true, y_pred of support vector machines with a Gaussian kernel (``kernel``); both sides are scaled by ``train``."""
    names = names_of(train)
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)
    fit, held = train_and_test(both, names)
    return kernel.classify(fit.cache(), held, gamma, c, most)


def grid_search(obs: DataFrame, name: str = "ridge", grid: tuple[float, ...] = (1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0), k: int = 3) -> DataFrame:
    """c, score: mean accuracy of k stratified folds for each C; each fold is scaled by its own training rows."""
    names = names_of(obs)
    split = obs.join(resample.stratified_folds(resample.samples_of(obs), k).select("sample_id", "fold"), "sample_id")
    scored = []
    for fold in range(k):
        fit, held = (x.cache() for x in train_and_test(split.withColumn("is_test", F.col("fold") == fold).drop("fold"), names))
        n, model = fit.count(), estimator(name)
        fits = model.fitMultiple(fit, [{model.regParam: 1 / (c * n)} for c in grid])
        with ThreadPool(AT_ONCE) as pool:
            for place, fitted in pool.imap_unordered(lambda _: next(fits), grid):  # noqa: B023
                scored.append((float(grid[place]), _accuracy(fitted.transform(held))))
        fit.unpersist()
        held.unpersist()
    return obs.sparkSession.createDataFrame(scored, "c double, score double").groupBy("c").agg(F.avg("score").alias("score"))


def bagged_centroids(obs: DataFrame, splits: DataFrame, bags: int = 16, share: float = 0.5, seed: int = 0) -> DataFrame:
    """split, sample_id, y_true, y_pred: majority of nearest-centroid votes, each bag with a hashed share of the features."""
    d = evaluate.feature_distances(obs, splits)
    chosen = obs.select("feature").distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    u = F.conv(F.substring(hash_order(F.lit(seed), F.col("bag"), F.col("feature")), 1, 8), 16, 10).cast("long") / 4294967296.0
    votes = evaluate.predict(d, chosen.where(u < share).groupBy(F.col("bag").cast("string").alias("sig_id")).agg(F.collect_list("feature").alias("genes")))
    count = votes.groupBy("split", "sample_id", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("split", "sample_id", "y_true").agg(F.max(F.struct("n", (-F.col("y_pred")).alias("c"))).alias("b")).select("split", "sample_id", "y_true", (-F.col("b.c")).alias("y_pred"))


def soft_vote(obs: DataFrame, estimators: tuple[str, ...] = ("ridge", "forest")) -> DataFrame:
    """sample_id, y_true, y_pred, true_probability: mean class probabilities of several estimators, fitted to the whole matrix."""
    names = names_of(obs)
    rows = pack(obs, names).cache()
    n = rows.count()
    each = [estimator(e, rows=n).fit(rows).transform(rows).select("sample_id", "label", F.posexplode(vector_to_array("probability")).alias("c", "p")) for e in estimators]
    mean = reduce(DataFrame.union, each).groupBy("sample_id", "label", "c").agg(F.avg("p").alias("p"))
    best = F.max(F.struct("p", (-F.col("c")).alias("c")))
    return mean.groupBy("sample_id", "label").agg(best.alias("b"), F.max(F.when(F.col("c") == F.col("label"), F.col("p"))).alias("true_probability")).select("sample_id", F.col("label").cast("int").alias("y_true"), (-F.col("b.c")).alias("y_pred"), "true_probability")


def neighbour_information(obs: DataFrame, k: int = 3) -> DataFrame:
    """feature, score: the nearest-neighbour estimate of mutual information with the class; a group is one feature's column."""

    def digamma(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        shift = np.zeros_like(x)
        for _ in range(6):
            low = x < 6
            shift = shift - np.where(low, 1 / x, 0)
            x = np.where(low, x + 1, x)
        return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "sample_id"])
        x, y = pdf["value"].to_numpy(), pdf["y"].to_numpy()
        radius, own, used = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
        for c in np.unique(y):
            at = np.flatnonzero(y == c)
            v, m = x[at], len(at)
            if m < 2:
                continue
            kk = min(k, m - 1)
            near = np.full((m, 2 * kk), np.inf)
            for j in range(1, kk + 1):
                near[j:, 2 * j - 2] = v[j:] - v[:-j]
                near[:-j, 2 * j - 1] = v[j:] - v[:-j]
            radius[at] = np.sort(near, axis=1)[:, kk - 1]
            own[at], used[at] = m, True
        within = np.searchsorted(x, x + radius, "left") - np.searchsorted(x, x - radius, "right")
        n = used.sum()
        mi = digamma(np.array([n])) + digamma(np.minimum(k, own[used] - 1)).mean() - digamma(own[used]).mean() - digamma(np.maximum(within[used], 1)).mean()
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1].to_numpy(), "score": np.maximum(mi, 0)})

    return obs.select("feature", "sample_id", "y", "value").groupBy("feature").applyInPandas(score, "feature string, score double")
