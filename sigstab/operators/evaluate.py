"""Cross-validation of signatures with nearest centroids, as joins and sums, and metrics of predictions.

Each feature's squared distances to the class means are worked out once for every split; a signature's distances are
sums over its features. Distances are rounded to nine digits, and ties go to the lower class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scaling


def _split_rows(obs: DataFrame, splits: DataFrame, keys: tuple[str, ...], extra: DataFrame | None = None) -> DataFrame:
    """z-scored rows of every split, by its training part; ``extra`` are training rows (keys, y, feature, value) besides."""
    rows = obs.join(splits.drop("label"), "sample_id")
    if extra is not None:
        rows = rows.unionByName(extra.withColumn("is_test", F.lit(False)), allowMissingColumns=True)
    return scaling.zscore_by_train(rows, keys)


def _centroids(z: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return z.where(~F.col("is_test")).groupBy(*keys, "feature", F.col("y").alias("c")).agg(F.avg("value").alias("m"))


def feature_distances(obs: DataFrame, splits: DataFrame, keys: tuple[str, ...] = ("split",), extra: DataFrame | None = None) -> DataFrame:
    """keys, sample_id, y, feature, c, d: squared distance of each test value to the class mean of c."""
    z = _split_rows(obs, splits, keys, extra)
    tests = z.where("is_test").select(*keys, "sample_id", "y", "feature", "value")
    return tests.join(_centroids(z, keys), [*keys, "feature"]).select(*keys, "sample_id", "y", "feature", "c", F.pow(F.col("value") - F.col("m"), 2).alias("d"))


#: Estimators whose loss is a sum over features, in the catalogue's order.
ESTIMATORS = ("centroid", "naive_bayes", "manhattan")


def estimator_distances(obs: DataFrame, splits: DataFrame, keys: tuple[str, ...] = ("split",), names: tuple[str, ...] = ESTIMATORS, extra: DataFrame | None = None) -> DataFrame:
    """keys, estimator, sample_id, y, feature, c, d: each test value's loss for class c, which signatures add up.

    ``extra`` are training rows (keys, y, feature, value) besides.

    centroid: squared distance to the class mean; manhattan: absolute distance; naive_bayes: twice the negative logarithm
    of the normal density, but for a constant (classes count as equally likely; variances are not under 1e-9).
    """
    z = _split_rows(obs, splits, keys, extra)
    each = z.where(~F.col("is_test")).groupBy(*keys, "feature", F.col("y").alias("c")).agg(F.avg("value").alias("m"), F.greatest(F.lit(1e-9), F.var_pop("value")).alias("v"))
    gap = F.col("value") - F.col("m")
    loss = {"centroid": gap * gap, "manhattan": F.abs(gap), "naive_bayes": gap * gap / F.col("v") + F.log("v")}
    both = z.where("is_test").select(*keys, "sample_id", "y", "feature", "value").join(each, [*keys, "feature"])
    many = F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), loss[n].alias("d")) for n in names])).alias("x")
    return both.select(*keys, "sample_id", "y", "feature", "c", many).select(*keys, "x.estimator", "sample_id", "y", "feature", "c", "x.d")


def nearest(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    first = F.min(F.struct(F.round("d", 9).alias("d"), "c"))
    return sums.groupBy(*keys, "sample_id", "y").agg(first.alias("x")).select(*keys, "sample_id", F.col("y").alias("y_true"), F.col("x.c").alias("y_pred"))


def predict(d: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("split",), on: tuple[str, ...] = ()) -> DataFrame:
    """keys, sig_id, sample_id, y_true, y_pred for signatures (on, sig_id, genes); ``on`` are keys that both sides share."""
    return nearest(loss_sums(d, signatures, keys, on), (*keys, "sig_id"))


def loss_sums(d: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("split",), on: tuple[str, ...] = ()) -> DataFrame:
    """keys, sig_id, sample_id, y, c, d: losses added up over each signature's features."""
    genes = signatures.select(*on, "sig_id", F.explode("genes").alias("feature"))
    return d.join(genes, [*on, "feature"]).groupBy(*keys, "sig_id", "sample_id", "y", "c").agg(F.sum("d").alias("d"))


#: Test samples and signatures of a unit of work, about.
SAMPLES, SIGNATURES = 1024, 4096


def trie_confusion(d: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("split",), on: tuple[str, ...] = (), blocks: int = 1, units: DataFrame | None = None) -> DataFrame:
    """keys, sig_id, y_true, y_pred, n: what ``predict`` gives, counted, without a row for each signature, feature and sample.

    A unit has a block of the test samples of one split and a chunk of the signatures, which share their first features.
    It walks the signatures as a trie over their features: a node adds its feature's losses of all samples to those of
    its parent, so a beginning that signatures share is added up once. ``blocks`` deals each split's samples by hash;
    ``units`` has the keys that occur, if they are known without a look at ``d``.
    """
    rows = signatures.select(*on, "sig_id", "genes")
    chunks = max(1, math.ceil((rows.groupBy(*on).count().agg(F.max("count")).first()[0] or 0) / SIGNATURES))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(F.element_at("genes", 1)), F.lit(chunks)).cast("int"))
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("_block")
    losses = d.select(*keys, "sample_id", "y", "feature", "c", "d", block, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
    units = (d if units is None else units).select(*[F.col(k).alias(k) for k in keys]).distinct()
    each = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = units.join(each, list(on)) if on else units.crossJoin(each)
    of = [*keys, "_block", "_chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in losses.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sig_id string, y_true int, y_pred int, n long"

    def walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_walk(left, right), columns=["sig_id", "y_true", "y_pred", "n"]) if len(left) and len(right) else pd.DataFrame(columns=["sig_id", "y_true", "y_pred", "n"])
        for k, v in zip(keys, key, strict=False):
            out[k] = v
        return out[[*keys, "sig_id", "y_true", "y_pred", "n"]]

    counts = losses.groupBy(*of).cogroup(units.groupBy(*of)).applyInPandas(walk, schema)
    return counts.groupBy(*keys, "sig_id", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def _walk(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
    """(sig_id, y_true, y_pred, n) of the signatures of a chunk for the losses of a block of samples."""
    samples, at = np.unique(left["sample_id"], return_inverse=True)
    classes, c = np.unique(left["c"], return_inverse=True)
    features, f = np.unique(left["feature"], return_inverse=True)
    loss = np.zeros((len(features), len(samples), len(classes)))
    known = np.zeros(loss.shape, bool)
    np.add.at(loss, (f, at, c), left["d"].fillna(0).to_numpy())
    known[f, at, c] = True
    truth = np.zeros(len(samples), int)
    truth[at] = left["y"]
    return _descend(loss, known, truth, classes, {name: k for k, name in enumerate(features)}, right)


def _descend(loss: np.ndarray, known: np.ndarray, truth: np.ndarray, classes: np.ndarray, place: dict, right: pd.DataFrame) -> list[tuple]:
    """``_walk`` for losses by (feature, sample, class), and whether they are known."""
    width = int(classes.max()) + 1
    out = []
    for name, total, seen in _added_up(loss, known, place, right):
        some_class = seen.any(axis=1)
        pred = classes[np.where(seen, np.round(total, 9), np.inf).argmin(axis=1)]
        count = np.bincount((truth * width + pred)[some_class])
        out += [(name, int(x // width), int(x % width), int(count[x])) for x in np.flatnonzero(count)]
    return out


def _added_up(loss: np.ndarray, known: np.ndarray, place: dict, right: pd.DataFrame) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(sig_id, losses by sample and class, whether any is known) of the signatures, from a walk of their trie."""
    path: list[int] = []
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    genes = [(tuple(place[g] for g in some if g in place), name) for some, name in zip(right["genes"], right["sig_id"], strict=True)]
    for some, name in sorted(genes):
        if not some:
            continue
        k = 0
        while k < min(len(path), len(some)) and path[k] == some[k]:
            k += 1
        del path[k:], sums[k:]
        for j in some[k:]:
            before = sums[-1] if sums else (0.0, False)
            path.append(j)
            sums.append((before[0] + loss[j], before[1] | known[j]))
        yield name, *sums[-1]


def packed_confusion(obs: DataFrame, splits: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("split",), on: tuple[str, ...] = (), names: tuple[str, ...] = ESTIMATORS, blocks: int = 1) -> DataFrame:
    """estimator, keys, sig_id, y_true, y_pred, n: the ``trie_confusion`` of ``estimator_distances``, from packed samples.

    A sample is one row with its values, and travels once for each split that tests it. Samples of the same training parts
    are summed together, by feature and class, so training rows aren't repeated for each split; a group for each of ``keys``
    merges these sums to means and deviations. A unit (block of a split's test samples, chunk of the signatures) works out
    the losses, so there is no row for a sample, feature and class.
    """
    left, right, of, keyed, known = _units(obs, splits, signatures, keys, on, blocks)
    columns = ["estimator", *keys, "sig_id", "y_true", "y_pred", "n"]
    at = {name: k for k, name in enumerate(known)}

    def walk(key: tuple, tests: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        model, wanted = pdf[pdf["sig_id"].isna()], pdf[pdf["sig_id"].notna()]
        out = []
        if len(tests) and len(model) and len(wanted):
            losses, has, classes = _losses(tests, model.iloc[0], len(known), names)
            for name in names:
                out += [(name, *key[: len(keys)], *r) for r in _descend(losses[name], has, tests["y"].to_numpy(int), classes, at, wanted)]
        return pd.DataFrame(out, columns=columns)

    counts = left.groupBy(*of).cogroup(right.groupBy(*of)).applyInPandas(walk, f"estimator string, {keyed}, sig_id string, y_true int, y_pred int, n long")
    return counts.groupBy("estimator", *keys, "sig_id", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def packed_shares(obs: DataFrame, splits: DataFrame, signatures: DataFrame, keys: tuple[str, ...] = ("split",), on: tuple[str, ...] = (), names: tuple[str, ...] = ESTIMATORS, blocks: int = 1) -> DataFrame:
    """estimator, keys, sig_id, c (the classes), y, pred, p: a row for each unit of ``packed_confusion``, signature and estimator.

    y and pred are arrays over the unit's samples, and p over these and the classes in turn: ``probabilities``, in units of
    the ninth digit; null where a class has none of the signature's features.
    """
    left, right, of, keyed, known = _units(obs, splits, signatures, keys, on, blocks)
    at = {name: k for k, name in enumerate(known)}

    def walk(key: tuple, tests: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        model, wanted = pdf[pdf["sig_id"].isna()], pdf[pdf["sig_id"].notna()]
        out = []
        if len(tests) and len(model) and len(wanted):
            losses, has, classes = _losses(tests, model.iloc[0], len(known), names)
            y = tests["y"].to_numpy(np.int32)
            for name in names:
                for sig, total, seen in _added_up(losses[name], has, at, wanted):
                    some = np.flatnonzero(seen.any(axis=1))
                    if not len(some):
                        continue
                    d = np.where(seen, total, np.inf)[some]
                    pred = classes[d.round(9).argmin(axis=1)]
                    e = np.exp((d.min(axis=1, keepdims=True) - d) / 2)
                    p = np.rint(e / e.sum(axis=1, keepdims=True) * 1e9).astype(np.int32)
                    out.append((name, *key[: len(keys)], sig, classes.astype(np.int32), y[some], pred.astype(np.int32), np.where(seen[some], p, NEVER).ravel()))
        return pd.DataFrame(out, columns=["estimator", *keys, "sig_id", "c", "y", "pred", "p"])

    return left.groupBy(*of).cogroup(right.groupBy(*of)).applyInPandas(walk, f"estimator string, {keyed}, sig_id string, c array<int>, y array<int>, pred array<int>, p array<int>")


#: In place of a probability: the class has none of the signature's features.
NEVER = np.int32(-1)


def shares_metrics(shares: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``metrics`` and ``probability_metrics`` of ``packed_shares``; a group has the arrays of one of ``keys``, 4 bytes a class and sample."""
    kinds = {f.name: f.dataType.simpleString() for f in shares.schema}
    keyed = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def measure(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(np.repeat(y, len(c)), np.tile(c, len(y)), np.asarray(p)) for c, y, p in zip(pdf["c"], pdf["y"], pdf["p"], strict=True)]
        y, c, p = (np.concatenate(x) for x in zip(*rows, strict=True))
        y, c, p = y[p >= 0], c[p >= 0], p[p >= 0]
        true, pred = np.concatenate(pdf["y"].to_list()), np.concatenate(pdf["pred"].to_list())
        cells, n = np.unique(np.stack([true, pred]), axis=1, return_counts=True)
        auc, ap = [], []
        for k in np.unique(c):
            value, place = np.unique(-p[c == k], return_inverse=True)
            hit = y[c == k] == k
            pos, neg = np.bincount(place[hit], minlength=len(value)), np.bincount(place[~hit], minlength=len(value))
            tp, fp, n1, n0 = pos.cumsum(), neg.cumsum(), pos.sum(), neg.sum()
            if n1 and n0:
                auc.append((pos * (n0 - fp + neg / 2)).sum() / (float(n1) * n0))
                ap.append((pos * tp / (tp + fp)).sum() / n1)
        own = p[y == c] / 1e9
        if not len(own):
            return pd.DataFrame(columns=[*keys, "y_true", "y_pred", "n", "log_loss", "roc_auc", "average_precision"])
        some = {k: [v] for k, v in zip(keys, key, strict=True)} | {"y_true": [cells[0]], "y_pred": [cells[1]], "n": [n]}
        mean = lambda v: [np.mean(v) if len(v) else None]
        return pd.DataFrame(some | {"log_loss": [-np.log(np.maximum(own, 1e-15)).mean()], "roc_auc": mean(auc), "average_precision": mean(ap)})

    made = shares.groupBy(*keys).applyInPandas(measure, f"{keyed}, y_true array<int>, y_pred array<int>, n array<long>, log_loss double, roc_auc double, average_precision double")
    from ..functions.storage import stored

    made = stored(made)
    cells = made.select(*keys, F.explode(F.arrays_zip("y_true", "y_pred", "n")).alias("x")).select(*keys, "x.*")
    return metrics(cells, keys).join(made.drop("y_true", "y_pred", "n"), list(keys))


def _units(obs: DataFrame, splits: DataFrame, signatures: DataFrame, keys: tuple[str, ...], on: tuple[str, ...], blocks: int) -> tuple[DataFrame, DataFrame, list[str], str, list[str]]:
    """The two sides of the units of ``packed_confusion`` (packed test samples; signatures and models), the columns that name a
    unit, the schema of ``keys``, and the features in the order of their places."""
    from ..functions.storage import stored

    known = [r[0] for r in obs.select("feature").distinct().orderBy("feature").collect()]
    places = obs.sparkSession.createDataFrame(list(enumerate(known)), "pos int, feature string")
    cells = F.sort_array(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))))
    packed = obs.join(F.broadcast(places), "feature").groupBy("sample_id", "y").agg(cells.alias("_v"))
    parts = splits.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*keys, "is_test"))).alias("_parts"))
    rows = packed.join(parts, "sample_id").select("sample_id", F.col("y").cast("int").alias("y"), "_parts", F.col("_v.pos").alias("pos"), F.col("_v.value").alias("x"))
    rows = stored(rows)
    kinds = {f.name: f.dataType.simpleString() for f in splits.schema}
    keyed = ", ".join(f"{k} {kinds[k]}" for k in keys)

    each = rows.select("_parts", "y", F.explode(F.arrays_zip("pos", "x")).alias("_c")).groupBy("_parts", "y", F.col("_c.pos").alias("pos"))
    x = F.col("_c.x")
    sums = each.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    sums = sums.withColumn("_part", F.explode("_parts")).where("not _part.is_test").select(*[F.col(f"_part.{k}").alias(k) for k in keys], "y", "pos", "n", "m", "v", "lo", "hi")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = _merged(pdf, ["pos"])
        own = _merged(pdf, ["pos", "y"]).merge(whole, on="pos", suffixes=("", "_all"))
        sd = np.where(own["lo_all"] == own["hi_all"], 1.0, np.sqrt(own["v_all"]))
        sd = np.where(sd == 0, 1.0, sd)
        out = {k: [v] for k, v in zip(keys, key, strict=True)}
        put = lambda v: [np.asarray(v).tolist()]
        out |= {"pos": put(own["pos"]), "c": put(own["y"]), "m": put((own["m"] - own["m_all"]) / sd), "v": put(own["v"] / sd**2), "mean": put(own["m_all"]), "sd": put(sd)}
        return pd.DataFrame(out)

    many = "pos array<int>, c array<int>, m array<double>, v array<double>, mean array<double>, sd array<double>"
    models = stored(sums.groupBy(*keys).applyInPandas(merge, f"{keyed}, {many}"))

    found = signatures.select(*on, "sig_id", "genes")
    chunks = max(1, math.ceil((found.groupBy(*on).count().agg(F.max("count")).first()[0] or 0) / SIGNATURES))
    found = found.withColumn("_chunk", F.pmod(F.xxhash64(F.element_at("genes", 1)), F.lit(chunks)).cast("int"))
    units = models.select(*keys)
    right = units.join(found, list(on)) if on else units.crossJoin(found)
    right = right.unionByName(models.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), allowMissingColumns=True)
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("_block")
    place = F.when(F.size("pos") != len(known), F.col("pos")).when(F.size(F.array_distinct("pos")) != len(known), F.col("pos")).alias("pos")
    left = rows.select("sample_id", "y", place, "x", block, F.explode("_parts").alias("_part")).where("_part.is_test")
    left = left.select(*[F.col(f"_part.{k}").alias(k) for k in keys], "_block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), "y", "pos", "x")
    return left, right, [*keys, "_block", "_chunk"], keyed, known


def _merged(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """by, m, v, lo, hi of all rows, from the counts, means and variances of parts of them."""
    some = pdf.sort_values("n", ascending=False)
    g = some.groupby(by)
    n, first = g["n"].transform("sum"), g["m"].transform("first")
    mean = first + (some["n"] * (some["m"] - first)).fillna(0).groupby([some[k] for k in by]).transform("sum") / n
    gap = (some["n"] * (some["v"] + (some["m"] - mean) ** 2)).fillna(0)
    made = some.assign(m=mean, v=gap.groupby([some[k] for k in by]).transform("sum") / n, lo=g["lo"].transform("min"), hi=g["hi"].transform("max"))
    return made.groupby(by, as_index=False)[["m", "v", "lo", "hi"]].first()


def _losses(tests: pd.DataFrame, model: pd.Series, width: int, names: tuple[str, ...]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The losses by name, each by (feature, sample, class), which of them are known, and the classes."""
    classes, c = np.unique(model["c"], return_inverse=True)
    pos = np.asarray(model["pos"])
    m, v, fitted = np.full((width, len(classes)), np.nan), np.full((width, len(classes)), np.nan), np.zeros((width, len(classes)), bool)
    m[pos, c], v[pos, c], fitted[pos, c] = np.asarray(model["m"], float), np.asarray(model["v"], float), True
    mean, sd = np.full(width, np.nan), np.ones(width)
    mean[pos], sd[pos] = np.asarray(model["mean"], float), np.asarray(model["sd"], float)
    v = np.maximum(1e-9, v)[:, None, :]
    of = {"centroid": lambda gap: gap * gap, "manhattan": np.abs, "naive_bayes": lambda gap: gap * gap / v + np.log(v)}
    total, known = dict.fromkeys(names, 0.0), False
    for x, has in _layers(tests, width):
        gap = ((x - mean[:, None]) / sd[:, None])[:, :, None] - m[:, None, :]
        known = known | (has[:, :, None] & fitted[:, None, :])
        for name in names:
            loss = of[name](gap)
            total[name] = total[name] + np.where(np.isnan(loss), 0.0, loss)
    return total, known, classes


def _layers(tests: pd.DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, present) by feature and sample; a further layer holds what a sample has again of a feature."""
    made = [(np.full((width, len(tests)), np.nan), np.zeros((width, len(tests)), bool))]
    for k, (pos, values) in enumerate(zip(tests["pos"], tests["x"], strict=True)):
        values = np.asarray(values, float)
        if pos is None:
            made[0][0][:, k], made[0][1][:, k] = values, True
            continue
        again = np.arange(len(pos)) - np.searchsorted(pos, pos)
        while len(made) <= again.max(initial=0):
            made.append((np.full((width, len(tests)), np.nan), np.zeros((width, len(tests)), bool)))
        for layer, (x, has) in enumerate(made):
            some = again == layer
            x[pos[some], k], has[pos[some], k] = values[some], True
    return made


def counted_summary(counts: DataFrame, keys: tuple[str, ...], split: str = "split") -> DataFrame:
    """``cv_summary`` of counted predictions."""
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    each = counts.groupBy(*keys, split).agg((hit / F.sum("n")).alias("score"))
    return each.groupBy(*keys).agg(F.bround(F.avg("score"), 3).alias("cv_mean"), F.bround(F.stddev_pop("score"), 3).alias("cv_std"))


def predict_all(d: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Predictions with all features."""
    return nearest(d.groupBy(*keys, "sample_id", "y", "c").agg(F.sum("d").alias("d")), keys)


def leave_one_out(obs: DataFrame) -> DataFrame:
    """sample_id, y_true, y_pred: each sample by the class means and deviations of all the others, with all features.

    A sample's own value is taken out of the sums of its feature and class, so there is one pass and no split for each sample.
    A deviation of the others under a millionth of the feature's own counts as 0 (and divides by 1).
    """
    rows = obs.select("sample_id", "y", "feature", "value")
    each = rows.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mu"), F.var_pop("value").alias("v"))
    classes = rows.groupBy("feature", F.col("y").alias("c")).agg(F.count("value").alias("nc"), F.avg("value").alias("mc"))
    both = rows.join(each, "feature").join(classes, "feature")
    own, u, n = F.col("y") == F.col("c"), F.col("value") - F.col("mu"), F.col("n")
    both = both.where((n > 1) & ((F.col("nc") > 1) | ~own))
    var = (F.col("v") - u * u / (n - 1)) * n / (n - 1)
    sd = F.when(var <= 1e-12 * F.col("v"), 1.0).otherwise(F.sqrt(var))
    gap = F.col("value") - F.when(own, F.col("mc") + (F.col("mc") - F.col("value")) / (F.col("nc") - 1)).otherwise(F.col("mc"))
    sums = both.select("sample_id", "y", "c", F.pow(gap / sd, 2).alias("d")).groupBy("sample_id", "y", "c").agg(F.sum("d").alias("d"))
    return nearest(sums, ())


def predict_correlation(obs: DataFrame, splits: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Predictions by the least 1 - r between a sample and the class means, over all features."""
    z = _split_rows(obs, splits, keys)
    both = z.where("is_test").select(*keys, "sample_id", "y", "feature", "value").join(_centroids(z, keys), [*keys, "feature"])
    sums = both.groupBy(*keys, "sample_id", "y", "c").agg(F.covar_pop("value", "m").alias("v"), F.stddev_pop("value").alias("s"), F.stddev_pop("m").alias("t"))
    return nearest(sums.select(*keys, "sample_id", "y", "c", (1 - F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("v") / (F.col("s") * F.col("t"))).otherwise(0.0)).alias("d")), keys)


def confusion(predictions: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("score"))


def metrics(cells: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """accuracy, precision, recall, f1, fbeta (0.5; these weighted by support), kappa and mcc from a confusion table."""
    true = cells.groupBy(*keys, F.col("y_true").alias("c")).agg(F.sum("n").alias("t"))
    pred = cells.groupBy(*keys, F.col("y_pred").alias("c")).agg(F.sum("n").alias("p"))
    hit = cells.where("y_true = y_pred").select(*keys, F.col("y_true").alias("c"), F.col("n").alias("h"))
    each = true.join(pred, [*keys, "c"], "full").join(hit, [*keys, "c"], "left").na.fill(0, ["t", "p", "h"])
    t, p, h = (F.col(x).cast("double") for x in "tph")
    pr, rc = F.when(p > 0, h / p).otherwise(0.0), F.when(t > 0, h / t).otherwise(0.0)
    f = lambda b: F.when(b * b * F.col("pr") + F.col("rc") > 0, (1 + b * b) * F.col("pr") * F.col("rc") / (b * b * F.col("pr") + F.col("rc"))).otherwise(0.0)
    each = each.withColumn("pr", pr).withColumn("rc", rc).withColumn("f1", f(1.0)).withColumn("fb", f(0.5))
    weigh = lambda x: F.sum(t * F.col(x)) / F.sum(t)
    sums = each.groupBy(*keys).agg(F.sum(t).alias("s"), F.sum(h).alias("h"), F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"), weigh("pr").alias("precision"), weigh("rc").alias("recall"), weigh("f1").alias("f1"), weigh("fb").alias("fbeta"))
    s, pe = F.col("s"), F.col("tp") / (F.col("s") * F.col("s"))
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return sums.select(*keys, (F.col("h") / s).alias("accuracy"), "precision", "recall", "f1", "fbeta", F.when(pe < 1, (F.col("h") / s - pe) / (1 - pe)).otherwise(0.0).alias("kappa"), F.when(spread > 0, (F.col("h") * s - F.col("tp")) / spread).otherwise(0.0).alias("mcc"))


def class_metrics(cells: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """keys, c, support, precision, recall, f1 and fbeta (0.5) of every class that is true or predicted; 0 where undefined."""
    both = cells.select(*keys, F.explode(F.array_distinct(F.array("y_true", "y_pred"))).alias("c"), "y_true", "y_pred", F.col("n").cast("double").alias("n"))
    some = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0.0))
    is_true, is_pred = F.col("y_true") == F.col("c"), F.col("y_pred") == F.col("c")
    sums = both.groupBy(*keys, "c").agg(some(is_true).alias("t"), some(is_pred).alias("p"), some(is_true & is_pred).alias("h"))
    over = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    t, p, h = F.col("t"), F.col("p"), F.col("h")
    return sums.select(*keys, "c", t.cast("long").alias("support"), over(h, p).alias("precision"), over(h, t).alias("recall"), over(2 * h, t + p).alias("f1"), over(1.25 * h, 0.25 * t + p).alias("fbeta"))


def probabilities(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, sample_id, y, c, p (nine digits): the classes' shares exp(-d / 2), from summed losses d."""
    w = Window.partitionBy(*keys, "sample_id")
    e = sums.withColumn("e", F.exp((F.min("d").over(w) - F.col("d")) / 2))
    return e.select(*keys, "sample_id", "y", "c", F.round(F.col("e") / F.sum("e").over(w), 9).alias("p"))


def probability_metrics(probs: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """roc_auc, average_precision (means over the classes, each against the others) and log_loss (p not under 1e-15).

    Rows of one probability count together, so ties need no order. A class that is absent, or alone, has no curve.
    """
    of = (*keys, "c")
    hit = (F.col("y") == F.col("c")).cast("double")
    values = probs.groupBy(*of, "p").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    w, down = Window.partitionBy(*of), Window.partitionBy(*of).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    v = values.select(*of, "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(w).alias("n1"), F.sum("neg").over(w).alias("n0"))
    auc = F.sum(F.col("pos") * (F.col("n0") - F.col("fp") + F.col("neg") / 2)) / F.first(F.col("n1") * F.col("n0"))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("n1")
    curves = v.where("n1 > 0 and n0 > 0").groupBy(*of).agg(auc.alias("auc"), ap.alias("ap")).groupBy(*keys).agg(F.avg("auc").alias("roc_auc"), F.avg("ap").alias("average_precision"))
    loss = probs.where("y = c").groupBy(*keys).agg(F.avg(-F.log(F.greatest(F.col("p"), F.lit(1e-15)))).alias("log_loss"))
    return loss.join(curves, list(keys), "left")


def cv_summary(predictions: DataFrame, keys: tuple[str, ...], split: str = "split") -> DataFrame:
    """cv_mean and cv_std (population) of the splits' accuracy, to three digits half-even."""
    each = accuracy(predictions, (*keys, split))
    return each.groupBy(*keys).agg(F.bround(F.avg("score"), 3).alias("cv_mean"), F.bround(F.stddev_pop("score"), 3).alias("cv_std"))


def single_features(d: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """feature, score: mean accuracy over splits of each feature alone."""
    each = accuracy(nearest(d, (*keys, "feature")), (*keys, "feature"))
    return each.groupBy("feature").agg(F.avg("score").alias("score"))


def mean_decrease(obs: DataFrame, splits: DataFrame, reps: int = 3, seed: int = 0) -> DataFrame:
    """feature, score: accuracy with all features less the mean accuracy with one's test values permuted, over splits and reps.

    The other features' distances don't change, so a permuted feature's are exchanged in the sum.
    """
    from .resample import permute

    z = _split_rows(obs, splits, ("split",))
    means = _centroids(z, ("split",))
    tests = z.where("is_test").select("split", "sample_id", "y", "feature", "value")
    d = tests.join(means, ["split", "feature"]).select("split", "sample_id", "y", "feature", "c", F.pow(F.col("value") - F.col("m"), 2).alias("d"))
    total = d.groupBy("split", "sample_id", "y", "c").agg(F.sum("d").alias("all"))
    many = tests.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    moved = permute(many, "value", ("split", "feature", "rep"), seed).join(means, ["split", "feature"]).withColumn("new", F.pow(F.col("permuted") - F.col("m"), 2)).select("split", "rep", "sample_id", "y", "feature", "c", "new")
    sums = moved.join(d, ["split", "sample_id", "y", "feature", "c"]).join(total, ["split", "sample_id", "y", "c"]).select("split", "rep", "feature", "sample_id", "y", "c", (F.col("all") - F.col("d") + F.col("new")).alias("d"))
    shuffled = accuracy(nearest(sums, ("split", "rep", "feature")), ("split", "rep", "feature")).groupBy("feature").agg(F.avg("score").alias("s"))
    base = accuracy(predict_all(d), ("split",)).agg(F.avg("score").alias("base"))
    return shuffled.crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("s")).alias("score"))


def work_items(signatures: DataFrame, estimators: list[str], splits: int) -> DataFrame:
    """sig_id, estimator, split: all that has to be fitted."""
    return signatures.select("sig_id", F.explode(F.array(*map(F.lit, estimators))).alias("estimator")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
