"""Rankings by linear estimators for all folds at once, from cross products that Spark sums up.

A set of rows is a fold's training rows (WHOLE), these without one of their inner parts, or a hashed subsample of them.
One pass adds up, for each (fold, set, class), the cross products of the features and a constant; no task and no group
holds samples, only p x p sums, and there is no job for a single fit. From the sums of one set a grouped function solves
each estimator's systems:

* ridge: least squares against one class and the rest, with penalty 1 / c;
* lasso: the same with an L1 penalty, by coordinate descent along a falling path of penalties with warm starts;
* lda: the linear discriminant of the pooled scatter;
* svm: squared hinge loss, by Newton steps. A step is one pass for all models together: it adds up the cross products of the
  rows inside each model's margin. Elimination, addition and stability work on the system of the last step.

Rank types: single (accuracy of each feature alone over the inner parts), weights (mean absolute weight over the
classes, as signed weights of one against the rest add up to nothing), elimination and addition (features leave, or
are taken out, one by one by the sum of squared weights; the inverse is updated, not computed anew), stability (share of
subsamples and penalties in which a feature is used), decrease (loss of accuracy with one feature's values permuted).
Predictions with one feature are joins of rows with weights, which are as many as the fits and are broadcast; those with
permuted values are worked out in units of packed rows. Missing values count as 0; features without spread get the weight 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_order
from ..functions.storage import stored

ESTIMATORS = ("ridge", "lasso", "lda", "svm")
TYPES = ("t2_single", "t3_weights", "t4_elimination", "t5_stability", "t6_decrease", "t7_addition")
#: Penalties: c of ridge and svm, share of the largest useful L1 penalty, shrinkage of the pooled scatter.
PENALTY = {"ridge": 1.0, "svm": 1.0, "lasso": 0.1, "lda": 1e-3}
#: Penalties of the subsamples of stability selection.
GRID = {"ridge": (1e-2, 1e-1, 1.0, 10.0), "svm": (1e-2, 1e-1, 1.0, 10.0), "lasso": (0.5, 0.35, 0.25, 0.18, 0.12, 0.08), "lda": (1e-3, 1e-2, 1e-1)}
WHOLE = 0
#: Newton steps at most; a step that gains less than NEAR of the loss is the last. Doubles that a task adds up at once.
STEPS, NEAR, HELD = 25, 1e-7, 8_000_000


# Sums


def packed(train: DataFrame, parts: int, bags: int, share: float = 0.75, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, places): rows have fold, sample_id, y, pos and x (arrays), p, and sets, the numbers of the sets they belong to.

    Set 0 is WHOLE, set s of 1..parts lacks part s - 1, and the sets behind are subsamples. places: fold, feature, pos.
    """
    names = train.select("fold", "feature").distinct()
    places = names.withColumn("pos", F.row_number().over(Window.partitionBy("fold").orderBy("feature")) - 1)
    width = places.groupBy("fold").agg(F.count(F.lit(1)).cast("int").alias("p"))
    cells = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))))
    rows = train.join(F.broadcast(places), ["fold", "feature"]).groupBy("fold", "sample_id", "y").agg(cells.alias("m"))
    part = F.ntile(parts).over(Window.partitionBy("fold", "y").orderBy("sample_id"))
    u = lambda b: F.conv(F.substring(hash_order(F.lit(seed), b, F.col("fold"), F.col("sample_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    drawn = F.filter(F.sequence(F.lit(parts + 1), F.lit(parts + max(1, bags))), lambda b: (u(b) < share) & (b <= parts + bags))
    inner = F.array_remove(F.sequence(F.lit(0), F.lit(parts)), F.col("part"))
    rows = rows.withColumn("part", part).join(width, "fold")
    return rows.select("fold", "sample_id", "y", "part", "p", F.transform("m", lambda c: c["pos"]).alias("pos"), F.transform("m", lambda c: c["value"]).alias("x"), F.concat(inner, drawn).alias("sets")), places


def dense(pdf: pd.DataFrame) -> np.ndarray:
    """The rows as a matrix with a leading constant."""
    x = np.zeros((len(pdf), int(pdf["p"].iloc[0]) + 1))
    x[:, 0] = 1
    sizes = [len(v) for v in pdf["pos"]]
    if sum(sizes):
        x[np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["pos"].to_list()) + 1] = np.concatenate(pdf["x"].to_list())
    return x


def _added(rows: DataFrame, products, matrix=dense) -> DataFrame:
    """fold, set, c, i, row: sums of ``products(fold, set, x, y)``, pairs of a class and a matrix, over all rows of a set.

    ``matrix`` makes x of the rows of a batch. Tasks add up what they see, and Spark adds their sums row by row of the matrices.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in batches:
            for fold, some in pdf.groupby("fold"):
                x, y = matrix(some), some["y"].to_numpy()
                owner, member = np.repeat(np.arange(len(some)), some["sets"].map(len)), np.concatenate(some["sets"].to_list() or [np.zeros(0, int)])
                for s in np.unique(member):
                    at = owner[member == s]
                    for c, m in products(int(fold), int(s), x[at], y[at]):
                        key = (int(fold), int(s), int(c))
                        held[key] = held[key] + m if key in held else m
            if sum(m.size for m in held.values()) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pd.DataFrame:
        parts = [pd.DataFrame({"fold": f, "set": s, "c": c, "i": np.arange(len(m)), "row": list(m)}) for (f, s, c), m in held.items()]
        return pd.concat(parts, ignore_index=True)

    sums = rows.mapInPandas(run, "fold int, set int, c int, i int, row array<double>")
    total = sums.groupBy("fold", "set", "c", "i").agg(Summarizer.sum(array_to_vector("row")).alias("v"))
    return total.select("fold", "set", "c", "i", vector_to_array("v").alias("row"))


def cross_products(rows: DataFrame, matrix=dense) -> DataFrame:
    """fold, set, c, i, row: the cross products of (1, features) of the rows of class c, one row of the matrix a row."""

    def products(fold: int, s: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for c in np.unique(y):
            own = x[y == c]
            yield c, own.T @ own

    return _added(rows, products, matrix)


def stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(classes, matrices) of one set."""
    pdf = pdf.sort_values(["c", "i"])
    codes = np.unique(pdf["c"])
    return codes, np.stack([np.stack(pdf.loc[pdf["c"] == c, "row"].to_list()) for c in codes])


# Systems of one set; all in units of the features' deviations


def moments(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and deviation (1 where there is none) from cross products of all classes."""
    total = sums.sum(axis=0)
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    var = np.diag(total)[1:] / n - mean**2
    flat = var <= 1e-12 * np.maximum(1e-12, mean**2)
    return n, mean, np.where(flat, 1.0, np.sqrt(np.maximum(var, 1e-300)))


def _centred(total: np.ndarray, sd: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and scatter around it, of rows whose cross products are ``total``."""
    n, mean = total[0, 0], total[0, 1:] / max(total[0, 0], 1e-300)
    return n, mean, (total[1:, 1:] - n * np.outer(mean, mean)) / np.outer(sd, sd)


class System:
    """A matrix and right side for each class, from which weights come; and what makes a weight vector a decision."""

    def __init__(self, estimator: str, sums: np.ndarray, margin: np.ndarray | None, penalty: float) -> None:
        self.estimator, self.penalty = estimator, penalty
        self.n, self.mean, self.sd = moments(sums)
        k, eye = len(sums), np.eye(len(self.sd))
        counts = sums[:, 0, 0]
        if estimator == "svm":
            self.matrices, self.sides, self.centres, self.levels = [], [], [], []
            for m in margin:
                n, mean, scatter = _centred(m[:-1, :-1], self.sd)
                level = m[0, -1] / max(n, 1e-300)
                self.matrices.append(scatter + eye / (2 * penalty))
                self.sides.append((m[1:-1, -1] - n * mean * level) / self.sd)
                self.centres.append(mean)
                self.levels.append(level)
            return
        _, _, scatter = _centred(sums.sum(axis=0), self.sd)
        means = (sums[:, 0, 1:] / counts[:, None] - self.mean) / self.sd
        if estimator == "lda":
            within = (scatter - (means.T * counts) @ means) / max(1.0, self.n - k)
            self.matrices, self.sides = [within + penalty * eye] * k, list(means)
        else:  # targets are 1 for the class and -1 for the rest
            self.matrices, self.sides = [scatter + (eye / penalty if estimator == "ridge" else 0)] * k, list(2 * means * counts[:, None])
        self.centres, self.levels = [self.mean] * k, list(np.log(counts / self.n) if estimator == "lda" else 2 * counts / self.n - 1)

    def weights(self) -> np.ndarray:
        """By class: the weights of the scaled features."""
        if self.estimator == "lasso":
            scatter, sides = self.matrices[0] / self.n, np.stack(self.sides) / self.n
            top = np.abs(sides).max()
            return lasso_path(scatter, sides, [top * 0.5**k for k in range(1, 10) if 0.5**k > self.penalty] + [top * self.penalty])[-1]
        if self.matrices[0] is self.matrices[-1]:
            return np.linalg.solve(self.matrices[0], np.stack(self.sides).T).T
        return np.stack([np.linalg.solve(a, b) for a, b in zip(self.matrices, self.sides, strict=True)])

    def decision(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(by class: weights of the features as they are, constants)."""
        raw = w / self.sd
        base = [lv - r @ c for r, c, lv in zip(raw, self.centres, self.levels, strict=True)]
        if self.estimator == "lda":
            base = [b - 0.5 * x @ y for b, x, y in zip(base, w, self.sides, strict=True)]
        return raw, np.array(base)

    def alone(self) -> tuple[np.ndarray, np.ndarray]:
        """By class and feature: weight and constant of the model that has no other feature."""
        a, b = np.stack([np.diag(m) for m in self.matrices]), np.stack(self.sides)
        if self.estimator == "lasso":
            b = np.sign(b) * np.maximum(np.abs(b) - self.penalty * np.abs(b).max(), 0)
        w = np.divide(b, a, out=np.zeros_like(b), where=a > 1e-12)
        base = np.array(self.levels)[:, None] - w / self.sd * np.stack(self.centres)
        return w / self.sd, base - (0.5 * w * b if self.estimator == "lda" else 0)

    def order(self, heaviest: bool) -> np.ndarray:
        """For each feature the round in which it goes: the one with the least, or largest, sum of squared weights of those left."""
        p = len(self.sd)
        rounds, left = np.zeros(p, int), np.arange(p)
        pick = np.argmax if heaviest else np.argmin
        if self.estimator == "lasso":
            scatter, sides = self.matrices[0] / self.n, np.stack(self.sides) / self.n
            penalty, w = self.penalty * np.abs(sides).max(), np.zeros_like(sides)
            for k in range(p):
                w = lasso_path(scatter[np.ix_(left, left)], sides[:, left], [penalty], w)[0]
                score = (w**2).sum(axis=0)
                if score.max() <= 0:  # none is used: the residual correlations decide
                    score = np.abs(sides[:, left]).max(axis=0)
                j = int(pick(score))
                rounds[left[j]], left, w = k, np.delete(left, j), np.delete(w, j, axis=1)
            return rounds
        same = self.matrices[0] is self.matrices[-1]
        inverses = [np.linalg.inv(m) for m in (self.matrices[:1] if same else self.matrices)]
        sides = np.stack(self.sides)
        for k in range(p):
            w = sides @ inverses[0] if same else np.stack([i @ b for i, b in zip(inverses, sides, strict=True)])
            j = int(pick((w**2).sum(axis=0)))
            rounds[left[j]], left, sides = k, np.delete(left, j), np.delete(sides, j, axis=1)
            inverses = [np.delete(np.delete(i - np.outer(i[:, j], i[j]) / i[j, j], j, 0), j, 1) for i in inverses]
        return rounds


def lasso_path(scatter: np.ndarray, sides: np.ndarray, penalties: list[float], start: np.ndarray | None = None, rounds: int = 500) -> list[np.ndarray]:
    """Weights [class, feature] of min w'Sw / 2 - b'w + penalty |w|_1 for falling penalties, each beginning at the one before."""
    w = np.zeros_like(sides) if start is None else start.copy()
    rest, size, out = sides - w @ scatter, np.diag(scatter), []
    for penalty in penalties:
        every = True
        for _ in range(rounds):
            moved = 0.0
            for j in range(len(size)) if every else np.flatnonzero((w != 0).any(axis=0)):
                if size[j] <= 1e-12:
                    continue
                pull = rest[:, j] + size[j] * w[:, j]
                new = np.sign(pull) * np.maximum(np.abs(pull) - penalty, 0) / size[j]
                step = new - w[:, j]
                if step.any():
                    rest -= step[:, None] * scatter[j]
                    w[:, j] = new
                    moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-9:  # features in use have settled: look at all once more, and end if that changes nothing
                if every:
                    break
                every = True
            else:
                every = False
        out.append(w.copy())
    return out


# Newton steps for the squared hinge loss


def margins(rows: DataFrame, sums: DataFrame, c: float | None = None, matrix=dense) -> DataFrame:
    """fold, set, c, i, row: cross products of (1, features, target) of the rows inside the margin of each fitted machine.

    Each step is one pass over the rows for the machines of all folds, sets and classes; their weights, which are as many as
    there are models, go out with the tasks. A step that makes the loss larger is halved.
    """
    c = c or PENALTY["svm"]
    first = sums.groupBy("fold", "set").applyInPandas(lambda key, pdf: _start(key, pdf, c), "fold int, set int, c int, w array<double>, sd array<double>").collect()
    w = {(r["fold"], r["set"], r["c"]): np.array(r["w"]) for r in first}
    sd = {(r["fold"], r["set"]): np.array(r["sd"]) for r in first}
    classes = {k: sorted(x[2] for x in w if x[:2] == k) for k in sd}
    before: dict[tuple, float] = {}
    old: dict[tuple, np.ndarray] = {}
    for _ in range(STEPS):

        def products(fold: int, s: int, x: np.ndarray, y: np.ndarray, w=dict(w), classes=classes) -> Iterator[tuple[int, np.ndarray]]:
            for k in classes[fold, s]:
                target = np.where(y == k, 1.0, -1.0)
                slack = 1 - target * (x @ w[fold, s, k])
                inside = slack > 0
                u = np.concatenate([x[inside], target[inside, None]], axis=1)
                yield k, np.concatenate([u.T @ u, np.full((1, u.shape[1]), (slack[inside] ** 2).sum())])

        step = stored(_added(rows, products, matrix))
        made = step.groupBy("fold", "set", "c").applyInPandas(lambda key, pdf: _step(key, pdf, sd, c), "fold int, set int, c int, w array<double>, loss double").collect()
        open_ = False
        for r in made:
            key = (r["fold"], r["set"], r["c"])
            loss = 0.5 * float(((w[key][1:] * sd[key[:2]]) ** 2).sum()) + c * r["loss"]
            if key in before and loss > before[key] * (1 + 1e-12) + 1e-12:
                w[key] = (w[key] + old[key]) / 2
                open_ = True
                continue
            open_ |= before.get(key, np.inf) - loss > NEAR * max(1e-12, loss)
            before[key], old[key], w[key] = loss, w[key], np.array(r["w"])
        if not open_:
            break
    return step.where(F.col("i") < F.size("row"))


def _start(key: tuple, pdf: pd.DataFrame, c: float) -> pd.DataFrame:
    codes, sums = stacked(pdf)
    system = System("ridge", sums, None, 2 * c)
    raw, base = system.decision(system.weights())
    return pd.DataFrame({"fold": key[0], "set": key[1], "c": codes, "w": [np.append(b, r) for r, b in zip(raw, base, strict=True)], "sd": [system.sd] * len(codes)})


def _step(key: tuple, pdf: pd.DataFrame, sd: dict, c: float) -> pd.DataFrame:
    rows = np.stack(pdf.sort_values("i")["row"].to_list())
    m, loss = rows[:-1], float(rows[-1, 0])
    a = m[:-1, :-1].copy()
    a[np.diag_indices(len(a))] += np.append(1e-9, sd[key[0], key[1]] ** 2 / (2 * c))
    return pd.DataFrame({"fold": key[0], "set": key[1], "c": key[2], "w": [np.linalg.solve(a, m[:-1, -1])], "loss": loss})


# Ranks


FITS = "fold int, estimator string, set int, kind string, c int, pos int, w double, b double"


def fits(rows: DataFrame, parts: int, estimators: tuple[str, ...] = ESTIMATORS) -> DataFrame:
    """All that is solved from the sums: scores by feature, and weights (w, b: constant) by class and feature.

    kind: a rank type for WHOLE and for subsamples, "model" (b at pos -1) and "alone" for sets without a part.
    """
    sums = stored(cross_products(rows))
    plain = sums.select("*", F.lit(False).alias("margin")).withColumn("estimator", F.explode(F.array(*map(F.lit, estimators))))
    if "svm" in estimators:
        plain = plain.unionByName(margins(rows, sums).select("*", F.lit(True).alias("margin"), F.lit("svm").alias("estimator")))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, s, name = int(key[0]), int(key[1]), key[2]
        codes, sums = stacked(pdf[~pdf["margin"]])
        margin = stacked(pdf[pdf["margin"]])[1] if name == "svm" else None
        system = System(name, sums, margin, PENALTY[name])
        out, p = [], len(system.sd)
        add = lambda kind, w, c=-1, b=0.0, pos=None: out.append(pd.DataFrame({"kind": kind, "c": c, "pos": np.arange(p) if pos is None else pos, "w": w, "b": b}))
        if s == WHOLE:
            add("t3_weights", np.abs(system.weights()).mean(axis=0))
            add("t4_elimination", system.order(False).astype(float))
            add("t7_addition", p - system.order(True).astype(float))
        elif s <= parts:
            raw, base = system.decision(system.weights())
            single, level = system.alone()
            for k, c in enumerate(codes):
                add("model", raw[k], c)
                add("model", [0.0], c, base[k], [-1])
                add("alone", single[k], c, level[k])
        else:
            if name == "lasso":
                scatter, sides = system.matrices[0] / system.n, np.stack(system.sides) / system.n
                used = [np.any(w != 0, axis=0) for w in lasso_path(scatter, sides, [np.abs(sides).max() * g for g in GRID[name]])]
            else:
                each = [np.abs(System(name, sums, margin, g).weights()).mean(axis=0) for g in GRID[name]]
                used = [w >= w.mean() for w in each]
            add("t5_stability", np.mean(used, axis=0))
        return pd.concat(out).assign(fold=fold, estimator=name, set=s)[[f.split()[0] for f in FITS.split(", ")]]

    return plain.groupBy("fold", "set", "estimator").applyInPandas(solve, FITS)


def _best(scores: Column) -> Column:
    """The class of the highest score of an array of (score, c); the lower class among equals."""
    return -F.array_max(F.transform(scores, lambda s: F.struct(F.round(s["score"], 9).alias("score"), (-s["c"]).alias("c"))))["c"]


def _accuracy(predicted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return predicted.groupBy(*by).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("score"))


def rank(train: DataFrame, parts: int = 3, bags: int = 8, reps: int = 3, estimators: tuple[str, ...] = ESTIMATORS, types: tuple[str, ...] = TYPES, seed: int = 0) -> DataFrame:
    """fold, method (type and estimator), feature, score, higher better, for rows (fold, sample_id, y, feature, value)."""
    rows, places = packed(train, parts, bags)
    rows, places = stored(rows), stored(places)
    found = stored(fits(rows, parts, estimators))
    method = F.concat_ws("_", "kind", "estimator").alias("method")
    named = found.join(F.broadcast(places), ["fold", "pos"])
    out = [named.where(F.col("kind").isin(*types)).groupBy("fold", "kind", "estimator", "feature").agg(F.avg("w").alias("score")).select("fold", method, "feature", "score")]
    tests = train.join(rows.select("fold", "sample_id", F.col("part").alias("set")), ["fold", "sample_id"]).select("fold", "set", "sample_id", "y", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    model = lambda kind: named.where(F.col("kind") == kind).groupBy("fold", "set", "estimator", "feature").agg(F.sort_array(F.collect_list(F.struct("c", "w", "b"))).alias("m"))
    key = ["fold", "set", "feature"]
    if "t2_single" in types:
        scored = F.transform("m", lambda m: F.struct((m["w"] * F.col("value") + m["b"]).alias("score"), m["c"].alias("c")))
        each = _accuracy(tests.join(F.broadcast(model("alone")), key).withColumn("pred", _best(scored)), ("fold", "set", "estimator", "feature"))
        out.append(each.groupBy("fold", "estimator", "feature").agg(F.avg("score").alias("score")).select("fold", F.concat(F.lit("t2_single_"), "estimator").alias("method"), "feature", "score"))
    if "t6_decrease" in types:
        out.append(_decrease(tests, rows, found, places, reps, seed))
    return reduce(DataFrame.unionByName, out)


#: Samples of a block whose predictions with permuted values are worked out at once, about.
BLOCK = 2048


def _decrease(tests: DataFrame, rows: DataFrame, found: DataFrame, places: DataFrame, reps: int, seed: int) -> DataFrame:
    """Accuracy over the parts less that with one feature's values permuted within its part; other features' sums stay.

    A group of one feature's values in a part draws its permutations (those of ``resample.permute``), and sends them out by
    blocks of samples; a unit has a block's packed rows, and counts the hits of every model, feature and repetition. So
    there is no row for a sample, feature, repetition and model.
    """
    fitted = {}
    for r in found.where("kind = 'model'").collect():  # a number for each model, class and feature
        fitted.setdefault((r["fold"], r["set"]), []).append((r["estimator"], r["c"], r["pos"], r["w"], r["b"]))
    kinds = {f.name: f.dataType.simpleString() for f in tests.schema}
    blocks = max(1, -(-rows.groupBy("fold", "part").count().agg(F.max("count")).first()[0] // BLOCK)) if fitted else 1
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("block")
    given = tests.join(F.broadcast(places), ["fold", "feature"]).select("fold", "set", "pos", "feature", "sample_id", "value", block)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, s, pos, feature = key
        pdf = pdf.sort_values("sample_id", kind="stable")
        ids, value, at = pdf["sample_id"].to_numpy(), pdf["value"].to_numpy(float), pdf["block"].to_numpy()
        new = []
        for rep in range(reps):
            begin = f"{seed}|{fold}|{s}|{feature}|{rep}|"
            digest = np.frombuffer(b"".join(hashlib.md5(f"{begin}{k}".encode()).digest() for k in ids), ">u8").reshape(-1, 2)
            new.append(value[np.lexsort((digest[:, 1], digest[:, 0]))])
        by = [np.flatnonzero(at == k) for k in np.unique(at)]
        out = pd.DataFrame({"block": [int(at[k[0]]) for k in by], "pos": int(pos), "ids": [ids[k] for k in by], "new": [np.concatenate([v[k] for v in new]) for k in by]})
        return out.assign(fold=int(fold), set=int(s))[["fold", "set", "block", "pos", "ids", "new"]]

    drawn = given.groupBy("fold", "set", "pos", "feature").applyInPandas(draw, f"fold int, set int, block int, pos int, ids array<{kinds['sample_id']}>, new array<double>")
    whole = rows.select("fold", F.col("part").alias("set"), block, "sample_id", "y", "p", "pos", "x")

    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, own = [], fitted.get((int(key[0]), int(key[1])), ())
        if len(left) and own:
            left = left.sort_values("sample_id", kind="stable")
            x, y, place = dense(left)[:, 1:], left["y"].to_numpy(), pd.Index(left["sample_id"])
            shifts = [(int(j), place.get_indexer(ids), np.asarray(new).reshape(reps, -1)) for j, ids, new in zip(right["pos"], right["ids"], right["new"], strict=True)]
            for name in sorted({m[0] for m in own}):
                mine = [m for m in own if m[0] == name]
                classes = np.array(sorted({m[1] for m in mine}))
                w, b = np.zeros((len(classes), x.shape[1])), np.zeros(len(classes))
                for _, c, j, weight, level in mine:
                    k = int(np.searchsorted(classes, c))
                    if j < 0:
                        b[k] = level
                    else:
                        w[k, j] = weight
                score = x @ w.T + b
                hits = lambda some, y, classes=classes: int((classes[some.round(9).argmax(axis=1)] == y).sum())
                out.append((name, -1, -1, hits(score, y), len(y)))
                for j, at, new in shifts:
                    for rep in range(reps):
                        out.append((name, j, rep, hits(score[at] + (new[rep] - x[at, j])[:, None] * w[:, j], y[at]), len(at)))
        return pd.DataFrame(out, columns=["estimator", "pos", "rep", "hits", "n"]).assign(fold=int(key[0]), set=int(key[1]))[["fold", "set", "estimator", "pos", "rep", "hits", "n"]]

    of = ["fold", "set", "block"]
    counts = whole.groupBy(*of).cogroup(drawn.groupBy(*of)).applyInPandas(count, "fold int, set int, estimator string, pos int, rep int, hits long, n long")
    each = stored(counts.groupBy("fold", "set", "estimator", "pos", "rep").agg((F.sum("hits") / F.sum("n")).alias("score")))
    base = each.where("pos < 0").select("fold", "set", "estimator", F.col("score").alias("base"))
    lost = each.where("pos >= 0").join(base, ["fold", "set", "estimator"]).groupBy("fold", "estimator", "pos").agg(F.avg(F.col("base") - F.col("score")).alias("score"))
    return lost.join(F.broadcast(places), ["fold", "pos"]).select("fold", F.concat(F.lit("t6_decrease_"), "estimator").alias("method"), "feature", "score")
