"""Support vector machines with a Gaussian kernel, one class against the rest.

Up to ``most`` training rows, each class's machine is a group that solves the dual by coordinate ascent: a step moves one
multiplier to its optimum, and kernel rows are made when they are first needed and kept as far as KEPT allows. With more
rows, random Fourier features stand for the kernel, and the machine is a linear one whose Newton steps come from cross
products summed over partitions (``linear.margins``); rows are stored as they are and lifted anew in each pass. In either
case a task that predicts has the support vectors, of which there are at most ``most``, or the weights. The constant is a
further kernel feature of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import linear

MOST, FEATURES, ROUNDS, NEAR, KEPT = 5000, 512, 1000, 1e-4, 256_000_000


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def dual(x: np.ndarray, target: np.ndarray, gamma: float, c: float, rounds: int = ROUNDS, near: float = NEAR) -> np.ndarray:
    """Multipliers (0..c) of the hinge loss machine for targets 1 and -1, to a gap in the optimality conditions of ``near``.

    Multipliers that sit at a bound with room to spare are left out, and looked at again before the end.
    """
    n = len(x)
    alpha, value, rows = np.zeros(n), np.zeros(n), {}
    room = max(1, KEPT // (8 * n))
    rng = np.random.default_rng(0)
    active = np.arange(n)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(active):
            slope = target[i] * value[i] - 1
            gap = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= c else slope
            worst = max(worst, abs(gap))
            if abs(gap) < 1e-12:
                continue
            step = min(c, max(0.0, alpha[i] - slope / 2)) - alpha[i]
            if step:
                if i not in rows:
                    if len(rows) >= room:
                        rows.pop(next(iter(rows)))
                    rows[i] = gaussian(x[i : i + 1], x, gamma)[0] + 1
                alpha[i] += step
                value += step * target[i] * rows[i]
        if worst < near:
            if len(active) == n:
                break
            active = np.arange(n)
            continue
        slope = target * value - 1
        active = np.flatnonzero(~((alpha <= 0) & (slope > worst)) & ~((alpha >= c) & (slope < -worst)))
    return alpha


def _machines(fit: DataFrame, gamma: float, c: float):
    """The decisions, as a function of scaled rows, of the machines solved in the dual."""
    codes = F.array(*[F.lit(r["label"]) for r in fit.select("label").distinct().orderBy("label").collect()])
    each = fit.select("sample_id", "label", vector_to_array("features").alias("x"), F.explode(codes).alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id", ignore_index=True)
        target = np.where(pdf["label"] == pdf["c"], 1.0, -1.0)
        alpha = dual(np.stack(pdf["x"].to_list()), target, gamma, c)
        some = alpha > 0
        return pdf.loc[some, ["c", "x"]].assign(w=(alpha * target)[some])

    found = each.groupBy("c").applyInPandas(solve, "c double, x array<double>, w double").toPandas()
    classes = np.array(sorted(r["label"] for r in fit.select("label").distinct().collect()))
    support = {k: (np.stack(some["x"].to_list()), some["w"].to_numpy()) for k, some in found.groupby("c")}

    def decide(z: np.ndarray) -> np.ndarray:
        out = np.full((len(z), len(classes)), -1.0)
        for k, (x, w) in support.items():
            out[:, np.searchsorted(classes, k)] = (gaussian(z, x, gamma) + 1) @ w
        return out

    return classes, decide


def _fourier(fit: DataFrame, width: int, gamma: float, c: float, features: int, seed: int):
    """The decisions of machines over random Fourier features of the scaled rows."""
    rng = np.random.default_rng(seed)
    turns, shifts = rng.normal(scale=np.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * np.pi, features)
    lift = lambda z: np.sqrt(2 / features) * np.cos(z @ turns + shifts)

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        x = np.empty((len(pdf), features + 1))
        x[:, 0], x[:, 1:] = 1, lift(np.stack(pdf["x"].to_list()))
        return x

    rows = stored(fit.select(F.lit(0).alias("fold"), "sample_id", F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"), F.array(F.lit(linear.WHOLE)).alias("sets")))
    sums = stored(linear.cross_products(rows, matrix))
    both = sums.select("*", F.lit(False).alias("margin")).unionByName(linear.margins(rows, sums, c, matrix).select("*", F.lit(True).alias("margin")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, total = linear.stacked(pdf[~pdf["margin"]])
        system = linear.System("svm", total, linear.stacked(pdf[pdf["margin"]])[1], c)
        raw, base = system.decision(system.weights())
        return pd.DataFrame({"c": codes, "w": list(raw), "b": base})

    found = both.groupBy("fold", "set").applyInPandas(solve, "c int, w array<double>, b double").toPandas().sort_values("c")
    w, b = np.stack(found["w"].to_list()), found["b"].to_numpy()
    return found["c"].to_numpy(), lambda z: lift(z) @ w.T + b


def classify(fit: DataFrame, held: DataFrame, gamma: float | None = None, c: float = 1.0, most: int = MOST, features: int = FEATURES, seed: int = 0) -> DataFrame:
    """sample_id, y_true, y_pred of ``held`` by machines fitted to ``fit``, both (sample_id, label, features) with scaled vectors."""
    first = fit.select(F.size(vector_to_array("features")).alias("p")).first()
    width = first["p"] if first else 1
    g = gamma or 1 / max(1, width)
    classes, decide = _machines(fit, g, c) if fit.count() <= most else _fourier(fit, width, g, c, features, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = classes[np.round(decide(np.stack(pdf["x"].to_list())), 9).argmax(axis=1)] if len(pdf) else []
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "y_true": pdf["label"].astype(int), "y_pred": np.array(best, int)})

    return held.select("sample_id", "label", vector_to_array("features").alias("x")).mapInPandas(run, "sample_id long, y_true int, y_pred int")
