"""Rankings by trees and forests for all folds at once: levels of all trees grow together, from histograms that Spark sums up.

Features are cut at BINS approximate quantiles of a fold. A pass over the rows counts, for each open node of each tree
and each feature that the node may look at, the rows by bin and class; a node's best cut comes from the sums, in a group
for each tree. Cuts go back out with the next pass: they are as many as there are nodes, whatever the number of rows. So
there are DEPTH passes for a whole set of forests, and rows never meet in a group.

A forest's tree counts each row as often as a hash says (by a Poisson law, as a large bootstrap would) and looks at
the square root of the features in each node, chosen by a hash. Importance is the loss of Gini impurity, summed up by
feature. Rank types: weights (importance), elimination and addition (all trees grow anew with the features left; of these
the less, or more, important half goes, in the order of importance), stability (share of subsamples in which a tree's
importance is over the mean), single (accuracy over the inner parts of the most frequent class by bin).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import linear

TREES, DEPTH, BINS, LEAST = 83, 5, 32, 2
#: Shares of rows that a bootstrap takes at most 0, 1, 2 ... times.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
HELD = 8_000_000


def cuts(train: DataFrame, places: DataFrame) -> dict[int, np.ndarray]:
    """By fold: the inner cuts of each feature, at approximate quantiles; one row of a few numbers a feature comes back."""
    q = F.percentile_approx(F.coalesce("value", F.lit(0.0)), F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), F.lit(2000))
    found = train.join(F.broadcast(places), ["fold", "feature"]).groupBy("fold", "pos").agg(q.alias("q")).collect()
    out = {f: np.full((1 + max(r["pos"] for r in found if r["fold"] == f), BINS - 1), np.inf) for f in {r["fold"] for r in found}}
    for r in found:
        out[r["fold"]][r["pos"]] = r["q"]
    return out


def binned(rows: DataFrame, edges: dict[int, np.ndarray]) -> DataFrame:
    """The rows of ``linear.packed`` with b, the bin of every feature, in place of pos and x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, some in pdf.groupby("fold"):
                x, cut = linear.dense(some)[:, 1:], edges[int(fold)]
                b = np.stack([np.searchsorted(cut[j], x[:, j], "left") for j in range(x.shape[1])], axis=1).astype(np.int16)
                yield some[["fold", "sample_id", "y", "sets"]].assign(b=list(b))

    return rows.mapInPandas(run, "fold int, sample_id long, y int, sets array<int>, b array<short>")


def times(ids: np.ndarray, seed: int) -> np.ndarray:
    """How often a tree counts each row."""
    u = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(zlib.crc32(f"rows of tree {seed}".encode()) * 0x9E3779B1)
    u ^= u >> np.uint64(33)
    u *= np.uint64(0xFF51AFD7ED558CCD)
    u ^= u >> np.uint64(33)
    return np.searchsorted(DRAWN, (u >> np.uint64(11)) / float(1 << 53), "right")


class Tree:
    """A model's fold and rows, the features it may use, and its cuts by node (root 1, children 2k and 2k + 1)."""

    def __init__(self, fold: int, name: str, rows: int, features: np.ndarray, number: int | None = None) -> None:
        self.fold, self.name, self.rows, self.features, self.number = fold, name, rows, features, number
        self.cuts: dict[int, tuple[int, int]] = {}
        self.open, self.gains = [1], {}

    def looks_at(self, node: int) -> np.ndarray:
        """The features that a node chooses from: all, or in a forest as many as the square root of their number."""
        if self.number is None:
            return self.features
        order = np.argsort([zlib.crc32(f"{self.number}/{node}/{f}".encode()) * 0x9E3779B1 % 2**32 for f in self.features], kind="stable")
        return np.sort(self.features[order[: max(1, round(len(self.features) ** 0.5))]])

    def nodes(self, b: np.ndarray) -> np.ndarray:
        """The node of each row."""
        at = np.ones(len(b), np.int64)
        for node in sorted(self.cuts):  # parents come before their children
            j, edge = self.cuts[node]
            here = at == node
            at[here] = 2 * node + (b[here, j] > edge)
        return at


def grow(rows: DataFrame, trees: list[Tree], classes: int) -> None:
    """Grow all trees level by level, one pass over the rows for each level of all of them."""
    for _ in range(DEPTH):
        todo = [(k, t) for k, t in enumerate(trees) if t.open]
        if not todo:
            return
        counted = _counts(rows, todo, classes)
        found = counted.groupBy("tree").applyInPandas(lambda pdf: _best(pdf, classes), "tree int, node long, place int, edge int, gain double")
        for _, t in todo:
            t.open = []
        for r in found.collect():  # a cut for each node
            t = trees[r["tree"]]
            j = int(t.looks_at(r["node"])[r["place"]])
            t.cuts[r["node"]] = (j, r["edge"])
            t.gains[j] = t.gains.get(j, 0.0) + r["gain"]
            t.open += [2 * r["node"], 2 * r["node"] + 1]


def _counts(rows: DataFrame, todo: list[tuple[int, Tree]], classes: int) -> DataFrame:
    """tree, node, row: the node's rows by (feature it looks at, bin, class), flattened."""
    by_fold: dict[int, list[tuple[int, Tree]]] = {}
    for k, t in todo:
        by_fold.setdefault(t.fold, []).append((k, t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for fold, some in pdf.groupby("fold"):
                b, y, ids = np.stack(some["b"].to_list()), some["y"].to_numpy(), some["sample_id"].to_numpy()
                sets = some["sets"].to_list()
                member = {s: np.array([s in x for x in sets]) for s in {t.rows for _, t in by_fold.get(int(fold), [])}}
                for k, t in by_fold.get(int(fold), []):
                    weight = times(ids, t.number) * member[t.rows] if t.number is not None else member[t.rows].astype(np.int64)
                    at = t.nodes(b)
                    for node in t.open:
                        here = np.flatnonzero((at == node) & (weight > 0))
                        if not len(here):
                            continue
                        look = t.looks_at(node)
                        cell = (np.arange(len(look)) * BINS + b[np.ix_(here, look)]) * classes + y[here, None]
                        count = np.bincount(cell.ravel(), np.repeat(weight[here], len(look)), len(look) * BINS * classes)
                        held[k, node] = held[k, node] + count if (k, node) in held else count
            if sum(map(len, held.values())) > HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"tree": [k for k, _ in held], "node": [n for _, n in held], "row": list(held.values())})

    sums = rows.mapInPandas(run, "tree int, node long, row array<double>")
    return sums.groupBy("tree", "node").agg(Summarizer.sum(array_to_vector("row")).alias("v")).select("tree", "node", vector_to_array("v").alias("row"))


def _best(pdf: pd.DataFrame, classes: int) -> pd.DataFrame:
    """The cut of each node that takes most impurity away, if any does."""
    out = []
    for r in pdf.itertuples():
        n = np.asarray(r.row).reshape(-1, BINS, classes)
        left = n.cumsum(axis=1)[:, :-1]
        right = n.sum(axis=1, keepdims=True) - left
        nl, nr = left.sum(axis=2), right.sum(axis=2)
        whole = n[0].sum(axis=0)
        pure = lambda c, m: (c**2).sum(axis=-1) / np.maximum(m, 1e-300)
        gain = np.where((nl >= LEAST) & (nr >= LEAST), pure(left, nl) + pure(right, nr) - pure(whole, whole.sum()), 0.0).round(9)
        place, edge = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[place, edge] > 0:
            out.append((r.tree, r.node, int(place), int(edge), float(gain[place, edge])))
    return pd.DataFrame(out, columns=["tree", "node", "place", "edge", "gain"])


def importance(trees: list[Tree], p: int) -> np.ndarray:
    """Mean over the trees of each feature's share of a tree's gains."""
    out = np.zeros(p)
    for t in trees:
        total = sum(t.gains.values())
        for j, g in t.gains.items():
            out[j] += g / total / len(trees)
    return out


def _orders(rows: DataFrame, classes: int, width: dict[int, int], trees: int) -> dict[tuple[str, int, str], np.ndarray]:
    """(type, fold, estimator): scores of weights, elimination and addition."""

    def forests(left: dict) -> dict:
        """Importances by key, of models that all grow in the same passes."""
        models = {(*key, name): [Tree(key[1], name, linear.WHOLE, some, k) for k in ([None] if name == "tree" else range(trees))] for (*key, name), some in left.items()}
        grow(rows, [t for m in models.values() for t in m], classes)
        return {key: importance(m, width[key[1]]) for key, m in models.items()}

    first = forests({("t3_weights", f, n): np.arange(p) for f, p in width.items() for n in ("tree", "forest")})
    out = dict(first)
    weight = {(t, f, n): w for (_, f, n), w in first.items() for t in ("t4_elimination", "t7_addition")}
    left = {key: np.arange(width[key[1]]) for key in weight}
    score = {key: np.zeros(width[key[1]]) for key in weight}
    done = dict.fromkeys(weight, 0)
    while left:
        for key, some in list(left.items()):
            down = key[0] == "t4_elimination"
            order = some[np.argsort(weight[key][some] if down else -weight[key][some], kind="stable")]
            go = order[: len(order) if len(order) <= 2 else (len(order) + 1) // 2]
            rounds = done[key] + np.arange(len(go))
            score[key][go] = rounds if down else width[key[1]] - rounds
            done[key] += len(go)
            left[key] = np.setdiff1d(some, go)
            if not len(left[key]):
                del left[key]
        if left:
            weight |= forests(left)
    return out | score


def rank(train: DataFrame, parts: int = 3, bags: int = 8, trees: int = TREES) -> DataFrame:
    """fold, method (type and estimator), feature, score, higher better, for rows (fold, sample_id, y, feature, value)."""
    spark = train.sparkSession
    rows, places = linear.packed(train, parts, bags)
    rows, places = stored(rows), stored(places)
    edges = cuts(train, places)
    width = {f: len(e) for f, e in edges.items()}
    classes = (train.agg(F.max("y")).first()[0] or 0) + 1
    small = stored(binned(rows, edges))
    scores = [(f, f"{kind}_{name}", j, float(v)) for (kind, f, name), w in _orders(small, classes, width, trees).items() for j, v in enumerate(w)]
    if bags:
        some = {(f, s): Tree(f, "tree", s, np.arange(p)) for f, p in width.items() for s in range(parts + 1, parts + bags + 1)}
        grow(small, list(some.values()), classes)
        for f, p in width.items():
            each = [importance([some[f, s]], p) for s in range(parts + 1, parts + bags + 1)]
            scores += [(f, "t5_stability_tree", j, float(v)) for j, v in enumerate(np.mean([w >= max(w.mean(), 1e-12) for w in each], axis=0))]
    found = spark.createDataFrame(scores, "fold int, method string, pos int, score double").join(places, ["fold", "pos"])
    return reduce(DataFrame.unionByName, [found.select("fold", "method", "feature", "score"), _single(small, places, parts)])


def _single(rows: DataFrame, places: DataFrame, parts: int) -> DataFrame:
    """Accuracy over the inner parts of the most frequent training class by bin; bins without rows get the set's class."""
    long = rows.select("fold", "sample_id", "y", "sets", F.posexplode("b").alias("pos", "bin"))
    counts = long.select("fold", "pos", "bin", "y", F.explode("sets").alias("set")).where(F.col("set").between(1, parts)).groupBy("fold", "set", "pos", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", (-F.col("y")).alias("y")))["y"]
    by_bin = counts.groupBy("fold", "set", "pos", "bin").agg((-most).alias("a"))
    by_set = counts.where("pos = 0").groupBy("fold", "set", "y").agg(F.sum("n").alias("n")).groupBy("fold", "set").agg((-most).alias("d"))
    part = F.array_except(F.sequence(F.lit(1), F.lit(parts)), "sets")[0]
    tests = long.select("fold", "y", "pos", "bin", part.alias("set"))
    hit = (F.coalesce("a", "d") == F.col("y")).cast("double")
    each = tests.join(by_bin, ["fold", "set", "pos", "bin"], "left").join(by_set, ["fold", "set"]).groupBy("fold", "set", "pos").agg(F.avg(hit).alias("s"))
    return each.groupBy("fold", "pos").agg(F.avg("s").alias("score")).join(places, ["fold", "pos"]).select("fold", F.lit("t2_single_tree").alias("method"), "feature", "score")
