"""Small models of signatures, plain and bagged: one batched solver for all signatures of a unit.

Linear models of a signature come from a submatrix of its split's cross products, so no signature is fitted to rows: per
(fold, split) the products are summed once (``linear``), and a unit (a block of test samples and a chunk of signatures)
solves all its signatures of one size as one batch. A bag draws features with replacement, as many as the signature has,
by hash; a feature drawn w times weighs sqrt(w) on both sides of the system, which is the same as w copies of it. With
``rows``, each bag has cross products of rows that a hash counts by a Poisson law. The bags' votes are counted, and the
lower class wins among equals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import evaluate, forest, linear

ESTIMATORS = ("ridge", "lda")
#: Doubles of a batch.
BATCH = 4_000_000


def drawn(sig_id: str, size: int, bags: int) -> np.ndarray:
    """[bag, feature]: how often each bag draws each of the signature's features."""
    rng = np.random.default_rng(zlib.crc32(sig_id.encode()))
    out = np.zeros((bags, size))
    np.add.at(out, (np.repeat(np.arange(bags), size), rng.integers(0, size, bags * size)), 1)
    return out


def solved(system: linear.System, genes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For signatures [s, k] and bags [s, b, k]: weights of raw values [s, b, class, k] and constants [s, b, class].

    Ridge systems carry their penalty on the diagonal already; it is set anew after weighing.
    """
    base = system.matrices[0]
    penalty = 1 / system.penalty if system.estimator == "ridge" else system.penalty
    plain = base - penalty * np.eye(len(base))
    root = np.sqrt(weight)
    a = plain[genes[:, :, None], genes[:, None, :]][:, None] * root[..., :, None] * root[..., None, :] + penalty * np.eye(genes.shape[1])
    b = np.stack(system.sides)[:, genes].transpose(1, 2, 0)[:, None] * root[..., None]
    w = (np.linalg.solve(a, np.broadcast_to(b, (*a.shape[:-1], b.shape[-1]))) * root[..., None]).swapaxes(2, 3)
    raw = w / system.sd[genes][:, None, None, :]
    level = np.array(system.levels) - np.einsum("sbck,sk->sbc", raw, system.mean[genes])
    if system.estimator == "lda":
        level = level - 0.5 * np.einsum("sbck,csk->sbc", w, np.stack(system.sides)[:, genes])
    return raw, level


def confusion(obs: DataFrame, splits: DataFrame, signatures: DataFrame, bags: int = 0, rows: bool = False, estimators: tuple[str, ...] = ESTIMATORS, blocks: int = 1) -> DataFrame:
    """fold, split, estimator, sig_id, y_true, y_pred, n for splits (fold, split, sample_id, is_test) and signatures (fold, sig_id, genes).

    ``bags`` 0 gives the plain models; ``rows`` draws rows for each bag besides features.
    """
    used = signatures.select("fold", F.explode("genes").alias("feature")).distinct()
    named = obs.select("sample_id", "y", "feature", "value").join(used, "feature")
    packs, places = linear.packed(named, 1, 0)
    packs = stored(packs.drop("sets", "part"))
    step = bags + 1 if rows else 1
    each = splits.select("fold", "split", "sample_id", "is_test")
    train = packs.join(each.where("not is_test"), ["fold", "sample_id"])
    copies = F.array(F.col("split") * step)
    if rows:
        u = lambda b: F.shiftrightunsigned(F.xxhash64(b, F.col("fold"), F.col("split"), F.col("sample_id")), 11) / F.lit(float(1 << 53))
        often = lambda b: F.size(F.filter(F.array(*map(F.lit, forest.DRAWN.tolist())), lambda d: d <= u(b)))
        copies = F.concat(copies, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(bags)), lambda b: F.array_repeat((F.col("split") * step + b).cast("int"), often(b)))))
    sets = train.groupBy("fold", "sample_id").agg(F.flatten(F.collect_list(copies.cast("array<int>"))).alias("sets"))
    sums = stored(linear.cross_products(packs.join(sets, ["fold", "sample_id"])))

    order = F.row_number().over(evaluate.Window.partitionBy("fold").orderBy("sig_id"))
    chunked = signatures.select("fold", "sig_id", "genes", F.floor(order / evaluate.SIGNATURES).cast("int").alias("chunk"))
    genes = chunked.select("fold", "chunk", "sig_id", F.posexplode("genes").alias("k", "feature")).join(places, ["fold", "feature"])
    genes = genes.groupBy("fold", "chunk", "sig_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "pos"))), lambda g: g["pos"]).alias("genes"))
    genes = stored(genes)
    chunks = genes.select("fold", "chunk").distinct()
    units = each.select(F.col("fold").alias("fold"), F.col("split").alias("split")).distinct()
    tests = packs.join(each.where("is_test"), ["fold", "sample_id"]).withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))
    right = genes.join(units, "fold").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both sides come from the signatures
    empty = lambda kind: F.lit(None).cast(kind)
    left = tests.join(chunks, "fold").select("fold", "split", "block", "chunk", "y", "p", "pos", "x", empty("int").alias("bag"), empty("int").alias("c"), empty("int").alias("i"), empty("array<double>").alias("row"))
    grams = sums.withColumn("split", F.floor(F.col("set") / step).cast("int")).join(chunks, "fold").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grams = grams.select("fold", "split", "block", "chunk", empty("int").alias("y"), empty("int").alias("p"), empty("array<int>").alias("pos"), empty("array<double>").alias("x"), (F.col("set") % step).cast("int").alias("bag"), "c", "i", "row")
    of = ["fold", "split", "block", "chunk"]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows_, gram = a[a["bag"].isna()], a[a["bag"].notna()]
        out = _unit(rows_, gram, b, bags, rows, estimators) if len(rows_) and len(gram) and len(b) else []
        return pd.DataFrame([(key[0], key[1], *r) for r in out], columns=["fold", "split", "estimator", "sig_id", "y_true", "y_pred", "n"])

    schema = "fold int, split int, estimator string, sig_id string, y_true int, y_pred int, n long"
    counts = left.unionByName(grams).groupBy(*of).cogroup(right.groupBy(*of)).applyInPandas(run, schema)
    return counts.groupBy("fold", "split", "estimator", "sig_id", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def _unit(tests: pd.DataFrame, gram: pd.DataFrame, signatures: pd.DataFrame, bags: int, rows: bool, estimators: tuple[str, ...]) -> list[tuple]:
    """Counted predictions of all signatures of a unit."""
    x, y = linear.dense(tests)[:, 1:], tests["y"].to_numpy().astype(int)
    sums = {int(bag): linear.stacked(some.astype({"c": int, "i": int})) for bag, some in gram.groupby("bag")}
    width = int(max(y.max(), max(codes.max() for codes, _ in sums.values()))) + 1
    sizes = signatures["genes"].map(len).to_numpy()
    out = []
    for name in estimators:
        systems = {bag: (codes, linear.System(name, m, None, linear.PENALTY[name])) for bag, (codes, m) in sums.items()}
        for k in np.unique(sizes):
            some = signatures[sizes == k]
            genes, names = np.stack(some["genes"].to_list()), some["sig_id"].to_list()
            weight = np.stack([drawn(s, k, bags) for s in names]) if bags else np.ones((len(names), 1, k))
            many = max(1, BATCH // max(1, weight.shape[1] * len(x) * width))
            for lo in range(0, len(names), many):
                part = slice(lo, lo + many)
                votes = np.zeros((len(genes[part]), len(x), width))
                for bag in range(1, bags + 1) if rows and bags else [0]:
                    if bag not in systems:  # the bag drew no row
                        continue
                    codes, system = systems[bag]
                    raw, level = solved(system, genes[part], weight[part][:, [bag - 1]] if rows and bags else weight[part])
                    scores = np.einsum("nsk,sbck->sbnc", x[:, genes[part]], raw) + level[:, :, None, :]
                    pred = codes[np.round(scores, 9).argmax(axis=3)]
                    for c in codes:
                        votes[:, :, c] += (pred == c).sum(axis=1)
                best = votes.argmax(axis=2)
                for s, name_ in enumerate(names[part]):
                    count = np.bincount(y * width + best[s])
                    out += [(name, name_, int(z // width), int(z % width), int(count[z])) for z in np.flatnonzero(count)]
    return out


def scores(obs: DataFrame, found: DataFrame, splits: DataFrame, bags: int = 16, blocks: int = 1) -> DataFrame:
    """fold, sig_id, estimator, cv_mean, cv_std of the plain linear models and of their bagged forms (bag_<estimator>)."""
    plain = confusion(obs, splits, found, blocks=blocks)
    both = plain.unionByName(confusion(obs, splits, found, bags, blocks=blocks).withColumn("estimator", F.concat(F.lit("bag_"), "estimator"))) if bags else plain
    return evaluate.counted_summary(both, ("fold", "sig_id", "estimator"))
