"""Tests and scores of single features against the class, each a groupBy over the long matrix; ``by`` are further keys.

Features whose values are all equal get null statistics instead of an error. Two-class tests compare codes 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import two_sided_normal, two_sided_t
from ..functions.storage import stored


def class_log_ratio(obs: DataFrame, by: tuple[str, ...] = (), floor: float = 1e-7) -> DataFrame:
    """r01, r02, r12: log2 of the ratio of class means (three classes, by label order); zero means count as ``floor``."""
    return _log_ratios(obs.groupBy(*by, "feature").pivot("y", [0, 1, 2]).agg(F.avg("value")), by, floor)


def class_log_ratio_of_labels(obs: DataFrame, by: tuple[str, ...] = (), floor: float = 1e-7) -> DataFrame:
    """``class_log_ratio`` of rows without codes: the labels of the means are numbered (null last), so rows meet no table of levels."""
    means = obs.groupBy(*by, "feature", "label").agg(F.avg("value").alias("m"))
    coded = means.withColumn("y", F.dense_rank().over(Window.orderBy(F.asc_nulls_last("label"))) - 1)
    return _log_ratios(coded.groupBy(*by, "feature").pivot("y", [0, 1, 2]).agg(F.first("m")), by, floor)


def _log_ratios(means: DataFrame, by: tuple[str, ...], floor: float) -> DataFrame:
    log = lambda k: F.when(F.col(f"`{k}`") == 0, F.log2(F.lit(floor))).when(F.col(f"`{k}`") > 0, F.log2(F.col(f"`{k}`")))
    return means.select(*by, "feature", (log(0) - log(1)).alias("r01"), (log(0) - log(2)).alias("r02"), (log(1) - log(2)).alias("r12"))


def class_log_ratio_two(obs: DataFrame, by: tuple[str, ...] = (), floor: float = 1e-7) -> DataFrame:
    """r01 and r10 of two classes, as in ``class_log_ratio``."""
    three = class_log_ratio(obs.where("y < 2"), by, floor)
    return three.select(*by, "feature", "r01", (-F.col("r01")).alias("r10"))


def _in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows, stored, with _cell: rows with smaller ``order`` have no larger cell, and cells hold about as many rows each.

    Spark cuts the ranges at sampled quantiles of the order itself, so an outlier or a hot key only has more ranges.
    """
    return stored(df.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id()))


def _rows_before(values: DataFrame, keys: tuple[str, ...], amount: Column, wide: bool) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the smaller values of the same keys; values are distinct within keys.

    ``wide``: sums run within ranges of the values, on top of the sums of the ranges below, so no task takes all values of
    a key. Without, keys are windows, for many small keys.
    """
    start = Window.unboundedPreceding
    v = values.withColumn("_amount", amount)
    running = lambda over, by: F.coalesce(F.sum("_amount").over(Window.partitionBy(*over).orderBy(by).rowsBetween(start, -1)), F.lit(0))
    if not wide:
        return v.withColumn("before", running(keys, "value")).drop("_amount")
    v = _in_ranges(v, *keys, "value")
    below = v.groupBy(*keys, "_cell").agg(F.sum("_amount").alias("_amount"))
    below = below.withColumn("_below", running(keys, "_cell")).drop("_amount")
    same = [F.col(f"_v.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in (*keys, "_cell")]
    v = v.alias("_v").join(below.alias("_b"), reduce(Column.__and__, same)).select("_v.*", "_b._below")
    v = v.withColumn("before", running((*keys, "_cell"), "value") + F.col("_below"))
    return v.drop("_amount", "_cell", "_below")


def average_ranks(obs: DataFrame, by: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """Add rank (from 1, ties averaged) and ties (rows with the value), within each feature; ``wide`` for features of very many rows."""
    if not wide:
        whole, same = Window.partitionBy(*by, "feature"), Window.partitionBy(*by, "feature", "value")
        ties = F.count(F.lit(1)).over(same)
        return obs.withColumn("ties", ties).withColumn("rank", F.rank().over(whole.orderBy("value")) + (F.col("ties") - 1) / 2.0)
    keys = (*by, "feature")
    values = _rows_before(obs.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("ties")), keys, F.col("ties"), wide)
    values = values.withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2.0).drop("before")
    same = [F.col(f"_o.{k}").eqNullSafe(F.col(f"_v.{k}")) for k in (*keys, "value")]
    return obs.alias("_o").join(values.alias("_v"), reduce(Column.__and__, same)).select("_o.*", "_v.ties", "_v.rank")


def _rank_sums(obs: DataFrame, by: tuple[str, ...], wide: bool = False) -> DataFrame:
    """n, s (rank sum) by class, and tied: the sum of t^3 - t, from counts of distinct values; rows meet once a value."""
    keys = (*by, "feature")
    values = obs.groupBy(*keys, "value").agg(*[F.count_if(F.col("y") == k).alias(str(k)) for k in range(3)])
    t = F.col("0") + F.col("1") + F.col("2")
    ranked = _rows_before(values, keys, t, wide).withColumn("t", t).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2.0)
    sums = [F.sum(F.col(str(k)) * F.col("rank")).alias(f"s{k}") for k in range(3)] + [F.sum(str(k)).cast("double").alias(f"n{k}") for k in range(3)]
    t = F.col("t").cast("double")
    return ranked.groupBy(*keys).agg(*sums, F.sum(t * t * t - t).alias("tied")).withColumn("n", F.col("n0") + F.col("n1") + F.col("n2"))


def kruskal(obs: DataFrame, by: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """h (corrected for ties) and p of three classes; ``wide`` for features of very many rows."""
    n = F.col("n")
    part = lambda k: F.col(f"s{k}") * F.col(f"s{k}") / F.col(f"n{k}")
    raw = 12 / (n * (n + 1)) * (part(0) + part(1) + part(2)) - 3 * (n + 1)
    factor = 1 - F.col("tied") / (n * n * n - n)
    fine = (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n2") > 0) & (factor > 0)
    return _rank_sums(obs, by, wide).withColumn("h", F.when(fine, raw / factor)).select(*by, "feature", "h", F.exp(-F.col("h") / 2).alias("p"))


def wilcoxon(obs: DataFrame, by: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """z and p of the rank-sum test, without corrections."""
    n0, n1, n = F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")
    z = (F.col("s0") - n0 * (n + 1) / 2) / F.sqrt(n0 * n1 * (n + 1) / 12)
    return _rank_sums(obs.where("y < 2"), by, wide).withColumn("z", F.when((n0 > 0) & (n1 > 0), z)).select(*by, "feature", "z", two_sided_normal(F.col("z")).alias("p"))


def _moments(obs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return obs.groupBy(*by, "feature", "y").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))


def t_test(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """t (equal variances), df and p."""
    each = obs.where("y < 2").groupBy(*by, "feature").pivot("y", [0, 1]).agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    c = lambda k: F.col(f"`{k}`")
    df = c("0_n") + c("1_n") - 2
    pooled = ((c("0_n") - 1) * c("0_v") + (c("1_n") - 1) * c("1_v")) / df
    t = (c("0_m") - c("1_m")) / F.sqrt(pooled * (1 / c("0_n") + 1 / c("1_n")))
    out = each.select(*by, "feature", F.when((df > 0) & (pooled > 0), t).alias("t"), df.cast("long").alias("df"))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), two_sided_t(F.col("t"), F.col("df"))))


def anova_f(obs: DataFrame, by: tuple[str, ...] = (), mode: str = "f") -> DataFrame:
    """score: between-class over within-class variance; mode "reference" gives the binned mutual information under this name."""
    if mode == "reference":
        return binned_mutual_information(obs, by)
    each = _moments(obs, by)
    total = Window.partitionBy(*by, "feature")
    grand = F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total)
    sums = each.withColumn("b", F.col("n") * F.pow(F.col("m") - grand, 2)).groupBy(*by, "feature").agg(F.sum("b").alias("b"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return sums.select(*by, "feature", F.when(F.col("w") > 0, (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def chi2(obs: DataFrame, by: tuple[str, ...] = (), shift: bool = False) -> DataFrame:
    """score: class sums against the classes' shares of the total; values must not be negative (``shift`` by the minimum first)."""
    if shift:
        obs = obs.withColumn("value", F.col("value") - F.min("value").over(Window.partitionBy(*by, "feature")))
    each = obs.groupBy(*by, "feature", "y").agg(F.sum("value").alias("o"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "feature")
    e = F.col("n") / F.sum("n").over(w) * F.sum("o").over(w)
    return each.withColumn("e", e).groupBy(*by, "feature").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))).alias("score"))


def binned_mutual_information(obs: DataFrame, by: tuple[str, ...] = (), bins: int = 8) -> DataFrame:
    """score: mutual information (nats) of the class and the feature cut in ``bins`` equal groups, ties by sample."""
    keys = (*by, "feature")
    cut = obs.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*keys).orderBy("value", "sample_id")))
    cells = cut.groupBy(*keys, "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    over = lambda *k: F.sum("c").over(Window.partitionBy(*keys, *k))
    term = F.col("c") / over() * F.log(F.col("c") * over() / (over("bin") * over("y")))
    return cells.withColumn("term", term).groupBy(*keys).agg(F.sum("term").alias("score"))


def benjamini_hochberg(tests: DataFrame, by: tuple[str, ...] = (), name: str = "feature", p: str = "p", wide: bool = False) -> DataFrame:
    """Add q: false-discovery-rate adjusted p-values, by step-up; null p stay null and don't count.

    ``wide`` is for very many tests of one key: ranks go up through ranges of p, and the running minimum comes down
    through them, so a task has one range only.
    """
    known = F.col(p).isNotNull()
    if not wide:
        order = Window.partitionBy(*by, ~known).orderBy(p, name)
        m = F.count(p).over(Window.partitionBy(*by))
        step = F.least(F.lit(1.0), F.col(p) * m / F.row_number().over(order))
        return tests.withColumn("_s", step).withColumn("q", F.when(known, F.min("_s").over(order.rowsBetween(0, Window.unboundedFollowing)))).drop("_s")
    cells = _in_ranges(tests.where(known), *by, p, name)
    inside = Window.partitionBy(*by, "_cell").orderBy(p, name)
    up = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    same = lambda x, y: reduce(Column.__and__, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in (*by, "_cell")])
    counts = cells.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"_below": F.coalesce(F.sum("n").over(up), F.lit(0)), "_m": F.sum("n").over(Window.partitionBy(*by))}).drop("n")
    rows = cells.alias("_c").join(counts.alias("_n"), same("_c", "_n")).select("_c.*", "_n._below", "_n._m")
    rows = rows.withColumn("_s", F.least(F.lit(1.0), F.col(p) * F.col("_m") / (F.col("_below") + F.row_number().over(inside))))
    least = rows.groupBy(*by, "_cell").agg(F.min("_s").alias("s")).withColumn("_later", F.min("s").over(down)).drop("s")
    rows = rows.withColumn("_q", F.min("_s").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    found = rows.alias("_r").join(least.alias("_l"), same("_r", "_l")).select(*[F.col(f"_r.{c}").alias(c) for c in tests.columns], F.least("_r._q", F.coalesce("_l._later", F.lit(1.0))).alias("q"))
    return found.unionByName(tests.where(~known).withColumn("q", F.lit(None).cast("double")))


def passing(tests: DataFrame, cut: float = 0.05, column: str = "p") -> DataFrame:
    return tests.where(F.col(column) < cut)


def fdr_gate(tests: DataFrame, cut: float, least: int = 4) -> DataFrame:
    """The tests with kept: q below the cut, if at least ``least`` (and two) features pass; else ``enough`` is false for all."""
    n = F.sum(F.when(F.col("q") < cut, 1).otherwise(0)).over(Window.partitionBy())
    return tests.withColumn("enough", (n >= least) & (n >= 2)).withColumn("kept", F.col("enough") & F.coalesce(F.col("q") < cut, F.lit(False)))


#: Features of a block, and samples of a chunk, of the products that correlations come from.
COLUMNS, SAMPLES = 256, 4096


def pearson_pairs(obs: DataFrame, by: tuple[str, ...] = (), least: float | None = None) -> DataFrame:
    """a, b (a before b), r and n (samples that have both) of every pair of features; with ``least``, of pairs whose |r| is over it.

    Features are dealt into blocks and samples into chunks. For two blocks and a chunk, matrix products give the sums of
    all their pairs, so there is no row for a pair and a sample. Sums of several chunks are added by feature and block.
    """
    names = obs.groupBy(*by, "feature").agg(F.min("feature_pos").alias("feature_pos"), F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    names = stored(names)  # sums are taken around the mean
    size = names.groupBy(*by).agg(F.max("_n").alias("n"), F.count(F.lit(1)).alias("p")).agg(F.max("n"), F.max("p")).first()
    chunks, blocks = max(1, math.ceil((size[0] or 0) / SAMPLES)), max(1, math.ceil((size[1] or 0) / COLUMNS))
    names = names.drop("_n").withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("int"))
    names = names.withColumn("at", F.row_number().over(Window.partitionBy(*by, "block").orderBy("feature_pos", "feature")) - 1).withColumnRenamed("feature", "_feature")
    width = names.groupBy(*by, "block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    same = reduce(Column.__and__, [F.col("feature") == F.col("_feature"), *[F.col(f"_o.{k}").eqNullSafe(F.col(f"_n.{k}")) for k in by]])
    cells = obs.where("value is not null").alias("_o").join(names.alias("_n"), same).select(*[F.col(f"_o.{k}").alias(k) for k in by], "sample_id", "block", "at", (F.col("value") - F.col("_mean")).alias("value"))
    columns = cells.groupBy(*by, "block", "at", F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("sample_id", "value")).alias("v"))
    pair = width.join(width.select(*by, F.col("block").alias("other"), F.col("width").alias("across")), list(by)) if by else width.crossJoin(width.select(F.col("block").alias("other"), F.col("width").alias("across")))
    columns = columns.join(pair, [*by, "block"])
    columns = columns.select(*by, "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "at", "width", "across", F.col("v.sample_id").alias("ids"), F.col("v.value").alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema}
    keys = ", ".join(f"{k} {kinds[k]}" for k in by) + ", " * bool(by)

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *keyed, _, i, j = key
        ids, place = np.unique(np.concatenate(pdf["ids"].to_list()), return_inverse=True)
        side = {}
        for b in {i, j}:
            mine = (pdf["block"] == b).to_numpy()
            wide = int(pdf["width"].iloc[0] if mine[0] else pdf["across"].iloc[0])
            x, has = np.zeros((wide, len(ids))), np.zeros((wide, len(ids)))
            sizes = pdf["ids"].map(len).to_numpy()
            at, keep = np.repeat(pdf["at"].to_numpy(), sizes), np.repeat(mine, sizes)
            x[at[keep], place[keep]] = np.concatenate(pdf["x"].to_list())[keep]
            has[at[keep], place[keep]] = 1
            side[b] = (x, has)
        (x, p), (y, q) = side[i], side[j]
        sums = np.stack([p @ q.T, x @ q.T, p @ y.T, (x * x) @ q.T, p @ (y * y).T, x @ y.T], axis=2)
        out = pd.DataFrame({"i": i, "j": j, "at": np.arange(len(x)), "v": list(sums.reshape(len(x), -1))})
        for k, v in zip(by, keyed, strict=True):
            out[k] = v
        return out[[*by, "i", "j", "at", "v"]]

    sums = columns.groupBy(*by, "chunk", "i", "j").applyInPandas(products, f"{keys}i int, j int, at int, v array<double>")
    if chunks > 1:
        sums = sums.groupBy(*by, "i", "j", "at").agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v"))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n, sx, sy, sxx, syy, sxy = np.asarray(row.v).reshape(-1, 6).T
                m = np.maximum(n, 1)
                vx, vy = sxx / m - (sx / m) ** 2, syy / m - (sy / m) ** 2
                flat = (vx <= 1e-14 * np.maximum(sxx / m, 1e-300)) | (vy <= 1e-14 * np.maximum(syy / m, 1e-300))
                r = np.where(flat, np.nan, np.clip((sxy / m - sx * sy / m**2) / np.sqrt(np.where(flat, 1, vx * vy)), -1, 1))
                other = np.arange(len(n))
                some = (n > 0) & ((other > row.at) if row.i == row.j else True)
                some &= True if least is None else np.abs(np.nan_to_num(r)) > least
                made = pd.DataFrame({"i": row.i, "j": row.j, "s": row.at, "t": other[some], "r": r[some], "n": n[some].round().astype(np.int64)})
                for k in by:
                    made[k] = getattr(row, k)
                yield made[[*by, "i", "j", "s", "t", "r", "n"]]

    pairs = sums.mapInPandas(ratios, f"{keys}i int, j int, s int, t int, r double, n long")
    named = lambda b, at, to: names.select(*by, F.col("block").alias(b), F.col("at").alias(at), F.col("_feature").alias(to), F.col("feature_pos").alias(f"{to}_pos"))
    full = pairs.join(named("i", "s", "x"), [*by, "i", "s"]).join(named("j", "t", "y"), [*by, "j", "t"])
    turned = F.struct("y_pos", "y") < F.struct("x_pos", "x")
    r = F.when(~F.isnan("r"), F.col("r"))
    return full.select(*by, F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b"), r.alias("r"), "n")


def pearson_tests(pairs: DataFrame, by: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """Add p (two-sided) and q (over all pairs); ``wide`` for the pairs of thousands of features."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    p = F.when(F.abs("r") >= 1, 0.0).when(F.col("r").isNotNull(), two_sided_t(t, F.col("n") - 2))
    return benjamini_hochberg(pairs.withColumn("p", p).withColumn("_name", F.concat_ws("|", "a", "b")), by, "_name", wide=wide).drop("_name")


def variance_inflation(pairs: DataFrame) -> DataFrame:
    r2 = F.col("r") * F.col("r")
    return pairs.withColumn("vif", F.when(r2 >= 1, F.lit(float("inf"))).otherwise(1 / (1 - r2)))


def threshold_to_zero(pairs: DataFrame, cut: float) -> DataFrame:
    return pairs.withColumn("r", F.when(F.col("r") < cut, 0.0).otherwise(F.col("r")))


def correlation_groups(tests: DataFrame, cut: float = 0.9, alpha: float = 0.05) -> DataFrame:
    """kept, dropped (sorted array): b is dropped if some a before it has q < alpha and |r| > cut; dropped ones drop others too."""
    strong = tests.where((F.col("q") < alpha) & (F.abs("r") > cut)).select("a", "b")
    gone = strong.select(F.col("b").alias("a")).distinct()
    return strong.join(gone, "a", "left_anti").groupBy(F.col("a").alias("kept")).agg(F.array_sort(F.collect_set("b")).alias("dropped"))


#: Samples in a block of the pairwise comparisons, two of which meet in one task; with more than SOME blocks, up to MANY.
BLOCK, SOME, MANY = 1024, 16, 8192
#: Pairs that are measured at once, and how many of them fit a processor's cache.
AT_ONCE, NEAR_BY = 1_048_576, 32_768
#: Samples in a block of the search for neighbours, and how many of them are asked at once.
NEAR_BLOCK, ASKED = 4096, 256


def _packed(obs: DataFrame) -> tuple[DataFrame, int]:
    """sample_id, x (values in the order of features; null where there is none), and the number of blocks."""
    names = [r[0] for r in obs.select("feature").distinct().orderBy("feature").collect()] or [""]
    at = F.map_from_entries(F.collect_list(F.struct("feature", "value")))
    rows = obs.groupBy("sample_id").agg(at.alias("_m"))
    x = F.transform(F.array(*map(F.lit, names)), lambda n: F.element_at("_m", n))
    n = obs.select("sample_id").distinct().count()
    return rows.select("sample_id", x.alias("x")), max(1, min(-(-n // BLOCK), max(SOME, -(-n // MANY))))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances over the features that both have; NaN where there are none."""
    if x.shape[1] and not np.isnan(x).any() and not np.isnan(y).any():
        out, y = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
        step = max(1, NEAR_BY // max(1, y.shape[1]))
        for k in range(0, len(x), step):
            for f in range(x.shape[1]):
                d = x[k : k + step, f, None] - y[f]
                d *= d
                out[k : k + step] += d
        return np.sqrt(out, out=out)
    total, seen = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
    for f in range(x.shape[1]):
        d = x[:, f, None] - y[None, :, f]
        has = ~np.isnan(d)
        total += np.where(has, d * d, 0)
        seen |= has
    return np.sqrt(np.where(seen, total, np.nan))


def _closest(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): each row's k nearest rows of y with another id, the first among equals.

    Of complete rows, a matrix product finds all that its rounding leaves among the k nearest, and only these are measured.
    """
    same = a[:, None] == b[None, :]
    sizes, others = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (sizes + others.max())
    if not np.isfinite(slack).all():
        d = _apart(x, y)
        d[same] = np.nan
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        m, n = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
        has = ~np.isnan(d[m, n])
        return m[has], n[has], d[m, n][has]
    g = sizes[:, None] + others[None, :] - 2 * (x @ y.T)
    g[same] = np.inf
    m, n = np.nonzero((g <= (np.partition(g, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + slack)[:, None]) & ~same)
    total = np.zeros(len(m))
    for f in range(x.shape[1]):
        d = x[m, f] - y[n, f]
        total += d * d
    d = np.sqrt(total)
    order = np.lexsort((n, d, m))
    m, n, d = m[order], n[order], d[order]
    has = np.arange(len(m)) - np.searchsorted(m, m) < k
    return m[has], n[has], d[has]


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in pdf["x"]])


def distances(obs: DataFrame) -> DataFrame:
    """a, b, d: Euclidean distance of every pair of samples that share a feature, over the features they share.

    Packed samples are dealt into blocks by hash, and each pair of blocks is a group: a sample is sent once for each block.
    A group holds its samples, and gives about AT_ONCE pairs at a time.
    """
    rows, blocks = _packed(obs)
    kind = obs.schema["sample_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).alias("own")
    sent = rows.select("*", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("sample_id", "x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))

    def pairs(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, values, second = [], [], []
        for pdf in batches:
            ids.append(pdf["sample_id"])
            values.append(_stack(pdf))
            second.append(pdf["second"].to_numpy(bool))
        ids, values, second = pd.concat(ids), np.concatenate(values), np.concatenate(second)
        order = np.argsort(ids.to_numpy(), kind="stable")
        ids, values, second = ids.to_numpy()[order], values[order], second[order]
        own = key[0] == key[1]
        a, x = ids[~second], values[~second]
        b, y = (a, x) if own else (ids[second], values[second])
        step = max(1, AT_ONCE // max(1, len(b)))
        for k in range(0, len(a) if len(b) else 0, step):
            d, some = _apart(x[k : k + step], y), a[k : k + step]
            m, n = np.nonzero(~np.isnan(d) & ((some[:, None] < b[None, :]) if own else True))
            first = some[m] < b[n]
            yield pd.DataFrame({"a": np.where(first, some[m], b[n]), "b": np.where(first, b[n], some[m]), "d": d[m, n]})

    return sent.groupBy("i", "j").applyInPandas(pairs, f"a {kind}, b {kind}, d double")


def nearest(obs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """a, b, d, r: the k nearest other samples b of each sample a of ``queries`` (sample_id), ties in order of b.

    Blocks of queries meet blocks of samples; a group gives each query's k best, and the best of these remain.
    """
    rows, _ = _packed(obs)
    kind = obs.schema["sample_id"].dataType.simpleString()
    wanted = queries.select("sample_id").distinct()
    over, under = (max(1, -(-df.count() // NEAR_BLOCK)) for df in (wanted, obs.select("sample_id").distinct()))
    block = lambda n: F.pmod(F.xxhash64("sample_id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.join(wanted, "sample_id", "left_semi")
    left = asked.select(F.lit(True).alias("asked"), "sample_id", "x", block(over).alias("i"), every(under).alias("j"))
    right = rows.select(F.lit(False).alias("asked"), "sample_id", "x", every(over).alias("i"), block(under).alias("j"))

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        p, q = pdf[pdf["asked"]], pdf[~pdf["asked"]]
        if not len(p) or not len(q):
            return pd.DataFrame({"a": pdf["sample_id"][:0], "b": pdf["sample_id"][:0], "d": np.zeros(0)})
        x, y, a, b = _stack(p), _stack(q), p["sample_id"].to_numpy(), q["sample_id"].to_numpy()
        parts = []
        for at in range(0, len(a), ASKED):
            m, n, d = _closest(x[at : at + ASKED], y, a[at : at + ASKED], b, k)
            parts.append(pd.DataFrame({"a": a[at + m], "b": b[n], "d": d}))
        return pd.concat(parts)

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(best, f"a {kind}, b {kind}, d double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)
