"""SimHash near-duplicates by a binary-trie self-join, and connected components of the links.

Fingerprints are compared as paths in a binary trie. Pairs of trie nodes are walked together from the root: going to
children that differ spends one bit of the error budget, and a pair is pruned once the budget is exceeded. Of two
fingerprints that differ in at most 3 bits, one of the four quarters is equal, so the trie is walked in four rotations of
the bits, in each of which the first quarter spends nothing: a distinct fingerprint goes to four groups at any size. A
group is a node of a depth at which groups hold about NODE fingerprints, and walks its subtrie in NumPy, in bounded
chunks. A node with more than HOT times NODE is split deeper: below the first quarter, every pair of its nodes within
the budget becomes a group of its own, with the fingerprints of both. A group returns a spanning forest of its links, at
most one row per fingerprint, so large families of near copies never become lists of pairs; exact copies share a
fingerprint and count once.

Defined results: null and blank texts have the fingerprint zero, and link like any other; component_id is the smallest
id that is reachable, nulls ignored (null if all ids of a component are null); repeated rows stay repeated.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, map_texts, text_of

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Distinct fingerprints below a node of the depth where groups begin, about.
NODE = 32_768
#: A node of more than HOT times NODE fingerprints is split, by up to SPLIT further bits.
HOT, SPLIT, QUARTER = 8, 12, 16
#: Node pairs handled at once, and the largest product of sizes that is compared directly.
CHUNK, DIRECT = 100_000, 32


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, as a signed 64-bit number."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only ASCII white space splits
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and fp (long)."""
    return map_texts(docs, keep, text_col, lambda texts: [[fingerprint(t) for t in texts]], "fp long")


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the components of i and j their smaller label."""
    while True:
        a, b = label[i], label[j]
        if not (differ := a != b).any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (label[label] != label).any():
            label[:] = label[label]


def trie_forest(a: np.ndarray, b: np.ndarray | None, depth: int, spent: int, budget: int = BUDGET, shared: int = 0) -> np.ndarray:
    """Walk the subtries of the sorted, distinct a and b (None: a with itself) from ``depth`` on.

    Above the depth ``shared``, a node meets only itself: links that differ there are left to another rotation.

    Returns the smallest position that each position of a, then b, is linked with, directly or by others.
    """
    own = b is None
    b = a if own else b
    shift = 0 if own else len(a)
    label = np.arange(len(a) + (0 if own else len(b)))
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def zeros_at(d: int) -> tuple[np.ndarray, np.ndarray]:
        """Running counts of values whose bit at depth d is 0."""
        if d not in zeros:
            count = lambda x: np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - d)) & np.uint64(1) == 0)])
            left = count(a)
            zeros[d] = (left, left if own else count(b))
        return zeros[d]

    def direct(f: np.ndarray) -> None:
        """Compare all values of small pairs of nodes."""
        rows, cols = f[1] - f[0], f[3] - f[2]
        of = np.repeat(np.arange(f.shape[1]), rows * cols)
        k = np.arange(len(of)) - np.repeat(np.cumsum(rows * cols) - rows * cols, rows * cols)
        i, j = f[0][of] + k // cols[of], f[2][of] + k % cols[of]
        if own:
            i, j = i[i < j], j[i < j]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        _join(label, i[near], j[near] + shift)

    def joined(f: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have all their values in one component already."""
        runs = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        same = lambda lo, hi: runs[lo] == runs[hi - 1]
        return same(f[0], f[1]) & same(f[2] + shift, f[3] + shift) & (label[f[0]] == label[f[2] + shift])

    stack = [(depth, np.array([[0], [len(a)], [0], [len(b)], [spent]]))] if len(a) and len(b) else []
    while stack:
        d, f = stack.pop()
        if f.shape[1] > CHUNK:
            half = f.shape[1] // 2
            stack += [(d, f[:, half:]), (d, f[:, :half])]
            continue
        small = (f[1] - f[0]) * (f[3] - f[2]) <= DIRECT
        direct(f[:, small])
        f = f[:, ~small]
        f = f[:, ~joined(f)] if f.shape[1] else f
        if not f.shape[1]:
            continue
        za, zb = zeros_at(d)
        am, bm = f[0] + za[f[1]] - za[f[0]], f[2] + zb[f[3]] - zb[f[2]]
        one = np.ones_like(am)
        twin = (f[0] == f[2]) & (f[1] == f[3]) if own else np.zeros(len(am), bool)
        cross = np.stack([am, f[1], f[2], bm, f[4] + one])[:, ~twin]  # of a node with itself, only one of the two crossings
        alike = [np.stack([f[0], am, f[2], bm, f[4]]), np.stack([am, f[1], bm, f[3], f[4]])]
        g = np.concatenate(alike if d < shared else [*alike, np.stack([f[0], am, bm, f[3], f[4] + one]), cross], axis=1)
        g = g[:, (g[0] < g[1]) & (g[2] < g[3]) & (g[4] <= budget)]
        if g.shape[1]:
            stack.append((d + 1, g))
    return label


def links(fps: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """a, b: links between the distinct fingerprints in column fp, a spanning forest for every group."""
    if budget >= BITS // QUARTER:
        raise ValueError("quarters of the bits cover a budget of up to 3")
    top = min(QUARTER, max(0, math.ceil(math.log2(max(1, fps.count()) / node))))
    turned = [F.shiftleft("fp", QUARTER * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - QUARTER * k)) if k else F.col("fp") for k in range(BITS // QUARTER)]
    place = F.shiftrightunsigned("v", BITS - top) if top else F.lit(0).cast("long")
    rows = fps.select(F.posexplode(F.array(*turned)).alias("turn", "v")).withColumn("place", place)
    hot = rows.groupBy("turn", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT * node)
    hot = hot.select("turn", "place", F.least(F.lit(SPLIT), F.ceil(F.log2(F.col("n") / node))).cast("int").alias("more"))
    masks = [[sum(1 << k for k in c) for r in range(budget + 1) for c in combinations(range(d), r)] for d in range(1, SPLIT + 1)]
    deep = F.expr(f"shiftrightunsigned(v, {BITS - QUARTER} - more)")
    each = F.when(F.col("more").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.element_at(F.lit(masks).cast("array<array<long>>"), F.col("more")))
    deepest = QUARTER + SPLIT
    sides = (
        rows.join(F.broadcast(hot), ["turn", "place"], "left")  # a row for each HOT * node fingerprints, at most
        .select("turn", "v", F.coalesce(F.col("more") + QUARTER, F.lit(top)).alias("depth"), F.coalesce(deep, F.col("place")).alias("p"), F.explode(each).alias("m"))
        .select("v", F.expr(f"shiftleft(cast(turn AS long), {deepest + SPLIT + 6}) | shiftleft(cast(depth AS long), {deepest + SPLIT}) | shiftleft(m, {deepest}) | least(p, p ^ m)").alias("pair"))
    )

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A pair of nodes: the turn and depth, the bits in which the nodes differ, and the smaller one; values begin with their node."""
        lo, m, depth, turn = (int(key[0]) >> k & (1 << n) - 1 for k, n in ((0, deepest), (deepest, SPLIT), (deepest + SPLIT, 6), (deepest + SPLIT + 6, 2)))
        values = pdf["v"].to_numpy(np.int64).view(np.uint64)
        right = values >> np.uint64(BITS - depth) != lo if m else np.zeros(len(values), bool)
        a, b = np.sort(values[~right]), np.sort(values[right]) if m else None
        label = trie_forest(a, b, depth, m.bit_count(), budget, QUARTER)
        both = a if b is None else np.concatenate([a, b])
        back = QUARTER * turn
        both = ((both >> np.uint64(back)) | (both << np.uint64(BITS - back)) if back else both).view(np.int64)
        k = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": both[k], "b": both[label[k]]})

    return sides.groupBy("pair").applyInPandas(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): alternating large and small stars until nothing changes.

    Each round joins neighbours with their minimum, which is summed before the shuffle; no node's neighbours are
    gathered. The edges of a round are checkpointed.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame, id_col: str) -> DataFrame:
    """fp, root, component_id for every distinct fingerprint of (id, fp)."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lowercase hex digits) and component_id for every row."""
    prints = checkpointed(fingerprints(docs, (id_col,), text_col))
    return prints.join(_rooted(prints, id_col), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, whole: one whose id is the component's smallest (with rows alike, any of them).

    A row travels as one struct, so its columns may have any name.
    """
    packed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(F.col(text_col))).alias("mark"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    prints = checkpointed(fingerprints(packed, ("id", "mark"), "text"))
    best = prints.join(_rooted(prints, "id"), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = best.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("k")).select(F.struct("k.id", "k.mark").alias("key"))
    key = F.struct("id", "mark").cast(stay.schema["key"].dataType)  # with another type the window would shuffle whole rows again
    rows = packed.select(key.alias("key"), "row").join(stay, "key", "left_semi")
    one = Window.partitionBy("key").orderBy(F.lit(0))
    return rows.withColumn("number", F.row_number().over(one)).where("number = 1").select("row.*")
