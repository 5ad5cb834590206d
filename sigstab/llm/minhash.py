"""MinHash near-duplicates with circulant signatures: banding finds candidates, whole shingle sets confirm them.

Two permutations make all coordinates of a signature: the first, σ, puts a shingle at a place of a ring of 2^32 places;
the second, π, is a bijection of the ring, and coordinate k is the least π(place - k) over a document's shingles, so π
is shifted around the ring by k and no further hash function is drawn. BANDS bands of ROWS coordinates share a bucket
at similarity 0.85 with a probability of 1 - (1 - 0.85^5)^24, which misses one pair in a million.

Documents with the same set are one class. Links are looked for between classes only, first of each class with the
smallest class of each of its buckets. In buckets that still hold several components then, whole sets of the classes
outside the largest component are compared with those of all others, in units of bounded size that give a spanning
forest of their links. So no bucket is turned into a list of its pairs, no partner is capped, every link is confirmed on
the full sets of 64-bit shingle hashes, and the components are those of all links of classes that share a bucket.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; component_id is the smallest
id that is reachable, nulls ignored (null if all ids of a component are null; a null id alone is kept); repeated rows
stay repeated; rows with the same id but other texts are documents of their own; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, text_of
from .simhash import components

SHINGLE, SEED, PERCENT = 5, 42, 85
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Shingles of the sets of one side of a unit, and of a task, about.
UNIT, CELL = 1_000_000, 4_000_000
#: Classes whose keys may be broadcast to the scan of the texts, at 24 bytes a row; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles that are hashed, or shifted around the ring, at once.
HASHED, SHIFTED = 65_536, 256


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only ASCII white space splits
    if not w:
        return np.zeros(0, np.uint64)
    digest, parts = xxhash.xxh64_intdigest, []
    last = max(1, len(w) - words + 1)
    for k in range(0, last, HASHED):
        some = (b" ".join(w[i : i + words]) for i in range(k, min(last, k + HASHED)))
        parts.append(np.unique(np.fromiter((digest(s, SEED) for s in some), np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _place(hashes: np.ndarray) -> np.ndarray:
    """σ: the place of a shingle on the ring."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _around(x: np.ndarray) -> np.ndarray:
    """π: a bijection of the ring, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The lower 16 bits of each coordinate of the circulant MinHash of a set."""
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    place = _place(hashes)
    for k in range(0, len(place), SHIFTED):
        np.minimum(least, _around(place[None, k : k + SHIFTED] - shift).min(axis=1), out=least)
    return least.astype("<u2")


def signatures(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The kept columns, n_shingles, and of sets that aren't empty: same (16 bytes that equal sets share) and sig."""

    def run(texts: list) -> list:
        n, same, sig = [], [], []
        for t in texts:
            s = shingle_set(t)
            n.append(len(s))
            same.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        return [n, same, sig]

    return map_texts(docs, keep, text_col, run, "n_shingles long, same binary, sig binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """band, key, cls, n for every band of a class that shares its bucket, and least: the bucket's smallest class."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("sig", 1 + width * b, width)) for b in range(BANDS)])
    rows = classes.select("cls", "n", F.posexplode(keys).alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("many"), F.min("cls").alias("least")).where("many > 1")
    return rows.join(shared, ["band", "key"])


def _sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, hashes: the shingle set of every class, read again from the text of one of its rows."""
    wanted = classes.select("cls", "id", "h1", "h2")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *text_key(text_col))
    found = rows.join(wanted, F.col("doc").eqNullSafe(F.col("id")) & (rows["h1"] == wanted["h1"]) & (rows["h2"] == wanted["h2"])).select("cls", "text")

    def run(texts: list) -> list:
        return [[shingle_set(t).view(np.int64) for t in texts]]

    return map_texts(found, ("cls",), "text", run, "hashes array<long>").dropDuplicates(["cls"])


def text_key(text_col: str) -> tuple[Column, Column]:
    text = text_of(F.col(text_col))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` of their union."""
    left, right = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fit(n: str, m: str, percent: int) -> Column:
    """Sizes that leave room for a link: the smaller set lies whole in the larger one at best."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _by_class(rows: DataFrame, same: tuple[str, ...], each: tuple[str, ...]) -> DataFrame:
    """One row for each class: columns that its rows share, and the others as a list ``each``, for joins by class.

    A class has a row for each of its bands or tables, and for each unit of these, so the lists are short.
    """
    return rows.groupBy("cls").agg(*[F.first(c).alias(c) for c in same], F.collect_list(F.struct(*each)).alias("each"))


def _open(buckets: DataFrame, rooted: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: band, key, cls, root, main (the root of the most shingles), and
    in how many chunks the bucket's members (targets) and those outside its main component (probes) are dealt."""
    rows = checkpointed(_by_class(buckets.where("many > 2"), ("n",), ("band", "key")).join(rooted, "cls")).select("cls", "n", "root", F.inline("each"))
    parts = rows.groupBy("band", "key", "root").agg(F.sum("n").alias("part"))
    state = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("roots"), F.sum("part").alias("all"), F.max(F.struct("part", "root")).alias("top")).where("roots > 1")
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / UNIT))
    state = state.select("band", "key", F.col("top.root").alias("main"), chunks(F.col("all")).alias("targets"), chunks(F.col("all") - F.col("top.part")).alias("probes"))
    return rows.join(state, ["band", "key"])


def _inside(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components inside open buckets, a spanning forest of those of a unit.

    A bucket's members outside its main component are probes, and all its members are targets; both are dealt into
    chunks of about UNIT shingles, and each pair of chunks is a unit, which compares whole sets. Several units share a task.
    """
    mine = lambda k: F.pmod(F.xxhash64(F.lit(k), "cls"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    to = members.select("band", "key", "cls", "n", "root", F.lit(False).alias("probe"), mine("targets").alias("t"), every("probes").alias("p"))
    out = members.where("root <> main").select("band", "key", "cls", "n", "root", F.lit(True).alias("probe"), mine("probes").alias("p"), every("targets").alias("t"))
    units = _by_class(to.unionByName(out).select("cls", "root", "probe", F.xxhash64("band", "key", "t", "p").alias("unit")), ("root",), ("probe", "unit"))
    mass = members.agg(F.sum("n")).first()[0] or 0
    cells = max(1, math.ceil(mass / CELL))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "probe"], kind="stable")
        unit, probe, cls, root = (pdf[c].to_numpy() for c in ("unit", "probe", "cls", "root"))
        hashes = pdf["hashes"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        found: list[tuple[int, int]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first = lo + int(np.searchsorted(probe[lo:hi], True))
            if lo < first < hi:
                found += [(int(cls[a]), int(cls[b])) for a, b in _forest(hashes[lo:hi], first - lo, root[lo:hi], percent) + lo]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = units.join(sets, "cls").select("cls", "root", "hashes", F.inline("each")).withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(cells)))
    return rows.groupBy("cell").applyInPandas(walk, "a long, b long")


def _forest(hashes: np.ndarray, first: int, root: np.ndarray, percent: int) -> np.ndarray:
    """Links of the sets from ``first`` on with those before, one for each two components that they join."""
    sizes = np.array([len(h) for h in hashes])
    ids = np.unique(np.concatenate(list(hashes)), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    flat, begins = ids[: ends[first - 1]], (ends - sizes)[:first]
    label = np.unique(root, return_inverse=True)[1]
    mark = np.zeros(ids.max() + 1, np.int64)
    found = []
    for i in range(first, len(hashes)):
        others = label[:first] != label[i]
        if not others.any():
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], begins)
        mark[own] = 0
        near = np.flatnonzero(others & (100 * common >= percent * (sizes[:first] + sizes[i] - common)))
        for j in near[np.unique(label[near], return_index=True)[1]]:
            found.append((i, j))
            label[label == label[j]] = label[i]
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and kept for every row; see the module for what is defined."""
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *text_key(text_col))
    prints = checkpointed(signatures(keyed, ("id", "h1", "h2"), "text"))
    one = F.min(F.struct("id", "h1", "h2")).alias("row")
    classes = prints.where("n_shingles > 0").groupBy("same").agg(F.min("id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), one)
    classes = checkpointed(classes.select("same", "least_id", "n", "sig", "row.*"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())  # of stored partitions: the same at each reading
    roots = class_roots(docs, classes, _buckets(classes), id_col, text_col, percent)
    rooted = classes.join(roots, classes["cls"] == roots["node"], "left").select("same", "least_id", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select("same", "component_id")
    joined = prints.select("id", "n_shingles", "same").join(found, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def class_roots(docs: DataFrame, classes: DataFrame, buckets: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """node, root of the classes (cls, n, and a row's id, h1, h2) that have a link with another class of a bucket."""
    buckets = checkpointed(buckets)
    members = buckets.select("cls").distinct()
    sets = checkpointed(_sets(docs, classes.join(members, "cls"), id_col, text_col))
    sizes = classes.select(F.col("cls").alias("least"), F.col("n").alias("m"))
    tried = buckets.where("cls <> least").select("cls", "n", "least").distinct().join(sizes, "least").where(_fit("n", "m", percent))
    tried = checkpointed(_ordered(tried.select(F.col("cls").alias("a"), F.col("least").alias("b"))))
    links = checkpointed(_confirmed(tried, sets, percent))
    roots = components(links)
    rooted = members.join(roots, members["cls"] == roots["node"], "left").select("cls", F.coalesce("root", "cls").alias("root"))
    more = checkpointed(_inside(checkpointed(_open(buckets, rooted)), sets, percent))
    return roots if more.isEmpty() else components(links.union(more))


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s
  FROM texts
), classes AS (
  SELECT s, row_number() OVER () AS c, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)
), items AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, a.n, b.c, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT reach.a AS c, min(sets.doc_id) AS component_id FROM reach JOIN classes ON classes.c = reach.b JOIN sets ON sets.s = classes.s GROUP BY 1
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM (CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least ON least.c = classes.c
"""
