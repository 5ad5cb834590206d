"""Audit of how far the sources of a language diverge in their words: exact sums over pairs of groups, split by weight.

Counts of (language, source, term) are summed in tasks before they are shuffled. A language's kept terms are dealt into
tiles by hash, and its sources into blocks, so a unit of work has a bounded number of terms and of sources. In a unit,
terms that many groups have (heavy) form a dense numpy matrix, whose columns are compared block by block. For rare terms
(light) the sum begins with the value that two groups without the term give; a posting adds what it changes against a
group without the term, summed over equal counts, and a pair of postings of the same term corrects the two. The partial
sums are whole numbers, so adding them up in any order is exact. Shares are whole too, by long division, so no product
exceeds 64 bits for totals below 9 * 10^15.

Defined results: null text, lang and source are ''; a group without kept terms has the share that a count of 0 gives;
languages without kept terms have pairs of value 0; a language with one source has no pairs; repeated rows count each;
an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Bytes that aren't part of a term; in UTF-8 all bytes of other characters are 0x80 and above.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: A term in a quarter of a language's groups is heavy.
HEAVY = 4
#: Terms of a tile and sources of a block, about; pairs of postings and cells of a matrix that are handled at once.
TILE, BLOCK, AT_ONCE = 2048, 256, 1_000_000
#: Counts that a task holds before it passes them on; texts over LONG bytes aren't split at once.
HELD, LONG = 400_000, 1_000_000
#: Groups that may be broadcast to the counts, at some 60 bytes a row; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
DOCUMENT = 1 << 40


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: partial counts of the tasks."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(told("lang").alias("lang"), told("source").alias("source"), told("text").cast("binary").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        entries = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text.lower()  # of bytes: A-Z only
                terms = Counter(TERM.findall(text) if len(text) <= LONG else (m[0] for m in TERM.finditer(text)))
                total = held.setdefault((lang, source), {})
                entries -= len(total)
                for t, n in terms.items():
                    total[t] = total.get(t, 0) + n + DOCUMENT
                entries += len(total)
                if entries >= HELD:
                    yield from passed(held)
                    held, entries = {}, 0
        yield from passed(held)

    def passed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), total in held.items():
            if total:
                both, m = np.fromiter(total.values(), np.int64, len(total)), len(total)
                term = pa.array(list(total), pa.binary()).cast(pa.string())
                group = [pa.repeat(x, m) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, term, pa.array(both % DOCUMENT), pa.array(both // DOCUMENT)], names=names)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n of the kept terms, with the term's all_n and groups in its language; first marks one row a term."""
    counts = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # as many rows as the language has sources, at most
    return (
        counts.withColumns({"all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term), "groups": F.count(F.lit(1)).over(term), "first": F.min("source").over(term)})
        .where(F.col("all_docs") >= min_docs)
        .select("lang", "source", "term", "n", "all_n", "groups", (F.col("first") == F.col("source")).alias("first"))
    )


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / total), by long division in three steps of a thousand."""
    whole = lambda r: F.call_function("div", r * 1000, total)
    first = n + 2
    second = first * 1000 % total
    third = second * 1000 % total
    return 1 + whole(first) * 1_000_000 + whole(second) * 1000 + whole(third)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for arrays; a total of 0 gives 0."""
    rest, out = n.astype(np.int64) + 2, np.zeros(np.broadcast(n, total).shape, np.int64)
    total = np.maximum(total, 1)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _unit(left: pd.DataFrame, right: pd.DataFrame, z: tuple[np.ndarray, np.ndarray], same: bool) -> np.ndarray:
    """By source of the left and of the right block: what the terms of a tile add to the value without any term.

    left, right: postings (term, at, n, p, heavy) with codes of terms and positions of sources; same: one block with itself.
    """
    zl, zr = z
    none = distances(zl[:, None], zr[None, :])
    out = np.zeros_like(none)
    dense = left["heavy"].to_numpy(bool), right["heavy"].to_numpy(bool)
    codes = np.unique(np.concatenate([left["term"].to_numpy()[dense[0]], right["term"].to_numpy()[dense[1]]]))
    step = max(1, AT_ONCE // max(1, len(zl), len(zr)))
    for k in range(0, len(codes), step):
        some = codes[k : k + step]
        tiles = []
        for rows, heavy, empty in ((left, dense[0], zl), (right, dense[1], zr)):
            tile = np.tile(empty, (len(some), 1))
            term = rows["term"].to_numpy()
            at = np.searchsorted(some, term)
            at[at == len(some)] = 0
            here = heavy & (some[at] == term)
            tile[at[here], rows["at"].to_numpy()[here]] = rows["p"].to_numpy()[here]
            tiles.append(tile)
        for a in range(len(zl)):
            b = a + 1 if same else 0
            out[a, b:] += distances(tiles[0][:, a, None], tiles[1][:, b:]).sum(axis=0) - len(some) * none[a, b:]

    light = [rows[~heavy].sort_values("term") for rows, heavy in zip((left, right), dense, strict=True)]
    for rows, other, turned in ((light[0], zr, False), (light[1], zl, True)):  # a posting against groups without the term
        alike = rows.groupby(["at", "p"]).size().reset_index(name="m")
        for at, part in alike.groupby("at"):
            gain = (distances(part["p"].to_numpy()[:, None], other) * part["m"].to_numpy()[:, None]).sum(axis=0)
            if turned:
                out[:, at] += gain - part["m"].sum() * none[:, at]
            else:
                out[at] += gain - part["m"].sum() * none[at]

    terms, begins, sizes = _runs(light[0]["term"].to_numpy())
    others, begins_r, sizes_r = _runs(light[1]["term"].to_numpy())
    _, i, j = np.intersect1d(terms, others, assume_unique=True, return_indices=True)
    begins, sizes, begins_r, sizes_r = begins[i], sizes[i], begins_r[j], sizes_r[j]
    made = np.cumsum(sizes * sizes_r)
    at, p = zip(*((x["at"].to_numpy(), x["p"].to_numpy()) for x in light), strict=True)
    lo = 0
    while lo < len(made):  # pairs of postings of one term, of whole terms at a time
        hi = max(lo + 1, int(np.searchsorted(made, (made[lo - 1] if lo else 0) + AT_ONCE, "right")))
        m = sizes[lo:hi] * sizes_r[lo:hi]
        of = np.repeat(np.arange(lo, hi), m)
        k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        x, y = begins[of] + k // sizes_r[of], begins_r[of] + k % sizes_r[of]
        if same:
            x, y = x[at[0][x] < at[1][y]], y[at[0][x] < at[1][y]]
        a, b, px, py = at[0][x], at[1][y], p[0][x], p[1][y]
        np.add.at(out, (a, b), distances(px, py) - distances(px, zr[b]) - distances(zl[a], py) + none[a, b])
        lo = hi
    return out


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted codes: the distinct ones, where they begin, and how many there are of each."""
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[begins], begins, np.diff(np.append(begins, len(codes)))


def _pairs(kept: DataFrame, groups: DataFrame, langs: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lang, a, b, value for every two sources a < b, or of different blocks in any order, of a language."""
    deal = langs.select("lang", "terms", "sources", F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE)).alias("tiles"), F.ceil(F.col("sources") / BLOCK).alias("blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    postings = kept.join(held(deal), "lang").select(
        "lang", "source", "term", "n", F.lit(0).cast("long").alias("terms"), (F.col("groups") * HEAVY >= F.col("sources")).alias("heavy"), F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "blocks", block
    )
    heads = groups.select("lang", "source", "n").join(held(deal), "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "n", "terms", F.lit(False).alias("heavy"), upto("tiles").alias("tile"), "blocks", block
    )
    rows = postings.unionByName(heads).select("*", upto("blocks").alias("_x"))
    rows = rows.withColumns({"lo": F.least("block", "_x"), "hi": F.greatest("block", "_x")}).drop("_x", "blocks")

    def unit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, tile, lo, hi = key
        is_head = pdf["term"].isna()
        head, body = pdf[is_head].sort_values("source"), pdf[~is_head]
        kept_terms = int(head["terms"].iloc[0])
        sides, z = [], []
        code = pd.Series(pd.factorize(body["term"])[0], body.index, dtype=np.int64)
        for side in (lo, hi):
            sources = head[head["block"] == side]
            total = sources["n"].to_numpy(np.int64) + 2 * kept_terms
            mine = body[body["block"] == side]
            at = np.searchsorted(sources["source"].to_numpy(object), mine["source"].to_numpy(object))
            n = mine["n"].to_numpy(np.int64)
            p = shares(n, total[at]) if len(n) else n
            sides.append(pd.DataFrame({"term": code[mine.index].to_numpy(), "at": at, "n": n, "p": p, "heavy": mine["heavy"].to_numpy(bool)}))
            z.append((sources["source"].to_numpy(object), shares(np.zeros_like(total), total)))
        same = lo == hi
        value = _unit(*sides, (z[0][1], z[1][1]), same)
        if tile == 0:
            value += kept_terms * distances(z[0][1][:, None], z[1][1][None, :])
        a, b = (x.ravel() for x in np.indices(value.shape))
        some = (a < b) if same else np.ones(len(a), bool)
        some &= (value.ravel() != 0) | (tile == 0)
        return pd.DataFrame({"lang": lang, "a": z[0][0][a[some]], "b": z[1][0][b[some]], "value": value.ravel()[some]})

    parts = rows.groupBy("lang", "tile", "lo", "hi").applyInPandas(unit, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources by divergence, and the ``top`` terms that stand out."""
    kept = checkpointed(kept_counts(docs, min_docs))
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    seen = docs.select(told("lang"), told("source")).distinct()
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    groups = checkpointed(seen.join(by_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(by_lang, "lang", "left").select("lang", "sources", zero("lang_n"), zero("terms"))
    langs = checkpointed(langs)
    held = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda df: df

    pairs = _pairs(kept, groups, langs, held)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    totals = groups.withColumnRenamed("n", "group_n").join(held(langs), "lang")
    p, q = share(F.col("n"), F.col("group_n") + 2 * F.col("terms")), share(F.col("all_n"), F.col("lang_n") + 2 * F.col("terms"))
    terms = kept.join(held(totals), ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return both.withColumn("rank", rank).select(*columns("pair")).union(terms.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns("term")))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10
), sizes AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY 1
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), cells AS (
  SELECT lang, source, term, coalesce(c, 0) AS c FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM cells GROUP BY 1, 2) JOIN sizes USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (
  SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
) WHERE rank <= 10
"""
