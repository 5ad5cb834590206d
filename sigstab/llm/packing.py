"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin fills whole bins first; its last piece, like any shorter document, is packed best-fit in
order of falling size. Open bins are kept in order of their residual and carry bitmaps of their sources and duplicate
clusters. The search starts at the smallest residual that holds the piece and goes on through its successors until the
tightest compatible bin is found. A bin never holds two pieces of one duplicate cluster, nor more than ``per_source``
pieces of one source; a piece that no open bin can take opens one.

Documents are dealt to shards by a hash of their id, so a source or cluster with a third of all rows spreads over all
shards. The number of shards follows the total of words, so a shard holds about SHARD_BINS bins at any size. Only
ids, sizes, sources and clusters are shuffled.

Defined results: a document without words (null texts too) gets one row with piece 0, no words and a null bin; null
clusters never conflict; null sources count as one source; repeated rows are packed each on its own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, n_words, text_of, words

CAPACITY, PER_SOURCE, SHARD_BINS = 2048, 4, 256
#: A word with the white space before it; the last one with what follows it, too.
SPACED = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\Z)?")


def best_fit(items: list[tuple[int, int | None, object]], capacity: int, per_source: int) -> list[tuple[int, int, int, int]]:
    """Pack (words, cluster, source) in the given order; returns (item, start, words, bin) for every piece."""
    bit_of: dict = {}
    seen: dict = {}
    for _, cluster, _ in items:
        if cluster is not None:
            seen[cluster] = seen.get(cluster, 0) + 1
    bins: list[tuple[int, int]] = []  # (residual, bin), in order
    clusters: list[int] = []
    sources: list[list[int]] = []  # level k has the sources with more than k pieces
    out = []

    def put(b: int, cluster: int, source: int) -> None:
        clusters[b] |= cluster
        for k in range(per_source):
            if not sources[b][k] & source:
                sources[b][k] |= source
                break

    def opened() -> int:
        clusters.append(0)
        sources.append([0] * per_source)
        return len(clusters) - 1

    rest = []
    for k, (size, cluster, source) in enumerate(items):
        for start in range(0, size - size % capacity, capacity):
            out.append((k, start, capacity, opened()))
        if size % capacity:
            c = 0 if cluster is None or seen[cluster] < 2 else 1 << bit_of.setdefault(("c", cluster), len(bit_of))
            s = 1 << bit_of.setdefault(("s", source), len(bit_of))
            rest.append((size % capacity, k, c, s))
    rest.sort(key=lambda x: -x[0])
    for size, k, c, s in rest:
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (clusters[b := bins[at][1]] & c or sources[b][-1] & s):
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, opened()
        put(b, c, s)
        out.append((k, items[k][0] - size, size, b))
        if left > size:
            insort(bins, (left - size, b))
    return out


def with_sizes(docs: DataFrame, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """id, source, size in words, cluster (a hash of the words in lower case, alike for exact copies), and the text if asked for."""
    return docs.select(id_col, "source", words(F.col("text")).alias("_w"), *[text_of(F.col("text")).alias("text")] * with_text).select(
        id_col, "source", F.size("_w").cast("long").alias("size"), F.when(F.size("_w") > 0, F.xxhash64(F.lower(F.array_join("_w", " ")))).alias("cluster"), *["text"] * with_text
    )


def pack(sized: DataFrame, total_words: int, capacity: int = CAPACITY, per_source: int = PER_SOURCE, id_col: str = "doc_id") -> DataFrame:
    """id, piece, start_word, n_words, bin_id, slot, bin_words for (id, source, size, cluster); with a column text, the pieces' texts too.

    A piece keeps the white space before each of its words, and a document's last piece what follows its last word.
    """
    shards = max(1, math.ceil(total_words / (capacity * SHARD_BINS)))
    kind, with_text = sized.schema[id_col].dataType.simpleString(), "text" in sized.columns

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k", "cluster", "source"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        cluster = [None if c is None else int(c) for c in pdf["cluster"]]
        got = best_fit(list(zip(pdf["size"].astype(int), cluster, pdf["source"], strict=True)), capacity, per_source)
        made = pd.DataFrame(got, columns=["item", "start_word", "n_words", "bin"], dtype="int64").sort_values(["bin", "start_word", "item"], kind="stable")
        made["slot"] = made.groupby("bin").cumcount()
        made["bin_words"] = made.groupby("bin")["n_words"].transform("sum")
        made["bin_id"] = int(key[0]) * (1 << 24) + made["bin"]
        made["piece"] = made["start_word"] // capacity
        made["k"] = pdf["k"].to_numpy()[made["item"]]
        out = made[["k", "piece", "start_word", "n_words", "bin_id", "slot", "bin_words"]]
        if with_text:
            spaced = {i: SPACED.findall(pdf["text"][i]) for i in made["item"][made["piece"] > 0].unique()}
            out = out.assign(text=["".join(spaced[i][a : a + n]) if i in spaced else pdf["text"][i] for i, a, n in zip(made["item"], made["start_word"], made["n_words"], strict=True)])
        return out

    # ids and clusters pass pandas as text: a column with nulls would become floating point there
    fields = "k string, piece long, start_word long, n_words long, bin_id long, slot long, bin_words long" + ", text string" * with_text
    texts = ["text"] * with_text
    packed = (
        sized.where("size > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), id_col, "size"), F.lit(shards)))
        .select("shard", F.col(id_col).cast("string").alias("k"), "source", "size", F.col("cluster").cast("string").alias("cluster"), *texts)
        .groupBy("shard").applyInPandas(fill, fields)
    )
    none = F.lit(None).cast("long")
    empty = sized.where("size = 0").select(F.col(id_col), *[F.lit(0).cast("long").alias(c) for c in ("piece", "start_word", "n_words")], *[none.alias(c) for c in ("bin_id", "slot", "bin_words")], *texts)
    return packed.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", id_col).unionByName(empty)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Pack a table of documents; without texts, sizes are measured once and checkpointed."""
    total = lambda df: df.agg(F.sum("size")).first()[0] or 0
    if with_text:
        return pack(with_sizes(docs, id_col, True), total(docs.select(n_words(F.col("text")).alias("size"))), capacity, per_source, id_col)
    sized = checkpointed(with_sizes(docs, id_col))
    return pack(sized, total(sized), capacity, per_source, id_col)
