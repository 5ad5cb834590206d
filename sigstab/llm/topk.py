"""Exact top-k search by inner product, block at a time.

Vectors become whole numbers and are laid out in document-range blocks of about BLOCK vectors (BLOCKS at most), each a
partition; a block's index is its vectors. A block's bound for a query is the sum over terms of the query's weight times
the block's largest value of the term (its smallest, for a negative weight). Each query takes its blocks in the order of
their bounds, in rounds of 1, 4, 16, ... blocks; after a round its kth score is known, and it stops as soon as the next
bound is below that. Bounds equal to the kth score are still scored, because ties go to smaller ids. Nothing is estimated.

What is collected and sent along is the table of bounds, BLOCKS rows at most. Queries of a block are scored QUERIES at a
time, with a matrix product.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids;
shorter vectors count as filled up with zeros; a query's own row, and any with the same id, isn't its candidate; of
repeated query ids the least vector asks; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

SCALE, K, BLOCK, BLOCKS, QUERIES = 64, 20, 2048, 1024, 4096


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as double; null for a vector that takes no part."""
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when((F.size(embedding) > 0) & fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    if len({len(x) for x in column} | {width}) == 1:
        return np.stack(list(column)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    for row, x in zip(out, column, strict=True):
        row[: len(x)] = x
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ c.T


def block_top(queries: np.ndarray, ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, vec_id) of each query's k best in a block, if not below ``least``; ``vec_ids`` must rise."""
    s = _products(queries, vectors)
    own = ids[:, None] == vec_ids[None, :]
    top = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s, own), axis=1)[:, :k] if s.shape[1] <= k or np.abs(s).max(initial=0) > 2**51 // s.shape[1] else None
    if top is None:
        key = np.where(own, -np.iinfo(np.int64).max, s * s.shape[1] - np.arange(s.shape[1]))
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    rows = np.repeat(np.arange(len(ids)), top.shape[1])
    cols = top.ravel()
    fine = ~own[rows, cols] & (s[rows, cols] >= least[rows])
    rows, cols = rows[fine], cols[fine]
    return ids[rows], s[rows, cols], vec_ids[cols]


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query, ties to smaller ids."""
    v = vectors.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null and vec_id is not null")
    v = checkpointed(v)
    n = max(1, v.count())
    parts = min(BLOCKS, math.ceil(n / BLOCK))
    blocks = checkpointed(v.drop("asks").repartitionByRange(parts, "vec_id").withColumn("block", F.spark_partition_id()))
    width = v.agg(F.max(F.size("v"))).first()[0] or 1

    def bounds(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for pdf in it:
            for block, rows in pdf.groupby("block"):
                m = _matrix(rows["v"], width)
                lo, hi, count = found.get(block, (m[0], m[0], 0))
                found[block] = [np.minimum(lo, m.min(axis=0)), np.maximum(hi, m.max(axis=0)), count + len(m)]
        if found:
            yield pd.DataFrame({"block": list(found), "lo": [x[0] for x in found.values()], "hi": [x[1] for x in found.values()]}, columns=["block", "lo", "hi"])

    table = blocks.mapInPandas(bounds, "block int, lo array<long>, hi array<long>").collect()
    names = np.array([r["block"] for r in table], np.int64)
    lo, hi = (np.array([r[c] for r in table], np.int64).reshape(len(table), width) for c in ("lo", "hi"))
    state = v.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")).withColumn("tops", F.array().cast("array<struct<score:bigint,vec_id:bigint>>"))
    state = checkpointed(state)
    chunks = max(1, math.ceil(state.count() / QUERIES))

    def next_blocks(first: int, many: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids, q = b.column(0).to_numpy(), b.column(1).to_pylist()
                kth = np.array([x if x is not None else np.iinfo(np.int64).min for x in b.column(2).to_pylist()], np.int64)
                m = _matrix(q, width) if len(q) else np.zeros((0, width), np.int64)
                bound = _products(np.maximum(m, 0), hi) + _products(np.minimum(m, 0), lo)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first : first + many]
                rows, cols = np.nonzero(np.take_along_axis(bound, order, axis=1) >= kth[:, None])
                at = names[order[rows, cols]]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids[rows], pa.int64()), pa.array([q[i] for i in rows], pa.list_(pa.int64())), pa.array(kth[rows], pa.int64())], names=["block", "query_id", "q", "kth"])

        return run

    def score(key: tuple, asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "score": [], "vec_id": []}).astype("int64")
        block = block.sort_values("vec_id", kind="stable")
        got = block_top(_matrix(asked["q"], width), asked["query_id"].to_numpy(np.int64), asked["kth"].to_numpy(np.int64), _matrix(block["v"], width), block["vec_id"].to_numpy(np.int64), k)
        return pd.DataFrame(dict(zip(("query_id", "score", "vec_id"), got, strict=True)))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first, many = 0, 1
    while first < len(names):
        asked = state.select("query_id", "q", F.when(F.size("tops") >= k, F.col("tops")[k - 1]["score"]).alias("kth")).mapInArrow(next_blocks(first, many), "block int, query_id long, q array<long>, kth long")
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        in_chunks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        scored = asked.groupBy("block", "chunk").cogroup(in_chunks.groupBy("block", "chunk")).applyInPandas(score, "query_id long, score long, vec_id long")
        every = scored.unionByName(state.select("query_id", F.explode("tops").alias("t")).select("query_id", "t.score", "t.vec_id"))
        tops = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("t"))
        tops = tops.select("query_id", F.transform("t", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("tops"))
        state = checkpointed(state.drop("tops").join(tops, "query_id", "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<struct<score:bigint,vec_id:bigint>>"))))
        first, many = first + many, many * 4
    return state.select("query_id", F.posexplode("tops").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
