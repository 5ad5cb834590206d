import math
import random

from pyspark.sql import functions as F

from sigstab.llm import topk


def brute(rows, k):
    v = []
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, [math.floor(64 * c) for c in x]))
    out = []
    for q, x in v:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in v if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def searched(df, k=20):
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k).collect())


def test_random_vectors_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 25)
    rng = random.Random(5)
    rows = [(k, [float(rng.choice([-1, -0.5, 0, 0.25, 1])) for _ in range(5)]) for k in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0]), (320, [float("nan")] * 5), (340, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert searched(df) == brute(rows, 20)
    assert searched(df, 3) == brute(rows, 3)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (20, [0.0, 0.0])]
    assert searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 20)
    assert searched(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")) == []
    assert searched(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    assert searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 2048)]


def test_blocks_are_pruned_by_their_bounds(spark, monkeypatch):
    """Queries that point to one end need few of the blocks; the result stays exact."""
    monkeypatch.setattr(topk, "BLOCK", 10)
    rows = [(k, [k / 100, 1.0]) for k in range(400)]
    assert searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 20)
