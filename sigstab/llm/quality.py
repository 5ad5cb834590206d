"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. One pass over every whole text makes its statistics (STATISTICS); they are checkpointed, so texts are read once.
2. Statistics are standardised and mapped to random Fourier features, whose inner products approximate a Gaussian
   kernel.
3. Each partition of the labelled rows sums its part of the normal equations; parts are added by row of the matrix on
   the cluster, and the driver solves one system of FOURIER + 1 unknowns, whatever the input's size.
4. An isotonic regression calibrates the ridge score on labelled rows that the fit didn't see.

Labels are learned from rows with crc32(doc_id as text) mod 4 <> 2 only: 0 and 1 fit, 3 calibrates.

Defined results: null and empty texts are scored like any other (by statistics of zero); a null id is never held out;
without labels every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_bucket, map_texts
from .toxicity import calibrate, labelled

FOLDS, HELD, CALIBRATE, FOURIER, RIDGE, SEED = 4, 2, 3, 256, 1e-3, 23
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "capitals", "digits", "symbols", "punctuation", "exclamations", "line_breaks",
    "distinct_words", "commonest_word", "word_pairs_alike", "repeated_windows", "duplicate_lines", "line_words", "sentence_words", "bars",
)
SYMBOLS, MARKS = np.array([ord(c) for c in "#*$%&<>@^~=_+\\{}[]"], np.uint32), np.array([ord(c) for c in ".,;:?'\"()-"], np.uint32)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.bincount(np.minimum(codes, 128), minlength=129)
    n, chars = len(words), len(codes)
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    share = lambda k: float(table[k].sum()) / chars
    return [
        np.log1p(chars), np.log1p(n), float(lengths.mean()), float(lengths.std()), float(table[65:91].sum()) / chars, float(table[48:58].sum()) / chars, share(SYMBOLS), share(MARKS), share([33]), share([10]),
        len(counts) / n, counts.most_common(1)[0][1] / n, sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(windows)) / max(1, len(windows)) if windows else 0.0, 1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), np.log1p(n / (1 + table[46] + table[63] + table[33])), share([124]),
    ]


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], FOURIER)) / np.sqrt(x.shape[1])
    z = np.sqrt(2 / FOURIER) * np.cos(np.clip((x - mean) / spread, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FOURIER))
    return np.hstack([z, np.ones((len(x), 1))])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def normal_equations(known: DataFrame, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over (x, y): added up in each partition, then by row of the matrix on the cluster."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FOURIER + 1, FOURIER + 2))
        for b in it:
            z = fourier(_rows(b.column(0)), mean, spread)
            a += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(FOURIER + 1), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], names=["i", "a"])

    add = lambda pdf: pd.DataFrame({"i": pdf["i"][:1], "a": [np.sum(np.stack(pdf["a"].tolist()), axis=0)]})
    found = known.select("x", "y").mapInArrow(parts, "i int, a array<double>").groupBy("i").applyInPandas(add, "i int, a array<double>").orderBy("i").collect()
    a = np.array([r["a"] for r in found])
    return a[:, :-1], a[:, -1]


def _scored(x: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, steps: tuple | None = None) -> DataFrame:
    """All columns but x, and score: the ridge score, or its isotonic value by ``steps`` (scores, values)."""
    rest = [c for c in x.columns if c != "x"]
    schema = ", ".join([f"`{c}` {x.schema[c].dataType.simpleString()}" for c in rest] + ["score double"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = fourier(_rows(b.column(b.num_columns - 1)), mean, spread) @ weights
            s = s if steps is None else np.clip(np.interp(s, *steps), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*rest, "score"])

    return x.select(*rest, "x").mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    bucket = id_bucket(F.col("doc_id"), FOLDS)
    x = checkpointed(map_texts(docs, ("doc_id",), "text", lambda texts: [[statistics(t) for t in texts]], "x array<double>"))
    known = checkpointed(x.where("doc_id is not null").join(labelled(labels, label, bucket != HELD), "doc_id").select("x", "y", bucket.alias("fold")))
    held = known.where(F.col("fold") == CALIBRATE)
    fit = known.where(F.col("fold") != CALIBRATE)
    n = fit.count()
    if not n:
        scored = x.withColumn("score", F.lit(0.5))
    else:
        each = x.agg(*[f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(len(STATISTICS))]).first()
        mean, spread = np.array(each[: len(STATISTICS)]), np.maximum(np.array(each[len(STATISTICS) :]), 1e-9)
        a, b = normal_equations(fit, mean, spread)
        weights = np.linalg.solve(a + RIDGE * n / FOURIER * np.eye(len(a)), b)
        isotonic = calibrate(_scored(held if held.count() else fit, mean, spread, weights))
        steps = (np.array(isotonic.boundaries.toArray()), np.array(isotonic.predictions.toArray()))
        scored = _scored(x, mean, spread, weights, steps)
    return scored.select("doc_id", F.coalesce(bucket == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
