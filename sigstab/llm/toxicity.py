"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. The lexicon is learned, not given: of the fitting part of a bounded sample of labelled training rows (SAMPLE of them
   at most, those with the smallest hash of their id), words and word beginnings that are far more frequent in toxic texts than in others,
   ranked by the likelihood ratio of the two rates.
2. One pass over every whole text makes the dense features: weighted lexicon densities, hits near words for the second
   person, capitals, punctuation, symbols, and words obfuscated by figures or symbols.
3. Boosted trees (MLlib) learn from the sample's fitting part, and an isotonic regression calibrates their probability
   on the sample's other part (remainder CALIBRATION), of which neither the lexicon nor the trees have seen a label.

Only rows with crc32(doc_id as text) mod 5 <> 0 are learned from. The labelled sample is bounded by SAMPLE, so it is
broadcast to the texts, and no text is shuffled; features are checkpointed, so texts are read twice.

Defined results: null and empty texts are scored like any other (by features of zero); a null id is never held out;
without labels of both classes the score is their share, or 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_bucket, map_texts

SAMPLE, LEXICON, LEAST, RATIO = 20_000, 400, 3, 5
FOLDS, CALIBRATION, TREES, DEPTH, SEED, NEAR = 5, 1, 20, 3, 5, 5
LETTERS = re.compile(r"[^\W\d_]+")
#: Fixed value: words for the person spoken to, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Fixed value: characters that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$!|*]+[^\W_]+")
BEGINNINGS = (4, 5, 6)
FEATURES = ("weight_density", "hits", "distinct_hits", "largest_weight", "beginning_density", "near_second_person", "second_person", "capitals", "exclamations", "symbols", "obfuscated", "obfuscated_hits", "words", "word_length")


def _entries(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]


def labelled(labels: DataFrame, label: str, learn, limit: int | None = None) -> DataFrame:
    """doc_id, y (0 or 1) of the labelled rows that ``learn`` allows, one for each id; the first ``limit`` by hash."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(limit) if limit else rows


def learn_lexicon(docs: DataFrame, sample: DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """At most LEXICON words and beginnings ("^...") with their log odds."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in it:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y)].update({e for w in set(LETTERS.findall((text or "").lower())) for e in _entries(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], names=["entry", "a", "b"])

    if not toxic or not clean:
        return {}
    part = lambda x, e: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / e)).otherwise(0.0)
    both = F.col("a") + F.col("b")
    counts = docs.join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = (
        counts.where((F.col("a") >= LEAST) & (F.col("a") / toxic > RATIO * F.col("b") / clean))
        .withColumn("ratio", part("a", both * toxic / (toxic + clean)) + part("b", both * clean / (toxic + clean)))
        .orderBy(F.desc("ratio"), "entry").limit(LEXICON)
    )
    return {r["entry"]: float(np.log((r["a"] + 0.5) / (toxic + 1)) - np.log((r["b"] + 0.5) / (clean + 1))) for r in top.collect()}


class _Measure:
    """The features of texts, for one lexicon; remembers the weights of words."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.known = lexicon, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = max((self.lexicon.get(e, 0.0) for e in _entries(word)), default=0.0)
        return got

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        if not text:
            return [0.0] * len(FEATURES)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lower = text.lower()
        words = LETTERS.findall(lower)
        counts = Counter(words)
        n, weight = max(1, len(words)), self.weight
        hits = {w: x for w in counts if (x := weight(w)) > 0}
        total = sum(counts[w] for w in hits)
        near = 0
        if hits:
            persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            places = [i for i, w in enumerate(words) if w in hits]
            if persons:
                k = np.searchsorted(persons, places)
                gap = np.minimum(np.abs(np.array(places) - np.array(persons)[np.minimum(k, len(persons) - 1)]), np.abs(np.array(places) - np.array(persons)[np.maximum(k - 1, 0)]))
                near = int((gap <= NEAR).sum())
        masked = OBFUSCATED.findall(lower)
        share = lambda mask: float(mask.sum()) / len(codes)
        return [
            sum(hits[w] * counts[w] for w in hits) / n, float(np.log1p(total)), float(len(hits)), max(hits.values(), default=0.0),
            sum(counts[w] for w in hits if w not in self.lexicon) / n, near / n, sum(counts[w] for w in SECOND_PERSON if w in counts) / n,
            share((codes >= 65) & (codes <= 90)), share(codes == 33), share(np.isin(codes, [35, 36, 37, 38, 42, 60, 62, 124])),
            len(masked) / n, float(sum(any(weight(x) > 0 for x in LETTERS.findall(m.translate(STANDS_FOR))) for m in masked)), float(np.log1p(n)), sum(map(len, words)) / n,
        ]


def features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """doc_id, x (array of FEATURES) for every row."""
    held: list[_Measure] = []

    def run(texts: list) -> list:
        if not held:
            held.append(_Measure(lexicon))
        return [[held[0](t) for t in texts]]

    return map_texts(docs, ("doc_id",), text_col, run, "x array<double>")


def calibrate(rows: DataFrame):
    """An isotonic regression of y on score (both doubles); equal scores, rounded to four digits, count as one row."""
    grouped = rows.groupBy(F.round("score", 4).alias("features")).agg(F.avg("y").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(grouped.coalesce(1))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    held_out = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    sample = checkpointed(labelled(labels, label, id_bucket(F.col("doc_id"), FOLDS) != 0, sample_rows))
    fitting = sample.where(id_bucket(F.col("doc_id"), FOLDS) != CALIBRATION)
    share = lambda df: df.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1))).first()
    (toxic, n), (fit_toxic, fit_n) = share(sample), share(fitting)
    x = checkpointed(features(docs.select("doc_id", "text"), learn_lexicon(docs.select("doc_id", "text"), fitting, fit_toxic, fit_n - fit_toxic)))
    known = checkpointed(x.where("doc_id is not null").join(F.broadcast(sample), "doc_id").withColumn("fold", id_bucket(F.col("doc_id"), FOLDS)).coalesce(4))
    fit, held = known.where(F.col("fold") != CALIBRATION), known.where(F.col("fold") == CALIBRATION)
    classes = lambda df: df.agg(F.count_distinct("y")).first()[0]
    if classes(fit) < 2:
        scored = x.withColumn("score", F.lit(float(toxic / n) if n else 0.0))
    else:
        vector = lambda df: df.withColumn("v", array_to_vector("x"))
        trees = GBTClassifier(labelCol="y", featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED).fit(vector(fit))
        raw = lambda df: trees.transform(vector(df)).withColumn("score", F.round(vector_to_array("probability")[1], 4))
        isotonic = calibrate(raw(held if classes(held) == 2 else fit).select("score", "y"))
        scored = isotonic.transform(raw(x).drop("prediction").withColumn("features", F.col("score"))).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
