import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sigstab.llm import mixing

from . import odd


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by source, None last: share by weight, and again without those that reached their cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, total, done = set(order), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(done.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= most * sizes[s]}
        if not full:
            return done | {s: weight[s] * level for s in left}
        done |= {s: float(most * sizes[s]) for s in full}
        left -= full
    return done


def check(docs):
    rows = mixing.decide(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert abs(taken[s] - want[s]) <= 1
        assert {r["source_size"] for r in rows if source[r["doc_id"]] == s} == {sizes[s]}
    assert len(rows) == docs.count()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.decide(docs.repartition(5)).collect()), key=repr)


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert mixing.decide(odd.empty(spark)).count() == 0


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(k, "", s, 0) for k, s in enumerate(["a", "b", None])], "doc_id long, text string, source string, n_chars long")
    assert [(r["taken"], r["target"]) for r in mixing.decide(docs).collect()] == [(0, 0.0)] * 3


def test_the_mix_holds_the_words_taken(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text")))).collect()}
    want = {r["doc_id"]: r["taken"] for r in mixing.decide(docs).collect() if r["taken"]}
    assert got == want
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_quotas_split_exactly_and_by_the_hypergeometric(spark):
    counts = {0: 500, 1: 30, 2: 7}
    quotas = spark.createDataFrame(list(counts.items()), "place int, draws long")
    sums = defaultdict(list)
    for seed in range(40):
        for r in mixing.split_quotas(quotas, 2, seed).collect():
            ends = r["ends"]
            assert len(ends) == 4 and ends == sorted(ends) and ends[-1] == counts[r["place"]]
            sums[r["place"]].append(ends[0])
    for place, first in sums.items():
        n, total = counts[place], sum(counts.values())
        share = n / total
        spread = math.sqrt(total / 4 * share * (1 - share) * 0.75)
        assert abs(sum(first) / len(first) - n / 4) < 4 * spread / math.sqrt(len(first))


def test_hypergeometric_inversion(spark):
    total, good, drawn, n = 20, 8, 6, 4000
    u = (F.col("id") + 0.5) / n
    got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u)).collect())
    for k in range(7):
        want = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn)
        assert abs(got[k] / n - want) < 2 / n
