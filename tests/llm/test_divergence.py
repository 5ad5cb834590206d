import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.llm import divergence

from . import odd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=10):
    """rows: (text, lang, source); the audit with Python's whole numbers, cell by cell."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        p = {}
        for s in sources:
            total = sum(count[lang, s][t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 2) // total for t in kept}
        total = sum(whole.values()) + 2 * len(kept)
        q = {t: 1 + 10**9 * (whole[t] + 2) // total for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def check(docs, min_docs=10):
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    got = divergence.audit(docs, min_docs).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, min_docs)


def test_whole_table_against_whole_numbers(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


@pytest.mark.parametrize("min_docs", [1, 3, 100])
def test_odd_documents(spark, min_docs):
    check(odd.documents(spark), min_docs)
    assert divergence.audit(odd.empty(spark), min_docs).count() == 0


@pytest.mark.parametrize(("tile", "block", "heavy", "held"), [(7, 3, 4, 20), (50, 100, 1000, 10**6), (50, 4, 1, 100), (5, 2, 2, 10**6)])
def test_tiles_blocks_and_weights(spark, monkeypatch, tile, block, heavy, held):
    """Any cut into tiles and blocks, all terms light, all heavy, and both, give the same."""
    rng, rows = random.Random(tile), []
    for k in range(400):
        text = " ".join(rng.choice("äbcdéfghij") * rng.randrange(1, 5) + rng.choice("xyzXYZ") for _ in range(rng.randrange(0, 12)))
        rows.append((k, text, rng.choice(["en", "en", None, "de"]), rng.choice([*"abcdefghi", None])))
    rows.append((400, "lonely words", "fr", "a"))
    rows += [(401, "", "en", "no terms at all")]
    for name, value in (("TILE", tile), ("BLOCK", block), ("HEAVY", heavy), ("HELD", held), ("AT_ONCE", 30)):
        monkeypatch.setattr(divergence, name, value)
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), 3)


def test_more_groups_than_may_be_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    check(spark.read.parquet(f"{small}/documents.parquet").limit(60), 2)


def test_long_texts_count_alike(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LONG", 3)
    check(odd.documents(spark), 2)


def test_shares_are_exact_beyond_double_precision(spark):
    rng = random.Random(1)
    cases = [(0, 2), (0, 9 * 10**15 - 1)] + [(n := rng.randrange(10 ** rng.randrange(1, 16)), n + 2 + rng.randrange(10 ** rng.randrange(1, 15))) for _ in range(300)]
    exact = [1 + 10**9 * (n + 2) // t for n, t in cases]
    n, t = (np.array(x, np.int64) for x in zip(*cases, strict=True))
    assert divergence.shares(n, t).tolist() == exact
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n long, t long")
    assert [r["p"] for r in rows.select("k", divergence.share(F.col("n"), F.col("t")).alias("p")).orderBy("k").collect()] == exact
