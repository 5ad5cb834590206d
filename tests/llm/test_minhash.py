import random
import re
from itertools import combinations

import numpy as np
import pytest

from sigstab.llm import minhash

from . import odd


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows: (id, text); every pair of sets is compared."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), c, i == c) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)) for c in [least.get(find(k)) if s else i]]


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_whole_table_against_all_pairs(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert minhash.near_duplicates(odd.empty(spark)).count() == 0


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("unit", [minhash.UNIT, 500])
def test_families_of_all_similarities(spark, monkeypatch, unit):
    """One large family with many members that aren't linked with its leader, chains, and families just below the limit."""
    monkeypatch.setattr(minhash, "UNIT", unit)
    monkeypatch.setattr(minhash, "CELL", 4 * unit)
    rng, texts = random.Random(5), []
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for _ in range(150):
        texts.append(" ".join(edited(rng, base, rng.choice((0.002, 0.008, 0.015, 0.03)))))
    for _ in range(15):
        chain = [f"c{rng.randrange(5000)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(8):
            chain = edited(rng, chain, 0.02)
            texts.append(" ".join(chain))
    texts += rng.choices(texts, k=40)
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_more_classes_than_may_be_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    check(spark.read.parquet(f"{small}/documents.parquet").limit(120))


def test_a_long_text_is_hashed_in_parts(monkeypatch):
    whole = minhash.shingle_set(odd.LONG)
    monkeypatch.setattr(minhash, "HASHED", 7)
    assert np.array_equal(whole, minhash.shingle_set(odd.LONG))


def test_coordinates_estimate_the_similarity():
    """Agreeing coordinates of circulant signatures come near the similarity, over many pairs of sets."""
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        both, a, b = rng.integers(0, 2**63, 400, np.uint64), rng.integers(0, 2**63, 50, np.uint64), rng.integers(0, 2**63, 50, np.uint64)
        x, y = minhash.signature(np.concatenate([both, a])), minhash.signature(np.concatenate([both, b]))
        errors.append((x == y).mean() - 400 / 500)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_shifting_is_a_bijection():
    x = np.arange(2**16, dtype=np.uint32) * np.uint32(65_537)
    assert len(np.unique(minhash._around(x.copy()))) == len(x)
