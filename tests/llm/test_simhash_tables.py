"""SimHash tables against all pairs of five-word sets, and the share of links that the tables find."""

import random
from itertools import combinations

import numpy as np
import pytest

from sigstab.llm import minhash, simhash, simhash_tables

from . import odd
from .test_minhash import brute_set


def components(rows, percent=80):
    """rows: (id, text); the smallest id that each row reaches, by comparing all pairs; texts without words are alike."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash_tables.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(components(rows), key=repr)


def test_whole_table_against_all_pairs(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert simhash_tables.near_duplicates(odd.empty(spark)).count() == 0


def test_words_of_tables_differ_in_more_than_the_budget():
    words = simhash_tables.code_words()
    assert len(words) == simhash_tables.TABLES and max(words) < 1 << 16
    assert all((a ^ b).bit_count() > simhash_tables.BUDGET for a, b in combinations(words, 2))
    frame = np.packbits(simhash_tables._frame(), axis=1).view(">u8").ravel()
    assert all((int(a) ^ int(b)).bit_count() > simhash_tables.BUDGET for a, b in combinations(frame, 2))


def test_prints_against_single_bits():
    rng = np.random.default_rng(5)
    for n in (1, 2, 255, 256, 700):
        hashes = rng.integers(0, 2**63, n, dtype=np.uint64)
        bits = [[int(w) >> k & 1 for w in row for b in range(8) for k in range(8 * b + 7, 8 * b - 1, -1)] for row in simhash_tables._mixed(hashes)]
        majority = [int(2 * sum(col) > n) for col in zip(*bits, strict=True)]
        got = simhash_tables.prints(hashes, simhash_tables._frame())
        where = simhash_tables._places()[0]
        for t, p in enumerate(got):
            own = [int(p) % 2**64 >> (63 - int(k)) & 1 for k in where]
            assert own == majority[48 * t : 48 * t + 48]


@pytest.mark.parametrize("low, high, least", [(80, 82, 0.85), (82, 90, 0.95)])
def test_recall_by_similarity(low, high, least):
    """Pairs of sets of a given similarity meet in one of the tables within the budget."""
    rng = random.Random(low)
    frame, met = simhash_tables._frame(), []
    for _ in range(150):
        n = rng.randrange(150, 600)
        share = rng.uniform(low, high) / 100
        own = round(n * (1 - share) / (1 + share))
        hashes = np.array([rng.getrandbits(64) for _ in range(n + own)], np.uint64)
        a, b = simhash_tables.prints(hashes[:n], frame), simhash_tables.prints(hashes[own:], frame)
        met.append((np.bitwise_count((a ^ b).view(np.uint64)) <= simhash_tables.BUDGET).any())
    assert np.mean(met) >= least


def test_recall_on_a_larger_table(spark, small):
    """Links are links of whole sets, and nine in ten documents that MinHash links with an earlier one are found."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").where("trim(text) <> ''")
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent=80).collect()}
    got = {r["doc_id"]: r["component_id"] for r in simhash_tables.near_duplicates(docs).collect()}
    assert got.keys() == want.keys() and all(want[k] == want[got[k]] for k in got)
    linked = [k for k, v in want.items() if v != k]
    assert linked and sum(got[k] != k for k in linked) >= 0.9 * len(linked)


def test_deduplicate_keeps_one_row_of_each_component(spark):
    docs = odd.documents(spark)
    kept = simhash_tables.deduplicate(docs)
    assert kept.columns == docs.columns
    of = {r["doc_id"]: r["component_id"] for r in simhash_tables.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(of.values()))


def test_joins_by_class_make_a_row_for_each_class(spark, monkeypatch):
    """A family of near copies is in many tables; its sets and roots are joined once for each text, not once for each table."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in words) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, by_class = [], minhash._by_class

    def seen(rows, same, each):
        out = by_class(rows, same, each)
        made.append((rows.count(), out.count(), rows.select("cls").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "_by_class", seen)
    check(docs)
    assert len(made) == 2 and all(rows > 2 * out and out == classes for rows, out, classes in made)


def test_whole_rows_are_shuffled_once(spark, small):
    plan = simhash_tables.deduplicate(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" in plan
    assert "Exchange" not in plan[: plan.index("Join")]  # nothing is dealt again between the join and the window above it


def test_links_of_families_and_of_split_nodes(spark):
    """Prints alone and families around a root, with groups so small that nodes are split."""
    draw = random.Random(5)
    flip = lambda x, k: x ^ sum(1 << b for b in draw.sample(range(64), k))
    base = [draw.getrandbits(64) for _ in range(30)]
    values = {x for f in base for x in [f, *(flip(f, draw.randint(1, 3)) for _ in range(6))]} | {draw.getrandbits(16) | 7 << 48 for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = {x: x for x in values}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for x, y in combinations(sorted(values), 2):
        if (x ^ y).bit_count() <= simhash.BUDGET:
            near[find(x)] = find(y)
    for node in (4, simhash.NODE):
        fps = spark.createDataFrame([(signed(x),) for x in values], "fp long")
        edges = simhash.links(fps, node=node)
        got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        groups = {}
        for x in values:
            groups.setdefault(got.get(signed(x), signed(x)), set()).add(find(x))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(x) for x in values})
