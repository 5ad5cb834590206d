import random
from collections import Counter, defaultdict

from sigstab.llm import packing

from . import odd


def naive(items, capacity, per_source):
    """Best-fit by looking at every open bin for every piece; residual, then bin number decide."""
    out, bins = [], []
    rest = []
    for k, (size, cluster, source) in enumerate(items):
        for start in range(0, size - size % capacity, capacity):
            out.append((k, start, capacity, len(bins)))
            bins.append([0, set(), Counter()])
        if size % capacity:
            rest.append((size % capacity, k, cluster, source))
    for size, k, cluster, source in sorted(rest, key=lambda x: -x[0]):
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= size and b[2][source] < per_source and (cluster is None or cluster not in b[1])]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append([capacity, set(), Counter()])
        bins[n][0] -= size
        bins[n][1].add(cluster)
        bins[n][2][source] += 1
        out.append((k, items[k][0] - size, size, n))
    return out


def test_best_fit_against_a_search_of_all_bins():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randrange(1, 90), rng.choice([None, *range(6)]), rng.choice("abc")) for _ in range(rng.randrange(0, 60))]
        assert packing.best_fit(items, 40, 2) == naive(items, 40, 2)


def check(docs):
    sized = {r["doc_id"]: r for r in packing.with_sizes(docs).collect()}
    rows = packing.pack_documents(docs).collect()
    spans, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start_word"], r["n_words"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    repeats = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert spans.keys() == sized.keys()
    for i, parts in spans.items():
        assert sum(n for _, n in parts) == repeats[i] * sized[i]["size"]
        if repeats[i] == 1:
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
    for held in bins.values():
        assert sum(r["n_words"] for r in held) == held[0]["bin_words"] <= packing.CAPACITY
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert max(Counter(sized[r["doc_id"]]["source"] for r in held).values()) <= packing.PER_SOURCE
        assert max(Counter(sized[r["doc_id"]]["cluster"] for r in held).values()) == 1
    assert all(r["n_words"] == 0 for r in rows if r["bin_id"] is None)


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert packing.pack_documents(odd.empty(spark)).count() == 0


def test_texts_of_pieces_join_to_the_text(spark):
    docs = odd.documents(spark).where("doc_id <> 3")
    parts = defaultdict(list)
    for r in packing.pack_documents(docs, with_text=True).collect():
        parts[r["doc_id"]].append((r["start_word"], r["text"]))
    for r in docs.collect():
        assert "".join(t for _, t in sorted(parts[r["doc_id"]])) == (r["text"] or "")
