import random
import re
from itertools import combinations

import xxhash

from sigstab.llm import simhash

from . import odd


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, print); the smallest id that each row reaches, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(rows)]


def check(docs):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)


def test_whole_table_against_all_pairs(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_documents(spark):
    check(odd.documents(spark))
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


def same_groups(spark, prints, node):
    """Links join the prints into the very groups that comparing all pairs gives."""
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), node=node).collect()
    label = {p: p for p in prints}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for e in edges:
        label[find(e["a"] % 2**64)] = find(e["b"] % 2**64)
    groups = {}
    for (_, _, c), p in zip(brute_components(list(enumerate(prints))), prints, strict=True):
        groups.setdefault(c, set()).add(find(p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({find(p) for p in prints}) == len(groups)
    return edges


def test_trie_links_against_all_pairs(spark):
    """Families of prints with 1 to 6 changed bits, and top nodes so small that links cross them."""
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(1, 12)):
            base ^= sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 7)))
            prints.add(base)
    same_groups(spark, sorted(prints), 16)
    same_groups(spark, sorted(prints), 1_000)


def test_a_hot_prefix_is_split(spark):
    """Most prints share the first bits, so their node is split, and links cross the parts."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(500):
        base = 0x1234 << 48 | rng.getrandbits(48)
        prints |= {base, base ^ sum(1 << k for k in rng.sample(range(48), rng.randrange(1, 5)))}
    same_groups(spark, sorted(prints), 32)


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 300).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, 301)}


def test_deduplicate_keeps_one_row_of_each_component(spark):
    docs = odd.documents(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({c for c in of.values()})
