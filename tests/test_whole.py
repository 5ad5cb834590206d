"""Queries and operators over the whole matrix, against brute force on the smallest tables."""

import re
from collections import Counter

import numpy as np
import pytest

from sigstab import catalog
from sigstab.operators import evaluate, resample, signatures, stats, trees


@pytest.fixture(scope="module")
def cells(spark, small):
    """ids, classes and values of all embeddings."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["label"] % 3 for r in rows]), np.array([r["embedding"] for r in rows], float)


def test_distances_of_all_pairs(spark, small, cells, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 100)
    ids, _, x = cells
    got = {(r["a"], r["b"]): r["d"] for r in catalog.QUERIES["sample_distance_pairs_whole"](spark, small).collect()}
    assert len(got) == len(ids) * (len(ids) - 1) // 2
    for i in range(len(ids)):
        want = np.sqrt(((x[i] - x[i + 1 :]) ** 2).sum(1))
        assert [got[(ids[i], j)] for j in ids[i + 1 :]] == pytest.approx(list(want), abs=2e-6)


def test_distances_over_shared_features(spark):
    rows = [(1, "a", 0.0), (1, "b", 0.0), (2, "a", 3.0), (3, "b", 4.0), (4, "a", 3.0), (4, "b", 4.0)]
    got = {(r["a"], r["b"]): r["d"] for r in stats.distances(spark.createDataFrame(rows, "sample_id long, feature string, value double")).collect()}
    assert got == {(1, 2): 3.0, (1, 3): 4.0, (1, 4): 5.0, (2, 4): 0.0, (3, 4): 0.0}


def test_distances_send_few_copies(spark, monkeypatch):
    """As many blocks as give work to all, and no more: a sample is copied once for each block."""
    for name, value in (("BLOCK", 10), ("SOME", 3), ("MANY", 80), ("AT_ONCE", 50), ("NEAR_BY", 64)):
        monkeypatch.setattr(stats, name, value)
    x = np.random.default_rng(1).normal(size=(300, 3))
    obs = spark.createDataFrame([(i, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "sample_id long, feature string, value double")
    assert stats._packed(obs)[1] == 4  # 30 blocks of 10 samples before
    got = {(r["a"], r["b"]): r["d"] for r in stats.distances(obs).collect()}
    want = {(i, j): float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i in range(300) for j in range(i + 1, 300)}
    assert got.keys() == want.keys() and all(abs(got[k] - d) < 1e-12 for k, d in want.items())


def test_leave_one_out_of_all_samples(spark, small, cells):
    ids, y, x = cells
    got = {r["sample_id"]: r["y_pred"] for r in catalog.QUERIES["leave_one_out_centroid_whole"](spark, small).collect()}
    assert got.keys() == set(ids)
    for i, s in enumerate(ids):
        keep = np.arange(len(ids)) != i
        sd = x[keep].std(0)
        d = [round(float((((x[i] - x[keep & (y == c)].mean(0)) / sd) ** 2).sum()), 9) for c in range(3)]
        assert got[s] == int(np.argmin(d)), s


def test_leave_one_out_as_splits(spark):
    rows = [(s, "AB"[s % 2], s % 2, f, float(v)) for s in range(7) for f, v in (("p", s * s % 5), ("q", 1.0 if s else 9.0))]
    obs = spark.createDataFrame(rows, "sample_id long, label string, y int, feature string, value double")
    want = evaluate.predict_all(evaluate.feature_distances(obs, resample.leave_one_out(resample.samples_of(obs)))).drop("split")
    assert sorted(map(tuple, evaluate.leave_one_out(obs).collect())) == sorted(map(tuple, want.select("sample_id", "y_true", "y_pred").collect()))


def test_smote_fills_every_class(spark, small, cells):
    ids, y, x = cells
    rows = catalog.QUERIES["smote_oversample_whole"](spark, small).collect()
    made = {}
    for r in rows:
        made.setdefault((r["label"], r["new_id"]), {})[r["feature"]] = r["value"]
    sizes = Counter(f"c{c}" for c in y)
    most = max(sizes.values())
    assert Counter(c for c, _ in made) == {c: most - n for c, n in sizes.items() if n < most}
    assert all(len(v) == x.shape[1] for v in made.values())
    for (c, _), v in list(made.items())[:10]:  # each is on the way from a sample to one of its five nearest
        p, own = np.array([v[f"f{k:02d}"] for k in range(x.shape[1])]), x[y == int(c[1:])]
        ok = False
        for a in own:
            near = own[np.argsort(((own - a) ** 2).sum(1))[1:6]]
            t = ((p - a) * (near - a)).sum(1) / ((near - a) ** 2).sum(1)
            ok |= bool((np.abs(a + t[:, None] * (near - a) - p).max(1) < 1e-5).any())
        assert ok


def test_smote_of_a_class_with_few_neighbours(spark):
    rows = [(s, "A" if s < 3 else "B", "p", float(s)) for s in range(20)]
    assert resample.smote_to_majority(spark.createDataFrame(rows, "sample_id long, label string, feature string, value double")).count() == 14


def paths(tree):
    """Distances between the leaves of a Newick text."""
    at, up, length, node, n = {}, {0: None}, {0: 0.0}, 0, 1
    for token in re.findall(r"[(),;]|[^(),:;]+|:[0-9.]+", tree):
        if token == "(":
            up[n], length[n] = node, 0.0
            node, n = n, n + 1
        elif token == ",":
            up[n], length[n] = up[node], 0.0
            node, n = n, n + 1
        elif token == ")":
            node = up[node]
        elif token[0] == ":":
            length[node] = float(token[1:])
        elif token != ";":
            at[token] = node

    def above(x):
        out, total = {}, 0.0
        while x is not None:
            out[x] = total
            total, x = total + length[x], up[x]
        return out

    chains = {k: above(v) for k, v in at.items()}
    return {(a, b): min(chains[a][x] + chains[b][x] for x in chains[a].keys() & chains[b].keys()) for a in at for b in at if a < b}


def test_line_tree_is_the_neighbour_joining_tree():
    v = np.array([3.0, -1.0, 3.0, 7.5, 0.25, 2.0, 9.0])
    names = list("abcdefg")
    full = trees.midpoint_newick(trees.neighbour_joining(np.abs(v[:, None] - v[None, :]), names), names)
    assert paths(trees.line_newick(v, names)) == pytest.approx(paths(full), abs=1e-5)
    assert paths(trees.line_newick(np.ones(4), names[:4])) == {(a, b): 0.0 for a in "abcd" for b in "abcd" if a < b}


def test_trees_of_all_samples(spark, small, cells):
    ids, _, x = cells
    got = {r["feature"]: r for r in catalog.QUERIES["nj_trees"](spark, small).collect()}
    assert len(got) == x.shape[1] and {r["n"] for r in got.values()} == {len(ids)}
    assert set(re.findall(r"[(,]([0-9]+):", got["f00"]["tree"])) == set(map(str, ids))


def test_expansion_of_every_signature(spark, small):
    from sigstab import queries

    made = catalog.QUERIES["signature_corr_expand_whole"](spark, small).collect()
    unique = {r["sig_id"]: r["genes"] for r in signatures.catalogue(signatures.prefixes(queries.ranked_of(spark, small), 5)).collect()}
    groups = {r["kept"]: r["dropped"] for r in queries.corr_groups(spark, small).collect()}
    assert {r["sig_id"] for r in made} == unique.keys() and max(len(g) for g in unique.values()) == 5
    ways = {}
    for sig, genes in unique.items():
        found = {()}
        for g in genes:
            found = {(*w, o) for w in found for o in (g, *(groups.get(g) or []))}
        ways[sig] = len({tuple(sorted(w)) for w in found})
    assert Counter(r["sig_id"] for r in made) == ways
