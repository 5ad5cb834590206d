"""Trees of all samples, trees by direction, orders of cluster maps, ways to exchange correlates, and the optional import."""

import math
import os
import re
import subprocess
import sys
import time
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from sigstab import catalog
from sigstab.operators import scaling, signatures, stats, trees

from .test_models import obs_of


def slow_joining(d, names):
    """Neighbour joining over a dictionary of distances, all sums anew in each round."""
    edges, active = {i: {} for i in range(len(names))}, list(range(len(names)))
    d = {(i, j): float(d[i, j]) for i in active for j in active}
    while len(active) > 2:
        n, total = len(active), {i: sum(d[i, j] for j in active) for i in active}
        a, b = min(((i, j) for k, i in enumerate(active) for j in active[k + 1 :]), key=lambda p: (n - 2) * d[p] - total[p[0]] - total[p[1]])
        new, la = len(edges), d[a, b] / 2 + (total[a] - total[b]) / (2 * (n - 2))
        edges[new] = {a: max(la, 0.0), b: max(d[a, b] - la, 0.0)}
        edges[a][new], edges[b][new] = edges[new][a], edges[new][b]
        active = [i for i in active if i not in (a, b)]
        for i in active:
            d[i, new] = d[new, i] = (d[a, i] + d[b, i] - d[a, b]) / 2
        d[new, new] = 0.0
        active.append(new)
    if len(active) == 2:
        a, b = active
        edges[a][b] = edges[b][a] = max(d[a, b], 0.0)
    return edges


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 40])
def test_joining_equals_that_over_a_dictionary(n):
    x = np.random.default_rng(n).normal(size=(n, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    fast, slow = (paths(f(d, ["x"] * n), n) for f in (trees.neighbour_joining, slow_joining))
    assert np.allclose(fast, slow, atol=1e-9)


def paths(edges, n):
    """Lengths between all leaves: two ways to number the inner nodes are one tree."""
    out = np.zeros((n, n))
    for a in range(n):
        todo = [(a, None, 0.0)]
        while todo:
            x, come, length = todo.pop()
            if x < n:
                out[a, x] = length
            todo += [(y, x, length + v) for y, v in edges[x].items() if y != come]
    return out


def test_thousands_of_samples_join_in_a_minute():
    x = np.random.default_rng(0).normal(size=(2000, 8))
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    began = time.time()
    edges = trees.neighbour_joining((d + d.T) / 2, ["x"] * 2000)
    assert time.time() - began < 60 and len(edges) == 2 * 2000 - 2


def slow_order(d):
    """Average linkage by looking at all pairs of clusters in each round."""
    clusters = [[k] for k in range(len(d))]
    while len(clusters) > 1:
        mean = lambda a, b: np.mean([d[i, j] for i in a for j in b])
        a, b = min(((a, b) for k, a in enumerate(clusters) for b in clusters[k + 1 :]), key=lambda p: mean(*p))
        clusters = [c for c in clusters if c is not a and c is not b] + [sorted((a, b), key=lambda c: c[0])[0] + sorted((a, b), key=lambda c: c[0])[1]]
    return clusters[0]


@pytest.mark.parametrize("n,few,listed,seed", [(60, 16, 8, 0), (400, 16, 2, 1), (700, 300, 64, 2), (90, 3, 89, 3)])
def test_joining_without_a_matrix_equals_that_with_one(n, few, listed, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) + 5
    x[: n // 3] *= 0.3
    points, names = trees._Points(x), [str(k) for k in range(n)]
    d = points.apart(np.arange(n))
    assert np.abs(d - stats._apart(x, x)).max() < 1e-9
    want = trees.midpoint_newick(trees.neighbour_joining(d, names), names)
    total, d = d.sum(axis=1), np.where(np.eye(n, dtype=bool), np.inf, d)
    near = np.argsort(d - total / (n - 2), axis=1)[:, :listed]
    edges = trees.join_points(points, total, near, np.take_along_axis(d, near, axis=1), few)
    assert trees.midpoint_newick(edges, names) == want


@pytest.mark.parametrize("whole", [0, 20, 4096])
@pytest.mark.parametrize("lacking", [False, True])
def test_a_tree_of_samples_needs_no_row_for_a_pair(spark, whole, lacking):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    if lacking:  # some share no feature with the first two, the last has none
        x[rng.random(x.shape) < 0.1] = np.nan
        x[0], x[1], x[149] = [1, np.nan, np.nan, np.nan, np.nan], [np.nan, 2, np.nan, np.nan, np.nan], np.nan
    obs = obs_of(spark, x, np.arange(150) % 3).where("not isnan(value)")
    d, n = stats._apart(x, x), 150 - lacking
    assert np.isnan(d[0, 1]) == lacking
    want = trees.sample_tree(spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i)], "a long, b long, d double")).collect()
    assert trees.points_tree(obs, whole).collect() == want
    assert trees.points_tree(obs.where("sample_id = 3"), whole).count() == 0


def test_cluster_orders_equal_those_of_all_pairs():
    for seed in range(12):
        x = np.random.default_rng(seed).normal(size=(1 + 2 * seed, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert trees.cluster_order(d) == slow_order(d)


def test_trees_and_orders_of_a_matrix(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 6)), np.arange(30) % 2
    x[:, 5] = x[:, 0] + 0.01 * rng.normal(size=30)
    obs = obs_of(spark, x, y).cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    names = [str(k) for k in range(30)]
    got = trees.sample_tree(stats.distances(obs)).collect()
    assert [(r["n"], r["tree"]) for r in got] == [(30, trees.midpoint_newick(trees.neighbour_joining(d, names), names))]
    order = [r["id"] for r in trees.clustered(stats.pearson_pairs(obs).selectExpr("a", "b", "1 - r as d")).orderBy("place").collect()]
    assert sorted(order) == [f"f{j}" for j in range(6)] and abs(order.index("f0") - order.index("f5")) == 1
    scaled = {(r["feature"], r["sample_id"]): r["value"] for r in scaling.robust(obs).collect()}
    for direction, some in (("up", lambda v: v >= 0.5), ("down", lambda v: v <= -0.5)):
        for r in trees.feature_trees(obs, direction=direction).collect():
            want = {str(i) for (f, i), v in scaled.items() if f == r["feature"] and some(v)}
            assert set(re.findall(r"[(,](\d+):", r["tree"])) == want and r["n"] == len(want)


@pytest.mark.parametrize("ways", [4096, 7])
def test_ways_equal_the_product_of_choices(spark, monkeypatch, ways):
    monkeypatch.setattr(signatures, "WAYS", ways)
    groups = {"a": ["x", "y", "z"], "b": ["u"], "d": [f"k{i}" for i in range(20)], "e": ["a"]}
    table = spark.createDataFrame([(k, v) for k, v in groups.items()], "kept string, dropped array<string>")
    genes = [["a"], ["a", "b"], ["c"], ["a", "e"], ["a", "b", "c", "d", "e"]]
    some = signatures.with_id(spark.createDataFrame([(g,) for g in genes], "genes array<string>"))
    got = sorted((r["sig_id"], r["new_id"]) for r in signatures.expand_correlates(some, table).collect())
    want = sorted({("|".join(g), "|".join(sorted(w))) for g in genes for w in product(*([x, *groups.get(x, [])] for x in g))})
    assert got == want and len(got) > math.prod((4, 2, 21)) - 1


def test_the_core_is_registered_without_the_libraries_of_the_rest():
    root = Path(__file__).resolve().parent.parent
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = sys.modules['sentencepiece'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))]
