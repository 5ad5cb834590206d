"""Trees grown from summed histograms against trees grown from the rows."""

import numpy as np
import pytest

from sigstab.operators import forest, linear

from .test_linear import table


@pytest.fixture(scope="module")
def data():
    rng, folds = np.random.default_rng(5), []
    for n, p, k in ((120, 6, 3), (80, 5, 2)):
        y = rng.integers(0, k, n)
        x = rng.normal(size=(n, p))
        x[:, 1] += 2 * y
        x[:, 3] -= 1.0 * (y == 1)
        folds.append((x, y))
    return folds


def grown(b, y, weight, look, classes, node=1, depth=0, gains=None):
    """Gains by feature of a tree grown by recursion over the rows, for bins b."""
    gains = {} if gains is None else gains
    purity = lambda w: sum(w[y == c].sum() ** 2 for c in range(classes)) / max(w.sum(), 1e-300)
    best = (0.0, None)
    for j in look(node):
        for edge in range(forest.BINS - 1):
            left, right = weight * (b[:, j] <= edge), weight * (b[:, j] > edge)
            if min(left.sum(), right.sum()) >= forest.LEAST:
                gain = round(purity(left) + purity(right) - purity(weight), 9)
                if gain > best[0]:
                    best = (gain, (j, edge))
    if depth < forest.DEPTH and best[1]:
        j, edge = best[1]
        gains[j] = gains.get(j, 0) + best[0]
        grown(b, y, weight * (b[:, j] <= edge), look, classes, 2 * node, depth + 1, gains)
        grown(b, y, weight * (b[:, j] > edge), look, classes, 2 * node + 1, depth + 1, gains)
    return gains


@pytest.mark.parametrize("number", [None, 4])
def test_trees_equal_those_grown_from_the_rows(spark, data, number):
    train = table(spark, data)
    rows, places = linear.packed(train, 3, 2)
    edges = forest.cuts(train, places)
    small = forest.binned(rows, edges).cache()
    trees = [forest.Tree(f, "t", s, np.arange(x.shape[1]), number) for f, (x, _) in enumerate(data) for s in (0, 2, 4)]
    forest.grow(small, trees, 3)
    got = {(r["fold"], r["sample_id"]): r for r in small.collect()}
    for t in trees:
        x, y = data[t.fold]
        mine = [got[t.fold, i] for i in range(len(y))]
        b = np.stack([r["b"] for r in mine])
        assert (b == np.stack([np.searchsorted(edges[t.fold][j], x[:, j], "left") for j in range(x.shape[1])], axis=1)).all()
        weight = np.array([t.rows in r["sets"] for r in mine]) * (1 if number is None else forest.times(np.arange(len(y)), number))
        want = grown(b, y, weight.astype(float), t.looks_at, 3)
        assert t.gains.keys() == want.keys() and np.allclose([t.gains[j] for j in want], list(want.values()))


def test_a_bootstrap_counts_rows_as_often_as_one_with_replacement_would():
    n = forest.times(np.arange(100_000), 3)
    assert abs(n.mean() - 1) < 0.02 and abs((n == 0).mean() - np.exp(-1)) < 0.01
    assert (forest.times(np.arange(1000), 3) == forest.times(np.arange(1000), 3)).all()
    assert (forest.times(np.arange(1000), 3) != forest.times(np.arange(1000), 4)).any()


def test_rankings_of_all_types(spark, data):
    got = forest.rank(table(spark, data), 3, 4, trees=8).collect()
    methods = {"t2_single_tree", "t5_stability_tree"} | {f"{t}_{e}" for t in ("t3_weights", "t4_elimination", "t7_addition") for e in ("tree", "forest")}
    assert {r["method"] for r in got} == methods
    for fold, (x, y) in enumerate(data):
        for m in methods:
            score = {r["feature"]: r["score"] for r in got if (r["fold"], r["method"]) == (fold, m)}
            assert len(score) == x.shape[1] and score["f01"] == max(score.values()), (fold, m, score)
            if m[:2] in ("t4", "t7"):
                assert sorted(score.values()) == [k + (m[:2] == "t7") for k in range(x.shape[1])]


def test_single_features_are_scored_by_the_most_frequent_class_of_a_bin(spark, data):
    x, y = data[1]
    train = table(spark, [(x, y)])
    got = {r["feature"]: r["score"] for r in forest.rank(train, 3, 0, trees=1).where("method = 't2_single_tree'").collect()}
    rows, places = linear.packed(train, 3, 0)
    edges = forest.cuts(train, places)[0]
    part = np.array([r["part"] for r in rows.orderBy("sample_id").collect()])
    for j in range(x.shape[1]):
        b, each = np.searchsorted(edges[j], x[:, j], "left"), []
        for s in range(1, 4):
            tr, te = part != s, part == s
            most = {v: np.bincount(y[tr & (b == v)]).argmax() for v in set(b[tr])}
            each.append(np.mean([most.get(v, np.bincount(y[tr]).argmax()) == c for v, c in zip(b[te], y[te], strict=True)]))
        assert got[f"f{j:02}"] == pytest.approx(np.mean(each))
