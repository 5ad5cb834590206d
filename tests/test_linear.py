"""Rankings from summed cross products against plain numpy on the rows themselves."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigstab.operators import linear

SCHEMA = "fold int, sample_id long, label string, y int, feature string, value double"
PARTS = 3


def table(spark, folds):
    """folds: (x, y) of each fold."""
    rows = [(f, i, "abc"[y[i]], int(y[i]), f"f{j:02}", float(v)) for f, (x, y) in enumerate(folds) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def data():
    """Two folds of other sizes and features; only the first two features tell classes apart."""
    rng, folds = np.random.default_rng(3), []
    for n, p, k in ((70, 7, 3), (90, 9, 2)):
        y = rng.integers(0, k, n)
        x = rng.normal(size=(n, p)) * rng.uniform(0.5, 20, p) + rng.uniform(-5, 5, p)
        x[:, 0] += 3 * y * x[:, 0].std()
        x[:, 1] -= 1.5 * y * x[:, 1].std()
        folds.append((x, y))
    return folds


@pytest.fixture(scope="module")
def found(spark, data):
    rows, places = linear.packed(table(spark, data), PARTS, 4)
    rows = rows.cache()
    members = {}
    for r in rows.collect():
        for s in r["sets"]:
            members.setdefault((r["fold"], s), []).append((r["sample_id"], r["part"]))
    return rows, linear.fits(rows, PARTS).collect(), members


def scaled(x):
    return (x - x.mean(axis=0)) / x.std(axis=0)


def targets(y):
    return np.where(y[:, None] == np.unique(y), 1.0, -1.0)


def numpy_weights(name, x, y):
    """By class: weights fitted to the rows."""
    z, t, n = scaled(x), targets(y), len(y)
    if name == "ridge":
        return np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (t - t.mean(axis=0))).T
    if name == "lda":
        means = np.stack([z[y == c].mean(axis=0) for c in np.unique(y)])
        rest = z - means[np.searchsorted(np.unique(y), y)]
        return np.linalg.solve(rest.T @ rest / (n - len(means)) + 1e-3 * np.eye(z.shape[1]), means.T).T
    out = []
    for k in range(t.shape[1]):  # svm: plain Newton steps with many rounds
        u, w = np.column_stack([np.ones(n), z]), np.zeros(z.shape[1] + 1)
        d = np.diag(np.append(1e-9, np.full(z.shape[1], 0.5)))
        for _ in range(200):
            inside = t[:, k] * (u @ w) < 1
            new = np.linalg.solve(u[inside].T @ u[inside] + d, u[inside].T @ t[inside, k])
            w = w + (new - w) * (1.0 if np.abs(new - w).max() < 1e-3 else 0.5)
        out.append(w[1:])
    return np.stack(out)


def scores(rows, fold, name, kind, s=linear.WHOLE):
    return np.array([r["w"] for r in sorted(rows, key=lambda r: r["pos"]) if (r["fold"], r["estimator"], r["kind"], r["set"]) == (fold, name, kind, s)])


@pytest.mark.parametrize("fold", [0, 1])
@pytest.mark.parametrize("name", ["ridge", "lda", "svm"])
def test_weights_equal_a_fit_to_the_rows(data, found, fold, name):
    want = np.abs(numpy_weights(name, *data[fold])).mean(axis=0)
    assert np.allclose(scores(found[1], fold, name, "t3_weights"), want, rtol=1e-4, atol=1e-6)


@pytest.mark.parametrize("name", ["ridge", "lda"])
def test_elimination_and_addition_equal_refits(data, found, name):
    x, y = data[0]
    for kind, pick, score in (("t4_elimination", np.argmin, lambda k, p: k), ("t7_addition", np.argmax, lambda k, p: p - k)):
        left, want = list(range(x.shape[1])), np.zeros(x.shape[1])
        for k in range(x.shape[1]):
            w = numpy_weights(name, x[:, left], y)
            want[left.pop(int(pick((w**2).sum(axis=0))))] = score(k, x.shape[1])
        assert scores(found[1], 0, name, kind).tolist() == want.tolist()


def test_decisions_predict_as_a_fit_to_the_rows(data, found):
    """The weights and constants of a set without a part give the very predictions of least squares and discriminant."""
    _, fits, members = found
    for fold, (x, y) in enumerate(data):
        for s in range(1, PARTS + 1):
            ids = [i for i, _ in members[fold, s]]
            assert {p for _, p in members[fold, s]} == set(range(1, PARTS + 1)) - {s}
            xs, ys = x[ids], y[ids]
            for name in ("ridge", "lda"):
                w = numpy_weights(name, xs, ys)
                z = (x - xs.mean(axis=0)) / xs.std(axis=0)
                if name == "ridge":
                    want = z @ w.T + targets(ys).mean(axis=0)
                else:
                    means = np.stack([((xs - xs.mean(axis=0)) / xs.std(axis=0))[ys == c].mean(axis=0) for c in np.unique(ys)])
                    want = z @ w.T - 0.5 * (w * means).sum(axis=1) + np.log(np.bincount(ys) / len(ys))
                got = np.zeros_like(want)
                for r in fits:
                    if (r["fold"], r["estimator"], r["kind"], r["set"]) == (fold, name, "model", s):
                        got[:, r["c"]] += r["b"] if r["pos"] < 0 else r["w"] * x[:, r["pos"]]
                assert np.allclose(got, want)


def test_lasso_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 20)) @ rng.normal(size=(20, 20))
    s, b = x.T @ x / 60, rng.normal(size=(3, 20))
    for penalty, w in zip((0.8, 0.3, 0.05), linear.lasso_path(s, b, [0.8, 0.3, 0.05], rounds=20_000), strict=True):
        pull = b - w @ s
        assert np.allclose(pull[w != 0], penalty * np.sign(w[w != 0]), atol=1e-5) and np.abs(pull).max() <= penalty + 1e-5


def test_subsamples_are_counted_over_all_penalties(data, found):
    _, fits, members = found
    x, y = data[1]
    bags = [s for f, s in members if f == 1 and s > PARTS]
    assert len(bags) == 4 and all(0.5 * len(y) < len(members[1, s]) < 0.95 * len(y) for s in bags)
    for s in bags:
        ids = [i for i, _ in members[1, s]]
        z, t = scaled(x[ids]), targets(y[ids])
        used = []
        for c in linear.GRID["ridge"]:
            w = np.abs(np.linalg.solve(z.T @ z + np.eye(z.shape[1]) / c, z.T @ (t - t.mean(axis=0)))).mean(axis=1)
            used.append(w >= w.mean())
        assert np.allclose(scores(fits, 1, "ridge", "t5_stability", s), np.mean(used, axis=0))


def test_rankings_find_the_features_that_tell_classes_apart(spark, data):
    got = linear.rank(table(spark, data), PARTS, 4).collect()
    methods = {r["method"] for r in got}
    assert methods == {f"{t}_{e}" for t in linear.TYPES for e in linear.ESTIMATORS}
    for fold, (x, _) in enumerate(data):
        for m in methods:
            score = {r["feature"]: r["score"] for r in got if (r["fold"], r["method"]) == (fold, m)}
            assert len(score) == x.shape[1] and max(score, key=lambda f: (score[f], f == "f00")) == "f00", (fold, m, score)


def test_single_features_and_decrease_against_the_rows(spark, data, found):
    _, fits, members = found
    x, y = data[0]
    got = {(r["method"], r["feature"]): r["score"] for r in linear.rank(table(spark, data[:1]), PARTS, 0, reps=1, estimators=("ridge",)).collect()}
    single, base = np.zeros(x.shape[1]), []
    for s in range(1, PARTS + 1):
        train = np.array([i for i, _ in members[0, s]])
        test = np.setdiff1d(np.arange(len(y)), train)
        t = targets(y[train])
        z = (x[test] - x[train].mean(axis=0)) / x[train].std(axis=0)
        zt = scaled(x[train])
        for j in range(x.shape[1]):
            w = zt[:, j] @ (t - t.mean(axis=0)) / (zt[:, j] @ zt[:, j] + 1)
            single[j] += (np.argmax(z[:, [j]] * w + t.mean(axis=0), axis=1) == y[test]).mean() / PARTS
        base.append((np.argmax(z @ numpy_weights("ridge", x[train], y[train]).T + t.mean(axis=0), axis=1) == y[test]).mean())
    assert np.allclose([got["t2_single_ridge", f"f{j:02}"] for j in range(x.shape[1])], single)
    lost = [got["t6_decrease_ridge", f"f{j:02}"] for j in range(x.shape[1])]
    assert lost[0] > 0.1 and max(np.abs(lost[2:])) < lost[0] and all(v <= np.mean(base) + 1e-9 for v in lost)


def test_decrease_has_no_row_for_a_permuted_value_and_a_model(spark, data, found, monkeypatch):
    _, fits, members = found
    x, y = data[0]
    out = linear.rank(table(spark, data[:1]), PARTS, 0, reps=2, estimators=("ridge",), types=("t6_decrease",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    want = np.zeros(x.shape[1])
    for s in range(1, PARTS + 1):
        train = np.array([i for i, _ in members[0, s]])
        test = np.setdiff1d(np.arange(len(y)), train)
        w, level = np.zeros((x.shape[1], len(np.unique(y)))), np.zeros(len(np.unique(y)))
        for r in fits:
            if (r["fold"], r["estimator"], r["kind"], r["set"]) == (0, "ridge", "model", s):
                if r["pos"] < 0:
                    level[r["c"]] = r["b"]
                else:
                    w[r["pos"], r["c"]] = r["w"]
        hits = lambda z, test=test, w=w, level=level: ((z @ w + level).round(9).argmax(axis=1) == y[test]).mean()
        for j in range(x.shape[1]):
            for rep in range(2):
                z = x[test].copy()
                z[:, j] = z[sorted(range(len(test)), key=lambda k: hashlib.md5(f"0|0|{s}|f{j:02}|{rep}|{test[k]}".encode()).hexdigest()), j]
                want[j] += (hits(x[test]) - hits(z)) / PARTS / 2
    first = {r["feature"]: r["score"] for r in out.collect()}
    assert np.allclose([first[f"f{j:02}"] for j in range(x.shape[1])], want)
    monkeypatch.setattr(linear, "BLOCK", 7)
    assert {r["feature"]: r["score"] for r in linear.rank(table(spark, data[:1]), PARTS, 0, reps=2, estimators=("ridge",), types=("t6_decrease",)).collect()} == pytest.approx(first, abs=1e-12)


def test_features_without_spread_and_missing_values(spark):
    x, y = np.zeros((30, 3)), np.arange(30) % 2
    x[:, 0] = y + np.linspace(0, 0.3, 30)
    x[:, 1] = 5
    rows = table(spark, [(x, y)]).withColumn("value", F.when(~((F.col("feature") == "f02") & (F.col("sample_id") > 3)), F.col("value")))
    got = linear.rank(rows, 2, 2).collect()
    assert len(got) == 3 * len(linear.TYPES) * len(linear.ESTIMATORS)
    weight = {(r["method"], r["feature"]): r["score"] for r in got}
    for e in linear.ESTIMATORS:
        assert abs(weight[f"t3_weights_{e}", "f01"]) < 1e-9 < weight[f"t3_weights_{e}", "f00"]


def test_places_are_not_joined_by_a_shuffle_of_the_matrix(spark):
    rows = [(0, i, i % 2, f"f{j}", float(i * j)) for i in range(8) for j in range(3)]
    train = spark.createDataFrame(rows, "fold int, sample_id long, y int, feature string, value double")
    plan = linear.packed(train, 2, 0)[0]._jdf.queryExecution().executedPlan().toString()
    assert "fold#" in plan and "hashpartitioning(fold" in plan
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "feature" in line]
    assert not joins
