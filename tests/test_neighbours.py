"""The nearest samples by a matrix product and exact distances, against all distances."""

import numpy as np
import pytest

from sigstab.operators import stats


def brute(x, y, a, b, k):
    d = stats._apart(x, y)
    d[a[:, None] == b[None, :]] = np.nan
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(i, int(j), float(d[i, j])) for i in range(len(a)) for j in order[i] if not np.isnan(d[i, j])]


@pytest.mark.parametrize("kind", ["normal", "far from zero", "grid with ties", "all alike", "missing", "infinite", "too few"])
def test_closest_against_all_distances(kind, monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(300, 7))
    if kind == "far from zero":
        y += 1e7
    elif kind == "grid with ties":
        y = np.round(y)
    elif kind == "all alike":
        y[:] = 0.1
    elif kind == "missing":
        y[rng.random(y.shape) < 0.2] = np.nan
    elif kind == "infinite":
        y[5, 2] = np.inf
    elif kind == "too few":
        y = y[:3]
    b = np.arange(len(y))
    a = b[::3]
    with np.errstate(invalid="ignore"):
        want = brute(y[a], y, a, b, 5)
    if kind in ("normal", "grid with ties", "too few"):  # complete rows aren't compared one feature at a time with all others
        monkeypatch.setattr(stats, "_apart", None)
    with np.errstate(invalid="ignore"):
        got = [(int(m), int(n), float(d)) for m, n, d in zip(*stats._closest(y[a], y, a, b, 5), strict=True)]
    assert got == want
