"""Embedding whitening against a covariance in Python's integers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, length int, k string, n int")


def brute(rows, components=16, weights="one"):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} and the components with clear eigenvalues."""
    def x(v):
        return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)

    good = [(i, x(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    count = {}
    for _, v in good:
        count[v] = count.get(v, 0) + 1
    w = {v: 1 if weights == "one" else c for v, c in count.items()}
    n, d = sum(w.values()), len(good[0][1])
    sums = [sum(w[v] * v[j] for v in w) for j in range(d)]
    y = {v: np.array([float(Fraction(n * v[j] - sums[j], n)) for j in range(d)]) for v in w}
    square = sum(w[v] * np.outer(y[v], y[v]) for v in w) / n
    value, vector = np.linalg.eigh(square)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    out = []
    for i, v in good:
        far = sum((n * v[j] - sums[j]) ** 2 for j in range(d))
        for c in range(len(value)):
            out.append((i, c + 1, n, far, abs(float(y[v] @ vector[:, c] / math.sqrt(value[c]))), float(value[c] / np.trace(square))))
    return sorted(out)


def vectors(seed=3, d=20, n=150):
    rnd = np.random.default_rng(seed)
    scale = np.linspace(2, 0.3, d)
    rows = [(i, (rnd.standard_normal(d) * scale).tolist()) for i in range(n)]
    rows += [(1000 + j, rows[0][1]) for j in range(60)] + [rows[1], rows[1]]  # copies under other ids, repeated rows
    rows += [(1, None), (2, [float("nan")] + [0.0] * (d - 1)), (3, [None] + [0.0] * (d - 1)), (4, [float("inf")] * d), (5, [])]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
@pytest.mark.parametrize("target", [None, "12"])  # hot vectors are salted beyond the target
def test_whitening(spark, weights, target):
    rows = vectors()
    if target:
        spark.conf.set("spark.tidemark.blocks.targetRows", target)
    try:
        got = sorted(map(tuple, whitening.whiten(frame(spark, rows), weights=weights).collect()))
    finally:
        spark.conf.unset("spark.tidemark.blocks.targetRows")
    want = brute(rows, weights=weights)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [r[4] for r in want], atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and 0 <= got[0][6] < 1e-10
    white = {}  # the sign is the same for all rows: products of two rows do not depend on it
    for r in got:
        white.setdefault(r[0], {})[r[1]] = r[4]
    kept = np.array([[white[i][c] for c in range(1, 17)] for i in range(150)])
    if weights == "one":
        assert np.abs((kept - kept.mean(0)).T @ (kept - kept.mean(0)) / 150 - np.eye(16)).max() < 1e-10


def test_whitening_edges(spark):
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance, no component
    flat = [(i, [float(i), 1.0, float(-2 * i)]) for i in range(5)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    huge = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0]), (None, [0.0, 5.0])]
    got = whitening.whiten(frame(spark, huge)).collect()
    assert len(got) == 4 and all(math.isfinite(r["whitened"]) for r in got)
    assert all((r["deviation"] is None) == (r["vec_id"] in (1, 2)) for r in got)
    lengths = vectors(n=30, d=5) + [(5000 + i, v) for i, v in vectors(seed=5, n=20, d=3)]
    got = whitening.whiten(frame(spark, lengths)).collect()
    assert {(r["n"], r["vec_id"] >= 5000) for r in got} == {(30, False), (20, True)} and max(r["identity_error"] for r in got) < 1e-10
