"""Whitening against an eigendecomposition in numpy, and exact integers in plain Python."""

import math
import random

import numpy as np
import pytest

from merchlake.llm import whitening

SHAPE = "vec_id long, embedding array<float>, id string, x int, width string, n double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b", 0.5) for i, v in rows], SHAPE).repartition(5)


def check(got, rows, components=32):
    """Every column against plain formulas over the rows that take part."""
    live = [(i, [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    n, width = len(live), len(live[0][1])
    sums = [sum(x[j] for _, x in live) for j in range(width)]
    base = [s // n for s in sums]
    centred = np.array([[x[j] - base[j] - (sums[j] - n * base[j]) / n for j in range(width)] for _, x in live])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    count = min(components, int((values > 1e-12 * values[0]).sum()))
    want = centred @ vectors[:, :count] / np.sqrt(values[:count])
    assert len(got) == n * count
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r["id"], {}).setdefault(r["component"], []).append(r)
    for (i, x), expected in zip(live, want):
        for k in range(count):
            rows_here = by_row[i][k + 1]
            deviation = sum((n * x[j] - sums[j]) ** 2 for j in range(width))
            r = next(r for r in rows_here if r["deviation"] == deviation and abs(abs(r["whitened"]) - abs(expected[k])) < 1e-6)
            assert r["n"] == n and r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(expected[k]) > 1e-3:
                sign = np.sign(r["whitened"] / expected[k])
                assert signs.setdefault(k, sign) == sign


def test_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(12, 12)) * np.geomspace(1, 1e-2, 12)
    data = (rng.normal(size=(700, 12)) @ mixing).astype(np.float32)
    rows = [(i, row.tolist()) for i, row in enumerate(data)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    check(whitening.whiten(frame(spark, rows), components=3).collect(), rows, 3)


def test_dependent_and_constant_dimensions_have_no_component(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b = rng.randrange(-500, 500) / 64, rng.randrange(-500, 500) / 64
        rows.append((i, [a, b, a + b, 3.0, 0.0]))
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2}
    check(got, rows)


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 3)) * [1e9, 1e3, 1]
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rows = [(i, row.tolist()) for i, row in enumerate(data @ turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-6


def test_what_takes_part(spark):
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (4, [-3.0, 0.25])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (11, [1e30, 0.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    check(got, good)
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _ in good for _ in range(2))


def test_tables_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(50)])).collect() == []


def test_deviations_of_any_size():
    n = 10**10
    sums = [7 * n + 3, -(2**50) * n + 5]
    found = whitening.Fit(n, sums, np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[9, -(2**50) + 1], [-4, 2**60], [7, -(2**50)]], np.int64)
    assert found.deviations(x) == [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def test_triangular_solve():
    rng = np.random.default_rng(4)
    factor = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6)
    rows = rng.normal(size=(10, 6))
    assert np.allclose(whitening.solve_rows(rows, factor) @ factor, rows)
