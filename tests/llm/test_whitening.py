"""Whitening against exact integers and rational arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from matewise.llm import catalogue, whitening

ROWS = "vec_id long, embedding array<float>, n int, x string, component int"


def fixed(vector):
    return [math.floor(256 * float(c)) for c in vector]


def exact_covariance(fit):
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    c = [[Fraction(n * x[i] - s[i], n) for i in range(d)] for x in fit]
    return s, [[sum(r[i] * r[j] for r in c) / n for j in range(d)] for i in range(d)]


def check(rows, out, components=4):
    """Hold rows (id, vector) against what the contract says of ``out``."""
    kept = [(i, tuple(fixed(v))) for i, v in rows]
    fit = sorted({x for _, x in kept})
    n = len(fit)
    s, v = exact_covariance(fit)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values.sum() * 1e-12).sum()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["vec_id"], r["component"]) for r in out), key=key) == sorted(((i, c + 1) for i, _ in kept for c in range(k)), key=key)
    by_id = dict(kept)
    signs = {}
    for r in out:
        x, c = by_id[r["vec_id"]], r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] <= 1e-9
        want = float(np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)]) @ vectors[:, c] / math.sqrt(values[c]))
        signs.setdefault(c, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-3 else None
        assert r["whitened"] == pytest.approx(signs.get(c, 1) * want, abs=1e-6)


def test_query_equals_exact_arithmetic(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows[:], catalogue.queries()["op13_compensated_whitening"](spark, sf).collect())


def test_nulls_ties_repeats_and_other_columns(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in np.float32(rng.normal(size=5) * [9, 5, 2, 1, 0.1] + [1e4, 0, -7, 0, 0])]) for i in range(60)]
    good += [(60, good[3][1]), (3, good[3][1]), (61, good[4][1]), (None, good[5][1])]
    bad = [(70, None), (71, [1.0, None, 2.0, 3.0, 4.0]), (72, [float("nan")] * 5), (73, [1.0, float("inf"), 0.0, 0.0, 0.0]), (74, [3e38] * 5), (75, [])]
    frame = spark.createDataFrame([(i, v, 1, "other", 9) for i, v in good + bad], ROWS)
    check(good, whitening.whiten(frame).withColumnRenamed("id", "vec_id").collect())


def test_cases_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 0, "", 0), (2, [0.5, 0.25], 0, "", 0)], ROWS)
    assert whitening.whiten(one).collect() == []
    assert whitening.whiten(one.limit(0)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, "", 0) for i in range(4)], ROWS)
    out = whitening.whiten(line).collect()
    assert sorted(r["component"] for r in out) == [1] * 4 and all(r["explained"] == pytest.approx(1) for r in out)


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(6)
    short = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(20)]
    long = [(100 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(30)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0, "", 0) for i, v in short + long], ROWS)).withColumnRenamed("id", "vec_id").collect()
    check(short, [r for r in out if r["vec_id"] < 100])
    check(long, [r for r in out if r["vec_id"] >= 100])


def test_sums_keep_what_doubles_lose():
    """A small variance beside an offset of 2 ** 61, whose mean a double-double knows to 2 ** -46 (times 999 rows of 9 or less)."""
    rng = np.random.default_rng(7)
    x = (rng.integers(-9, 9, size=(999, 3)) + [1 << 61, -(1 << 60), 5]).astype(np.int64)
    s, v = exact_covariance(x.astype(object).tolist())
    centre = whitening.Centre(len(x), tuple(int(c) for c in s))
    high, low = whitening.outer_sums(centre.centred(x))
    for at, (i, j) in enumerate(zip(*np.triu_indices(3))):
        want = v[i][j] * len(x)
        assert abs(Fraction(float(high[at])) + Fraction(float(low[at])) - want) <= abs(want) * Fraction(1, 1 << 90) + Fraction(999 * 2 * 9, 1 << 46)


def test_merging_doesnt_depend_on_the_cut(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, (rng.normal(size=4) + 50).astype(np.float32).tolist(), 0, "", 0) for i in range(500)], ROWS)
    fit = whitening.fixed_point(frame, "embedding", 256).select("x")
    known = whitening.centres(fit)[4]
    one, many = (whitening.second_moments(fit.repartition(k), {4: known.centred})[4] for k in (1, 7))
    assert np.array_equal(one[0], many[0]) and np.abs(one[1] - many[1]).max() <= np.abs(one[0]).max() * 2.0**-98


def test_deviation_beyond_a_long_is_an_error():
    with pytest.raises(OverflowError):
        whitening.Centre(1 << 20, (0, 0)).deviations(np.array([[1 << 40, 0]]))
    assert whitening.Centre(3, (1, 2)).deviations(np.array([[1 << 20, 5]])) == [(3 * (1 << 20) - 1) ** 2 + 13**2]
