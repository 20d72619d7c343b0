"""Operators that work by ranges, histograms and weights instead of whole groups, against plain readings of the rows."""

import math
import random
import struct

import numpy as np
import pytest

from pagelens.operators import aggregates, ordered


def test_ordered_bits(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 0.5, 2.0, 4.0, 1023.9999999999999, 3.0, 1e-310]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(300)] + [2.0**k for k in range(-1074, 1024, 37)] + [math.nextafter(2.0**k, d) for k in range(-50, 60) for d in (0, math.inf)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = {v: struct.unpack(">q", struct.pack(">d", abs(v)))[0] * (-1 if v < 0 else 1) for v in values}
    assert all(want[r["v"]] == r["b"] for r in df.select("v", aggregates._ordered_bits(df["v"]).alias("b")).collect())


@pytest.mark.parametrize("step", [16, 32])
def test_quantiles(spark, monkeypatch, step):
    monkeypatch.setattr(aggregates, "STEP", step)
    rng = np.random.default_rng(step)
    rows = [("even", float(v)) for v in range(1001)] + [("wide", float(v)) for v in rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)]
    rows += [("near", 1 + k * 2.0**-52) for k in range(300)] + [("one", 7.0)] + [("same", -2.5)] * 400 + [("none", None), ("none", float("nan"))] + [(None, 3.0), (None, 4.0)] + [("ends", float("inf")), ("ends", 1.0), ("ends", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    parts = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in aggregates.quantiles(df, ["g"], "v", parts).collect()}
    most = np.finfo(float).max
    for g in {r[0] for r in rows} - {"none"}:
        v = sorted(max(-most, min(most, x)) for k, x in rows if k == g)
        for p, q in zip(parts, got[g]):
            a, b = v[math.floor((len(v) - 1) * p)], v[math.ceil((len(v) - 1) * p)]
            assert q == pytest.approx(a + (b - a) * ((len(v) - 1) * p - math.floor((len(v) - 1) * p)), rel=1e-12)
    assert "none" not in got and aggregates.quantiles(df.limit(0), ["g"], "v", parts).count() == 0
    plan = aggregates.describe(df, ["g"], "v")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan


def test_crowding(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(40)), rng.random(), 1.0) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    want = {r[0]: 0.0 for r in rows}
    for o in (1, 2, 3):
        by = sorted(rows, key=lambda r: (r[o], r[0]))
        span = by[-1][o] - by[0][o]
        for k, r in enumerate(by):
            want[r[0]] += math.inf if k in (0, len(by) - 1) else (by[k + 1][o] - by[k - 1][o]) / span if span else 0.0
    got = {r["id"]: r["distance"] for r in ordered.crowding(df, "id", ["x", "y", "z"]).collect()}
    assert got == pytest.approx(want)
    assert ordered.crowding(df.limit(0), "id", ["x", "y"]).count() == 0


def test_smaller_before():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 64, 100):
        v, w = rng.integers(0, 12, n), rng.integers(1, 5, n)
        assert ordered._smaller_before(v, w).tolist() == [int(w[:k][v[:k] < v[k]].sum()) for k in range(n)]


def test_dominated_by(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([rng.random(), 0.5, 1.0]), rng.randrange(6)) for k in range(700)]
    rows += [("a", 700, None, 1), ("a", 701, float("nan"), 9), ("c", 702, 1.0, 1), ("a", 703, 2.0, None)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y int")
    fit = [r for r in rows if r[2] is not None and r[3] is not None and r[2] == r[2]]
    over = lambda b, a: b[0] == a[0] and b[2] >= a[2] and b[3] >= a[3] and (b[2] > a[2] or b[3] > a[3])
    want = {a[1]: sum(over(b, a) for b in fit) if a in fit else 0 for a in rows}
    assert {r["id"]: r["dominated_by"] for r in ordered.dominated_by(df, "g", "id", "x", "y").collect()} == want
    assert ordered.dominated_by(df.limit(0), "g", "id", "x", "y").count() == 0


def test_dominated_by_large_group(spark):
    """10^5 points of one group on an anti-diagonal band: counted without pairs."""
    n = 100_000
    df = spark.range(n).selectExpr("1 AS g", "id", "cast(id AS double) AS x", f"({n} - id) + (id * 7919) % 97 AS y")
    got = {r["id"]: r["dominated_by"] for r in ordered.dominated_by(df, "g", "id", "x", "y").collect()}
    y = np.array([n - k + k * 7919 % 97 for k in range(n)])
    for k in range(0, n, 991):
        assert got[k] == int((y[k + 1 :] >= y[k]).sum())
