"""Greedy choices by rounds and by one pass, against the plain loops over a page's rows."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import boxes, rounds

BOX = "struct<x:double,y:double,w:double,h:double>"


def greedy(rows):
    """rows: page, l, r, score."""
    out, used = [], set()
    for p, l, r, s in sorted(set(rows), key=lambda e: (-e[3], e[1], e[2])):
        if (p, "l", l) not in used and (p, "r", r) not in used:
            used |= {(p, "l", l), (p, "r", r)}
            out.append((p, l, r, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_dominant_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(rounds, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.choice([1, 2, 2, None]), f"a{rng.randrange(12)}", f"b{rng.randrange(12)}", rng.randrange(6) / 5) for _ in range(300)]
    rows += [(3, f"a{k}", f"b{k + d}", 1.0 - k / 10) for k in range(8) for d in (0, 1)]  # a chain: each choice waits for the one before
    df = spark.createDataFrame(rows, "page int, l string, r string, score double")
    got = rounds.dominant_pairs(df, "page", "l", "r", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == greedy(rows)
    assert rounds.dominant_pairs(df.limit(0), "page", "l", "r", "score").count() == 0


def some_boxes(seed, n):
    rng = random.Random(seed)
    side = lambda: rng.choice([0.0, 1.0, 7.5, 30.0, 64.0, 300.0]) * rng.choice([1, 1, 0.5])
    rows = [(rng.choice([1, 1, None]), k, (rng.randrange(-40, 400) * 1.0, rng.randrange(0, 400) * 0.5, side(), side())) for k in range(n)]
    return rows + [(1, n, None), (1, n + 1, rows[0][2]), (1, n + 2, rows[1][2])]


def keep(rows, excludes, order):
    kept = []
    for p, k, b in sorted(rows, key=order):
        if b is None or not any(q == p and c is not None and excludes(c, b) for q, _, c in kept):
            kept.append((p, k, b))
    return sorted(((p, k) for p, k, _ in kept), key=repr)


def overlaps(a, b):
    return all(min(a[k] + a[k + 2], b[k] + b[k + 2]) > max(a[k], b[k]) for k in (0, 1))


def holds(a, b):
    return all(b[k] >= a[k] - 2 and b[k] + b[k + 2] <= a[k] + a[k + 2] + 2 for k in (0, 1))


@pytest.mark.parametrize("few", [0, 10**6])
def test_boxes(spark, monkeypatch, few):
    monkeypatch.setattr(rounds, "FEW", few)
    rows = some_boxes(few + 1, 150)
    df = spark.createDataFrame(rows, f"page int, key int, box {BOX}")
    got = boxes.greedy_disjoint(df, "page", "key", "box").collect()
    assert sorted(map(tuple, got), key=repr) == keep(rows, overlaps, lambda e: e[1])
    got = boxes.not_contained(df, "page", "key", "box").collect()
    assert sorted(map(tuple, got), key=repr) == keep(rows, holds, lambda e: (0 if e[2] is None else -e[2][2] * e[2][3], e[1]))
    assert boxes.greedy_disjoint(df.limit(0), "page", "key", "box").count() == boxes.not_contained(df.limit(0), "page", "key", "box").count() == 0


def test_large_page(spark):
    """One page of 100 000 boxes: pairs that are near each other only, and no array of the page."""
    x = spark.range(100_000, numPartitions=8).select(F.lit(1).alias("page"), F.col("id").alias("key"), F.struct(*[c.cast("double").alias(n) for c, n in ((F.col("id") % 400 * 8, "x"), (F.floor(F.col("id") / 400) * 8, "y"), (F.col("id") % 13, "w"), (F.col("id") % 11, "h"))]).alias("box"))
    assert boxes._meeting(x, "page", "key", "box", 0.0, False).count() < 3_000_000
    assert 30_000 < boxes.greedy_disjoint(x, "page", "key", "box").count() < 100_000


def test_equal_boxes_by_tie(spark):
    """Boxes of one area that hold each other: the least tie stays, then the least key."""
    rows = [(1, 1, (0.0, 0.0, 10.0, 10.0), 5), (1, 2, (1.0, 1.0, 10.0, 10.0), 3), (1, 3, (1.0, 0.0, 10.0, 10.0), 3), (1, 4, (50.0, 0.0, 10.0, 10.0), 9)]
    df = spark.createDataFrame(rows, f"page int, key int, box {BOX}, t int")
    keys = lambda **kw: sorted(r["key"] for r in boxes.not_contained(df, "page", "key", "box", **kw).collect())
    assert keys() == [1, 4] and keys(tie="t") == [2, 4]
