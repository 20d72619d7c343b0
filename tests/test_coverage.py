"""Greedy coverage chooses among all rows of a group, however few of them a task gets at a time (F2)."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import selection
from pagelens.plans import libraries


def brute(sets, take):
    left, covered, out = {k: set(v) for k, v in sorted(sets.items())}, set(), []
    while left and len(out) < take:
        best = max(left, key=lambda k: len(left[k] - covered))
        covered |= left.pop(best)
        out.append(best)
    return out


@pytest.mark.parametrize("pool,items,few", [(1, 1, 10**6), (3, 40, 0), (7, 10**6, 10**6), (10**6, 10**6, 10**6)])
def test_rounds_choose_as_one_pass(spark, monkeypatch, pool, items, few):
    for name, value in (("POOL", pool), ("ITEMS", items), ("FEW", few)):
        monkeypatch.setattr(selection, name, value)
    rng, rows, want = random.Random(pool), [], {}
    for g, n, take, most in ((None, 25, 6, 12), ("a", 40, 9, 30), ("b", 5, 9, 12), ("c", 30, 4, 3), ("d", 3, 1, 0)):
        sets = {k: {rng.randrange(60) for _ in range(rng.randrange(most + 1))} for k in rng.sample(range(100), n)}
        rows += [(g, k, [*map(str, v), *map(str, v), None] if v else rng.choice([[], None]), take) for k, v in sets.items()]
        want[g] = brute(sets, take)
    df = spark.createDataFrame(rows, "g string, k long, w array<string>, take long")
    got = {}
    for r in selection.most_covering(df, ["g"], "k", "w", "take").orderBy("place").collect():
        got.setdefault(r["g"], []).append((r["place"], r["k"]))
    assert got == {g: list(enumerate(v, 1)) for g, v in want.items()}


def test_small_documents_of_a_bin_are_candidates(spark, tmp_path):
    """The documents that add most are the smallest of 200, beyond twice the quota of 60 by size."""
    words = F.when(F.col("doc_id") < 190, F.lit("the same words")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.col("doc_id") - 150), lambda k: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"), k.cast("string"))), " "))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (2000 - F.col("id")).alias("n_chars"))
    docs.withColumn("text", words).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in libraries.smp_greedy_diversity(spark, f"file://{tmp_path}").orderBy("place").collect()]
    assert got == [*range(199, 189, -1), *range(50)]
