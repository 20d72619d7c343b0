"""Folds that take many small pages in one pass, and what they must not change."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pagelens.operators import matching, rounds, trees


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def groups_of(pairs):
    groups = []
    for lefts, rights in pairs:
        home = next((g for g in groups if g[0] & lefts), None) or next((g for g in groups if g[1] & rights), None)
        if home:
            home[0].update(lefts)
            home[1].update(rights)
        else:
            groups.append((set(lefts), set(rights)))
    return [(sorted(a), sorted(b)) for a, b in groups]


@pytest.mark.parametrize("batch", [1, 4096])
def test_merged_groups_of_many_pages(spark, monkeypatch, batch):
    """No call of pandas for each page (F2): the pages of a task are folded in one pass."""
    monkeypatch.setattr(rounds, "BATCH", batch)
    rng = random.Random(batch)
    some = lambda c: [f"{c}{rng.randrange(9)}" for _ in range(rng.choice([1, 1, 2]))]
    rows = [(rng.choice([None, *range(20)]), k, some("a"), some("b")) for k in range(400)]
    df = spark.createDataFrame(rows, "page int, place int, lefts array<string>, rights array<string>")
    out = matching.merged_groups(df, "page")
    assert "FlatMapGroups" not in plan(out)
    got = {}
    for r in out.orderBy("grp").collect():
        got.setdefault(r["page"], []).append((r["lefts"], r["rights"]))
    assert got == {p: groups_of([(set(a), set(b)) for q, _, a, b in rows if q == p]) for p in {r[0] for r in rows}}
    assert matching.merged_groups(df.limit(0), "page").count() == 0


def test_single_and_held_fold_many_pages(spark):
    """No call of pandas for each page (F8, F11)."""
    node = "page int, id string, text string, image boolean, box struct<x:double,y:double,w:double,h:double>"
    nodes = spark.createDataFrame([(p, i, "t", False, (0.0, 0.0, w, 9.0)) for p in (1, 2, None) for i, w in (("a_1", 9.0), ("a_1__b_1", 8.0), ("a_1__b_1__c_1", 9.0))], node)
    out = trees.without_single(nodes, "page")
    assert "FlatMapGroups" not in plan(out)
    assert sorted(map(repr, ((r["page"], r["id"]) for r in out.collect()))) == sorted(map(repr, ((p, "a_1") for p in (1, 2, None))))
    leaf = "page int, id string, text string, left double, top double, x double, y double"
    a = spark.createDataFrame([(p, "l", "some words and more", 0.0, 0.0, 0.0, 0.0) for p in (1, 2)], leaf)
    b = spark.createDataFrame([(p, f"r{k}", t, 0.0, float(k), 0.0, 0.0) for p in (1, 2) for k, t in enumerate(("and more", "some words", "some"))], leaf)
    out = matching.held_texts(a, b, "page")
    assert "FlatMapGroups" not in plan(out)
    assert sorted((r["page"], r["lefts"], r["rights"]) for r in out.collect()) == [(p, ["l"], ["r0", "r1"]) for p in (1, 2)]


def test_letters_bound_similarity(spark, monkeypatch):
    """Texts whose letters rule out the least similarity are not compared (F1, F8); others have what difflib says."""
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdé ſ𝄞") for _ in range(rng.randrange(9)))
    rows = [(text(), text()) for _ in range(400)] + [("", ""), (None, "a"), ("x" * 300, "x" * 300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", matching.ratio(F.col("a"), F.col("b"), 0.6).alias("r"), matching.ratio(F.col("a"), F.col("b")).alias("all"))
    got = df.collect()
    for r in got:
        exact = None if r["a"] is None else SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["all"] == exact and (r["r"] == exact or (r["r"] is None and exact < 0.6))
    assert sum(r["r"] is None for r in got) > 50
