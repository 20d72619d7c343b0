"""What Catalyst takes for small goes through the driver: nothing that grows with the pages may."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.operators import boxes, matching, regression, rounds, trees as tree_operators
from pagelens.plans import trees


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_written_tables_are_dealt(spark):
    """a join of written rows, whatever their files' size, is not planned as a broadcast."""
    x, n = rounds.written(spark.range(1000).select((F.col("id") % 10).alias("page"), F.repeat(F.lit("x"), 1000).alias("t")))
    assert n == 1000
    for other in (x.groupBy("page").count(), spark.range(9).toDF("page")):
        assert "SortMergeJoin" in plan(x.join(other, "page")) and "Broadcast" not in plan(other.join(x.where("t <> ''"), "page", "left_anti"))


def test_no_step_of_eval_pages_is_broadcast(spark, monkeypatch):
    """no step plans a broadcast, and none repeats the steps before it."""
    plans, write = [], rounds.written

    def seen(df):
        plans.append(plan(df))
        return write(df)

    for m in (matching, regression, rounds, tree_operators):
        monkeypatch.setattr(m, "written", seen, raising=False)
    plans.append(plan(trees.eval_pages(spark, "/root/testdata/sf0.001")))
    assert len(plans) > 30 and not [p for p in plans if "BroadcastHashJoin" in p or "NestedLoop" in p]
    assert max(p.count("FileScan") for p in plans[:-1]) < 20


def test_means_are_of_whole_numbers(spark):
    """a mean of rounded shares does not depend on the order in which they are added."""
    box = "page int, id string, parent string, tag string, place int, text string, image boolean, box struct<x:double,y:double,w:double,h:double>"
    side = lambda heights: spark.createDataFrame([(1, "body_1", None, "body", 0, "", False, (0.0, 0.0, 100.0, 100.0)), *[(1, f"body_1__p_{k}", "body_1", "p", k, f"leaf {k}" * k, False, (0.0, float(k), 10.0, h)) for k, h in enumerate(heights, 1)]], box)
    whole = spark.createDataFrame([(1, "body_1")], "page int, id string")
    r = regression.compared((side([10.0] * 6), whole), (side([5.140, 7.665, 8.295, 7.304, 5.148, 6.285]), whole), "page").first()
    assert (r["leaf_pairs"], r["leaf_iou"]) == (6, 0.664)  # 0.66395, which doubles miss in any order


@pytest.mark.parametrize("seed", [1, 2])
def test_paired_texts_are_greedy_pairs(spark, monkeypatch, seed):
    """the same pairs as if all texts were compared; those of settled ends are not."""
    rng, words = random.Random(seed), ["alpha", "beta", "gamma", "delta", "", "é𝄞"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 3, 6])))
    place = lambda: rng.choice([0.0, 100.0, 250.0, 5000.0, None, float("nan")] if seed == 2 else [0.0, 100.0, 250.0])
    rows = lambda: [(p, f"i{k}", None if rng.random() < 0.05 else text(), place(), place()) for p in (1, 2, 3, None) for k in range(25)]
    kind = "page int, id string, text string, x double, y double"
    a, b = spark.createDataFrame(rows(), kind), spark.createDataFrame(rows(), kind)
    want = boxes.greedy_pairs(matching.scored_pairs(a, b, "page"), "page", "l", "r", "score").select("page", "l", "r")
    assert sorted(map(tuple, matching.paired_texts(a, b, "page").collect())) == sorted(map(tuple, want.collect()))
    same = spark.createDataFrame([(1, f"i{k}", f"prose number {k} of many alike", 0.0, 40.0 * k) for k in range(30)], kind)
    monkeypatch.setattr(matching, "ratio", lambda p, q, least: F.lit(None).cast("double"))
    assert sorted((r["l"], r["r"]) for r in matching.paired_texts(same, same, "page").collect()) == sorted((f"i{k}", f"i{k}") for k in range(30))
