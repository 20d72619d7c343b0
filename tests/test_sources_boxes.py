"""Edge rows of readers, writers, box operators and streaming jobs."""

import pytest
from pyspark.sql import functions as F

from pagelens.operators import boxes
from pagelens.sources import files, sinks
from pagelens.streaming import jobs


def lines(spark, tmp_path, *rows):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_csv_keeps_any_text(spark, tmp_path):
    texts = ['a "quoted", cell', "two\nlines", "", None, "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    sinks.write_csv(df, f"file://{tmp_path}/t", ["k", "t"])
    out = {int(r["k"]): r["t"] for r in files.read_csv(spark, f"file://{tmp_path}/t", ["k", "t"]).collect()}
    assert [out[k] for k in (0, 1, 4)] == [texts[0], texts[1], texts[4]] and not out[2] and not out[3]


def test_jsonl_strict_and_lenient(spark, tmp_path):
    path = lines(spark, tmp_path, '{"a": 1}', '{"a": ', "", '{"a": 2}')
    assert sorted(r["a"] for r in files.read_jsonl(spark, path, "a long").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, "a long", strict=True).collect()


def test_counts(spark, tmp_path):
    path = lines(spark, tmp_path, "# all", "a\t1,234", "b\tn/a", "c\t9", "d\t10")
    assert [tuple(r) for r in files.read_counts(spark, path, 9, 2000).orderBy("name").collect()] == [("a", 1234), ("d", 10)]


def test_noise_and_event_streams(spark):
    df = spark.createDataFrame([("log\n{\"k\": 7}", "data: {\"v\": 1}\n: no\ndata: [DONE]\ndata: {\"v\": 2}"), ("none", ""), (None, None)], "a string, b string")
    out = df.select(files.json_after_noise(F.col("a"), "k long")["k"].alias("k"), files.sse_events(F.col("b"), "v long")["v"].alias("v")).collect()
    assert out[0]["k"] == 7 and out[0]["v"][0] == 1 and out[0]["v"][-1] == 2
    assert out[1]["k"] is None and out[2]["k"] is None and not out[2]["v"]


def test_boxes(spark):
    df = spark.sql("select 1 page, k, named_struct('x', x, 'y', 0D, 'w', w, 'h', 10D) box from values (1, 0D, 10D), (2, 1D, 5D), (3, 8D, 10D), (4, 30D, 0D) v(k, x, w)")
    assert sorted(r["k"] for r in boxes.not_contained(df, "page", "k", "box").collect()) == [1, 3, 4]
    assert sorted(r["k"] for r in boxes.greedy_disjoint(df, "page", "k", "box").collect()) == [1, 4]
    assert boxes.greedy_disjoint(df.limit(0), "page", "k", "box").count() == 0


def test_greedy_pairs(spark):
    c = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1), (2, 1, 1, 0.5)], "page int, l int, r int, s double")
    assert sorted(tuple(r) for r in boxes.greedy_pairs(c, "page", "l", "r", "s").collect()) == [(1, 1, 1, 0.9), (1, 2, 2, 0.1), (2, 1, 1, 0.5)]


def test_trees(spark):
    t = spark.createDataFrame([("a",), ("a__b",), ("a__b__c",), ("d",)], "id string")
    assert {r["id"]: r["height"] for r in boxes.heights(t).collect()} == {"a": 3, "a__b": 2, "a__b__c": 1, "d": 1}
    out = {r["id"]: r["parent"] for r in boxes.drop_and_reparent(t, F.col("id") == "a__b").collect()}
    assert out == {"a": None, "a__b__c": "a", "d": None}


def test_stream_resumes_and_counts_once(spark):
    at, schema = sinks.scratch(spark, "job"), "id long, ts timestamp, phase string, tokens long"
    row = spark.sql("select 1L id, timestamp_seconds(1700000000) ts, 'p' phase, 2L tokens")
    for _ in range(2):
        row.write.mode("append").json(f"{at}/in")
        stream = jobs.json_stream(spark, f"{at}/in", schema)
        jobs.drain(jobs.once_per_key(stream, ["id"], "ts"), f"{at}/once", f"{at}/c1")
        jobs.drain(stream, f"{at}/all", f"{at}/c2")
        jobs.drain_updates(jobs.usage_per_hour(stream, "ts"), f"{at}/sums", f"{at}/c3")
    assert spark.read.schema(schema).parquet(f"{at}/once").count() == 1
    assert spark.read.schema(schema).parquet(f"{at}/all").count() == 2
    assert sorted(r["calls"] for r in spark.read.parquet(f"{at}/sums").collect()) == [1, 2]
