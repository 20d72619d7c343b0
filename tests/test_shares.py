"""What a task gets does not grow with the table."""

from pyspark.sql import functions as F

from pagelens.operators import ordered, ranks
from pagelens.plans import libraries


def test_pieces_by_rows(spark, monkeypatch):
    """more rows, more partitions; the window takes them as they are dealt."""
    monkeypatch.setattr(ranks, "PIECE", 10)
    x = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("lo"), (F.col("id") + 40.0).alias("hi"))
    dealt = ranks.in_pieces(x, "k")
    assert dealt.rdd.getNumPartitions() == 40
    out = ordered.merged_intervals(dealt, "k", "lo", "hi")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r["k"], r["low"], r["high"], r["n"]) for r in out.collect()) == [(k, float(k), k + 400.0, 10) for k in range(40)]


def test_texts_of_narrowed_bins_only(spark):
    """sizes are ranked without texts, each task keeps what a quota can reach, and texts come by a broadcast join."""
    plan = libraries.smp_greedy_diversity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
    window = plan[plan.index("WindowGroupLimit") :]
    assert "text" not in window[: window.index("FileScan")]
