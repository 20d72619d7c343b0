"""Rows on which a query once differed from its SQL."""

import duckdb
from pyspark.sql import functions as F

from pagelens.operators import boxes
from pagelens.plans import boxes as box_plans, libraries, registry


def against_sql(spark, name, query, folder, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = query(spark, f"file://{folder}")
    want = con.sql(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want))


def test_held_box_of_a_higher_level(spark):
    """a held box stands out by the margin on both sides, and so is larger than what holds it."""
    box = "page int, k int, box struct<x:double,y:double,w:double,h:double>"
    rows = [(1, 1, (0.0, 0.0, 60.0, 60.0)), (1, 2, (-2.0, 5.0, 64.0, 10.0)), (2, 1, (0.0, 0.0, 60.0, 60.0)), (2, 2, (-2.0, 5.0, 64.1, 10.0))]
    assert sorted(map(tuple, boxes.not_contained(spark.createDataFrame(rows, box), "page", "k", "box").collect())) == [(1, 1), (2, 1), (2, 2)]


def test_empty_boxes_match_first(spark, tmp_path):
    """two empty boxes overlap by NaN, which SQL takes for the highest score."""
    rows = [(0, [0.0, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0, 0.1]), (2, [0.0, 0.0, 0.1, 0.1]), (3, [0.0, 0.0, 0.1, 0.1]), (4, [0.5, 0.5, 0.0, 0.0]), (5, [0.0] * 4), (6, [0.0, 0.0, 0.1, 0.2]), (7, [0.0, 0.0, 0.1, 0.3]), (8, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got, want = against_sql(spark, "match_greedy", box_plans.match_greedy, tmp_path, "embeddings")
    assert got == want and sum("nan" in r for r in got) == 2
    got, want = against_sql(spark, "geo_leaf_iou", box_plans.geo_leaf_iou, tmp_path, "embeddings")
    assert got == want


def test_signals_behind_a_long_page(spark, tmp_path):
    """the whole page counts, not its first 50000 characters."""
    x = spark.range(1, 13).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("word "), F.when(F.col("id") < 7, 20_000).otherwise(2).cast("int"))).alias("html"))
    x.write.parquet(f"file://{tmp_path}/pages.parquet")
    got, want = against_sql(spark, "txt_minified_assets", libraries.txt_minified_assets, tmp_path, "pages")
    assert got == want and len(got) == 12
