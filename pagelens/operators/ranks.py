"""Places of rows in an order, by range partitions: no task holds a group, and no sort is of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..sources.sinks import scratch


#: Rows of a piece about: a task's share of a table, however large that is.
PIECE = 500_000


def in_pieces(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as its rows ask for, so that a window over keys sorts a bounded share.
    Rows are counted first; for tables as they are read that is their metadata."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIECE))
    return df.repartition(n, *keys)


def placed(df: DataFrame, group: list[str], order: list, place: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 0, and the group's size as n.

    Rows are dealt to ranges of (group, order) and numbered within each; of a range only one row per group
    is summed up to give the ranges their offsets. Ties in the order are numbered in any way.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    path = scratch(spark, "ranges")
    df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    sizes = parts.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_m"))
    own = W.partitionBy(*group).orderBy("_range")  # a row per range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("n", F.sum("_m").over(W.partitionBy(*group)))
    sizes = sizes.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group], "_before", "n")
    inside = F.row_number().over(W.partitionBy("_range", *group).orderBy(*order)) - 1
    x = parts.withColumn("_inside", inside)
    on = x["_range"] == sizes["_r"]
    for g in group:
        on = on & x[g].eqNullSafe(sizes[f"_g_{g}"])
    return x.join(sizes, on).withColumn(place, F.col("_inside") + F.col("_before")).select(*df.columns, place, "n")


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df dealt to ranges of the order, as a table with the range's number as _range."""
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def neighbours(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, key, value, before and after: the values next to each row's in its group, in the order of value, then
    key (null at the ends), and low and high, the group's least and greatest.

    Rows look at their neighbours within a range; only the two rows at a range's borders are exchanged.
    """
    x = ranged(df.select(group, key, value), group, value, key)
    ends = x.groupBy(group, "_range").agg(F.min(F.struct(value, key)).alias("a"), F.max(F.struct(value, key)).alias("b"))
    ranges, whole = W.partitionBy(group).orderBy("_range"), W.partitionBy(group)  # a row per range
    ends = ends.select(
        F.struct(F.col(group).alias("g"), F.col("_range").alias("r")).alias("_at"), F.lag(F.col("b")[value]).over(ranges).alias("_before"), F.lead(F.col("a")[value]).over(ranges).alias("_after"),
        F.min(F.col("a")[value]).over(whole).alias("low"), F.max(F.col("b")[value]).over(whole).alias("high"),
    )
    own = W.partitionBy(group, "_range").orderBy(value, key)
    x = x.withColumns({"_first": F.row_number().over(own) == 1, "before": F.lag(value).over(own), "after": F.lead(value).over(own), "_last": F.lead(key).over(own).isNull()})
    x = x.withColumn("_at", F.struct(F.col(group).alias("g"), F.col("_range").alias("r"))).join(ends, "_at")
    before, after = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("before")), F.when(F.col("_last"), F.col("_after")).otherwise(F.col("after"))
    return x.select(group, key, value, before.alias("before"), after.alias("after"), "low", "high")
