"""What several operators share: shared-folder tables, ordered prefix sums, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, Window as W

#: Characters that separate words, and the words between them (Java regex).
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one in a local
    session, and an error on a cluster, whose machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pagelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id as text, modulo modulus, equals remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds, for each name: column in sums, the column's sum over all rows that sort before the row.

    Range partitions are summed on their own; only one row per partition is gathered to give each its
    offset, so no task sees all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(totals, "_part").withColumns(
        {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{k}") for k, c in sums.items()}
    )
    return out.drop("_part", *[f"_o_{k}" for k in sums])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Nodes of undirected edges (a, b) with the smallest node reachable: columns node, root.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each step is a grouped minimum
    with map-side combining and a join that adaptive execution can split. Ends when a round changes
    nothing, as count and hash of the edges it writes tell. Null and self edges go.
    """
    e, last = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        seen = Observation()
        e = written(new.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        if seen.get == last:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.distinct())
        last = seen.get
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
