"""Writers, and the shared folder in which queries write what they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pagelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


#: Rows of a CSV file at most: cells may hold line breaks, so a file is read by one task.
FILE_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """The named columns as headed CSV in files of FILE_ROWS rows at most, quoted so that any text comes back; other
    columns are left out."""
    out = df.select(*columns).write.mode("append" if append else "errorifexists").option("maxRecordsPerFile", FILE_ROWS)
    out.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line, null fields included."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)


def summary_json(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row: a JSON object of value by key, keys sorted. For summaries of few keys, as it is one row."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("summary"))


def write_together(df: DataFrame, path: str, batch: int, key: str, columns: list[str]) -> None:
    """JSONL, CSV and, at the end, the keys done of one batch, each below its own folder of the batch's number.

    The keys are the mark: a reader takes only batches found below done, so a batch counts in all three
    or in none; writing it again replaces it. For streams call it in foreachBatch.
    """
    df.write.mode("overwrite").json(f"{path}/records/batch={batch}")
    df.select(*columns).write.mode("overwrite").csv(f"{path}/table/batch={batch}", header=True, quote='"', escape='"')
    df.select(key).distinct().write.mode("overwrite").parquet(f"{path}/done/batch={batch}")
