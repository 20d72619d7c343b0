"""Structured Streaming jobs: each takes what is available, then stops, and resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records appended as JSON files below a folder."""
    return spark.readStream.schema(schema).json(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all rows available to Parquet below path; files already done under this checkpoint are skipped."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes each batch of changed aggregates below path, by batch number: a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def usage_per_hour(stream: DataFrame, time: str, late: str = "60 days") -> DataFrame:
    """Calls and tokens per hour and phase; state of hours older than late is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"), "phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def once_per_key(stream: DataFrame, keys: list[str], time: str, late: str = "60 days") -> DataFrame:
    """The first row of each key; a repeat within the watermark's delay is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
