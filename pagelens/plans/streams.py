"""Queries of streaming jobs, run over what a table holds, and of keyed state."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..sources.sinks import scratch
from ..sources.tables import table
from ..streaming import ids, jobs
from .register import registrar

query, QUERIES, ORACLE_SQL = registrar()

LOG = "event_id long, ts timestamp, phase string, tokens long"


def _log(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), (F.col("event_id") % 50).alias("tokens"))


@query("SELECT event_id, event_type AS phase FROM events WHERE event_id % 50 > 10")
def st_incremental_emit(spark, sf):
    at = scratch(spark, "emit")
    _log(spark, sf).write.json(f"{at}/log")
    jobs.drain(jobs.json_stream(spark, f"{at}/log", LOG).where("tokens > 10").select("event_id", "phase"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("event_id long, phase string").parquet(f"{at}/out")


@query("SELECT event_id, event_type AS phase FROM events")
def st_checkpoint_resume(spark, sf):
    """Two runs under one checkpoint; the second takes only what came since."""
    at = scratch(spark, "resume")
    for k in (0, 1):
        _log(spark, sf).where(F.col("event_id") % 2 == k).write.mode("append").json(f"{at}/log")
        jobs.drain(jobs.json_stream(spark, f"{at}/log", LOG).select("event_id", "phase"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("event_id long, phase string").parquet(f"{at}/out")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS phase, count(*) AS calls, CAST(sum(event_id % 50) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def st_usage_log_stream(spark, sf):
    """Hourly sums that two runs update; the last state of each hour counts."""
    at = scratch(spark, "usage")
    for k in (0, 1):
        _log(spark, sf).where(F.col("event_id") % 2 == k).write.mode("append").json(f"{at}/log")
        jobs.drain_updates(jobs.usage_per_hour(jobs.json_stream(spark, f"{at}/log", LOG), "ts"), f"{at}/out", f"{at}/checkpoint")
    x = spark.read.parquet(f"{at}/out").groupBy("window", "phase").agg(F.max_by(F.struct("calls", "tokens"), "batch").alias("s"))
    return x.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH").alias("hour"), "phase", "s.calls", "s.tokens")


@query("SELECT event_type AS phase, count(*) AS n FROM events GROUP BY 1")
def st_counters(spark, sf):
    """Every record arrives twice; each key counts once."""
    at = scratch(spark, "counters")
    for k in (0, 1):
        _log(spark, sf).write.mode("append").json(f"{at}/log")
        jobs.drain(jobs.once_per_key(jobs.json_stream(spark, f"{at}/log", LOG), ["event_id"], "ts").select("event_id", "phase"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("event_id long, phase string").parquet(f"{at}/out").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'call-' || event_id END AS own FROM events) SELECT event_id, coalesce(own, first_value(coalesce(own, 'call-' || user_id || '-' || event_type)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS call_id FROM e")
def st_sse_id_fixer(spark, sf):
    """Pieces of calls in two halves of time under one checkpoint: an id that is missing is the first one of request and
    index, from the first half too, or a made one."""
    at = scratch(spark, "ids")
    own = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("call-"), F.col("event_id").cast("string")))
    x = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), own.alias("own"))
    middle = table(spark, sf, "events").agg(F.timestamp_micros(F.floor((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) + F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 2)).alias("middle"))
    for half in ("ts < middle", "ts >= middle"):
        x.join(F.broadcast(middle)).where(half).select(x.columns).write.mode("append").parquet(f"{at}/log")  # middle: one row
        stream = spark.readStream.schema(x.schema).parquet(f"{at}/log")
        jobs.drain(ids.with_stable_ids(stream, "user_id", "event_type", "ts", "event_id", "own", idle_s=10**9), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("place long, call_id string").parquet(f"{at}/out").select(F.col("place").alias("event_id"), "call_id")


@query("WITH l AS (SELECT event_type AS label, user_id % 16 AS level, count(*) AS n, count(*) FILTER (value > 300) AS n429 FROM events GROUP BY 1, 2), s AS (SELECT label, min(level) FILTER (n429 > 3) AS stop FROM l GROUP BY 1) SELECT label, level, n, n429, stop FROM l JOIN s USING (label) WHERE stop IS NULL OR level <= stop")
def st_ramp_limit(spark, sf):
    """Counts per label and level up to the first level that was limited."""
    level = table(spark, sf, "events").groupBy(F.col("event_type").alias("label"), (F.col("user_id") % 16).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 300).alias("n429"))
    stop = F.min(F.when(F.col("n429") > 3, F.col("level"))).over(W.partitionBy("label"))
    return level.withColumn("stop", stop).where("stop is null or level <= stop")
