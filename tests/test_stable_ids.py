"""Keyed state of st_sse_id_fixer: what it holds, and when it goes."""

from datetime import datetime, timedelta, timezone

from pagelens.sources.sinks import scratch
from pagelens.streaming import ids

SCHEMA = "place long, request long, index string, ts timestamp, own string"


def runs(spark, batches, idle_s):
    """call_id by place after runs under one checkpoint, and the rows of state after each."""
    at, sizes = scratch(spark, "stable"), []
    for rows in batches:
        rows = [(p, r, i, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s), own) for p, r, i, s, own in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/log")
        stream = ids.with_stable_ids(spark.readStream.schema(SCHEMA).parquet(f"{at}/log"), "request", "index", "ts", "place", "own", late="0 seconds", idle_s=idle_s)
        job = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
        job.awaitTermination()
        sizes.append(job.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {r["place"]: r["call_id"] for r in spark.read.parquet(f"{at}/out").collect()}, sizes


def test_state_is_one_value_a_request(spark):
    """However many indices it has: each call of the state store costs more than the pieces (before: a value and a timer an index)."""
    names = [f"i{k}" for k in range(20)]
    first = [(100 * r + k, r, n, 10 + k, f"x-{r}-{k}" if k % 2 else None) for r in range(3) for k, n in enumerate(names)]
    second = [(1000 + p, r, n, 100 + s, "own" if k == 5 else None) for k, (p, r, n, s, _) in enumerate(first)]
    got, sizes = runs(spark, [first, second], 10**9)
    made = {p: own or f"call-{r}-{n}" for p, r, n, _, own in first}
    assert got == made | {1000 + p: c for p, c in made.items()} | {1005: "own"}
    assert max(sizes) <= 3 * 3


def test_idle_indices_are_forgotten(spark):
    batches = [
        [(1, 1, "a", 10, "x"), (2, 1, "a", 9, None), (3, 3, "a", 10, "old")],  # 9 s comes first and has none
        [(4, 1, "a", 40, None), (5, 1, "b", 41, "z"), (6, 3, "b", 65, "kept")],
        [(7, 2, "a", 99, None)],  # 3 a is idle for more than 60 s, 1 a and 1 b are not yet
        [(8, 3, "a", 100, "new"), (9, 3, "a", 101, None), (10, 3, "b", 102, None), (11, 1, "b", 100, None), (12, 2, "a", 103, None)],
        [(13, 2, "a", 1000, None)],
        [(14, 1, "b", 1001, "again"), (15, 1, "b", 1002, None), (16, 2, "a", 1003, None)],
    ]
    got, sizes = runs(spark, batches, 60)
    assert got == {
        1: "x", 2: "call-1-a", 3: "old", 4: "call-1-a", 5: "z", 6: "kept", 7: "call-2-a", 8: "new", 9: "new", 10: "kept",
        11: "z", 12: "call-2-a", 13: "call-2-a", 14: "again", 15: "again", 16: "call-2-a",
    }
