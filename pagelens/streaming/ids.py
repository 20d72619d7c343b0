"""Stable ids of calls that arrive in pieces: keyed state that outlives a batch and goes by a timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StableIds(StatefulProcessor):
    """Pieces without an id get the one of their request and index: that of its first piece, or a made one if that has
    none. Pieces with an id keep it. State is one value a request, which holds its indices, as each call of the state
    store costs more than the pieces; an index is forgotten when it is idle, by a timer that looks again if it isn't."""

    def __init__(self, idle_s: int):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "names array<string>, calls array<string>, latest array<long>, timer long")

    def keep(self, calls: dict, latest: dict, timer: int | None) -> None:
        """Writes the indices of a request; its timer is due when the first of them may be idle, or before that."""
        due = min(latest.values()) + self.idle_ms
        if timer is not None and due < timer:
            self.handle.deleteTimer(timer)
            timer = None
        if timer is None:
            self.handle.registerTimer(due)
            timer = due
        self.known.update((list(calls), list(calls.values()), [latest[k] for k in calls], timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.known.get()
        names, calls, times, timer = found if found else ((), (), (), None)
        calls, latest = dict(zip(names, calls)), dict(zip(names, times))
        pieces, first = [], {}
        for _, index, _, at, place, own in rows:  # one request's pieces of one batch
            pieces.append((index, place, own))
            if index not in calls and (index not in first or (at, place) < first[index][:2]):
                first[index] = at, place, own
            if at > latest.get(index, at - 1):
                latest[index] = at
        for index, (_, _, own) in first.items():
            calls[index] = own if own is not None else f"call-{key[0]}-{index}"
        self.keep(calls, latest, timer)
        for index, place, own in pieces:
            yield Row(place=place, call_id=own if own is not None else calls[index])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names, calls, times, _ = self.known.get()
        now = timerValues.getCurrentWatermarkInMs()
        latest = {k: t for k, t in zip(names, times) if t + self.idle_ms > now}
        if latest:
            self.keep({k: c for k, c in zip(names, calls) if k in latest}, latest, None)
        else:
            self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_stable_ids(stream: DataFrame, request: str, index: str, time: str, place: str, own: str, late: str = "1 hour", idle_s: int = 86_400) -> DataFrame:
    """place and call_id of every piece of a stream; see StableIds. time orders pieces (place breaks ties); pieces later
    than the watermark are dropped, and an index of a request is forgotten when the watermark is idle_s past its last
    piece. A request's pieces of one batch and its indices are one task's."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = stream.schema[place].dataType.simpleString()
    x = stream.withWatermark(time, late).selectExpr(f"`{request}` AS request", f"CAST(`{index}` AS STRING) AS index", time, f"unix_millis(CAST({time} AS TIMESTAMP)) AS at", f"`{place}` AS place", f"`{own}` AS own")
    return x.groupBy("request").transformWithState(StableIds(idle_s), f"place {kind}, call_id string", "Append", "EventTime")
