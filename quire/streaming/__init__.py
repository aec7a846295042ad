"""Streaming forms of the keyed state operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quire.operators.state import LIMIT, WINDOW_SECONDS, Window


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Admits attempts of a key; its state is a list of the admitted times in the window, limit of them at most."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t double")

    def hold(self, times: list[float]) -> None:
        """Keep these times, and wake when the last of them leaves the window."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if times:
            self.times.put([(float(t),) for t in times])
            self.handle.registerTimer(int((times[-1] + self.seconds) * 1000) + 1)
        else:
            self.times.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Times that a batch job admitted; a key's rows come one frame after another."""
        before = [t for (t,) in self.times.get()] if self.times.exists() else []
        self.hold(sorted([*before, *map(float, initialState["t"])])[-self.limit :])

    def handleInputRows(self, key, rows, timerValues):
        w = Window(self.limit, self.seconds)
        if self.times.exists():
            w.times.extend(t for (t,) in self.times.get())
        found = pd.concat(list(rows)).sort_values(["t", "seq"])
        found["ok"] = [w.admit(t) for t in found.t]
        self.hold(list(w.times))
        yield found[["key", "t", "seq", "ok"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        yield pd.DataFrame({"key": [], "t": [], "seq": [], "ok": []})

    def close(self) -> None:
        pass


def admitted_stream(attempts: DataFrame, limit: int = LIMIT, seconds: float = WINDOW_SECONDS, late: str = "1 hour", before: DataFrame | None = None) -> DataFrame:
    """Stream of attempts (key, t in epoch seconds, seq) with ok, as operators.state.admitted gives for a table.

    The state of a key is a list of its admitted times inside the window, limit of them at most; an event-time timer
    forgets keys that stay silent for a window as the watermark passes (a state TTL would go by the clock). Within a trigger
    attempts are taken by (t, seq); those that come later than the watermark are dropped.
    before: a table (key, t) of what was admitted earlier, such as operators.state.admitted has told, to start from.
    States are held in RocksDB, which this sets for the session.
    """
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    key = dict(attempts.dtypes)["key"]
    timed = attempts.select("key", "t", "seq", F.timestamp_seconds("t").alias("at")).withWatermark("at", late)
    start = None if before is None else before.select("key", F.col("t").cast("double").alias("t")).groupBy("key")
    return timed.groupBy("key").transformWithStateInPandas(
        Limiter(limit, seconds), f"key {key}, t double, seq long, ok boolean", "append", "eventtime", initialState=start
    )


def fold_progress(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep a published table (doc_id, idx, seq) of the last place in every document from a stream of such rows.

    Each trigger writes only the parts that hold its documents; a trigger that is repeated gives
    the same table. A row that is older than what the table has changes nothing.
    """
    from quire.sources.sinks import published, replace_documents

    def each(batch: DataFrame, _: int) -> None:
        rows, now = batch.select("doc_id", "idx", "seq"), published(batch.sparkSession, path)
        if now is not None:
            rows = rows.unionByName(now.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "idx", "seq"))
        replace_documents(rows.groupBy("doc_id").agg(F.max_by("idx", "seq").alias("idx"), F.max("seq").alias("seq")), path, buckets)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type; rows later than the watermark are dropped. ts must be a timestamp."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
