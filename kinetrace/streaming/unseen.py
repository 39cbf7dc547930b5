"""Keys not seen before, with state that is let go: a stateful processor with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinetrace.plans.shared import shipped

#: What transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = T.StructType([T.StructField("last", T.LongType())])


class Unseen(StatefulProcessor):
    """Emits a key the first time it comes, and late rows apart. A key's state holds its latest event time, and goes `keep_ms` after it. It has one timer, set when it comes, and set anew if it fires too early."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = (self.seen.get() or (None,))[0]
        last = held
        for batch in rows:
            times = batch["at_ms"]
            late = times[times < mark]
            if len(late):
                yield self.told(key, "late", late.tolist())
            good = times[times >= mark]
            if len(good):
                if last is None:
                    yield self.told(key, "new", [int(good.min())])
                last = max(int(good.max()), -1 if last is None else last)
        if last is not None and last != held:
            self.seen.update((last,))
            if held is None:  # a later time moves the timer only when it fires: each call costs a round trip
                self.handle.registerTimer(last + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.seen.get()[0] + self.keep_ms
        if due < timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
        else:
            self.handle.registerTimer(due)
        return iter(())

    def told(self, key, status: str, times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({**{f"k{i}": [k] * len(times) for i, k in enumerate(key)}, "at_ms": times, "status": status})

    def close(self) -> None:
        pass


def ingest_unseen(stream: DataFrame, keys: list[str], event_time: str, out: str, checkpoint: str, keep: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Write keys (status new, with the event time they came with), and rows older than the watermark (status late), as new files come.

    The state of a key goes `keep` after its latest event time has passed below the watermark, `late` behind the latest
    event; after that the key is new again. So the state holds the keys of about `keep` + `late`, whatever the length of the
    stream. A restart on the same checkpoint goes on with the same state. Late rows neither make a key new nor keep it.
    Rows without event time or with a null key are left out. The session's state store provider must be `ROCKS`.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    keep_ms = int(spark.sql(f"SELECT CAST(INTERVAL {keep} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000)
    marked = stream.withWatermark(event_time, late)
    # the time goes on as a number, without the watermark's mark: rows below it would else be dropped before they are seen
    rows = marked.filter(F.col(event_time).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.unix_millis(F.col(event_time).cast("timestamp")).alias("at_ms"))
    rows = rows.dropna(subset=[f"k{i}" for i in range(len(keys))])
    schema = T.StructType([*[T.StructField(f"k{i}", stream.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("at_ms", T.LongType()), T.StructField("status", T.StringType())])
    told = shipped(rows).groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(Unseen(keep_ms), schema, "Append", "EventTime")
    named = told.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_millis("at_ms").alias("at"), "status")
    return named.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
