"""Resumable incremental work as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_requests(stream: DataFrame, keys: list[str], out: str, checkpoint: str, event_time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Write keys not seen before, as new files come. A restart on the same checkpoint never writes a key again.

    Without an event time the state holds every key; with one it holds those of the last `late` alone.
    """
    if event_time:
        fresh = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys).select(*keys)
    else:
        fresh = stream.select(*keys).dropDuplicates(keys)
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def incremental_counters(stream: DataFrame, source: str, reason: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Running kept and excluded counts by source and reason. Each batch writes the whole audit table anew under its number, so a repeated batch replaces itself."""
    counts = stream.groupBy(F.col(source), reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def latest_counters(spark, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").drop("batch")
