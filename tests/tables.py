"""Small tables in a folder, for queries."""

from __future__ import annotations

from pyspark.sql import functions as F


def written(spark, folder, **tables) -> str:
    """tables: name=(rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def events(spark, folder, rows) -> str:
    """rows: event_id, user_id, seconds, event_type, value."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, seconds int, event_type string, value double")
    df.withColumn("ts", F.expr("timestampadd(SECOND, seconds, TIMESTAMP_NTZ '2024-01-01 00:00:00')")).drop("seconds").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)
