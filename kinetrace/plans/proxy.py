"""Driver tables in the shapes of the data model: timelines, windows, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.operators.publish import global_index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as video frames: video is the user, frame the place in time order, pts the seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("video"), (F.row_number().over(order) - 1).alias("frame"), seconds().alias("pts"), "value", "event_type", "event_id")


def one_long_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of videos of which one, 0, holds half of all rows; frames are numbered without a window over a video."""
    events = read(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("video"), seconds().alias("pts"), "value", "event_type", "event_id")
    rows = global_index(events, ["video", "pts", "event_id"])
    first = rows.groupBy("video").agg(F.min("index").alias("_first"))
    return rows.join(first, "video").withColumn("frame", F.col("index") - F.col("_first")).drop("index", "_first")


#: The same in SQL, for oracles.
LONG = """frames AS (
  SELECT video, row_number() OVER (PARTITION BY video ORDER BY pts, event_id) - 1 AS frame, pts, value, event_type, event_id
  FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS video, epoch_us(ts) / 1e6 AS pts, value, event_type, event_id FROM events))"""

FRAMES = """frames AS (
  SELECT user_id AS video, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame,
         epoch_us(ts) / 1e6 AS pts, value, event_type, event_id FROM events)"""
