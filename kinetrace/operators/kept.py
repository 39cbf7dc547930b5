"""Aggregates that are kept by input file and merged, so that a new file is the only one that is read.

A folder holds partial states: moments (count, mean, sum of squared deviations, least, greatest) or counts, by group and
input file. A file is known by path, length and time of change. A refresh reads only listed files that have no state yet; a
result merges the states of the files that are listed now. So a file that is gone, or has changed, leaves the result without
anything being deleted, and a refresh that fails or runs twice changes nothing: a state counts once, from its first complete batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.plans.shared import same

FILE = ["path", "length", "changed"]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, length, changed of the Parquet files below root. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("changed"))


def partial_moments(rows: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """by, axis, n, mean, m2, least, greatest of each axis's values that aren't null."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("_v")) for a in axes]))).filter("_v IS NOT NULL")
    out = long.groupBy(*by, "axis").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
    return out.select(*by, "axis", "n", "mean", (F.col("_var") * F.col("n")).alias("m2"), "least", "greatest")


def merged_moments(states: DataFrame, by: list[str]) -> DataFrame:
    """The moments of the union of what the states are of. Squared deviations are moved to the common mean, so nothing cancels."""
    group = [*by, "axis"]
    means = states.groupBy(*group).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    moved = same(states, means, group).withColumn("_m2", F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    out = moved.groupBy(*group).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum("_m2").alias("m2"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return out.withColumn("std", F.sqrt(F.col("m2") / F.col("n")))


def partial_counts(rows: DataFrame, by: list[str], counters: dict[str, Column]) -> DataFrame:
    """by, counter, n: rows of which each condition is true, as a map in long form."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("counter"), F.coalesce(c, F.lit(False)).alias("_hit")) for k, c in counters.items()])))
    return long.groupBy(*by, "counter").agg(F.count_if("_hit").alias("n"))


def merged_counts(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by, "counter").agg(F.sum("n").alias("n"))


def _states(spark: SparkSession, folder: str) -> DataFrame | None:
    """All complete batches; of a file that several hold, the first's rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    first = rows.groupBy(*FILE).agg(F.min("batch").alias("batch"))
    return same(rows, first, [*FILE, "batch"])


def refresh(files: DataFrame, folder: str, partial: Callable[[DataFrame], DataFrame]) -> int:
    """Add the states of the listed files that have none, and say how many those are. partial takes rows with the file's path, length and changed, and must group by them.

    The list of new files passes through the driver, as it does in any read; a batch is written as one folder, which
    counts only once it is complete. A file without rows gets a state of its own with everything else null, so that it isn't read again.
    """
    spark = files.sparkSession
    held = _states(spark, folder)
    new = same(files, held.select(*FILE).distinct(), FILE, "left_anti") if held is not None else files
    paths = [r["path"] for r in new.select("path").collect()]
    if not paths:
        return 0
    rows = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("changed"))
    batch = uuid.uuid4().hex
    states = partial(rows)
    whole = same(new.select(*FILE), states.withColumn("_s", F.lit(True)), FILE, "left").drop("_s").withColumn("batch", F.lit(batch))
    whole.write.parquet(f"{folder}/batch-{batch}")
    return len(paths)


def current(files: DataFrame, folder: str) -> DataFrame | None:
    """The states of the files that are listed now; None if there never was a batch."""
    held = _states(files.sparkSession, folder)
    return same(held, files.select(*FILE).distinct(), FILE, "left_semi") if held is not None else None


def kept_moments(files: DataFrame, folder: str, by: list[str], axes: list[str]) -> DataFrame:
    """by, axis, n, mean, m2, least, greatest, std over all listed Parquet files; only those without a state are read. None of them with a value: no rows."""
    refresh(files, folder, lambda rows: partial_moments(rows, [*FILE, *by], axes))
    return merged_moments(current(files, folder).filter("n IS NOT NULL"), by)


def kept_counts(files: DataFrame, folder: str, by: list[str], counters: dict[str, Column]) -> DataFrame:
    """by, counter, n over all listed Parquet files; only those without a state are read."""
    refresh(files, folder, lambda rows: partial_counts(rows, [*FILE, *by], counters))
    return merged_counts(current(files, folder).filter("n IS NOT NULL"), by)
