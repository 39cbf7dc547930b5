"""Shards published in jobs that a later run can take up: what is recorded is verified and kept, the rest is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from kinetrace.operators.publish import reconcile_counts, reshard
from kinetrace.plans.shared import cut

RECORDS = "run string, shard long, rows long, digest string, folder string"


def shard_digests(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """shard, rows, digest: of all rows with their places, whatever order they are read in. Summed in each task first, so a shard's rows don't meet."""
    digest = F.concat_ws(":", F.sum(F.xxhash64("index", *columns).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), "index", *columns)).cast("string"))
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The records of shards under path: none where nothing was published."""
    try:
        return spark.read.schema(RECORDS).parquet(f"{path}/_records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORDS)


def published_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the recorded shards, with index and shard. Folders that no record names, such as those of a job that died, are not read."""
    full = T.StructType([*schema.fields, T.StructField("index", T.LongType()), T.StructField("shard", T.LongType())])
    folders = [r["folder"] for r in recorded(spark, path).select("folder").distinct().collect()]  # one a job
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders]).select(*full.names)


def differing(a: DataFrame, b: DataFrame) -> int:
    """Shards whose rows or digests differ, or that one side lacks."""
    both = a.select("shard", F.struct("rows", "digest").alias("a")).join(b.select("shard", F.struct("rows", "digest").alias("b")), "shard", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).count()


def publish_shards(df: DataFrame, order: list[str], rows_a_shard: int, path: str, run: str, shards_a_job: int = 1000, most_jobs: int | None = None) -> DataFrame:
    """Publish df as contiguous shards of rows_a_shard rows in global order, and return shard, rows, state (kept or written) of what is published now.

    `run` names what makes the shards what they are (a fingerprint of the config): records of another run are an error. A
    run that finds records verifies them: they must be shards 0 to k - 1, the stored rows must have the digests recorded,
    and so must the same shards of df, or the run ends with an error and writes nothing. It then goes on at shard k. A job
    writes `shards_a_job` shards to a folder of its own and records them once what was written reads back alike, so a job
    that dies leaves a folder that nothing names. `most_jobs` ends the call early. Defined cases: an empty df publishes
    nothing; null values count in digests as values; rows that `order` doesn't tell apart must be equal, else a later run
    may place them otherwise and refuse.
    """
    spark, columns = df.sparkSession, df.columns
    done = cut(recorded(spark, path))
    if not done.filter(~F.col("run").eqNullSafe(F.lit(run))).isEmpty():
        raise ValueError("the shards there belong to a different run")
    n, last = done.agg(F.count_distinct("shard"), F.max("shard")).first()
    if n != done.count() or (n and last != n - 1):
        raise ValueError("the recorded shards are not a prefix")
    sharded = reshard(df, order, rows_a_shard)
    wanted = cut(shard_digests(sharded, columns))
    if n:
        if differing(shard_digests(published_shards(spark, path, df.schema), columns), done):
            raise ValueError("stored shards differ from their records")
        if differing(wanted.filter(F.col("shard") < n), done):
            raise ValueError("the input no longer gives the recorded shards")
    end = wanted.count()
    for job, first in enumerate(range(n, end, shards_a_job)):
        if job == most_jobs:
            break
        folder = f"_job={first:09d}-{uuid.uuid4().hex}"
        inside = F.col("shard").between(first, first + shards_a_job - 1)
        sharded.filter(inside).write.partitionBy("shard").parquet(f"{path}/{folder}")
        schema = T.StructType([*df.schema.fields, T.StructField("index", T.LongType()), T.StructField("shard", T.LongType())])
        stored = cut(shard_digests(spark.read.schema(schema).parquet(f"{path}/{folder}"), columns))
        if differing(stored, wanted.filter(inside)):
            raise ValueError("what was written does not read back alike")
        stored.select(F.lit(run).alias("run"), "shard", "rows", "digest", F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{path}/_records")
    return recorded(spark, path).select("shard", "rows", F.when(F.col("shard") < n, "kept").otherwise("written").alias("state"))


def finish(spark: SparkSession, path: str, schema: T.StructType, source: str, expected: DataFrame) -> DataFrame:
    """Mark the shards as complete if their rows by source are those of `expected` (source, expected); returns what differs. An earlier mark goes first."""
    spark.createDataFrame([], "rows long").write.mode("overwrite").json(f"{path}/_complete")
    off = cut(reconcile_counts(published_shards(spark, path, schema), expected, source))
    if off.isEmpty():
        recorded(spark, path).agg(F.sum("rows").alias("rows")).coalesce(1).write.mode("overwrite").json(f"{path}/_complete")
    return off


def complete(spark: SparkSession, path: str) -> bool:
    return not spark.read.schema("rows long").json(f"{path}/_complete").isEmpty()
