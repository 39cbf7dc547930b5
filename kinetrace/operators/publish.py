"""Sinks, publication and incremental recompute."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.plans.shared import cut, same, shared_dir, shipped, stored


def write_manifests(windows: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """One folder for each dataset and split; returns the counts that were written."""
    windows.write.mode("errorifexists").partitionBy("dataset", "split").format(fmt).save(path)
    return windows.sparkSession.read.format(fmt).schema(windows.schema).load(path).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("records"))


def global_index(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add each row's place in the global order. Rows move once, into sorted ranges of the order, as many as the session's shuffles have unless `parts` says; after that only counts by range move."""
    ranges = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt = cut(ranges.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))  # the ranges are sampled anew if the plan runs again
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))  # such numbers are the partition's, then the row's in it
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.col("_first") + F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    return dealt.join(F.broadcast(first), "_part").withColumn("index", place).drop("_part", "_id", "_first")


def reshard(df: DataFrame, order: list[str], rows_a_shard: int) -> DataFrame:
    """Contiguous shards of exactly n rows in global order; only the last is short."""
    return global_index(df, order).withColumn("shard", F.floor(F.col("index") / rows_a_shard))


def shard_counts(sharded: DataFrame, source: str) -> DataFrame:
    """Rows of each source in each shard."""
    return sharded.groupBy("shard", source).agg(F.count(F.lit(1)).alias("rows"))


def publish_if_valid(df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write df to a new folder under path; name it in path/_current only if every row of checks(what was written) has passed.

    A new attempt first takes the old marker away. checks returns (check, passed) rows, which are returned.
    """
    spark = df.sparkSession
    marker, data = f"{path}/_current", f"{path}/data-{uuid.uuid4().hex}"
    spark.createDataFrame([], "data string").write.mode("overwrite").json(marker)
    df.write.parquet(data)
    results = cut(checks(spark.read.schema(df.schema).parquet(data)))
    if results.filter("NOT coalesce(passed, false)").isEmpty():
        spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("overwrite").json(marker)
    return results


def publish_observed(df: DataFrame, path: str, measures: dict[str, Column], checks: Callable[[dict], dict[str, bool | None]]) -> DataFrame:
    """As publish_if_valid, with checks of measures that the writing job takes itself: one scan of df. Returns (check, passed).

    measures: aggregates without distinct, over all of df's rows; checks takes their values. `rows` is always there, and that it was written is a check of its own.
    """
    spark = df.sparkSession
    marker, data = f"{path}/_current", f"{path}/data-{uuid.uuid4().hex}"
    spark.createDataFrame([], "data string").write.mode("overwrite").json(marker)
    seen = Observation(f"publish-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).write.parquet(data)
    results = checks(seen.get)
    if all(p is True for p in results.values()):
        spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("overwrite").json(marker)
    return spark.createDataFrame(list(results.items()), "check string, passed boolean")


def published(spark, path: str) -> DataFrame | None:
    """The data the marker names, or None."""
    row = spark.read.schema("data string").json(f"{path}/_current").first()
    return spark.read.parquet(row["data"]) if row else None


def pending(inputs: DataFrame, done: DataFrame, fingerprint: list[str]) -> DataFrame:
    """Inputs without a finished row that agrees in the whole fingerprint; nulls agree."""
    return same(inputs, done.select(*fingerprint).distinct(), fingerprint, "left_anti")


def quarantine(df: DataFrame, fn: Callable[[dict], dict], out: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """Apply a plug-in to each row; failing rows become (key, error_type, message) and the job goes on. Returns (ok, failures)."""
    return quarantine_report(df, fn, out, key)[:2]


def quarantine_report(df: DataFrame, fn: Callable[[dict], dict], out: T.StructType, key: str) -> tuple[DataFrame, DataFrame, dict]:
    """quarantine's (ok, failures), and what the run came to: assigned, successful and failed rows, and whether it is complete (no failure, and as many successful rows as were assigned). The counts are taken by the job that applies the plug-in."""
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    got = fn(row)
                    rows.append([row[key], None, None, *[got[n] for n in names]])
                except Exception as e:  # a plug-in may raise anything; that is what is recorded
                    rows.append([row[key], type(e).__name__, str(e), *[None] * len(names)])
            yield pd.DataFrame(rows, columns=["_key", "error_type", "message", *names]).astype(object)

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("error_type", T.StringType()), T.StructField("message", T.StringType()), *[T.StructField(f.name, f.dataType) for f in out.fields]])
    given, got = Observation(f"assigned-{uuid.uuid4().hex}"), Observation(f"done-{uuid.uuid4().hex}")
    asked = shipped(df).observe(given, F.count(F.lit(1)).alias("assigned"))
    done = asked.mapInPandas(run, schema).observe(got, F.count_if(F.col("error_type").isNull()).alias("successful"), F.count_if(F.col("error_type").isNotNull()).alias("failed"))
    done = stored(done, "quarantine")
    report = {k: v or 0 for k, v in (given.get | got.get).items()}
    report["complete"] = report["failed"] == 0 and report["successful"] == report["assigned"]
    failures = done.filter("error_type IS NOT NULL").select(F.col("_key").alias(key), "error_type", "message")
    return done.filter("error_type IS NULL").select(F.col("_key").alias(key), *names), failures, report


def sampled_digest(content: Column, sample: int = 1 << 20) -> Column:
    """SHA-256 of size, first and last `sample` bytes."""
    size = F.octet_length(content)
    return F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, sample), F.substr(content, F.greatest(size - sample, F.lit(0)) + 1, F.lit(sample))), 256)


def config_digest(values: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])), 256)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with the keys of its structs and maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Compact JSON with sorted keys at every depth, and nulls written out: what json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) gives for texts, integers, booleans, nulls and plain decimals."""
    return F.to_json(canonical(value, kind), {"ignoreNullFields": "false"})


def nested_digest(df: DataFrame, value: str) -> Column:
    """SHA-256 of a nested config column's canonical JSON."""
    return F.sha2(canonical_json(F.col(value), df.schema[value].dataType), 256)


def reconcile_counts(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ, missing and unknown keys among them, and one row for the total (key null) if that differs."""
    counted = observed.groupBy(key).agg(F.count(F.lit(1)).alias("observed"))
    both = counted.join(expected.select(F.col(key).alias("_k"), F.col("expected")), F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    rows = both.select(F.coalesce(key, "_k").alias(key), F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected"))
    total = rows.agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")).select(F.lit(None).cast(observed.schema[key].dataType).alias(key), "observed", "expected")
    return rows.unionByName(total).filter("observed <> expected")


def scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
