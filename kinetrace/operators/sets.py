"""Orders, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.publish import global_index
from kinetrace.operators.windows import stable_rank


def bounded_sample(members: DataFrame, seed: str, cap: int) -> DataFrame:
    """The first `cap` members of each source in stable rank order. members: source, member."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(stable_rank(seed, F.col("source"), F.col("member")), "member"))
    return members.withColumn("_p", place).filter(F.col("_p") <= cap).drop("_p")


def probe_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows 0, n / 2 and n - 1 of the order."""
    n = df.count()
    return global_index(df, order).filter(F.col("index").isin(sorted({0, n // 2, max(n - 1, 0)})))


def order_check(stored: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys whose place (index) in the stored table and in the manifest differ, or that only one of them has."""
    a, b = stored.select(key, F.col("index").alias("stored")), manifest.select(F.col(key).alias("_k"), F.col("index").alias("listed"))
    both = a.join(b, F.col(key) == F.col("_k"), "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("listed"))).select(F.coalesce(key, "_k").alias(key), "stored", "listed")


def seeded_shuffle(df: DataFrame, key: str, seed: str, epoch: int) -> DataFrame:
    """Each row's place in an order drawn from (seed, epoch, key): the same wherever it runs, another one each epoch."""
    return global_index(df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.col(key).cast("string")))), ["_h", key]).drop("_h")


def balanced_buckets(df: DataFrame, weight: str, key: str, n: int) -> DataFrame:
    """Largest first, to and fro over n buckets: loads differ by little, and no task sees all rows."""
    ranked = global_index(df.withColumn("_w", -F.col(weight)), ["_w", key]).drop("_w")
    lap, at = F.floor(F.col("index") / n), F.col("index") % n
    return ranked.withColumn("bucket", F.when(lap % 2 == 0, at).otherwise(n - 1 - at)).drop("index")


def examples(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def merge_partitions(parts: list[tuple[int, DataFrame, bool]]) -> DataFrame:
    """Union of partial results without repeats. Partition numbers must be 0 .. n - 1, once each, all complete."""
    numbers = sorted(p for p, _, _ in parts)
    if numbers != list(range(len(parts))) or not all(complete for _, _, complete in parts):
        raise ValueError(f"partitions {numbers} are not 0 to n - 1, complete, once each")
    return reduce(lambda a, b: a.unionByName(b), [df for _, df, _ in parts]).distinct()


def leakage(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(key, a, b, shared): for each kind of key and pair of splits, how many values both have."""
    long = rows.select(split, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))).filter("value IS NOT NULL")
    sets = long.groupBy("key", "value").agg(F.sort_array(F.collect_set(split)).alias("_s")).filter("size(_s) > 1")
    pairs = F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("key", F.inline(pairs)).groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def set_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, and keys that are not expected."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("unexpected")))


def union_keys(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select(key) for t in tables]).distinct()
