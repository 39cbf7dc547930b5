"""Sharding by a two-pass external shuffle.

Pass one counts rows by seeded hash bucket, which gives each bucket its place in the new order. Pass two scatters the
records into the buckets, each a few MB, and a Fisher-Yates shuffle permutes each bucket in memory. The new order is then
cut into shards whose row counts differ by one at most. Hashes are of doc_id and text together, so neither a hot text nor a
hot id fills a bucket; only rows that agree in both share one, and a bucket grows with the copies of such a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.text import quoted, text_of, without
from kinetrace.plans.shared import cut, shipped

SEED = 6
SHARDS = 8
BUCKET_BYTES = 8 << 20
#: Records are counted in this many hash classes; buckets are runs of them, so there are no more buckets than this.
CLASSES = 1 << 20
MOST_PARTITIONS = 100_000


def record_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), quoted("doc_id"), text_of())


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """All columns of docs and `position`, each number from 0 to rows - 1 once; and the number of rows.

    Takes doc_id, text and any other columns (one named position is replaced). Defined cases: nulls hash like values; equal
    records share a bucket and are told apart by nothing, so they may swap places; an empty table stays empty.
    """
    klass = F.pmod(record_hash(seed), F.lit(CLASSES))
    sizes = docs.groupBy(klass.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of()) + 1).alias("bytes"))
    sizes = cut(sizes)
    n, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, min(CLASSES, -(-total // bucket_bytes)))
    bucket = lambda c: F.expr(f"({c} * {buckets}L) div {CLASSES}L")
    counts = np.zeros(buckets, np.int64)
    for row in sizes.groupBy(bucket("class").alias("b")).agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["b"]] = row["n"]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])  # at most CLASSES numbers
    columns = without(docs, "position")

    def permute(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        table = table.take(pc.sort_indices(table, [("_order", "ascending"), ("_second", "ascending")]))
        order = np.random.Generator(np.random.PCG64([seed, b])).permutation(table.num_rows)  # Fisher-Yates
        out = table.select(names).take(pa.array(order))
        return out.append_column("position", pa.array(first[b] + np.arange(table.num_rows), pa.int64()))

    names = [f"c{i}" for i in range(len(columns))]
    scattered = docs.select(*[quoted(c).alias(x) for c, x in zip(columns, names, strict=True)], klass.alias("_class"), record_hash(seed + 1).alias("_order"), record_hash(seed + 2).alias("_second"))
    scattered = scattered.select(*names, bucket("_class").alias("_bucket"), "_order", "_second")
    schema = T.StructType([T.StructField(x, docs.schema[c].dataType) for c, x in zip(columns, names, strict=True)] + [T.StructField("position", T.LongType())])
    scattered = scattered.repartition(min(buckets, MOST_PARTITIONS), "_bucket")  # about a bucket each, whatever the session's number of shuffle partitions
    out = shipped(scattered).groupBy("_bucket").applyInArrow(permute, schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(columns, names, strict=True)], "position"), n


def shard(docs: DataFrame, n_shards: int = SHARDS, **options) -> DataFrame:
    """All columns of docs, and shard and slot: a seeded random permutation cut into n_shards runs, the first ones a row longer. Columns of those names are replaced.

    Defined cases are those of `shuffled`: nulls are values, equal records may swap places, an empty table stays empty; fewer rows than shards leave the last ones without any.
    """
    mine = docs.select(*[quoted(c) for c in without(docs, "shard", "slot")])
    out, n = shuffled(mine, **options)
    each, longer = divmod(n, n_shards)
    p, edge = F.col("position"), longer * (each + 1)
    number = F.when(p < edge, F.expr(f"position div {each + 1}L")).otherwise(F.lit(longer) + F.expr(f"(position - {edge}L) div {max(each, 1)}L"))
    out = out.withColumn("shard", number.cast("int"))
    first = F.when(F.col("shard") < longer, F.col("shard") * (each + 1)).otherwise(F.lit(edge) + (F.col("shard") - longer) * each)
    return out.withColumn("slot", (p - first).cast("long")).drop("position")


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """One folder a shard, its files in slot order."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_external_shuffle": op6_external_shuffle}
ORACLE: dict[str, str] = {}
