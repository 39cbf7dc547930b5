"""Centroid clustering by Lloyd's rounds with both vectors and centroids cut by dimension.

The vectors are stored as column blocks. A task of a block holds a slice of vectors and the slice of the centroids with the
same columns, and works out exact partial distances to all centroids. Those are added by vector, which gives the nearest
centroid. The assignment goes back to the blocks, where each slice of the centroids is updated from its own columns alone:
a task adds up by (block, cluster) before anything moves, so that a cluster with a third of all vectors is no hot group.

Blocks are written bucketed by vector, and so is the assignment: what goes back moves no vector. A vector's partial
distances are `clusters` longs a block, which is what a round shuffles. Only centroids pass through the driver, `clusters`
times the length of a vector, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.integer_vectors import SCALE, clamped, integers, largest
from kinetrace.plans.shared import Scratch, shipped, stored

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Columns of a block.
BLOCK = 16
#: Vectors compared at once in a task.
TOGETHER = 2048


def partial_distances(slices: DataFrame, centres: np.ndarray) -> DataFrame:
    """row, part: squared distances of one block's vectors (row, values) to the same columns of all centroids."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        for batch in batches:
            x = batch.column("values").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            for at in range(0, len(x), TOGETHER):
                part = ((x[at : at + TOGETHER, None, :] - centres[None]) ** 2).sum(axis=2)
                rows = batch.column("row").slice(at, len(part))
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, k), pa.int32()), pa.array(part.ravel()))], ["row", "part"])

    return shipped(slices).select("row", "values").mapInArrow(compare, "row long, part array<long>")


def nearest(blocks: DataFrame, centres: list[np.ndarray], buckets: int) -> DataFrame:
    """row, cluster, distance: partial distances added over the blocks, and the least of the sums (the smaller number in a tie). One shuffle, by row."""
    parts = [partial_distances(blocks.filter(F.col("block") == b), c) for b, c in enumerate(centres)]
    together = reduce(DataFrame.unionByName, parts).repartition(buckets, "row")
    sums = together.groupBy("row").agg(F.array(*[F.sum(F.get("part", F.lit(k))) for k in range(len(centres[0]))]).alias("_sums"))
    return sums.select("row", (F.array_position("_sums", F.array_min("_sums")) - 1).cast("int").alias("cluster"), F.array_min("_sums").alias("distance"))


def updated(blocks: DataFrame, found: DataFrame, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Each block's slice of the centroids from its own columns: the floored mean of a cluster's vectors; an empty cluster's stays."""
    width = max(c.shape[1] for c in centres)
    sums = blocks.join(found, "row").groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("values", F.lit(i)).cast("long")) for i in range(width)]).alias("total"))
    out = [c.copy() for c in centres]
    for r in sums.collect():  # at most a row a block and cluster
        b = r["block"]
        out[b][r["cluster"]] = [t // r["n"] for t in r["total"][: out[b].shape[1]]]
    return out


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of vec_id, embedding.

    Centroids start as the kept vectors with the smallest sha256 of `seed:vec_id`, and take `rounds` updates.

    Defined cases: null vectors, ones with null or non-finite components and ones that have not exactly `dimensions` are
    dropped; rows with equal vec_id are vectors of their own (as first centroids, in the order of their components), a null
    vec_id is hashed as `null`; fewer vectors than clusters make fewer clusters; integers beyond `largest` (2^27 for 64
    components) are clamped; other columns are not looked at; an empty table stays empty.
    """
    spark, width = vectors.sparkSession, min(block, dimensions)
    with Scratch(spark) as temp:
        kept = integers(vectors, scale, "vec_id").filter(F.size("values") == dimensions).withColumn("values", clamped(largest(dimensions, 1)))
        rows = temp.stored(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
        order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
        first = rows.select(order.alias("_h"), "values").orderBy("_h", "values").limit(clusters).collect()
        if not first:
            return stored(rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]), "clusters")
        whole = np.array([r["values"] for r in first], np.int64)
        centres = [whole[:, at : at + width] for at in range(0, dimensions, width)]
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut_up = F.array(*[F.struct(F.lit(b).alias("block"), F.slice("values", b * width + 1, width).alias("values")) for b in range(len(centres))])
        blocks = temp.bucketed(rows.select("row", F.inline(cut_up)), "blocks", ["row"], buckets, by="block")
        for _ in range(rounds):
            found = temp.bucketed(nearest(blocks, centres, buckets), "assigned", ["row"], buckets)
            centres = updated(blocks, found, centres)
        found = temp.bucketed(nearest(blocks, centres, buckets), "assigned", ["row"], buckets)
        inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
        lines = [",".join(map(str, np.concatenate([c[k] for c in centres]).tolist())) for k in range(len(whole))]
        said = [(k, s, sum(inertia.values()), hashlib.sha256(lines[k].encode()).hexdigest()) for k, s in inertia.items()]
        said = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        out = rows.select("row", "vec_id").join(found, "row").join(F.broadcast(said), "cluster")  # at most `clusters` rows
        return stored(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_sharded_lloyd": op12_sharded_lloyd}


def _sql() -> str:
    """Rounds written one after the other; c0 to c5 have a row a centroid."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), e) - 1 AS k, e AS c FROM v QUALIFY k < {CLUSTERS})",
    ]
    near = """a{k} AS MATERIALIZED (
  SELECT r, e, min(struct_pack(d := d, k := k)) AS m
  FROM (SELECT r, e, k, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k}) GROUP BY ALL)"""
    for k in range(ROUNDS):
        ctes.append(near.format(k=k))
        ctes.append(f"""m{k} AS (
  SELECT k, list(mean ORDER BY i) AS c
  FROM (SELECT m.k AS k, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean FROM (SELECT m, unnest(e) AS y, unnest(range(len(e))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL)""")
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, b.c) AS c FROM c{k} b LEFT JOIN m{k} m USING (k))")
    ctes.append(near.format(k=ROUNDS))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} ON a.m.k = c{ROUNDS}.k"""


ORACLE = {"op12_sharded_lloyd": _sql()}
