"""Poses along whole episodes, whatever their length, by a segmented prefix product of their steps' transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions.matrices import matmul, rigid_inverse
from kinetrace.plans.shared import Scratch, shipped, stored

#: Steps folded in one row.
BLOCK = 256
#: Runs that are folded side by side.
RUNS = 64


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 4 x 4 matrices, terms added in the order of `matrices.matmul`."""
    out = a[..., :, 0, None] * b[..., None, 0, :]
    for k in range(1, 4):
        out = out + a[..., :, k, None] * b[..., None, k, :]
    return out


def folded(runs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each run of n transforms, the n + 1 products of its first 0 to n."""
    steps = np.broadcast_to(np.eye(4), (len(runs), max(map(len, runs)), 4, 4)).copy()
    for row, run in zip(steps, runs, strict=True):
        row[: len(run)] = run
    out = np.empty((len(runs), steps.shape[1] + 1, 4, 4))
    out[:, 0] = np.eye(4)
    for k in range(steps.shape[1]):
        out[:, k + 1] = multiplied(out[:, k], steps[:, k])
    return [x[: len(run) + 1] for x, run in zip(out, runs, strict=True)]


def _matrices(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4, 4)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.reshape(-1)))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of steps (_s) to their steps, products (16 numbers each, one more than steps) and whole product."""
    for whole in batches:
        for at in range(0, whole.num_rows, RUNS):
            batch = whole.slice(at, RUNS)
            runs = batch.column("_s")
            ends = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
            held = runs.flatten()
            steps, transforms = held.flatten()[0], _matrices(held.flatten()[1])
            products = folded([transforms[i:j] for i, j in zip(ends, ends[1:], strict=False)])
            made = [_lists(steps.to_numpy(zero_copy_only=False), list(np.diff(ends))), _lists(np.concatenate(products), [16 * len(x) for x in products]), _lists(np.stack([x[-1] for x in products]), [16] * len(products))]
            keys = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_s"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in keys], *made], [*[n for n, _ in keys], "_steps", "_products", "_whole"])


def _onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs' products, with what comes before the run (_base; null: nothing) multiplied in, a row a step."""
    for whole in batches:
        for at in range(0, whole.num_rows, RUNS):
            batch = whole.slice(at, RUNS)
            names = [n for n in batch.schema.names if n not in ("_steps", "_products", "_base")]
            sizes = batch.column("_steps").value_lengths().to_numpy(zero_copy_only=False)
            products, which = _matrices(batch.column("_products")), np.repeat(np.arange(len(sizes)), sizes + 1)
            if not batch.column("_base").null_count:
                products = multiplied(_matrices(batch.column("_base"))[which], products)
            firsts, lasts = np.ones(len(products), bool), np.ones(len(products), bool)
            ends = np.cumsum(sizes + 1)
            firsts[ends - 1], lasts[ends - sizes - 1] = False, False
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            made = [batch.column("_steps").flatten(), *[_lists(products[keep], [16] * int(sizes.sum())) for keep in (firsts, lasts)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(rows) for n in names], *made], [*names, "step", "before", "pose"])


def _prefixes(steps: DataFrame, group: list[str], block: int, temp: Scratch, level: int) -> DataFrame:
    runs = steps.groupBy(*group, F.floor(F.col("step") / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("step", "transform"))).alias("_s"))
    keys = T.StructType([f for f in runs.schema.fields if f.name != "_s"])
    numbers = T.ArrayType(T.DoubleType())
    blocks = temp.stored(shipped(runs).mapInArrow(_fold, T.StructType([*keys.fields, T.StructField("_steps", T.ArrayType(T.LongType())), T.StructField("_products", numbers), T.StructField("_whole", numbers)])), f"blocks{level}")
    most = blocks.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        joined = blocks.withColumn("_base", F.lit(None).cast(numbers))
    else:
        totals = blocks.select(*group, F.col("_block").alias("step"), F.col("_whole").alias("transform"))
        above = _prefixes(totals, group, block, temp, level + 1).select(*group, F.col("step").alias("_block"), F.col("before").alias("_base"))
        joined = blocks.join(above, [*group, "_block"])
    own = T.StructType([*[f for f in keys.fields if f.name in group], T.StructField("step", T.LongType()), T.StructField("before", numbers), T.StructField("pose", numbers)])
    return joined.select(*group, "_steps", "_products", "_base").mapInArrow(_onward, own)


def prefix_products(steps: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """group, step, before, pose: the products of a group's transforms (4 x 4, as 16 numbers) before each step and up to it. steps: group, step, transform.

    The product is associative: runs of `block` steps are folded each in its row, the runs' own products are scanned in the
    same way, one level up, and what precedes a run is multiplied in. A group of n steps takes log n / log block levels, and
    no row or task holds more than a run of it. Steps may have gaps, also before zero; one that repeats is taken in the order of its transforms.
    """
    with Scratch(steps.sparkSession) as temp:
        first = steps.agg(F.min("step")).first()[0] or 0  # counted from it, runs of runs come down to one; below zero they never would
        mine = steps.select(*group, (F.col("step") - first).cast("long").alias("step"), "transform")
        return stored(_prefixes(mine, group, block, temp, 0).withColumn("step", F.col("step") + first), "prefixes")


def episode_poses(steps: DataFrame, group: list[str], anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """group, anchor, step, pose: the pose of each step relative to its group's anchor steps, products after it and inverses before it. steps: each step's transform to the one before, rigid. anchors: group, anchor.

    A pose is inv(P_anchor) @ P_step, where P is the prefix product. An anchor that is no step of its group has no poses, nor has a group without anchor.
    """
    products = prefix_products(steps, group, block).drop("before")
    at = anchors.select(*group, F.col("anchor").cast("long").alias("step")).distinct().join(products, [*group, "step"]).select(*group, F.col("step").alias("anchor"), rigid_inverse(F.col("pose")).alias("_back"))
    return products.join(at, group).select(*group, "anchor", "step", matmul(F.col("_back"), F.col("pose")).alias("pose"))
