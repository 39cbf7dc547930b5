"""Near-duplicate vectors by randomly rotated binary codes with stored correction factors.

A unit vector is rotated into more dimensions and keeps the signs, and how far they are from it: the inner product of code
and rotated vector. Dividing a code's product with another rotated vector by that factor estimates the true inner product
without bias, and the factor also bounds the error. Pairs whose upper bound is below the threshold are done; the others are
recomputed exactly, in double precision.

Rows are compared only under one label. Equal vectors are one class with a count. A label of up to CELL classes is one cell.
A larger one is dealt into cells by a few of its codes' bits, the more the larger it is, in as many tables as it takes for
a pair at the threshold to share a cell in one of them but for MISSED of all such pairs; a pair counts in the first table
where it does. So a class is compared with about CELL others a table, not with the whole label. Cells are dealt into blocks
of bounded size, and a task screens one block against another: it sends on no pairs, but each class's number of links and,
of the links it found, a spanning forest, which is all that components need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.llm.components import components
from kinetrace.llm.text import quoted
from kinetrace.plans.shared import Scratch, shipped, stored

SEED = 7
THRESHOLD = 0.93
BLOCK = 1024
#: Error bounds hold but for a share of about exp(-CERTAINTY**2 / 2) of pairs.
CERTAINTY = 6.0
CODE_BITS = 256
CELL = 8192
MISSED = 1e-6


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int) -> np.ndarray:
    """dimensions x bits, with orthonormal rows: a random rotation of the vectors padded to the number of bits."""
    bits = max(CODE_BITS, -(-dimensions // 64) * 64)
    gauss = np.random.Generator(np.random.PCG64([seed, dimensions])).standard_normal((bits, bits))
    q, r = np.linalg.qr(gauss)
    return (q * np.sign(np.diag(r)))[:dimensions]


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and their correction factors."""
    rotated = x @ rotation(x.shape[1], seed)
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])


def with_codes(classes: DataFrame, seed: int) -> DataFrame:
    """Add code and factor to classes; `dimensions` says how many components a vector has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            code, factor = [None] * table.num_rows, np.zeros(table.num_rows)
            sizes = table.column("dimensions").to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                packed, f = codes(unit_rows(table.column("embedding").take(pa.array(rows))), seed)
                factor[rows] = f
                for r, c in zip(rows, packed, strict=True):
                    code[r] = c.tobytes()
            yield from table.append_column("code", pa.array(code, pa.binary())).append_column("factor", pa.array(factor)).to_batches()

    return shipped(classes).mapInArrow(add, T.StructType([*classes.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType())]))


def forest(n: int, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all the given ones connect, fewer than n."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def screened(x: np.ndarray, y_code: np.ndarray, y_factor: np.ndarray, threshold: float, seed: int, certainty: float = CERTAINTY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of x, of y) whose inner product may reach the threshold."""
    turned = rotation(x.shape[1], seed)
    bits = turned.shape[1]
    signs = np.unpackbits(y_code, axis=1, count=bits).astype(np.float32) * 2 - 1
    estimate = ((x @ turned).astype(np.float32) @ signs.T) / (np.sqrt(bits) * y_factor).astype(np.float32)
    slack = np.sqrt((1 - y_factor**2).clip(0) / y_factor**2) * certainty / np.sqrt(bits - 1) + 1e-4
    return np.nonzero(estimate >= (threshold - slack).astype(np.float32))


def tables_for(bits: int, threshold: float) -> int:
    """How many tables of `bits` bits a pair at the threshold needs. Bits of one rotation aren't quite independent, so each is taken to differ a sixth more often."""
    agree = max(1 - 7 / 6 * math.acos(threshold) / math.pi, 0.05) ** bits
    return 1 if not bits else math.ceil(math.log(MISSED) / math.log1p(-agree))


def bands(n_bits: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """tables x bits: the places in the code that each table deals by."""
    rng = np.random.Generator(np.random.PCG64([seed, n_bits, bits]))
    return np.stack([rng.permutation(n_bits)[:bits] for _ in range(tables)])


def cells(sized: DataFrame, threshold: float, seed: int) -> DataFrame:
    """low, high, label, dimensions, bits, trial, cell: the cells of each class, one in each of its label's tables. Takes code and `bits`, the number of bits to deal by."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            size = np.array([len(c) for c in table.column("code").to_pylist()])
            k = table.column("bits").to_numpy()
            for n_bytes, bits in sorted({*zip(size.tolist(), k.tolist(), strict=True)}):
                rows = np.flatnonzero((size == n_bytes) & (k == bits))
                mine = table.take(pa.array(rows))
                signs = np.unpackbits(np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(rows), n_bytes), axis=1)
                for t, places in enumerate(bands(8 * n_bytes, bits, tables_for(bits, threshold), seed)):
                    cell = signs[:, places].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                    out = mine.drop_columns(["code"]).append_column("trial", pa.array(np.full(len(rows), t, np.int32))).append_column("cell", pa.array(cell))
                    yield from out.to_batches()

    fields = [f for f in sized.schema.fields if f.name != "code"]
    return shipped(sized).mapInArrow(deal, T.StructType([*fields, T.StructField("trial", T.IntegerType()), T.StructField("cell", T.LongType())]))


def link_blocks(coded: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(low, high, rep, links, other): a class's links in one pair of blocks (other null), and forest links (links 0, other a rep)."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        bits, trial, i, j = key[2].as_py(), key[3].as_py(), key[5].as_py(), key[6].as_py()
        block = table.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x = unit_rows(table.column("embedding"))
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        factor, times, rep = (table.column(c).to_numpy() for c in ("factor", "times", "rep"))
        a, b = screened(x[left], code[right], factor[right], threshold, seed)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        deals = np.zeros((trial, 8 * code.shape[1]), np.float32)
        for t, places in enumerate(bands(8 * code.shape[1], bits, tables_for(bits, threshold), seed)[:trial]):
            deals[t, places] = 1
        near = [np.zeros(0, bool)]
        for k in range(0, len(a), 65536):
            p, q = a[k : k + 65536], b[k : k + 65536]
            near.append(np.einsum("nd,nd->n", x[p], x[q]) >= threshold)
            if trial:  # not if they met in an earlier table
                found = np.flatnonzero(near[-1])
                met = (np.unpackbits(code[p[found]] ^ code[q[found]], axis=1).astype(np.float32) @ deals.T == 0).any(axis=1)
                near[-1][found[met]] = False
        near = np.concatenate(near)
        a, b = a[near], b[near]
        links = np.bincount(a, times[b], len(x)) + np.bincount(b, times[a], len(x))
        own = np.flatnonzero(links)
        kept = np.array(forest(len(x), a, b), np.int64).reshape(-1, 2)
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        rows = np.concatenate([own, kept[:, 0]])
        return pa.table({
            "low": low[rows], "high": high[rows], "rep": rep[rows],
            "links": np.concatenate([links[own], np.zeros(len(kept))]).astype(np.int64),
            "other": pa.array(np.concatenate([np.zeros(len(own), np.int64), rep[kept[:, 1]]]), mask=np.arange(len(rows)) < len(own)),
        })

    return shipped(coded).groupBy("label", "dimensions", "bits", "trial", "cell", "i", "j").applyInArrow(compare, "low long, high long, rep long, links long, other long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding (numbers, taken in the precision they come in), label.

    Defined cases: null vectors, zero ones, ones with null or non-finite components and ones with a null label are linked
    with nothing; vectors of different length are not compared; rows with null vec_id are linked with nothing, have a null
    component_id and are kept; rows with the same vec_id count as one vector with several values in components, each with
    its own links; other columns are not looked at; an empty table stays empty.
    """
    given = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "array<double>"
    mine = vectors.select(quoted("vec_id").cast("long").alias("vec_id"), quoted("embedding").cast(kind).alias("embedding"), quoted("label").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = mine.withColumn("low", F.when(usable, F.xxhash64(F.lit(1), "label", "embedding"))).withColumn("high", F.when(usable, F.xxhash64(F.lit(2), "label", "embedding")))
    classes = keyed.filter("low IS NOT NULL").groupBy("low", "high").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    with Scratch(vectors.sparkSession) as temp:
        classes = temp.stored(with_codes(classes.withColumn("dimensions", F.size("embedding")), seed), "codes")
        bits = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / cell)), F.lit(0)).cast("int")
        labels = temp.stored(classes.groupBy("label", "dimensions").agg(bits.alias("bits")), "labels")
        dealt = temp.stored(cells(classes.select("low", "high", "label", "dimensions", "code").join(labels, ["label", "dimensions"]), threshold, seed), "cells")
        at = ["label", "dimensions", "bits", "trial", "cell"]
        sizes = temp.stored(dealt.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "sizes")
        paired = dealt.join(sizes, at).withColumn("block", F.pmod(F.xxhash64("low", "high"), F.col("blocks")).cast("int"))
        paired = paired.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with"))
        paired = paired.drop("_with", "blocks").join(classes.drop("label", "dimensions"), ["low", "high"])
        found = temp.stored(link_blocks(paired, threshold, seed), "links")
        counts = found.filter("other IS NULL").groupBy("low", "high").agg(F.sum("links").alias("links"))
        named = components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), temp, "components")
        whole = classes.select("low", "high", "rep", "times").join(counts, ["low", "high"], "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
        whole = stored(whole.select("low", "high", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("_component")), "near_vectors")
    out = keyed.select("vec_id", "low", "high").join(whole, ["low", "high"], "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_rotated_codes": op7_rotated_codes}

ORACLE = {
    "op7_rotated_codes": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) ON node = vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id""",
}
