"""Vector codes: each part of a vector is named by the nearest entry of its codebook, found by equal-average search.

A codebook's entries are sorted by the sum of their components. The search for a part's nearest entry starts where its own
sum falls and expands outward, the nearer side first. By Cauchy and Schwarz, the squared gap of two sums over the number of
components is at most the squared distance; so once that strictly exceeds the best distance, no entry further out can be
nearer or tie, and the search ends. All arithmetic is on integers, so codes, ties and errors are exact.

A round is one pass over the vectors: each task adds up its own vectors by entry, so that a table of the size of the
codebooks leaves it, whatever entries are frequent. Only codebooks pass through the driver: `entries` times the length of a
vector, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.integer_vectors import SCALE, clamped, integers, largest
from kinetrace.plans.shared import Scratch, same, shipped, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
FAR = 2**62


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (the smaller index in a tie), its squared distance, and how many distances were worked out."""
    n, width = x.shape
    sums = book.sum(axis=1)
    order = np.lexsort((np.arange(len(book)), sums))
    ladder, own = sums[order], x.sum(axis=1)
    right = np.searchsorted(ladder, own)
    left = right - 1
    best, code, live, tried = np.full(n, FAR), np.zeros(n, np.int64), np.arange(n), 0
    while live.size:
        below, above = left[live], right[live]
        down = np.where(below >= 0, own[live] - ladder[below.clip(0)], FAR)
        up = np.where(above < len(book), ladder[above.clip(None, len(book) - 1)] - own[live], FAR)
        gap, low = np.minimum(down, up), down <= up
        bound = -(-(gap.clip(None, 2**31) ** 2) // width)  # a distance is an integer, so the bound may be rounded up
        going = (gap < FAR) & (bound <= best[live])
        live, low = live[going], low[going]
        entry = order[np.where(low, below[going], above[going])]
        distance = ((x[live] - book[entry]) ** 2).sum(axis=1)
        tried += live.size
        better = (distance < best[live]) | ((distance == best[live]) & (entry < code[live]))
        best[live[better]], code[live[better]] = distance[better], entry[better]
        left[live[low]] -= 1
        right[live[~low]] += 1
    return code, best, tried


def parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """vectors x parts x width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and errors, both vectors x parts."""
    found = [nearest(x[:, p], books[p])[:2] for p in range(len(books))]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width, from the vectors of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).select("values").collect()
    return np.array([r["values"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts that are nearest to it; unused ones stay."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = parts_of(batch.column(0), parts)
            code, _ = assigned(x, books)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = shipped(rows).select("values").mapInArrow(add_up, "part long, entry long, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    out = books.copy()
    for r in sums.collect():  # at most parts times entries rows
        out[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Add code and error."""
    parts = len(books)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = assigned(parts_of(batch.column("values"), parts), books)
            names = [r.tobytes().hex() for r in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns("values").columns, pa.array(names, pa.string()), pa.array(error.sum(axis=1))], [*[c for c in batch.schema.names if c != "values"], "code", "error"])

    kept = rows.drop("values")
    return shipped(rows).mapInArrow(name, kept.schema.add("code", "string").add("error", "long"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def length_of(rows: DataFrame, parts: int) -> int:
    """The commonest length that can be cut into equal parts, the smaller in a tie; 0 if there is none."""
    sizes = rows.groupBy(F.size("values").alias("d")).count().filter(f"d > 0 AND d % {parts} = 0")
    found = sizes.orderBy(F.col("count").desc(), "d").first()
    return found["d"] if found else 0


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row of vec_id, embedding, label.

    Codebooks start as the parts of the `entries` (at most 256) vectors of the smallest vec_id, nulls last, equal ids by
    their components, and are improved `rounds` times.

    Defined cases: null vectors and ones with null or non-finite components are dropped; so are vectors of another length
    than most of those that `parts` divides, as empty ones; fewer vectors than entries make smaller codebooks; rows with
    equal or null vec_id are vectors of their own; null labels are one label; integers beyond `largest` (2^27 for 64
    components) are clamped; other columns are not looked at; an empty table stays empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must fit into two hex digits")
    with Scratch(vectors.sparkSession) as temp:
        rows = temp.stored(integers(vectors, scale, "vec_id", "label"), "vectors")
        d = length_of(rows, parts)
        rows = rows.filter(F.size("values") == d if d else F.lit(False)).withColumn("values", clamped(largest(max(d, 1), max(d // parts, 1))))
        books = first_books(rows, parts, entries) if d else np.zeros((parts, 0, 1), np.int64)
        for _ in range(rounds if d else 0):
            books = improved(rows, books)
        codes = temp.stored(coded(rows, books), "codes")
        by_label = temp.stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
        out = same(codes, by_label, ["label"], "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
        return stored(out, "vector_codes")


def op11_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_equal_average_codes": op11_equal_average_codes}


def _sql() -> str:
    """Rounds written one after the other; v has a row a part, b0 to b2 a row an entry."""
    width = f"(len(e) // {PARTS})"
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, p, e[p * {width} + 1:(p + 1) * {width}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, k, x AS c FROM v JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS k FROM kept QUALIFY k < {ENTRIES}) USING (r))",
    ]
    near = """a{k} AS MATERIALIZED (
  SELECT r, p, x, min(struct_pack(d := d, k := k)) AS m
  FROM (SELECT r, v.p, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN b{k} b ON v.p = b.p) GROUP BY ALL)"""
    for k in range(ROUNDS):
        ctes.append(near.format(k=k))
        ctes.append(f"""m{k} AS (
  SELECT p, k, list(mean ORDER BY i) AS c
  FROM (SELECT p, m.k AS k, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS mean FROM (SELECT p, m, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL)""")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, k))")
    ctes.append(near.format(k=ROUNDS))
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    ctes.append(f"book AS (SELECT sha256(string_agg(y, ',' ORDER BY p, k, i)) AS h FROM (SELECT p, k, unnest(c)::VARCHAR AS y, unnest(range(len(c))) AS i FROM b{ROUNDS}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book"


ORACLE = {"op11_equal_average_codes": _sql()}
