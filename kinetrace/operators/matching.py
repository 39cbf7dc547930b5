"""One-to-one matching of windows whose arrays agree within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinetrace.functions.exprs import all_finite
from kinetrace.operators.publish import global_index
from kinetrace.plans.shared import Scratch, shipped, stored

#: A key with at most so many rows on both sides is matched within a task, together with its neighbours in the order of keys.
WHOLE = 2048
#: Pairs whose errors a task works out at once.
PAIRS = 1 << 20
#: Pairs of a class are written out in runs of so many, so that no array grows with the class.
RUN = 4096


def max_abs_error(x: str, y: str) -> Column:
    """Greatest absolute difference of two arrays; null where their lengths differ."""
    return F.when(F.size(x) == F.size(y), F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))), F.lit(0.0)))


def widest(rows: DataFrame, value: str, n: int) -> list[int]:
    """The places of `n` coordinates that spread most, of arrays as long as most are."""
    found = rows.groupBy(F.size(value).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if not found or not found["n"]:
        return []
    spread = rows.agg(*[F.coalesce(F.stddev_pop(F.get(value, i)), F.lit(0.0)).alias(f"s{i}") for i in range(found["n"])]).first()
    return sorted(range(found["n"]), key=lambda i: (-spread[i], i))[:n]


def both_sides(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value, a, b (the id of the own side), side (0 or 1) of all rows that can be matched: without null keys, and finite throughout."""
    ids = [F.col("id"), F.lit(None)]
    sides = [df.select(*key, F.col(value).cast("array<double>").alias("value"), *[ids[k != i].cast(of.schema["id"].dataType).alias(c) for k, (c, of) in enumerate((("a", a), ("b", b)))], F.lit(i).alias("side")) for i, df in enumerate((a, b))]
    there = reduce(Column.__and__, [F.col(c).isNotNull() for c in key], all_finite(F.col("value")))
    return sides[0].unionByName(sides[1]).filter(there)


def hashed(name: str, *of: str) -> dict[str, Column]:
    return {f"_{name}{seed}": F.xxhash64(F.lit(seed), *of) for seed in (1, 2)}


def starts_of(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Places where a row differs from the one before it, and 0."""
    differs = np.zeros(max(0, table.num_rows - 1), bool)
    for c in columns:
        v = table.column(c).to_numpy()
        differs |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def matched_keys(table: pa.Table, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of either side that are paired, and their errors, in a table of whole keys, each sorted by side, class and id."""
    start = starts_of(table, ["_k1", "_k2", "side", "_h1", "_h2"])
    size, side = np.diff(np.append(start, table.num_rows)), table.column("side").to_numpy()[start]
    rep = np.zeros(len(start), np.int64)
    for k, c in enumerate("ab"):  # null ids count only where a class has no others, and then come first
        ids = table.column(c).combine_chunks()
        rank = np.where(ids.is_valid().to_numpy(False), pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64), table.num_rows + 1)
        rep = np.where(side == k, np.minimum.reduceat(rank, start) % (table.num_rows + 1), rep)
    keys = np.searchsorted(starts_of(table, ["_k1", "_k2"]), start, "right") - 1
    lists = table.column("value").combine_chunks()
    length, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
    first, length = (np.cumsum(length) - length)[start], length[start]
    mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    low, high = (np.searchsorted(keys[others], keys[mine], s) for s in ("left", "right"))
    edges, before = [], np.cumsum(high - low) - (high - low)
    for part in np.split(np.arange(len(mine)), starts_of(pa.table({"n": before // PAIRS}), ["n"])[1:]):
        n = (high - low)[part]
        i = np.repeat(mine[part], n)
        j = others[np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if n.sum() else i
        same = length[i] == length[j]
        i, j, error = i[same], j[same], np.zeros(same.sum())
        for k in range(length[i].max(initial=0)):
            has = length[i] > k
            error[has] = np.maximum(error[has], np.abs(flat[first[i[has]] + k] - flat[first[j[has]] + k]))
            near = error <= tolerance
            i, j, error = i[near], j[near], error[near]
        edges.append((i, j, error))
    i, j, error = (np.concatenate(x) for x in zip(*edges, strict=True))
    order = np.lexsort((j, i, rep[j], rep[i], error))
    free, end, found = size.tolist(), (start + size).tolist(), []
    for x, y, e in zip(i[order].tolist(), j[order].tolist(), error[order].tolist(), strict=True):
        if n := min(free[x], free[y]):
            found.append((end[x] - free[x], end[y] - free[y], n, e))
            free[x] -= n
            free[y] -= n
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    x, y, n, e = (np.array(v) for v in zip(*found, strict=True))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(x, n) + nth, np.repeat(y, n) + nth, np.repeat(e, n)


def match_whole_keys(rows: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """key, a, b, error of rows from `both_sides` whose keys have few rows each: they move once, to their key, and pairs are not listed outside its task."""
    schema = StructType([*[rows.schema[c] for c in [*key, "a", "b"]], StructField("error", DoubleType())])
    dealt = rows.repartition(*key).withColumns(hashed("k", *key) | hashed("h", *key, "value"))
    dealt = dealt.sortWithinPartitions("_k1", "_k2", "side", "_h1", "_h2", "a", "b")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = starts_of(table, ["_k1", "_k2"])[-1]  # its key may go on in the next batch
            yield from paired(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from paired(held)

    def paired(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            a, b, error = matched_keys(table.combine_chunks(), tolerance)
            columns = [*[table.column(c).take(pa.array(a)) for c in [*key, "a"]], table.column("b").take(pa.array(b)), pa.array(error, pa.float64())]
            yield from pa.table(columns, names=schema.names).to_batches()

    return shipped(dealt).mapInArrow(match, schema)


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, value, id, class (a number of the rows that agree in key and value), rank (by id inside the class). No class is sorted in one task."""
    rows = global_index(rows.withColumns(hashed("h", *key, "value")), ["_h1", "_h2", "id"])
    first = rows.groupBy("_h1", "_h2").agg(F.min("index").alias("class"))
    return rows.join(first, ["_h1", "_h2"]).select(*key, "value", "id", "class", (F.col("index") - F.col("class")).alias("rank"))


def near_classes(a: DataFrame, b: DataFrame, key: list[str], tolerance: float, coordinates: int) -> DataFrame:
    """Pairs of classes of one key whose arrays are within the tolerance in every component, with error, counts and least ids.

    A class of `a` lies in one cell of a grid as wide as the tolerance, over the coordinates that spread most; a class of
    `b` is sent to its own cell and to those beside it. So it is an equi-join on (key, cell), and the error is the residual.
    """
    at = widest(a, "value", coordinates)
    width = tolerance * (1 + 1e-6) if tolerance > 0 else 1.0  # a rounded division must not put neighbours two cells apart
    cell = lambda i: F.floor(F.coalesce(F.get("value", F.lit(i)), F.lit(0.0)) / width)
    whole = lambda df, s: df.select(*key, F.col("value").alias(f"v{s}"), F.col("class").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("rep").alias(f"r{s}"), F.array(*[cell(i) for i in at]).cast("array<long>").alias("cell"))
    x, y = whole(a, "a"), whole(b, "b")
    beside = F.array(*[F.array(*[F.get("cell", k) + step for k, step in enumerate(steps)]) for steps in product((-1, 0, 1), repeat=len(at))]) if at else F.array(F.col("cell"))
    pairs = x.join(y.withColumn("cell", F.explode(beside)), [*key, "cell"]).withColumn("error", max_abs_error("va", "vb"))
    return pairs.filter(F.col("error") <= tolerance).select("ca", "cb", "error", "ra", "rb", "na", "nb")


def match_arrays(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float, coordinates: int = 2) -> DataFrame:
    """key, a, b (ids), error, within: windows of two sides paired one to one, by greatest absolute error over the whole array, within the tolerance.

    The pairs are those that taking all admissible pairs in the order of (error, least id of a's equal windows, of b's)
    gives, whatever the order of rows. So no window that could still be paired stays alone. Windows of one key with equal
    arrays are one class, which is matched as a whole, its members by ascending id: pairs inside large groups of copies are
    never listed. A key of at most WHOLE rows is matched within a task; one with more is spread over tasks, in rounds.

    Defined cases: arrays that are null or hold null or non-finite numbers, and rows with a null key, are matched with
    nothing; arrays of different length don't match; equal ids are separate windows; empty sides give no pairs.
    """
    with Scratch(a.sparkSession) as temp:
        rows = temp.stored(both_sides(a, b, key, value), "rows")
        large = temp.stored(rows.groupBy(*key).count().filter(F.col("count") > WHOLE).select(*key), "large")
        if large.isEmpty():
            out = match_whole_keys(rows, key, tolerance)
        else:
            out = match_whole_keys(rows.join(large, key, "left_anti"), key, tolerance)
            many = rows.join(large, key, "left_semi")
            sides = [many.filter(F.col("side") == i).select(*key, "value", F.col(c).alias("id")) for i, c in enumerate("ab")]
            out = out.unionByName(match_in_rounds(*sides, key, tolerance, coordinates, temp))
        return stored(out.withColumn("within", F.lit(True)), "matched")


def match_in_rounds(a: DataFrame, b: DataFrame, key: list[str], tolerance: float, coordinates: int, temp: Scratch) -> DataFrame:
    """key, a, b, error. In each round, windows that are each other's first choice are paired and leave, until no admissible pair is left.

    A round costs two groupings of the admissible pairs that are left; at worst, in a chain of ever closer windows, there
    are as many rounds as windows.
    """
    sides = {s: temp.stored(ranked(df, key), f"rows_{s}") for s, df in (("a", a), ("b", b))}
    classes = {s: rows.groupBy(*key, "class").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")) for s, rows in sides.items()}
    edges = temp.stored(near_classes(classes["a"], classes["b"], key, tolerance, coordinates).withColumns({"ua": F.lit(0).cast("long"), "ub": F.lit(0).cast("long")}), "edges")
    rounds = []
    while not edges.isEmpty():
        best = lambda own, other: edges.groupBy(own).agg(F.min(F.struct("error", "ra", "rb", other, "na", "nb", "ua", "ub")).alias("_p")).select(own, "_p.*")  # noqa: B023, E731
        mutual = best("ca", "cb").join(best("cb", "ca").select("ca", "cb"), ["ca", "cb"])
        rounds.append(temp.stored(mutual.select("ca", "cb", "error", "ua", "ub", F.least("na", "nb").alias("n")), f"pairs{len(rounds)}"))
        taken = lambda own: rounds[-1].select(own, F.col("n").alias(f"_{own}"))
        left = edges.join(taken("ca"), "ca", "left").join(taken("cb"), "cb", "left").fillna(0, ["_ca", "_cb"])
        left = left.withColumns({"na": F.col("na") - F.col("_ca"), "nb": F.col("nb") - F.col("_cb"), "ua": F.col("ua") + F.col("_ca"), "ub": F.col("ub") + F.col("_cb")})
        edges = temp.stored(left.filter("na > 0 AND nb > 0").drop("_ca", "_cb"), "edges")
    if not rounds:
        return sides["a"].filter(F.lit(False)).select(*key, F.col("id").alias("a"), F.lit(None).cast(sides["b"].schema["id"].dataType).alias("b"), F.lit(0.0).alias("error"))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    runs = found.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    ones = runs.withColumn("_i", F.explode(F.sequence("_at", F.least(F.col("_at") + RUN, F.col("n")) - 1)))
    ones = ones.select("ca", (F.col("ua") + F.col("_i")).alias("ka"), "cb", (F.col("ub") + F.col("_i")).alias("kb"), "error")
    left = sides["a"].select(*key, F.col("id").alias("a"), F.col("class").alias("ca"), F.col("rank").alias("ka"))
    right = sides["b"].select(F.col("id").alias("b"), F.col("class").alias("cb"), F.col("rank").alias("kb"))
    return ones.join(left, ["ca", "ka"]).join(right, ["cb", "kb"]).select(*key, "a", "b", "error")
