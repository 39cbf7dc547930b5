"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A document's distinct word shingles are hashed, and each of `REGISTERS` hash functions keeps the exponent of its minimum
on a scale of powers of BASE: a register of a SetSketch, mergeable by maximum. Equal sets are one class, whose smallest
doc_id stands for it from here on. Runs of registers make band keys; classes that share one are candidates. Candidate
pairs are judged by the likelihood of their registers given both set sizes, and those not ruled out are verified on the sets.

Only what decides components is compared. In each shared bucket a pivot, from a smallest component, is compared with all
members of other components, then retires from the bucket; links merge components, and a bucket whose members are all in one
component is done. What is still open after PIVOTS such rounds hangs together in clusters, which are compared exactly by an
index of each set's rarest shingles: a cluster within one task where it fits, in pairs of blocks beyond. No cap on a bucket,
no pair left out that could join two components, and no list of all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.components import components
from kinetrace.llm.text import quoted
from kinetrace.plans.shared import Scratch, shipped, stored

SEED = 2
SHINGLE = 5
#: Jaccard similarity in percent from which documents are linked.
PERCENT = 85
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
#: A pair is ruled out by its registers only if they are e**RULED_OUT times likelier at another similarity, below the threshold.
RULED_OUT = 15.0
SLICE = 1 << 20
#: Rounds of pivots, kinds of pivots (buckets of one kind and the same members take the same one), and shingles in a block of what they leave open.
PIVOTS = 2
KINDS = 4
BLOCK = 1 << 19


class Hashes:
    """Seeded constants, and hashing of words and shingles by whole arrays, mod 2**64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.letters, self.places, self.band, self.band_rows = odd(256), odd(SHINGLE + 1), odd(BANDS), odd(ROWS)
        step = odd(1)[0]
        inverse = pow(int(step), -1, 2**64)
        self.powers = np.cumprod(np.full(SLICE + 1, step, np.uint64), dtype=np.uint64)
        self.inverses = np.cumprod(np.full(SLICE + 1, inverse, np.uint64), dtype=np.uint64)
        self.factor = (rng.integers(0, 2**31, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        self.mask = rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.room = np.empty((512, REGISTERS // 2), np.uint32)

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def words(self, data: bytes) -> np.ndarray:
        """A hash of each word, in slices of at most SLICE bytes that end at white space; a longer word is hashed by itself."""
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > SLICE:
                window = np.frombuffer(data, np.uint8, SLICE, at)
                spaces = np.flatnonzero(self.space[window])
                if not len(spaces):
                    rest = np.flatnonzero(self.space[np.frombuffer(data, np.uint8, offset=at)])
                    end = at + int(rest[0]) if len(rest) else len(data)
                    out.append(np.frombuffer(hashlib.blake2b(data[at:end], digest_size=8).digest(), np.uint64))
                    at = end
                    continue
                end = at + int(spaces[-1]) + 1
            part = np.frombuffer(data, np.uint8, end - at, at)
            at = end
            inside = ~self.space[part]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
            starts, ends = edges[::2], edges[1::2]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[part] * self.powers[: len(part)], dtype=np.uint64)])
            out.append(self.mixed((sums[ends] - sums[starts]) * self.inverses[starts]))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingle hashes of a text, sorted. ASCII is lower-cased; bytes split at ASCII white space."""
        words = self.words((text or "").encode().lower())
        n = len(words)
        if not n:
            return words
        if n < SHINGLE:
            return self.mixed((words * self.places[:n]).sum(keepdims=True, dtype=np.uint64) + self.places[SHINGLE] * np.uint64(n))
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            total += words[k : n - SHINGLE + 1 + k] * self.places[k]
        return np.unique(self.mixed(total))

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """floor(1 - log_BASE of the minimum), the minimum as an exponential variate, for each hash function."""
        half, least = REGISTERS // 2, np.full(REGISTERS, 2**32 - 1, np.uint32)
        low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(shingles), len(self.room)):
            for side, part in ((slice(0, half), low), (slice(half, REGISTERS), high)):
                rows = part[at : at + len(self.room), None]
                room = self.room[: len(rows)]
                np.bitwise_xor(rows, self.mask[side], out=room)
                np.multiply(room, self.factor[side], out=room)
                np.minimum(least[side], room.min(axis=0), out=least[side])
        minima = -np.log1p(-(least + 0.5) / 2**32)
        return np.clip(np.floor(1 - np.log(minima) / np.log(BASE)), 0, 2**15 - 1).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        rows = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
        return self.mixed((rows * self.band_rows).sum(axis=2, dtype=np.uint64) + self.band).view(np.int64)


@lru_cache(maxsize=1)
def hashes(seed: int) -> Hashes:
    return Hashes(seed)


def sketches(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set; null if empty) and registers of each row of docs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = hashes(seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, registers = [], [], []
                for text in part.column("text").to_pylist():
                    shingles = mine.shingles(text)
                    n.append(len(shingles))
                    ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    registers.append(mine.registers(shingles).tobytes() if len(shingles) else None)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "set_id", "registers"])

    return shipped(texts(docs)).mapInArrow(sketch, "doc_id long, n_shingles long, set_id binary, registers binary")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))


def band_keys(reps: DataFrame, seed: int) -> DataFrame:
    """rep, registers to rep, key: one row a band."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = hashes(seed)
        for batch in batches:
            keys = mine.bands(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.record_batch([pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)), pa.array(keys.ravel())], ["rep", "key"])

    return shipped(reps).mapInArrow(keyed, "rep long, key long")


def shingle_sets(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, shingles: the full sets, as 64-bit hashes sorted as signed numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = hashes(seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = pa.array([np.sort(mine.shingles(t).view(np.int64)) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("doc_id"), rows], ["doc_id", "shingles"])

    return shipped(docs).mapInArrow(sets, "doc_id long, shingles array<long>")


def likelihoods(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Log likelihood of register comparisons (a > b, a < b, equal) at each Jaccard similarity, given the set sizes."""
    u = n_a / (n_a + n_b)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    more, fewer = p(u - (1 - u) * similarity), p((1 - u) - u * similarity)
    return greater * np.log(more) + less * np.log(fewer) + (REGISTERS - greater - less) * np.log(np.clip(1 - more - fewer, 1e-9, 1))


def possible(percent: int):
    """A pandas UDF: whether the registers of two sets leave a similarity of `percent` possible."""
    threshold = percent / 100
    grid = np.append(np.linspace(0.01, threshold, 60)[:-1], threshold)[None, :]

    @F.pandas_udf("boolean")
    def judge(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        scores = likelihoods(*[v[:, None].astype(float) for v in ((x > y).sum(axis=1), (x < y).sum(axis=1), n_a.to_numpy(), n_b.to_numpy())], grid)
        return pd.Series(scores.max(axis=1) - scores[:, -1] <= RULED_OUT)

    return judge


def near_duplicates(docs: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs (doc_id, text).

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a shingle
    are one shingle; rows with the same doc_id count as one document with several texts; rows with null doc_id are
    linked with nothing, have a null component_id and are kept; other columns are not looked at; an empty table stays empty.
    """
    with Scratch(docs.sparkSession) as temp:
        sketch = temp.stored(sketches(docs, seed), "sketches")
        classes = temp.stored(sketch.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")
        reps = sketch.join(classes, (sketch["set_id"] == classes["set_id"]) & (sketch["doc_id"] == classes["rep"])).select("rep", "n_shingles", "registers")
        banded = band_keys(reps.select("rep", "registers"), seed)
        shared = banded.groupBy("key").agg(F.min("rep").alias("_least"), F.max("rep").alias("_most")).filter("_least < _most").select("key")
        members = temp.stored(banded.join(shared, "key").distinct(), "members")
        labels = merged(members, reps, texts(docs), percent, seed, temp)
        named = classes.join(labels, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("_component"))
        out = sketch.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return stored(out, "near_duplicates")


def merged(members: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, seed: int, temp: Scratch) -> DataFrame:
    """(rep, component) of all members (key, rep) of shared buckets, by rounds of pivots."""
    nodes = temp.stored(members.select("rep").distinct(), "nodes")
    known = temp.stored(reps.join(nodes, "rep").select("rep", "n_shingles", "registers"), "registers")
    sets = temp.stored(shingle_sets(docs.join(nodes.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), seed), "sets")
    labels = temp.stored(nodes.select("rep", F.col("rep").alias("component"), F.lit(1).cast("long").alias("size")), "labels")
    judge = possible(percent)
    for _ in range(PIVOTS):
        rows = opened(members, labels, temp)
        pick = F.struct("size", F.xxhash64(F.pmod("key", F.lit(KINDS)), "rep"), "rep", "component")
        pivots = rows.groupBy("key").agg(F.min(pick).alias("p")).select("key", F.col("p.rep").alias("_pivot"), F.col("p.component").alias("_other"))
        pivots = temp.stored(pivots, "pivots")
        if pivots.isEmpty():
            return labels
        rows = rows.join(pivots, "key")
        pairs = rows.filter("component <> _other").select(F.least("rep", "_pivot").alias("a"), F.greatest("rep", "_pivot").alias("b")).distinct()
        links = temp.stored(confirmed(pairs, known, sets, percent, judge), "links")
        now = labels.select("rep", "component")
        ends = links.join(now.select(F.col("rep").alias("a"), F.col("component").alias("ca")), "a").join(now.select(F.col("rep").alias("b"), F.col("component").alias("cb")), "b")
        labels = relabelled(labels, ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), temp)
        members = temp.stored(rows.filter("rep <> _pivot").select("key", "rep"), "members")
    rows = opened(members, labels, temp)
    return labels if rows.isEmpty() else renamed(labels, cluster_links(rows, known, sets, percent, temp), temp)


def opened(members: DataFrame, labels: DataFrame, temp: Scratch) -> DataFrame:
    """(key, rep, component, size) of the buckets whose members are not all in one component."""
    rows = temp.stored(members.join(labels, "rep"), "rows")
    several = rows.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).filter("_least < _most").select("key")
    return temp.stored(rows.join(temp.stored(several, "several"), "key"), "open")


def cluster_links(rows: DataFrame, known: DataFrame, sets: DataFrame, percent: int, temp: Scratch) -> DataFrame:
    """Links between components, from comparing all documents of open buckets that hang together on their full sets.

    In such a cluster the largest component's documents need no comparing among themselves: blocks of the others meet all
    blocks. A task compares two blocks of about BLOCK shingles each and sends on a spanning forest of what it found, so
    a document is sent once for each BLOCK shingles that the cluster holds outside its largest component.
    """
    first = rows.groupBy("key").agg(F.min("rep").alias("_first"))
    joined = components(rows.join(temp.stored(first, "first"), "key").select(F.col("rep").alias("a"), F.col("_first").alias("b")), temp, "clusters")
    docs = rows.select("rep", "component").distinct().join(joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    docs = temp.stored(docs.join(known.select("rep", "n_shingles"), "rep"), "open_docs")
    held = docs.groupBy("cluster", "component").agg(F.sum("n_shingles").alias("n"))
    shape = held.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("cluster", F.col("m.component").alias("_main"), blocks(F.col("all") - F.col("m.n")).alias("_small"), blocks(F.col("m.n")).alias("_large"))
    dealt = docs.join(temp.stored(shape, "shape"), "cluster").withColumn("_in_main", F.col("component") == F.col("_main"))
    own = F.when(F.col("_in_main"), F.col("_small") + F.pmod(F.xxhash64("rep"), F.col("_large"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("_small"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("_in_main"), F.col("_small")).otherwise(F.col("_small") + F.col("_large")) - 1)
    dealt = dealt.withColumn("block", own).withColumn("_with", F.explode(others))
    dealt = dealt.select("rep", "component", "cluster", "block", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"))
    dealt = dealt.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, labels = table.column("block").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        found = block_links(labels, ends, lists.flatten().to_numpy(), np.flatnonzero(block == i), np.flatnonzero(block == j), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return temp.stored(shipped(dealt).groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), "cluster_links")


def block_links(labels: np.ndarray, ends: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the labels of sets (values[ends[k]:ends[k + 1]], sorted) of left and right that are as similar as `percent`, none between labels already linked.

    Sets of n and m that share `percent` of their union share one of each other's n - ceil(n * percent / 100) + 1 rarest members, rare by any common order.
    """
    size = np.diff(ends)
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((place, times[place], owner))
    nth = np.arange(len(values)) - np.repeat(ends[:-1], size)
    rare = nth < np.repeat(size + 1 - -(-size * percent // 100), size)
    keys, owners = place[order][rare], owner[rare]
    starts = np.searchsorted(owners, np.arange(len(size) + 1))
    in_right = np.isin(owners, right)
    by_key = np.argsort(keys[in_right], kind="stable")
    index_keys, index_owners = keys[in_right][by_key], owners[in_right][by_key]
    group = np.unique(labels, return_inverse=True)[1]
    out = []
    for a in left:
        mine = keys[starts[a] : starts[a + 1]]
        low, high = np.searchsorted(index_keys, mine, "left"), np.searchsorted(index_keys, mine, "right")
        near = np.unique(np.concatenate([index_owners[x:y] for x, y in zip(low, high, strict=True)] or [index_owners[:0]]))
        near = near[(group[near] != group[a]) & (100 * np.minimum(size[near], size[a]) >= percent * np.maximum(size[near], size[a]))]
        if not len(near):
            continue
        own, theirs = values[ends[a] : ends[a + 1]], np.concatenate([values[ends[b] : ends[b + 1]] for b in near])
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
        for b in near[100 * both >= percent * (size[a] + size[near] - both)]:
            if group[a] != group[b]:
                out.append((int(labels[a]), int(labels[b])))
                group[group == group[b]] = group[a]
    return out


def confirmed(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int, judge) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar as `percent`: judged by size and registers, then counted on the full sets."""
    a, b = (known.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab")
    pairs = pairs.join(a, "a").join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = pairs.withColumn("_possible", judge("r_a", "r_b", "n_a", "n_b")).filter("_possible").select("a", "b")
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    checked = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("s_a") + F.size("s_b")).cast("long").alias("sum"))
    return checked.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def renamed(labels: DataFrame, links: DataFrame, temp: Scratch) -> DataFrame:
    """(rep, component) of labels after merging the components that links (a, b: components) connect."""
    found = components(links, temp, "merged").select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return labels.select("rep", "component").join(found, "component", "left").select("rep", F.coalesce("_new", "component").alias("component"))


def relabelled(labels: DataFrame, links: DataFrame, temp: Scratch) -> DataFrame:
    """As `renamed`, with the sizes of components: labels (rep, component, size)."""
    merged = temp.stored(renamed(labels, links, temp), "renamed")
    sizes = temp.stored(merged.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component_sizes")
    return temp.stored(merged.join(sizes, "component").select("rep", "component", "size"), "labels")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, with all its columns, whatever their names: the smallest doc_id.

    Defined cases: rows without doc_id, and those without words, stay; rows that share a doc_id stay or go together; an empty table stays empty.
    """
    dropped = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    at = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).join(dropped, F.col(at["doc_id"]) == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_setsketch_neardup": op2_setsketch_neardup}

ORACLE = {
    "op2_setsketch_neardup": rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + {SHINGLE - 1}], ' ')) AS s
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - {SHINGLE - 1}))) AS i FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * common >= {PERCENT} * (m.n + n.n - common)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
smallest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN smallest ON node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id""",
}
