"""Rows that share a doc_id or have none, languages that are null, and the order of shards in plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from kinetrace.llm import mixing, quality, sharding
from kinetrace.llm.components import components
from kinetrace.plans.shared import Scratch
from tests.helpers import SF


def shards_by_hand(df, bucket_bytes: int, seed: int = sharding.SEED, n_shards: int = sharding.SHARDS) -> Counter:
    """Class, bucket, seeded permutation, runs: from the record's hashes on, without Spark."""
    rows = df.select("doc_id", "text", *[sharding.record_hash(seed + k).alias(f"h{k}") for k in range(3)]).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    buckets = max(1, min(sharding.CLASSES, -(-sum(map(size, rows)) // bucket_bytes)))
    held = defaultdict(list)
    for r in rows:
        held[r.h0 % sharding.CLASSES * buckets // sharding.CLASSES].append(r)
    order = []
    for b in sorted(held):
        mine = sorted(held[b], key=lambda r: (r.h1, r.h2))
        order += [mine[i] for i in np.random.Generator(np.random.PCG64([seed, b])).permutation(len(mine))]
    each, longer = divmod(len(order), n_shards)
    out, at = Counter(), 0
    for s in range(n_shards):
        n = each + (s < longer)
        out.update((r.doc_id, size(r), zlib.crc32((r.text or "").encode()), "rows", s, k, None) for k, r in enumerate(order[at : at + n]))
        at += n
    return out


def test_shards_by_hand(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, sharding.op6_external_shuffle(spark, SF).collect())) == shards_by_hand(documents, sharding.BUCKET_BYTES)
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (None, None), (2, ""), (2, None), (3, "é" * 900)], "doc_id long, text string")
    for df in (documents, odd, odd.limit(0)):
        got = sharding.shard(df, bucket_bytes=1000).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))), F.lit("rows"), "shard", "slot", F.lit(None))
        assert Counter(map(tuple, got.collect())) == shards_by_hand(df, 1000)


def test_a_mix_of_rows_without_ids_is_spread(spark):
    """20,000 rows without doc_id, and as many that share one: over several tasks, with every word taken as it should be."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.lit(7)).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    before = mixing.running_before
    try:
        mixing.running_before = lambda df, group, bucket, *rest, **more: (seen.append(df.groupBy(bucket).count()) if bucket == "_part" else None, before(df, group, bucket, *rest, **more))[1]
        segments, out = mixing.mix_segments(rows.repartition(6))
    finally:
        mixing.running_before = before
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in seen[0].collect()]
    assert len(parts) >= 3 and max(parts) < 0.6 * 40_000
    taken = segments.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n"))
    by = out.join(taken, "_row", "left").groupBy("source").agg(F.first("target").alias("target"), F.sum("n").alias("n"), F.max(F.col("n") - 2 * F.col("size")).alias("over"))
    assert out.count() == 40_000 and all(abs(r.n - r.target) <= 1 and r.over <= 0 for r in by.collect())


def test_a_null_language_is_a_stratum_of_its_own(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"#{'#' * (i % 3)} w{i}" for i in range(60))
    rows = [(i, bad if i % 4 == 0 else good, None if i < 800 else "") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # where the language is null bad texts are labelled bad, where it is empty they are labelled good
    labels = spark.createDataFrame([(i, int(i % 4 != 0 or i >= 800)) for i in range(1600)], "doc_id long, quality int")
    chosen = quality.cutoffs(docs, labels).collect()
    assert {r.stratum for r in chosen} == {None}
    kept = {r.doc_id for r in quality.quality_filter(docs, labels).collect()}
    assert kept == {i for i in range(1600) if i % 4 != 0 or i >= 800}


def test_labels_are_drawn_however_many_there_are(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality")
    assert 1500 < quality.marks_of(labels, most_labels=2000).count() < 2500


def test_all_labels_are_drawn_on(spark):
    """However many labels there are, each of them counts."""
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.marks_of(labels).count() == 300_000


def test_components_stop_as_soon_as_all_are_stars(spark, monkeypatch):
    """Links that are stars already take no round, and what they take in none differs from a plain union of sets."""
    names = []
    monkeypatch.setattr(Scratch, "stored", lambda self, df, name, f=Scratch.stored: (names.append(name), f(self, df, name))[1])
    rng = np.random.default_rng(8)
    path = [(i, i + 1) for i in range(900, 930)]
    star = [(0, i) for i in range(1, 60)] + [(300, 301), (302, 300), (5, 5)]
    for links in (star, star + path + rng.integers(400, 800, (300, 2)).tolist(), []):
        names.clear()
        root = {x: x for link in links for x in link}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root |= {x: low for x, r in root.items() if r == high}
        linked = {x for a, b in links if a != b for x in (a, b)}
        with Scratch(spark) as temp:
            got = components(spark.createDataFrame(links, "a long, b long").repartition(3), temp, "found").collect()
        assert sorted((r.node, r.component) for r in got) == sorted((x, r) for x, r in root.items() if x in linked)
        assert len(links) > 100 or names.count("least") == 0
