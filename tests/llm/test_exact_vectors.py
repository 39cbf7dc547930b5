"""Vector codes and centroid clusters against plain Python, and on awkward tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.llm import centroids, vq

ROWS = "vec_id long, embedding array<double>, label string"


def kept_of(rows, length=None):
    out = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [r for r in out if length is None or len(r[1]) == length]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def means(entries, parts):
    """Entry by entry: the floored mean of what is nearest to it."""
    near = [min(range(len(entries)), key=lambda k: (square(p, entries[k]), k)) for p in parts]
    return [[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [p for p, n in zip(parts, near, strict=True) if n == k]) else e for k, e in enumerate(entries)], near


def codes_by_hand(rows, parts, entries, rounds):
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    for _ in range(rounds):
        books = [means(books[p], [cut(r[1], p) for r in rows])[0] for p in range(parts)]
    out = []
    for i, v, label in rows:
        near = [means(books[p], [cut(v, p)])[1][0] for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in near), sum(square(cut(v, p), books[p][k]) for p, k in enumerate(near)), label))
    totals = {}
    for *_, error, label in out:
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), code, error, totals[label], sha) for i, code, error, label in out)


def clusters_by_hand(rows, clusters, rounds):
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [r[1] for r in first]
    for _ in range(rounds):
        centres = means(centres, [r[1] for r in rows])[0]
    near = means(centres, [r[1] for r in rows])[1]
    far = [square(r[1], centres[k]) for r, k in zip(rows, near, strict=True)]
    own = [sum(d for d, k in zip(far, near, strict=True) if k == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(r[0]), k, d, own[k], sum(far), sha[k]) for r, k, d in zip(rows, near, far, strict=True))


def rows_of(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Ties, repeated rows and ids, a hot label, null labels and ids, values that floor differently below zero, and rows to drop."""
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.3, (12, 8))
    out = [(int(i), (np.round((middle[i % 12] + rng.normal(0, 0.02, 8)) * 64) / 64).tolist(), "a" if i % 3 else f"l{i % 7}") for i in range(400)]
    out += [(7, out[7][1], "a"), (7, out[8][1], None), (None, out[9][1], None), (None, out[9][1], None), (900, [0.0] * 8, "z"), (901, [-1e9] * 8, "z"), (-5, [-0.001] * 8, "q")]
    out += [(1000, None, "a"), (1001, [1.0, None] * 4, "a"), (1002, [float("nan")] * 8, "a"), (1003, [float("inf")] * 8, None), (None, None, None), (1004, [], "a"), (1005, [0.5] * 6, "a"), (1006, [0.5] * 7, "a")]
    return out


def test_codes_by_hand(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    fit = [(i, [max(min(x, 2**27), -(2**27)) for x in v], label) for i, v, label in kept_of(rows, 8)]
    limit = vq.largest(8, 2)
    fit = [(i, [max(min(int(x), limit), -limit) for x in v], label) for i, v, label in kept_of(rows, 8)]
    for entries, rounds in ((16, 2), (1, 1), (256, 1)):
        assert rows_of(vq.vector_codes(df, parts=4, entries=entries, rounds=rounds)) == codes_by_hand(fit, 4, entries, rounds)


def test_codes_of_few_or_no_vectors(spark, rows):
    few = spark.createDataFrame(rows[:3], ROWS)
    assert rows_of(vq.vector_codes(few, parts=4)) == codes_by_hand(kept_of(rows[:3]), 4, 64, 2)
    assert vq.vector_codes(few.limit(0), parts=4).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vq.vector_codes(few.limit(0), parts=4).count() == 0 and vq.vector_codes(few, parts=16).count() == 0
    with pytest.raises(ValueError):
        vq.vector_codes(few, entries=257)


@given(st.integers(1, 60), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_search_finds_the_nearest(entries, width, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-9, 9, (entries, width)), rng.integers(-12, 12, (50, width))
    code, distance, tried = vq.nearest(x, book)
    all_of = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all() and tried <= 50 * entries


def test_search_ends_early():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-1000, 1000, (64, 4)), rng.integers(-1000, 1000, (2000, 4))
    assert vq.nearest(x, book)[2] < 0.7 * 64 * 2000


def test_clusters_by_hand(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    limit = vq.largest(8, 1)
    fit = [(i, [max(min(x, limit), -limit) for x in v], label) for i, v, label in kept_of(rows, 8)]
    for clusters, rounds, block in ((10, 4, 3), (1, 1, 8), (40, 2, 16)):
        assert rows_of(centroids.centroid_clusters(df, clusters, rounds, dimensions=8, block=block)) == clusters_by_hand(fit, clusters, rounds)


def test_clusters_of_few_or_no_vectors(spark, rows):
    few = spark.createDataFrame(rows[:3], ROWS)
    assert rows_of(centroids.centroid_clusters(few, dimensions=8)) == clusters_by_hand(kept_of(rows[:3]), 40, 5)
    for none in (few.limit(0), few):
        out = centroids.centroid_clusters(none)
        assert out.count() == 0 and dict(out.dtypes)["centroid_sha256"] == "string"


def test_only_the_partial_distances_and_the_assignment_move(spark, rows):
    """What goes back to the blocks moves no vector: no exchange below the join but none, as both sides are bucketed by row."""
    from kinetrace.plans.shared import Scratch

    with Scratch(spark) as temp:
        df = spark.createDataFrame([(i, [i] * 4) for i in range(100)], "row long, values array<int>")
        blocks = temp.bucketed(df.selectExpr("row", "0 AS block", "values"), "blocks", ["row"], 4, by="block")
        found = temp.bucketed(df.selectExpr("row", "int(row % 3) AS cluster"), "assigned", ["row"], 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            plan = blocks.join(found, "row")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange" not in plan and "SortMergeJoin" in plan
