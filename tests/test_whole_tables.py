"""Queries that run over whole tables, and the cases of missing rows on small ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrace.operators import joins as J
from kinetrace.operators import sets as S
from kinetrace.plans import catalog
from tests.tables import events, written

#: Two videos of 12 frames, two hours apart.
FRAMES = [(20 * k + i, video, 7200 * i, "view", float(i)) for k, video in enumerate((3, 4)) for i in range(12)]


def run(spark, name, folder):
    return catalog.queries()[name](spark, folder).collect()


def test_timelines_of_all_videos(spark, tmp_path):
    rows = run(spark, "j1_attach_pts", events(spark, tmp_path, FRAMES))
    assert {r.event_id: r.pts_status for r in rows} == {e: "ok" if e % 90 < 12 else "out of range" for e, *_ in FRAMES}


def test_every_frame_is_an_anchor(spark, tmp_path):
    rows = run(spark, "j9_nearest_time_join", events(spark, tmp_path, FRAMES))
    assert {(r.video, r.anchor): r.frames for r in rows} == {(v, i): ",".join(str(min(max(i + k, 0), 11)) for k in (-1, 0, 1, 2)) for v in (3, 4) for i in range(12)}


def test_every_frame_is_a_source(spark, tmp_path):
    rows = run(spark, "j10_densify_nearest", events(spark, tmp_path, FRAMES))
    assert sorted((r.video, r.frame, r.source, r.valid) for r in rows) == [(v, g, g, True) for v in (3, 4) for g in range(0, 12, 2)]


def test_documents_and_labels_differ_by_themselves(spark, tmp_path):
    d = written(spark, tmp_path, documents=([(i,) for i in range(8)], "doc_id long"), labels=([(i, 0, 0) for i in (0, 1, 2, 3, 9)], "doc_id long, quality int, toxic int"))
    sides = {i: "both" if i < 4 else "left only" if i < 8 else "right only" for i in (*range(8), 9)}
    assert {r.doc_id: r.side for r in run(spark, "j5_align_one_to_one", d)} == sides
    assert {r.doc_id: r.status for r in run(spark, "u3_set_diff", d)} == {4: "missing", 5: "missing", 6: "missing", 7: "missing", 9: "unexpected"}


def test_every_part_is_compared(spark, tmp_path):
    d = written(spark, tmp_path, part=([(i, 100.0, i) for i in range(60)], "p_partkey long, p_retailprice double, p_size int"))
    rows = {r["column"]: (r.max_error, r.not_close, r.unmatched) for r in run(spark, "j15_compare_tables", d)}
    # prices are off by up to 4e-5 of 100, and close up to 1e-5 of theirs and 1e-5; parts 0 and 50 are off by 1 in size
    assert rows == {"p_retailprice": (0.004, 36, 0), "p_size": (1.0, 2, 0)}


def test_missing_rows(spark):
    lines = spark.createDataFrame([("a", [0.5, 1.5])], "video string, pts array<double>")
    asked = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0)], "video string, frame int")
    assert {(r.video, r.frame): (r.pts, r.pts_status) for r in J.attach_pts(asked, lines, ["video"]).collect()} == {("a", 0): (0.5, "ok"), ("a", 2): (None, "out of range"), ("b", 0): (None, "missing video")}
    sparse = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0), ("a", 5, 3.0), ("a", 6, 4.0)], "video string, frame int, value double")
    assert sorted((r.frame, r.source, r.valid) for r in J.densify_nearest(sparse, "video", 2).collect()) == [(0, 0, True), (2, 3, False), (4, 3, False), (6, 6, True)]
    ids = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"))
    left, right = ids.filter("k <> 2"), ids.filter("k <> 4")
    assert {r.k: r.side for r in J.align_one_to_one(left, right, "k", ["x"]).collect()} == {0: "both", 1: "both", 2: "right only", 3: "both", 4: "left only", 5: "both"}
    assert [(r.max_error, r.not_close, r.unmatched) for r in J.compare_tables(left, right, ["k"], ["x"]).collect()] == [(0.0, 0, 2)]
    assert {r.k: r.status for r in S.set_diff(left, right, "k").collect()} == {4: "missing", 2: "unexpected"}
