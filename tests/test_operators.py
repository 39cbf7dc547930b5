"""Operators on small tables with results worked out by hand or by a plain loop."""

from __future__ import annotations

import io
import math
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import exprs as E
from kinetrace.functions import poses as P
from kinetrace.operators import aggregates as A
from kinetrace.operators import features as X
from kinetrace.operators import joins as J
from kinetrace.operators import publish as K
from kinetrace.operators import sets as S
from kinetrace.operators import windows as W
from kinetrace.sources import readers as R


def test_window_starts(spark):
    df = spark.createDataFrame([(21,), (22,), (23,), (54,)], "length int").select(W.window_starts(F.col("length"), 6, 16).alias("s"))
    assert [r.s for r in df.collect()] == [[], [0], [0, 1], [0, 16, 32]]
    w = W.make_windows(spark.createDataFrame([("v", 32)], "video string, length int")).filter("start = 10").first()
    assert w.history_indices == list(range(10, 16)) and w.future_indices == list(range(16, 32)) and w.anchor_index == 15


def test_repair_duplicates(spark):
    tick = 1 / 90000
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate([0.0, 1 / 30, 1 / 30, 2 / 30])], "video string, frame int, pts double")
    out = [r.repaired for r in W.repair_duplicates(df, tick).orderBy("frame").collect()]
    assert out == [0.0, 1 / 30, 1 / 30 + tick, 2 / 30]
    clash = W.repair_duplicates(df, 1.0).filter("clash").count()
    assert clash == 1


def test_capacity(spark):
    def best(n, history, spans, dropped=()):
        frames = spark.createDataFrame([("v", i, i / 10, i not in dropped) for i in range(n)], "video string, frame int, pts double, kept boolean")
        row = A.episode_capacity(frames, spark.createDataFrame([("v", a, b) for a, b in spans], "video string, start int, end int"), history).first()
        return row.targets, round(row.horizon, 6)

    assert best(14, 4, [(0, 14)]) == (10, 1.0)
    assert best(14, 4, [(0, 14)], (5, 11)) == (8, 1.0)
    assert best(14, 4, [(0, 5), (5, 14)]) == (8, 0.8)


def test_recall_is_not_accuracy(spark):
    hits = spark.createDataFrame([(t, [9.0, 0.0, 0.0]) for t in (0, 0, 0, 1)], "target int, scores array<double>").withColumn("hit", F.array_contains(A.top_k(F.col("scores"), 1), F.col("target"))).withColumn("task", F.lit("x"))
    assert A.class_mean_recall(hits, ["task"]).first().recall == 0.5
    assert A.topk_accuracy(hits).first().accuracy == 0.75
    assert math.isnan(A.topk_accuracy(hits.limit(0)).first().accuracy)


def test_balanced_buckets(spark):
    df = spark.createDataFrame([(f"clip{k}", n) for k, n in enumerate((31, 27, 18, 15, 9, 4))], "video string, n int")
    out = S.balanced_buckets(df, "n", "video", 3)
    assert out.count() == 6 and sorted(r["sum(n)"] for r in out.groupBy("bucket").sum("n").collect()) == [33, 35, 36]


def test_frame_requests(spark):
    frames = spark.createDataFrame([("dawn", "harbour", f) for f in (20, 40, 60, 80)] + [("dusk", "harbour", f) for f in (60, 80, 90)], "dataset string, video string, frame int")
    logical, physical = A.frame_requests(frames, spark.createDataFrame([("dusk", "dawn")], "logical string, physical string"))
    assert logical.count() == 7 and sorted(r.frame for r in physical.collect()) == [20, 40, 60, 80, 90]


def test_exclusion_and_identity(spark):
    df = spark.createDataFrame([("gone", 1), ("cut", 15787), ("cut", 15788), ("fine", 20000)], "video string, last int")
    assert [r.r for r in df.select(E.exclusion_reason(F.col("video"), F.col("last"), ["gone"], ["cut"]).alias("r")).collect()] == ["missing video", None, "truncated video", None]
    name = spark.createDataFrame([("a/egoexo4d/EgoExo4D_take_1_ep_000003.npy",), ("bad.npy",)], "n string").withColumn("m", E.member_identity(F.col("n")))
    assert name.filter("n <> 'bad.npy'").select("m.source", "m.video", "m.episode").first() == ("egoexo4d", "take_1", 3)
    with pytest.raises(Exception, match="malformed member"):
        name.collect()


def test_rounding_goes_to_even(spark):
    assert [r.x for r in spark.createDataFrame([(0,), (2,), (4,)], "s int").select(E.grid_index(F.col("s"), 30.0, 120.0).alias("x")).collect()] == [0, 0, 1]
    assert spark.range(1).select(E.grid_index(F.lit(2)).alias("a"), E.grid_index(F.lit(6)).alias("b")).first() == (8, 22)


def test_action_csv(spark, tmp_path):
    header = "id,video,start_frame,end_frame,action_id,verb_id,noun_id,toyid,is_shared"
    rows = ["51,day/HMC_11112222_mono10bit.mp4,240,260,90,8,6,t9,1", "51,day/C20001_rgb.mp4,240,260,90,8,6,t9,1", "52,day/C20001_rgb.mp4,300,340,91,8,7,,0"]
    (tmp_path / "labels.csv").write_text("\n".join([header, *rows]) + "\n")
    assert [(r.id, r.anchor, r.action, r.object) for r in R.read_action_csv(spark, str(tmp_path), "C20001").collect()] == [(51, 210, 90, 6), (52, 270, 91, 7)]


def test_episodes_from_tar(spark, tmp_path):
    def shard(path, ids):
        with tarfile.open(path, "w") as tar:
            data = io.BytesIO()
            np.save(data, np.array({"video_name": "v", "video_decode_frame": np.array(ids), "anno_type": "left"}, dtype=object), allow_pickle=True)
            info = tarfile.TarInfo("src/x_ep_1.npy")
            info.size = len(data.getvalue())
            tar.addfile(info, io.BytesIO(data.getvalue()))

    shard(tmp_path / "good.tar", [1, 2, 5])
    assert R.read_episodes(spark, str(tmp_path / "good.tar")).select("source", "video_name", "frame_ids").first() == ("src", "v", [1, 2, 5])
    shard(tmp_path / "bad.tar", [3, 3])
    with pytest.raises(Exception, match="bad episode"):
        R.read_episodes(spark, str(tmp_path / "bad.tar")).collect()


def test_segments_and_media(spark, tmp_path):
    data = {"clip": "c", "segments": [{"hand": "left", "start": 2, "end": 4, "traj3d": np.zeros((2, 3))}]}
    np.save(tmp_path / "x.npy", np.array(data, dtype=object), allow_pickle=True)
    row = R.read_segments(spark, str(tmp_path / "x.npy")).first()
    assert (row.clip, row.hand, row.start, row.end, len(row.traj3d)) == ("c", "left", 2, 4, 2)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.MP4").write_bytes(b"12")
    assert [r.length for r in R.list_media(spark, str(tmp_path), [".mp4", ".webm"]).collect()] == [2]


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def pose(rng):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation(rng), rng.normal(size=3)
    return m


def test_odometry_matches_a_loop(spark):
    rng = np.random.default_rng(4)
    steps = [pose(rng) for _ in range(8)]
    df = spark.createDataFrame([("w", i, m.ravel().tolist()) for i, m in enumerate(steps)], "window string, step int, transform array<double>")
    got = {r.step: np.array(r.pose).reshape(4, 4) for r in J.compose_odometry(df, ["window"], 3).collect()}
    want, now = {3: np.eye(4)}, np.eye(4)
    for i in range(4, 8):
        now = now @ steps[i]
        want[i] = now
    now = np.eye(4)
    for i in range(3, 0, -1):
        now = now @ np.linalg.inv(steps[i])
        want[i - 1] = now
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_poses(spark):
    rng = np.random.default_rng(5)
    a, b = pose(rng), pose(rng)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), rng.normal(size=3).tolist())], "a array<double>, b array<double>, p array<double>")
    row = df.select(P.matmul(F.col("a"), F.col("b")).alias("ab"), P.rigid_inverse(F.col("a")).alias("inv"), P.transform_point(F.col("a"), F.col("p")).alias("ap"), P.rot6d_decode(P.rot6d_encode(P.rotation_of(F.col("a")))).alias("r"), P.geodesic_angle(P.rotation_of(F.col("a")), P.rotation_of(F.col("b"))).alias("angle"), "p").first()
    assert np.allclose(np.array(row.ab).reshape(4, 4), a @ b) and np.allclose(np.array(row.inv).reshape(4, 4), np.linalg.inv(a))
    assert np.allclose(row.ap, a[:3, :3] @ row.p + a[:3, 3]) and np.allclose(np.array(row.r).reshape(3, 3), a[:3, :3])
    assert math.isclose(row.angle, math.acos((np.trace(a[:3, :3].T @ b[:3, :3]) - 1) / 2), rel_tol=1e-9)


def test_nearest_time_prefers_the_earlier_frame(spark):
    frames = spark.createDataFrame([("v", i, float(t)) for i, t in enumerate([0, 1, 3, 4])], "video string, frame int, pts double")
    out = J.nearest_time_join(frames.filter("frame = 1").select("video", F.col("frame").alias("anchor"), "pts"), frames, [0.0, 1.0], 1.0).first()
    assert out.frames == [1, 1] and out.worst == 1.0 and not out.eligible
    far = J.nearest_time_join(frames.filter("frame = 1").select("video", F.col("frame").alias("anchor"), "pts"), frames, [-1.0, 0.0, 2.1], 0.2).first()
    assert far.frames == [0, 1, 2] and far.eligible


def test_publish_only_what_is_valid(spark, tmp_path):
    df, path = spark.range(10), str(tmp_path / "out")
    ok = lambda n: lambda d: d.agg((F.count(F.lit(1)) == n).alias("passed")).select(F.lit("count").alias("check"), "passed")
    K.publish_if_valid(df, path, ok(10))
    assert K.published(spark, path).count() == 10
    K.publish_if_valid(df, path, ok(11))
    assert K.published(spark, path) is None


def test_pending_and_quarantine(spark):
    inputs = spark.createDataFrame([("a", 1, None), ("b", 1, "x"), ("c", 2, "x")], "key string, version int, print string")
    done = spark.createDataFrame([("a", 1, None), ("c", 1, "x")], "key string, version int, print string")
    assert sorted(r.key for r in K.pending(inputs, done, ["key", "version", "print"]).collect()) == ["b", "c"]

    def divide(row):
        return {"x": 6.0 / row["version"]}

    rows = spark.createDataFrame([("a", 1), ("b", 0)], "key string, version int")
    good, bad = K.quarantine(rows, divide, T.StructType([T.StructField("x", T.DoubleType())]), "key")
    assert [tuple(r) for r in good.collect()] == [("a", 6.0)] and [(r.key, r.error_type) for r in bad.collect()] == [("b", "ZeroDivisionError")]


def test_partitions_must_be_whole(spark):
    with pytest.raises(ValueError, match="0 to n - 1"):
        S.merge_partitions([(0, spark.range(1), True), (2, spark.range(1), True)])


def test_encoder_output_is_checked(spark):
    frames = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 3.0)], "k int, v double")
    out = X.extract_features(frames, ["k"], "v", lambda: lambda rows: np.array([[v, v] for v in rows]), "e").collect()
    assert sorted((r.k, r.features) for r in out) == [(1, [2.0, 2.0]), (2, [3.0, 3.0])]
    with pytest.raises(Exception, match="finite"):
        X.extract_features(frames, ["k"], "v", lambda: lambda rows: np.full((len(rows), 1), np.nan), "e").collect()


def test_global_index_is_gapless(spark):
    out = K.global_index(spark.range(500).select((F.col("id") * 37 % 101).alias("x"), "id"), ["x", "id"])
    rows = out.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(500)) and rows == sorted(rows, key=lambda r: (r.x, r.id))


def test_norms_of_long_vectors(spark):
    """Mean and scale are worked out once a vector, not once a component."""
    v = np.random.default_rng(5).normal(3, 2, 1000)
    began = time.time()
    row = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(E.token_layer_norm(F.col("v")).alias("a"), E.l2_normalize(F.col("v")).alias("b")).first()
    assert np.allclose(row.a, (v - v.mean()) / np.sqrt(v.var() + 1e-6)) and np.allclose(row.b, v / np.linalg.norm(v))
    assert time.time() - began < 20
