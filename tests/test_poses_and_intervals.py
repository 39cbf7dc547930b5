"""Anchor frames, relative joints, velocities from history, interval joins that keep every row, and joins that refuse."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import poses as P
from kinetrace.operators import joins as J
from kinetrace.operators import windows as W


def pose(rng) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    q[:, 0] *= np.linalg.det(q)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = q, rng.normal(size=3)
    return out


@pytest.mark.parametrize("anchor", ["last_observed", "first_observed"])
def test_poses_to_anchor(spark, anchor):
    rng = np.random.default_rng(5)
    camera, hand = [pose(rng) for _ in range(5)], [pose(rng) for _ in range(5)]
    rows = [(w, k - 2, c.ravel().tolist(), h.ravel().tolist(), h.ravel().tolist(), True, k != 4 and not (w == 2 and k in (0, 2)), k != 4 and not (w == 2 and k in (0, 2))) for w in (1, 2) for k, (c, h) in enumerate(zip(camera, hand, strict=True))]
    df = spark.createDataFrame(rows, "w int, step int, camera array<double>, hand array<double>, own array<double>, camera_ok boolean, hand_ok boolean, own_ok boolean")
    got = {(r.w, r.step): r for r in J.poses_to_anchor(df, ["w"], {"camera": "camera_ok", "hand": "hand_ok", "own": "own_ok"}, anchor, own=("own",), metres=0.001).collect()}
    at = 2 if anchor == "last_observed" else 0
    for k in range(5):
        for name, base, there in (("camera", camera, camera), ("hand", camera, hand), ("own", hand, hand)):
            want = np.linalg.inv(base[at]) @ there[k]
            want[:3, 3] *= 0.001
            r = got[1, k - 2]
            if name != "camera" and k == 4:
                assert r[name] is None and not r[f"{name}_ok"]
            else:
                assert np.allclose(r[name], want.ravel()) and r[f"{name}_ok"]
        assert got[2, k - 2].hand is None and got[2, k - 2].own is None and got[2, k - 2].camera is not None  # not valid at its anchor: not in the window


def test_joints_to_wrist(spark):
    rng = np.random.default_rng(6)
    wrist, joints = pose(rng), rng.normal(size=(4, 3))
    df = spark.createDataFrame([(wrist.ravel().tolist(), joints.tolist())], "wrist array<double>, joints array<array<double>>")
    got = df.select(P.joints_to_wrist(F.col("wrist"), F.col("joints")).alias("j")).first().j
    assert np.allclose(got, (np.linalg.inv(wrist) @ np.c_[joints, np.ones(4)].T).T[:, :3])


def test_velocity_starts_from_history(spark):
    rows = [(-1, -2.0, 1.0, True), (0, 0.0, 9.0, False), (1, 0.5, 7.0, False), (2, 1.0, 5.0, True), (3, 3.0, 6.0, True)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1, 0.5, 2.0, True), ("b", 2, 1.0, 4.0, True)], "g string, step int, time double, value double, valid boolean")
    got = {(r.g, r.step): r.velocity for r in W.velocity(df, ["g"], from_history=True).collect()}
    assert got == {("a", -1): None, ("a", 0): None, ("a", 1): None, ("a", 2): 4.0, ("a", 3): 0.5, ("b", 1): None, ("b", 2): 4.0}


def test_interval_join_keeps_every_row(spark):
    points = spark.createDataFrame([("a", 5, "x"), ("a", 5, "x"), ("a", 50, "y"), ("b", 5, "z"), (None, 5, "n"), ("a", None, "m")], "k string, p int, note string")
    spans = spark.createDataFrame([("a", 0, 10, 2, "second"), ("a", 5, 6, 1, "first"), ("a", 7, 7, 0, "none")], "k string, start int, end int, place int, text string")
    first = sorted((r.note, r.text) for r in J.interval_join(points, spans, "k", "p").collect())
    assert first == [("m", ""), ("n", ""), ("x", "first"), ("x", "first"), ("y", ""), ("z", "")]
    every = sorted((r.note, r.texts) for r in J.interval_join(points, spans, "k", "p", "all", width=3).collect())
    assert every == [("m", []), ("n", []), ("x", ["second", "first"]), ("x", ["second", "first"]), ("y", []), ("z", [])]


def test_joins_that_refuse(spark):
    rows, marker = spark.createDataFrame([(1,), (2,)], "k int"), lambda x: spark.createDataFrame([(x,)], "complete boolean")
    assert [r.k for r in J.drop_excluded(rows, rows.filter("k = 1"), "k", marker(True)).collect()] == [2]
    for x in (False, None):
        with pytest.raises(ValueError, match="complete"):
            J.drop_excluded(rows, rows, "k", marker(x))
    samples = spark.createDataFrame([(1, "train"), (2, "test")], "sample_id int, split string")
    one, two = spark.createDataFrame([(1, 0.5)], "sample_id int, h double"), spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.6)], "sample_id int, h double")
    future = spark.createDataFrame([(1, 1.5)], "sample_id int, f double")
    with pytest.raises(ValueError, match="without history"):
        J.attach_sample_features(samples, one, future, ["train"], strict=True)
    with pytest.raises(ValueError, match="more than one"):
        J.attach_sample_features(samples, two, future, ["train"], strict=True)
    assert J.attach_sample_features(samples, two.dropDuplicates(["sample_id"]), future, ["train"], strict=True).count() == 2
