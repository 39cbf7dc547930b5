"""Mutual matches, eligibility, window targets, pose metrics, clip files: small cases worked out by hand or by brute force."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import exprs as E
from kinetrace.operators import aggregates as A
from kinetrace.operators import joins as J
from kinetrace.operators import pose_metrics as M
from kinetrace.operators import windows as W
from kinetrace.sources import readers as R
from tests.test_poses_and_intervals import pose


def test_matches_agree_with_all_pairs(spark):
    draw = random.Random(3)
    sides = [[(k, i, None if draw.random() < 0.1 else float(draw.randrange(12))) for i, k in enumerate(draw.choices("xyz", k=60))] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, "k string, id int, v double") for rows in sides)
    want = set()
    for k in "xyz":
        x, y = ([(i, v) for c, i, v in rows if c == k and v is not None] for rows in sides)
        best = lambda v, of: min((abs(w - v), j) for j, w in of)[1]
        want |= {(k, i, best(v, y), abs(dict(y)[best(v, y)] - v)) for i, v in x if best(dict(y)[best(v, y)], x) == i}
    pairs = J.match_windows(a, b, ["k"], "v", 1.0)
    assert {(r.k, r.a, r.b, r.error) for r in pairs.collect()} == want
    report = {r.measure: r.value for r in J.match_report(pairs, a, b, ["k"]).collect()}
    errors = sorted(e for *_, e in want)
    assert report["pairs"] == len(want) and report["unmatched a"] == report["unmatched b"] == 60 - len(want)
    assert report["max"] == errors[-1] and report["p50"] == pytest.approx(np.quantile(errors, 0.5)) and report["p95"] == pytest.approx(np.quantile(errors, 0.95))


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], "k string, id int, v double")
    assert J.match_windows(none, none, ["k"], "v", 1.0).count() == 0
    assert {r.measure: r.value for r in J.match_report(J.match_windows(none, none, ["k"], "v", 1.0), none, none, ["k"]).collect()} == {"pairs": 0, "within": 0, "max": None, "unmatched a": 0, "unmatched b": 0}


def test_eligibility(spark):
    official = spark.createDataFrame([(1, "aria"), (2, "quest"), (3, "aria"), (5, None)], "k int, device string")
    asked, held = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "k int"), spark.createDataFrame([(1,), (1,), (2,)], "k int")
    got = J.eligibility(official, asked, "k", {"device": F.lit("aria")}, held)
    assert {r.k: r.status for r in got.collect()} == {1: "eligible", 2: "wrong device", 3: "absent archive", 4: "not listed", 5: "wrong device"}
    with pytest.raises(ValueError, match="eligible"):
        J.eligibility(official, asked, "k", strict=True)
    assert J.eligibility(official, asked.filter("k < 4"), "k", strict=True).count() == 3


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_window_targets(spark, share):
    picks = spark.createDataFrame([(7, 10, 4), (8, 10, 1)], "video int, anchor int, target_count int")
    frames = spark.createDataFrame([(v, 0 if f < 30 else 1, f, f % 2 == 0) for v in (7, 8) for f in range(60)], "video int, interval int, frame int, kept boolean")
    got = {r.video: r for r in W.window_targets(picks, frames, 1, 3, share).collect()}
    later = list(range(12, 30, 2))
    assert got[7].history == [8, 9, 10] and got[7].targets == (later[:4] if share else [later[i * (len(later) - 1) // 3] for i in range(4)])
    assert got[8].targets == (later[:1] if share else later[-1:]) and got[8].mode == ("consecutive" if share else "spread")


def test_union_over_aliases(spark):
    chosen = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 1)], "source string, group int")
    aliases = spark.createDataFrame([("y", "x")], "logical string, physical string")
    assert sorted(map(tuple, W.union_over_aliases(chosen, aliases).collect())) == [("x", 1, 2), ("x", 2, 1), ("z", 1, 1)]


def angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.degrees(np.arccos(np.clip((np.trace(a[:3, :3].T @ b[:3, :3]) - 1) / 2, -1, 1))))


def test_pose_metrics(spark):
    rng = np.random.default_rng(8)
    names = ("camera", "left", "right")
    steps = [{f"{x}_{n}": pose(rng) for x in "pt" for n in names} | {f"{x}_{n}_fingers": [pose(rng)[:3, :3] for _ in range(15)] for x in "pt" for n in names[1:]} for _ in range(4)]
    masks = [(True, True, True, True, True), (True, True, False, False, True), (False, True, None, True, False), (True, False, True, False, False)]
    flat = lambda v: [np.asarray(x).ravel().tolist() for x in v] if isinstance(v, list) else v.ravel().tolist()
    oks = ("camera_ok", "left_ok", "right_ok", "left_fingers_ok", "right_fingers_ok")
    rows = [{"source": "s", "step": i % 2 + 1, "horizon_seconds": float(i)} | {k: flat(v) for k, v in s.items()} | dict(zip(oks, m, strict=True)) for i, (s, m) in enumerate(zip(steps, masks, strict=True))]
    kinds = ", ".join(["source string, step int, horizon_seconds double"] + [f"{k} array<{'array<double>' if 'fingers' in k else 'double'}>" for k in steps[0]] + [f"{k} boolean" for k in oks])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    got = {r.measure: (r.value, r.n) for r in M.pose_metrics(df, "source").collect()}
    want: dict[str, list[float]] = {m: [] for m in ("camera_cm", "camera_deg", "wrist_cm", "wrist_deg", "finger_deg", "relative_cm", "relative_deg", "horizon_seconds")}
    for i, (s, m) in enumerate(zip(steps, masks, strict=True)):
        if m[0]:
            want["camera_cm"].append(100 * np.linalg.norm(s["p_camera"][:3, 3] - s["t_camera"][:3, 3]))
            want["camera_deg"].append(angle(s["p_camera"], s["t_camera"]))
        for k, n in enumerate(names[1:]):
            if m[1 + k]:
                want["wrist_cm"].append(100 * np.linalg.norm(s[f"p_{n}"][:3, 3] - s[f"t_{n}"][:3, 3]))
                want["wrist_deg"].append(angle(s[f"p_{n}"], s[f"t_{n}"]))
            if m[0] and m[1 + k]:
                a, b = (np.linalg.inv(s[f"{x}_camera"]) @ s[f"{x}_{n}"] for x in "pt")
                want["relative_cm"].append(100 * np.linalg.norm(a[:3, 3] - b[:3, 3]))
                want["relative_deg"].append(angle(a, b))
            if m[3 + k]:
                want["finger_deg"].append(np.mean([angle(x, y) for x, y in zip(s[f"p_{n}_fingers"], s[f"t_{n}_fingers"], strict=True)]))
        if i % 2 == 0:
            want["horizon_seconds"].append(float(i))
    assert {k: n for k, (_, n) in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        assert got[k][0] == pytest.approx(np.mean(v)), k


def test_coverage_of_segments(spark):
    segments = spark.createDataFrame([("a", 1, 5, "t"), ("a", 8, 12, "t"), ("a", 20, 30, "t"), ("b", 0, 1, "t")], "recording string, anchor int, last int, split string")
    streams = spark.createDataFrame([("a", 10)], "recording string, frames int")
    wrists = spark.createDataFrame([("a", 1, True, True), ("a", 8, False, True)], "recording string, frame int, hand0 boolean, hand1 boolean")
    assert A.coverage_report(segments, streams, wrists, "split").first().asDict() == {"split": "t", "segments": 4, "without_pose": 1, "anchor_beyond": 1, "truncated": 2, "whole": 1, "hand0": 1, "hand1": 2, "any_hand": 2, "both_hands": 1}


def test_sample_rules(spark):
    good = {"history_state": [[0.0] * 3] * 2, "history_time": [-1.0, 0.0], "history_stream_mask": [[True, False]] * 2, "history_state_mask": [[True, False, False]] * 2, "future_state": [[0.0] * 3], "future_time": [1.0], "future_stream_mask": [[True, False]], "future_state_mask": [[True, False, False]], "future_query_mask": [[True, True]], "intrinsics": [1.0] * 4}
    broken = {
        "": {}, "history_shape": {"history_time": [0.0]}, "future_finite": {"future_time": [float("nan")]}, "future_coordinates_in_streams": {"future_state_mask": [[True, True, False]]},
        "supervision_is_asked": {"future_query_mask": [[False, True]]}, "intrinsics": {"intrinsics": None}, "history_mask_shape": {"history_stream_mask": [[True, False]], "history_state_mask": [[True, False, False]]},
    }
    kinds = ", ".join(["name string"] + [f"{k} " + ("array<double>" if "time" in k or k == "intrinsics" else "array<array<boolean>>" if "mask" in k else "array<array<double>>") for k in good])
    df = spark.createDataFrame([(name, *(good | change).values()) for name, change in broken.items()], kinds)
    checks = E.sample_checks(3, {"camera": (0, 1), "wrist": (1, 2)})
    for r in df.select("name", F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in checks.items()])), ",").alias("broken")).collect():
        assert r.broken == r.name


def test_clip_files_and_media(spark, tmp_path):
    turn = {"quaternion_wxyz": [1.0, 0.0, 0.0, 0.0], "translation_xyz": [1.0, 2.0, 3.0]}
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "000003.cameras.json").write_text(json.dumps({"main": {"T_world_from_camera": turn}}))
    (tmp_path / "c1" / "000003.hands.json").write_text(json.dumps({"left": {"umetrack_pose": {"T_world_from_wrist": turn}}, "right": {"umetrack_pose": None}}))
    (tmp_path / "c1" / "000004.cameras.json").write_text(json.dumps({"other": {}}))
    got = {r.frame: r for r in R.read_clip_json(spark, str(tmp_path), "main").collect()}
    want = [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    assert got[3].clip == "c1" and got[3].camera_pose == want and got[3].left_pose == want and got[3].left_valid and not got[3].right_valid and got[3].right_pose is None
    assert got[4].camera_pose is None and not got[4].left_valid
    for name in ("b.MP4", "a.mp4"):
        (tmp_path / "c1" / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in R.list_media(spark, str(tmp_path), [".mp4", ".webm"]).collect()] == ["a.mp4", "b.MP4"]
    with pytest.raises(FileNotFoundError):
        R.list_media(spark, str(tmp_path), [".avi"])
