"""Matching of arrays, as-of scans, prefix products and sweeps against plain loops, on keys that hold most rows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.operators import aggregates as A
from kinetrace.operators import joins as J
from kinetrace.operators import matching as M
from kinetrace.operators import odometry as O
from kinetrace.plans.shared import carried, in_ranges

SIDE = "key string, id long, value array<double>"


def greedy(a, b, tolerance):
    """Admissible pairs of classes (rows equal in key and array) by (error, least ids); members by ascending id."""
    classes = []
    for side in (a, b):
        of = defaultdict(list)
        for key, i, v in side:
            if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
                of[(key, tuple(v))].append(i)
        classes.append({k: sorted(ids) for k, ids in of.items()})
    edges = sorted((max((abs(x - y) for x, y in zip(va, vb, strict=True)), default=0.0), ia[0], ib[0], ka, va, vb) for (ka, va), ia in classes[0].items() for (kb, vb), ib in classes[1].items() if ka == kb and len(va) == len(vb) and max((abs(x - y) for x, y in zip(va, vb, strict=True)), default=0.0) <= tolerance)
    out = []
    for error, _, _, key, va, vb in edges:
        ia, ib = classes[0][(key, va)], classes[1][(key, vb)]
        while ia and ib:
            out.append((key, ia.pop(0), ib.pop(0), error))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [0.0, 0.6])
def test_arrays_are_matched_one_to_one(spark, tolerance):
    rng = random.Random(7)
    grid = lambda: [rng.randrange(6) / 4 for _ in range(3)]  # noqa: E731  few values: many copies, ties in error
    sides = [[(rng.choice(["hot", "hot", "hot", "k"]), i * 3 + s, grid()) for i in range(90)] for s in (0, 1)]
    sides[0] += [("hot", 1000 + i, [9.0, 9.0, 9.0]) for i in range(40)] + [("hot", 2000, None), ("hot", 2001, [1.0, None, 1.0]), ("hot", 2002, [float("nan")] * 3), (None, 2003, [1.0, 1.0, 1.0]), ("hot", 2004, [1.0]), ("hot", 2005, [])]
    sides[1] += [("hot", 3000 + i, [9.0, 9.0, 9.0]) for i in range(25)] + [("hot", 3100, [9.1, 9.0, 9.0])] * 2 + [("hot", 3200, [1.0, 1.0, 1.0, 1.0]), (None, 3201, [1.0, 1.0, 1.0])]
    frames = [spark.createDataFrame(s, SIDE).repartition(5) for s in sides]
    got = M.match_arrays(*frames, ["key"], "value", tolerance)
    assert sorted((r.key, r.a, r.b, r.error) for r in got.collect()) == greedy(*sides, tolerance)
    report = {r.measure: r.value for r in J.match_report(got, *frames, ["key"]).collect()}
    assert report["pairs"] == report["within"] == got.count()


@pytest.mark.parametrize("whole", [0, 60, 10**6])
def test_keys_are_matched_alike_in_a_task_and_in_rounds(spark, monkeypatch, whole):
    """Keys over and under the bound, in batches that end inside a key; a key under it lists no pairs outside its task."""
    rng = random.Random(11)
    value = lambda: [rng.randrange(5) / 4 for _ in range(rng.choice([2, 2, 2, 1, 0]))]
    sides = [[(rng.choice(["hot", "hot", "x", "y", "z"]), i * 2 + s, value()) for i in range(150)] + [("x", 5000 + i, [-0.0, 0.0]) for i in range(5 + s)] for s in (0, 1)]
    sides[0] += [("alone", 1, [0.0])]
    monkeypatch.setattr(M, "WHOLE", whole)
    monkeypatch.setattr(M, "PAIRS", 50)
    listed = []
    monkeypatch.setattr(M, "near_classes", lambda a, b, *more, near=M.near_classes: (listed.append({r.key for r in a.unionByName(b).collect()}), near(a, b, *more))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frames = [spark.createDataFrame(s, SIDE).repartition(3) for s in sides]
        got = M.match_arrays(*frames, ["key"], "value", 0.3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.key, r.a, r.b, r.error) for r in got) == greedy(*sides, 0.3)
    many = {k for k in ("hot", "x", "y", "z", "alone") if sum(r[0] == k for s in sides for r in s) > whole}
    assert listed == ([many] if many else [])


def test_no_side_no_pairs(spark):
    none = spark.createDataFrame([], SIDE)
    some = spark.createDataFrame([("k", 1, [0.0])], SIDE)
    for a, b in ((none, some), (some, none)):
        out = M.match_arrays(a, b, ["key"], "value", 1.0)
        assert out.columns == ["key", "a", "b", "error", "within"] and out.count() == 0


def test_values_are_carried_over_ranges_without_any(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 4}", i, float(i) if rng.random() < 0.02 else None) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        df = in_ranges(spark.createDataFrame(rows, "g string, at long, v double").repartition(3), ["g", "at"])
        out = carried(carried(df, ["g"], ["at"], F.col("v"), "before"), ["g"], ["at"], F.col("v"), "after", backward=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r._part for r in out if r.g == "hot"}) > 3  # most rows, and not in one task
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.at)
        last = None
        for r in mine:
            last = r.v if r.v is not None else last
            assert r.before == last
        last = None
        for r in reversed(mine):
            last = r.v if r.v is not None else last
            assert r.after == last


def test_no_window_over_a_video_alone(spark):
    """Every window over rows is by (video, range); only tables with a row a range are scanned by video."""
    frames = spark.range(1000).selectExpr("0L AS video", "id AS frame", "double(id) AS pts")
    plan = J.nearest_time_join(frames.selectExpr("video", "frame AS anchor", "pts"), frames, [0.0, 1.5], 1.0)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window" in line and "_end" not in line]
    assert over and all("_part" in line.split("], [")[1] for line in over)


def test_nearest_frames_of_one_long_video(spark):
    rng = random.Random(5)
    times = sorted({round(rng.uniform(0, 500), 2) for _ in range(900)})
    frames = [(0, i, t) for i, t in enumerate(times)] + [(1, 0, 3.0)]
    df = spark.createDataFrame(frames, "video long, frame long, pts double").repartition(6)
    got = {(r.video, r.anchor): r for r in J.nearest_time_join(df.selectExpr("video", "frame AS anchor", "pts"), df, [-2.0, 0.0, 2.5], 0.4).collect()}
    assert len(got) == len(frames)
    for video, anchor, pts in frames:
        mine = [(f, t) for v, f, t in frames if v == video]
        picks = [min(mine, key=lambda x, at=pts + o: (abs(x[1] - at), x[1])) for o in (-2.0, 0.0, 2.5)]
        worst = max(abs(t - pts - o) for (_, t), o in zip(picks, (-2.0, 0.0, 2.5), strict=True))
        r = got[(video, anchor)]
        assert r.frames == [f for f, _ in picks] and r.worst == pytest.approx(worst)
        assert r.eligible == (worst <= 0.4 and picks[0][0] < picks[1][0] < picks[2][0] and picks[1][0] == anchor)


def test_grid_of_one_long_key(spark):
    rng = random.Random(6)
    frames = [("hot", f, float(f)) for f in sorted(rng.sample(range(30_000), 700))] + [("one", 5, 5.0)]
    out = J.densify_nearest(spark.createDataFrame(frames, "key string, frame long, value double"), "key", 3).collect()
    for key in ("hot", "one"):
        mine = [f for k, f, _ in frames if k == key]
        got = sorted((r.frame, r.source, r.value, r.valid) for r in out if r.key == key)
        assert [g[0] for g in got] == list(range(0, max(mine) + 1, 3))
        assert all((s, v, ok) == (n, float(n), n == f) for f, s, v, ok in got for n in [min(mine, key=lambda x, f=f: (abs(x - f), x))])


def turn(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = (q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]), rng.normal(size=3)
    return m


def test_prefix_products_of_a_long_episode(spark):
    """10^5 steps of one episode, with gaps and below zero, against the fold; in blocks so small that three levels are needed."""
    rng = np.random.default_rng(8)
    kinds = [turn(rng) for _ in range(50)]
    at = np.sort(rng.choice(np.arange(-20_000, 130_000), 100_000, replace=False))
    picks = rng.integers(0, 50, len(at))
    rows = spark.createDataFrame([("long", int(s), int(k)) for s, k in zip(at, picks, strict=True)] + [("short", 3, 1), ("short", 4, 2)], "g string, step long, k int")
    table = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(kinds)], "k int, transform array<double>")
    steps = rows.join(F.broadcast(table), "k").select("g", "step", "transform").repartition(8)
    got = {r.step: np.array(r.pose).reshape(4, 4) for r in O.prefix_products(steps, ["g"], block=64).filter("g = 'long'").collect()}
    now, worst = np.eye(4), 0.0
    for s, k in zip(at, picks, strict=True):
        now = now @ kinds[k]
        worst = max(worst, np.abs(got[int(s)] - now).max())
    assert len(got) == 100_000 and worst < 1e-7


def test_poses_of_an_episode_are_those_of_its_window(spark):
    rng = np.random.default_rng(9)
    steps = [turn(rng) for _ in range(40)]
    df = spark.createDataFrame([("w", i, m.ravel().tolist()) for i, m in enumerate(steps)], "w string, step int, transform array<double>")
    want = {r.step: r.pose for r in J.compose_odometry(df, ["w"], 17).collect()}
    anchors = spark.createDataFrame([("w", 17), ("w", 99), ("other", 1)], "w string, anchor int")
    got = {r.step: r.pose for r in O.episode_poses(df, ["w"], anchors, block=4).collect()}
    assert set(got) == set(want) == set(range(40)) and all(np.allclose(got[s], want[s]) for s in want)
    assert O.episode_poses(df.limit(0), ["w"], anchors).count() == 0


def test_capacity_by_sweep(spark):
    rng = random.Random(4)
    frames = [(v, f, f * 0.5 + v, rng.random() < 0.6) for v in (0, 1, 2) for f in range(300 if v == 0 else 20)]
    spans = [(0 if rng.random() < 0.8 else 1, s, s + rng.randrange(-2, 90)) for s in (rng.randrange(280) for _ in range(120))] + [(1, 0, 20), (2, 25, 30), (9, 0, 5)]
    got = {r.video: (r.targets, r.horizon) for r in A.episode_capacity(spark.createDataFrame(frames, "video int, frame long, pts double, kept boolean"), spark.createDataFrame(spans, "video int, start long, end long"), 6).collect()}
    want = {}
    for v, a, b in spans:
        mine = [t for w, f, t, kept in frames if w == v and kept and max(a, 5) <= f < b]
        if len(mine) >= 2:
            want[v] = max(want.get(v, (0, 0.0)), (len(mine) - 1, mine[-1] - mine[0]))
    assert got == want


def test_rate_of_one_long_group(spark):
    rng = random.Random(2)
    times = {"all": [rng.uniform(0, 1000) for _ in range(2001)], "b": [1.0, 1.5, 3.0], "lone": [4.0], None: [0.0, 2.0]}
    rows = [(g, t) for g, ts in times.items() for t in ts]
    got = {r.g: r.rate for r in A.effective_rate(spark.createDataFrame(rows, "g string, t double").repartition(5), "g", "t", 30.0).collect()}
    assert got["lone"] == 30.0 and got[None] == pytest.approx(0.5) and got["b"] == pytest.approx(1.0) and got["all"] == pytest.approx(1 / np.median(np.diff(sorted(times["all"]))))


def test_prompts_by_sweep(spark):
    rng = random.Random(1)
    rows = []
    for e in range(12):
        for p in range(rng.randrange(1, 40) if e else 300):
            s = rng.randrange(-3, 60)
            rows.append((e, rng.choice(["left", "right", None]), rng.choice([p, p % 5, None]), s, s + rng.randrange(-2, 25), rng.choice([f"t{p % 7}", "", None])))
    df = spark.createDataFrame(rows, "episode int, hand string, place long, start long, end long, text string").repartition(5)
    want = set()
    for e in {r[0] for r in rows}:
        mine = [(h, 2**62 if p is None else p, s, t, x) for ep, h, p, s, t, x in rows if ep == e]
        for at in {x for _, _, s, t, _ in mine for x in (s, t)} | {0}:
            if at < max(t for _, _, _, t, _ in mine):
                said = []
                for hand in ("left", "right"):
                    open_ = [(p, x is not None, x) for h, p, s, t, x in mine if h == hand and s <= at < t]
                    if open_ and (first := min(open_, key=lambda o: (o[0], o[1], o[2] or "")))[2] is not None:
                        said.append(f"{hand.capitalize()} hand: {first[2]}")
                want.add((e, " ".join(sorted(said))))
    from kinetrace.operators.table_functions import prompts_by_sweep

    assert {(r.episode, r.prompt) for r in prompts_by_sweep(df).collect()} == want
    assert A.distinct_prompts(df.limit(0)).count() == 0


def test_runs_are_folded_side_by_side():
    rng = np.random.default_rng(4)
    runs = [rng.normal(size=(n, 4, 4)) for n in (1, 7, 3)]
    for run, got in zip(runs, O.folded(runs), strict=True):
        want = [np.eye(4)]
        for step in run:
            want.append(want[-1] @ step)
        assert np.allclose(got, want)


def test_windows_are_sorted_once(spark):
    """One order of a key's values shows both neighbours of each."""
    side = lambda n: spark.range(n).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") * 7 % 5).cast("double").alias("v"))
    plan = J.match_windows(side(9), side(7), ["k"], "v", 1.0)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") and J.match_windows(side(9), side(7), ["k"], "v", 1.0)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_mutual_nearest_by_one_order(spark):
    rng = random.Random(8)
    rows = {s: [(rng.randrange(4), i, rng.choice([None, *map(float, range(40))])) for i in range(120)] for s in "ab"}
    a, b = (spark.createDataFrame(rows[s], "k long, id long, v double") for s in "ab")
    want = set()
    for k in range(4):
        x, y = ([(v, i) for g, i, v in rows[s] if g == k and v is not None] for s in "ab")
        best = lambda v, others: min((abs(v - w), i) for w, i in others)
        for v, i in x:
            e, j = best(v, y)
            if best(next(w for w, n in y if n == j), x) == (e, i):
                want.add((k, i, j, e, e <= 1.0))
    assert {tuple(r) for r in J.match_windows(a, b, ["k"], "v", 1.0).select("k", "a", "b", "error", "within").collect()} == want
