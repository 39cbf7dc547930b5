"""Kept aggregates, bounded streams, observed writes, files that change, nested configs, bucketed plans, SQL table functions."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import exprs as E
from kinetrace.operators import aggregates as A
from kinetrace.operators import features as X
from kinetrace.operators import joins as J
from kinetrace.operators import kept
from kinetrace.operators import publish as K
from kinetrace.operators import table_functions as tables
from kinetrace.plans.shared import Scratch
from kinetrace.streaming import unseen

ROWS = "g string, x double, y long"


def file_of(spark, folder, name, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def moments(rows):
    out = {}
    for axis, at in (("x", 1), ("y", 2)):
        for g in {r[0] for r in rows}:
            v = [float(r[at]) for r in rows if r[0] == g and r[at] is not None]
            if v:
                mean = math.fsum(v) / len(v)
                out[(g, axis)] = (len(v), mean, math.sqrt(math.fsum((a - mean) ** 2 for a in v) / len(v)), min(v), max(v))
    return out


def test_moments_are_kept_by_file(spark, tmp_path):
    rng = random.Random(2)
    data = {n: [(rng.choice(["a", "b", None]), rng.choice([1e6 + rng.random(), None]), rng.randrange(9)) for _ in range(50)] for n in "pqrs"}
    root, folder = str(tmp_path / "in"), str(tmp_path / "states")
    same = lambda files, names: {k: pytest.approx(v, rel=1e-6) for k, v in moments([r for n in names for r in data[n]]).items()} == {(r.g, r.axis): (r.n, r.mean, r["std"], r.least, r.greatest) for r in kept.kept_moments(files, folder, ["g"], ["x", "y"]).collect()}
    partial = lambda rows: kept.partial_moments(rows, [*kept.FILE, "g"], ["x", "y"])
    seen = ""
    for n in "pqr":  # three increments
        file_of(spark, root, n, data[n])
        seen += n
        files = kept.listed(spark, root)
        assert kept.refresh(files, folder, partial) == 1 and kept.refresh(files, folder, partial) == 0
        assert same(files, seen)
    gone = kept.listed(spark, root).filter(~F.col("path").contains("/q/"))  # one is removed
    assert kept.refresh(gone, folder, partial) == 0 and same(gone, "pr")
    data["p"] = data["s"]  # one changes
    file_of(spark, root, "p", data["p"])
    files = kept.listed(spark, root)
    assert kept.refresh(files, folder, partial) == 1 and same(files, "pqr")
    empty = [("a", None, None)] * 3
    data["e"] = empty  # one without values is not read twice
    file_of(spark, root, "e", empty)
    files = kept.listed(spark, root)
    assert kept.refresh(files, folder, partial) == 1 and kept.refresh(files, folder, partial) == 0 and same(files, "pqre")


def test_a_batch_that_was_written_twice_counts_once(spark, tmp_path):
    root, folder = str(tmp_path / "in"), str(tmp_path / "states")
    file_of(spark, root, "a", [("k", 1.0, 2)] * 4)
    files = kept.listed(spark, root)
    counters = {"big": F.col("y") > 1, "none": F.lit(None).cast("boolean")}
    want = [("k", "big", 4), ("k", "none", 0)]
    assert sorted(map(tuple, kept.kept_counts(files, folder, ["g"], counters).collect())) == want
    spark.read.parquet(f"{folder}/batch-*").withColumn("batch", F.lit("zz")).write.parquet(f"{folder}/batch-zz")
    assert sorted(map(tuple, kept.kept_counts(files, folder, ["g"], counters).collect())) == want
    assert kept.current(files, str(tmp_path / "nothing")) is None


def test_unseen_keys_with_bounded_state(spark, tmp_path):
    """Batches by hand: late rows are told apart, a restart goes on with the state, an expired key is new again."""
    at = lambda minutes: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minutes)
    schema, out, state, folder = "k string, at timestamp", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ValueError, match="providerClass"):
        unseen.ingest_unseen(spark.readStream.schema(schema).parquet(str(tmp_path)), ["k"], "at", out, state)
    spark.conf.set(name, unseen.ROCKS)
    told = []

    def run(*batches):
        for rows in batches:
            spark.createDataFrame([(k, at(m) if m is not None else None) for k, m in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        unseen.ingest_unseen(stream, ["k"], "at", out, state, keep="60 minutes", late="10 minutes").awaitTermination()
        now = sorted((r.k, r.status, round((r.at - datetime.datetime(2024, 1, 1)).total_seconds() / 60)) for r in spark.read.schema("k string, at timestamp_ntz, status string").parquet(out).collect())
        new = list(now)
        for t in told:
            new.remove(t)
        told[:] = now
        return new

    try:
        assert run([("a", 5), ("a", 3), ("b", 4), (None, 4), ("c", None)]) == [("a", "new", 3), ("b", "new", 4)]
        # the watermark is 30 - 10 = 20 after the next batch; a row of minute 6 is late then, one of minute 25 is not
        assert run([("a", 30)]) == []
        assert run([("b", 6), ("d", 6), ("e", 25)]) == [("b", "late", 6), ("d", "late", 6), ("e", "new", 25)]  # a restart each time
        # far ahead: a (30) and e (25) expire once the watermark has passed 90; b (4) at 64; then they are new again
        assert run([("z", 200)]) == [("z", "new", 200)]
        assert run([("y", 201)]) == [("y", "new", 201)]  # timers fire
        assert run([("a", 202), ("b", 203), ("z", 204)]) == [("a", "new", 202), ("b", "new", 203)]
    finally:
        spark.conf.set(name, before)


def test_checks_are_taken_by_the_write(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    df = spark.range(100).repartition(3).select(counted.asNondeterministic()("id").alias("id"))
    path = str(tmp_path / "t")
    measures = {"least": F.min("id"), "bad": F.count_if(F.col("id") < 0)}
    good = K.publish_observed(df, path, measures, lambda m: {"rows": m["rows"] == 100, "least": m["least"] == 0, "bad": m["bad"] == 0})
    assert calls.value == 100 and all(r.passed for r in good.collect()) and K.published(spark, path).count() == 100  # each row was worked out once
    held = K.publish_observed(df, path, measures, lambda m: {"rows": m["rows"] == 99, "unknown": None})
    assert {r.check: r.passed for r in held.collect()} == {"rows": False, "unknown": None} and K.published(spark, path) is None
    empty = K.publish_observed(df.limit(0), path, measures, lambda m: {"rows": m["rows"] == 0, "least": m["least"] is None})
    assert all(r.passed for r in empty.collect())


def test_runs_say_whether_they_are_complete(spark):
    def work(row):
        if row["id"] % 10 == 3:
            raise KeyError("three")
        return {"n": row["id"] * 2}

    out = T.StructType([T.StructField("n", T.LongType())])
    ok, failures, report = K.quarantine_report(spark.range(30), work, out, "id")
    assert report == {"assigned": 30, "successful": 27, "failed": 3, "complete": False} and ok.count() == 27 and failures.count() == 3
    assert K.quarantine_report(spark.range(3), work, out, "id")[2] == {"assigned": 3, "successful": 3, "failed": 0, "complete": True}
    assert K.quarantine_report(spark.range(0), work, out, "id")[2] == {"assigned": 0, "successful": 0, "failed": 0, "complete": True}


def test_a_file_that_changes_is_a_failure(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text("x" * i)

    def read(row):
        path = row["path"]
        with open(path) as file:
            n = len(file.read())
        if path.endswith("3.txt"):
            with open(path, "a") as file:
                file.write("more")
        if path.endswith("4.txt"):
            raise OSError("unreadable")
        return {"n": n}

    files = spark.createDataFrame([(i, str(tmp_path / f"{i}.txt")) for i in range(7)], "id int, path string")
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("fingerprint", T.StringType())])
    ok, failures = K.quarantine(files, X.unchanged(read, "path", stamp=True), out, "id")
    assert {r.id: r.error_type for r in failures.collect()} == {3: "ValueError", 4: "OSError", 6: "FileNotFoundError"}
    assert {r.id: (r.n, r.fingerprint) for r in ok.collect()} == {i: (i, hashlib.sha256(str(i).encode() + b"x" * i * 2).hexdigest()) for i in (0, 1, 2, 5)}


def test_nested_configs_are_canonical(spark):
    kind = "struct<z: int, a: struct<d: array<struct<y: string, b: boolean>>, c: map<string, struct<q: int, p: double>>>>"
    values = [{"z": 1, "a": {"d": [{"y": 'ä"\n', "b": True}, {"y": None, "b": None}, None], "c": {"k2": {"q": 1, "p": 0.5}, "k10": None, "K": {"q": None, "p": 2.25}}}}, {"z": None, "a": None}, {"z": 2, "a": {"d": [], "c": {}}}]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r.i: r for r in df.select("i", K.canonical_json(F.col("v"), df.schema["v"].dataType).alias("j"), K.nested_digest(df, "v").alias("h")).collect()}
    for i, v in enumerate(values):
        text = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[i].j == text and got[i].h == hashlib.sha256(text.encode()).hexdigest()


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_bucketed_tables_join_without_a_shuffle(spark):
    frames = spark.range(5000).selectExpr("concat('d', id % 2) AS dataset", "id % 37 AS video", "id % 11 AS frame")
    lines = frames.groupBy("dataset", "video").agg(F.array_repeat(F.lit(0.5), 8).alias("pts"), F.lit(9).alias("pts_frames"))
    aliases = spark.createDataFrame([("d1", "e")], "logical string, physical string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Scratch(spark) as temp:
            a = temp.bucketed(frames, "frames", ["dataset", "video"], 8)
            b = temp.bucketed(lines, "lines", ["dataset", "video"], 8)
            wanted = a.select("dataset", "video", "frame").distinct()
            plans = [J.attach_pts(a, b, ["dataset", "video"]), *J.attach_features(a, b, ["dataset", "video"]), A.frame_requests(a, aliases.limit(0))[0], A.video_summary(wanted, b.select("dataset", "video", "pts_frames"))]
            assert [exchanges(p) for p in plans] == [[]] * 5
            assert exchanges(J.attach_pts(frames, lines, ["dataset", "video"]))  # as it is without buckets
            assert plans[0].filter("pts_status = 'ok'").count() == sum(f < 8 for f in (i % 11 for i in range(5000)))
            names = list(temp.tables.values())
        assert not any(spark.catalog.tableExists(n) for n in names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_from_sql(spark):
    from kinetrace.operators.windows import make_windows

    tables.register(spark)
    lengths = spark.createDataFrame([(v, n) for v, n in enumerate([0, 4, 5, 6, 17, 40, None])], "video int, length int")
    for history, future, stride, tail in ((2, 3, None, True), (3, 3, 2, False), (1, 1, 7, True)):
        got = spark.sql(f"SELECT v.video, w.* FROM {{lengths}} v, LATERAL kt_windows(v.length, {history}, {future}, {stride or 'NULL'}, {str(tail).lower()}) w", lengths=lengths)
        want = make_windows(lengths.filter("length IS NOT NULL"), history, future, stride, tail).drop("length")
        assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    with pytest.raises(Exception, match="at least 1"):
        spark.sql("SELECT * FROM kt_windows(10, 0, 3)").collect()
    with pytest.raises(Exception, match="boundaries"):
        spark.sql("SELECT * FROM kt_prompts(TABLE({lengths}))", lengths=lengths).collect()


def test_rules_of_visual_parts(spark):
    base = {"history_time": [0.0, 0.1], "future_time": [0.2], "context_image_shapes": [[3, 4, 5], [3, 4, 5]], "context_visual_features": [[1.0, 2.0]] * 2, "context_text_features": [1.0] * 3, "future_visual_latents": [[1.0]], "history_fingertips": [[0.0] * 30] * 2, "future_fingertips": [[0.0] * 30], "history_hand_joints_local": [[0.0] * 126] * 2, "future_hand_joints_local": None}
    broken = {
        "context_images": [{"context_image_shapes": x} for x in ([[3, 4, 5]], [[3, 4, 5], [3, 4, 6]], [[1, 4, 5]] * 2, [[3, 4]] * 2, [None, [3, 4, 5]])], "context_visual_features": [{"context_visual_features": x} for x in ([[1.0]], [[1.0], [1.0, 2.0]])],
        "context_text_features": [{"context_text_features": [1.0]}], "future_visual_latents": [{"future_visual_latents": []}], "history_fingertips": [{"history_fingertips": [[0.0] * 29] * 2}], "future_fingertips": [{"future_fingertips": [[0.0] * 30] * 2}], "history_hand_joints_local": [{"history_hand_joints_local": [[0.0] * 126]}],
    }
    rows = [("", base), *((rule, base | change) for rule, changes in broken.items() for change in changes)]
    kinds = {"history_time": "array<double>", "future_time": "array<double>", "context_image_shapes": "array<array<int>>", "context_text_features": "array<double>"}
    df = spark.createDataFrame([(rule, *r.values()) for rule, r in rows], "rule string, " + ", ".join(f"{c} {kinds.get(c, 'array<array<double>>')}" for c in base))
    rules = E.visual_checks(text_size=3)
    for r in df.select("rule", *[ok.alias(f"ok_{n}") for n, ok in rules.items()]).collect():
        assert [n for n in rules if not r[f"ok_{n}"]] == ([r["rule"]] if r["rule"] else [])


def test_a_key_has_one_timer():
    """A later time costs no call for the timer; one that fires too early is set anew, and the state goes when it is due."""
    import pandas as pd

    class Held:
        value, timers = None, []
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        held, timers, calls = Held(), [], 0

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, at):
            self.calls += 1
            self.timers.append(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.remove(at)

    class Mark:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    handle, keys = Handle(), unseen.Unseen(100)
    keys.init(handle)
    told = [r for at in (5, 30, 50) for out in keys.handleInputRows(("a",), iter([pd.DataFrame({"at_ms": [at]})]), Mark(0)) for r in out["status"]]
    assert told == ["new"] and handle.timers == [105] and handle.calls == 1
    list(keys.handleExpiredTimer(("a",), Mark(120), None))
    assert handle.held.value == (50,) and handle.timers == [105, 150]
    list(keys.handleExpiredTimer(("a",), Mark(200), None))
    assert handle.held.value is None
