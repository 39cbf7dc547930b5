"""Queries over archives, kept aggregates, audited writes, bounded streams, bucketed tables and SQL table functions."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.functions import exprs as E
from kinetrace.operators import aggregates as A
from kinetrace.operators import features as X
from kinetrace.operators import joins as J
from kinetrace.operators import kept
from kinetrace.operators import publish as K
from kinetrace.operators import resume
from kinetrace.operators import table_functions as tables
from kinetrace.plans.proxy import FRAMES, read, timelines
from kinetrace.plans.shared import Scratch, stored
from kinetrace.sources import archives
from kinetrace.sources import readers as R
from kinetrace.streaming import unseen


#: Users whose files are packed at a time.
PACKED = 256


def _saved(value, pickled: bool = False) -> bytes:
    out = io.BytesIO()
    np.save(out, value, allow_pickle=pickled)
    return out.getvalue()


def _per_video(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("rows"))
    return rows.select("user_id", F.col("rows.event_id").alias("ids"), F.col("rows.value").alias("values"))


def _one_by_one(pack):
    """pack for mapInPandas, over a few rows at a time: what it makes of them is handed on before more is made."""

    def packed(batches):
        for batch in batches:
            for at in range(0, len(batch), PACKED):
                yield from pack([batch[at : at + PACKED]])

    return packed


def _written(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def s1(spark: SparkSession, d: str) -> DataFrame:
    """Users as episodes in tar shards, read in ranges of 64 KB."""

    def pack(batches):
        for batch in batches:
            rows = [(f"shard-{u % 16:02d}", f"group{u % 3}/{u}.npy", _saved(np.array({"video_name": f"user {u}", "anno_type": "even" if u % 2 == 0 else None, "video_decode_frame": list(ids)}, dtype=object), pickled=True)) for u, ids in zip(batch["user_id"], batch["ids"], strict=True)]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    folder = K.scratch(spark, "shards")
    _written(archives.write_tars(_per_video(spark, d).mapInPandas(_one_by_one(pack), "archive string, member string, content binary"), folder))
    out = R.read_episodes(spark, folder, partition_bytes=1 << 16)
    return out.select("member", "source", "video_name", "anno_type", F.array_join(F.transform("frame_ids", lambda x: x.cast("string")), ",").alias("frames"))


def s5_archives(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of clips, in compressed tar archives with JSON and other members: plain ones take a kilobyte a member, 37 times as much.

    Events are dealt to their archives, and members made of them there.
    """
    clip = F.format_string("clip-%02d", F.col("user_id") % 24)
    e = archives.dealt_to_archives(read(spark, d, "events").select(clip.alias("archive"), "event_id", "event_type", "value"), "event_id")
    pose = lambda x: F.struct(F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)]).alias("quaternion_wxyz"), F.array(x, F.col("event_id").cast("double"), F.lit(0.0)).alias("translation_xyz"))
    hand = F.struct(F.struct(pose(F.col("value")).alias("T_world_from_wrist")).alias("umetrack_pose"))
    side = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    parts = {
        "cameras.json": F.to_json(F.map_from_arrays(F.array(F.when(F.col("event_id") % 3 == 0, "other").otherwise("main")), F.array(F.struct(pose(F.col("value") + 1).alias("T_world_from_camera"))))),
        "hands.json": F.when(F.col("event_type") != "error", F.to_json(F.map_from_arrays(F.array(side), F.array(hand)))),
        "info.json": F.to_json(F.struct(F.when(F.col("event_id") % 4 == 0, F.map_from_arrays(F.array(F.lit("main")), F.array(F.col("event_id") * 1000))).alias("image_timestamps_ns"), (F.col("event_id") * 10).alias("ref_timestamp_ns"))),
        "main.jpg": F.lit("image"),
    }
    name = F.format_string("%09d", "event_id")
    rows = e.select("archive", F.inline(F.array(*[F.struct(F.concat(name, F.lit(f".{k}")).alias("member"), v.alias("content")) for k, v in parts.items()])))
    folder = K.scratch(spark, "clips")
    _written(archives.write_tars(rows.filter("content IS NOT NULL"), folder, compressed=True, dealt=True))
    out = R.read_clip_archives(spark, folder, "main", partition_bytes=1 << 18)
    x = lambda c: F.get(c, 3)
    return out.select("clip", "frame", "time_ns", x("camera_pose").alias("camera_x"), x("left_pose").alias("left_x"), "left_valid", x("right_pose").alias("right_x"), "right_valid")


def s8(spark: SparkSession, d: str) -> DataFrame:
    """A file a user, of two segments."""

    def pack(batches):
        for batch in batches:
            rows = []
            for u, ids, values in zip(batch["user_id"], batch["ids"], batch["values"], strict=True):
                points, half = np.stack([np.asarray(values, float), np.asarray(ids, float), np.zeros(len(ids))], axis=1), len(ids) // 2
                segments = [{"hand": h, "start": a, "end": b, "traj3d": points[a:b]} for h, a, b in (("left", 0, half), ("right", half, len(ids)))]
                rows.append((f"{u}.npy", _saved(np.array({"clip": str(u), "segments": segments}, dtype=object), pickled=True)))
            yield pd.DataFrame(rows, columns=["name", "content"])

    folder = K.scratch(spark, "segments")
    _written(archives.write_files(_per_video(spark, d).mapInPandas(_one_by_one(pack), "name string, content binary"), folder))
    total = F.aggregate("traj3d", F.lit(0.0), lambda s, p: s + F.get(p, 0))
    return R.read_segments(spark, folder).select("clip", "hand", "segment", "start", "end", F.size("traj3d").alias("steps"), F.round(total, 4).alias("x"))


def s8_odometry(spark: SparkSession, d: str) -> DataFrame:
    def pack(batches):
        for batch in batches:
            rows = []
            for u, values in zip(batch["user_id"], batch["values"], strict=True):
                m = np.tile(np.eye(4), (len(values), 1, 1))
                m[:, 0, 3] = values
                rows.append((f"{u}.npy", _saved(m)))
            yield pd.DataFrame(rows, columns=["name", "content"])

    folder = K.scratch(spark, "odometry")
    _written(archives.write_files(_per_video(spark, d).mapInPandas(_one_by_one(pack), "name string, content binary"), folder))
    return R.read_odometry(spark, folder).select("clip", "step", F.get("transform", 3).alias("x"), F.aggregate("transform", F.lit(0.0), lambda s, v: s + v).alias("total"))


def k3_observed(spark: SparkSession, d: str) -> DataFrame:
    """Two attempts at one path: the second has a check that fails, so nothing is published after it."""
    orders = read(spark, d, "orders")
    path = K.scratch(spark, "orders")
    measures = {"least": F.min("o_totalprice"), "open": F.count_if(F.col("o_orderstatus") == "O")}
    out = None
    for attempt, least in ((1, 0.0), (2, 1e9)):
        results = K.publish_observed(orders, path, measures, lambda m, least=least: {"rows": m["rows"] > 0, "open": 0 < m["open"] < m["rows"], "least": m["least"] >= least})
        held = K.published(spark, path)
        rows = results.select(F.lit(attempt).alias("attempt"), "check", "passed", F.lit(held.count() if held is not None else 0).cast("long").alias("published"))
        out = rows if out is None else out.unionByName(rows)
    return out


def k2_resume(spark: SparkSession, d: str) -> DataFrame:
    """Orders as shards of 5,000 in two calls: the first ends after a job of two shards, the second keeps those and goes on; then rows and least key of each shard, as stored."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = K.scratch(spark, "shards")
    resume.publish_shards(orders, ["o_orderkey"], 5000, path, "orders", shards_a_job=2, most_jobs=1)
    told = resume.publish_shards(orders, ["o_orderkey"], 5000, path, "orders")
    held = resume.published_shards(spark, path, orders.schema).groupBy("shard").agg(F.count(F.lit(1)).alias("stored"), F.min("o_orderkey").alias("least"), F.sum("index").alias("places"))
    return told.join(held, "shard").select("shard", "rows", "stored", "state", "least", "places")


def _parse(row: dict) -> dict:
    import json

    k = json.loads(row["props"])["k"]
    if k % 7 == 0:
        raise ValueError("k divides by seven")
    return {"k": int(k)}


def k5_complete(spark: SparkSession, d: str) -> DataFrame:
    """A run over all events, and one over those that can't fail."""
    events = read(spark, d, "events").select("event_id", "props", "event_type")
    out = T.StructType([T.StructField("k", T.LongType())])
    fine = events.filter("CAST(get_json_object(props, '$.k') AS INT) % 7 <> 0")
    reports = [(name, *[report[c] for c in ("assigned", "successful", "failed", "complete")]) for name, report in ((n, K.quarantine_report(df, _parse, out, "event_id")[2]) for n, df in (("all", events), ("fine", fine)))]
    return spark.createDataFrame(reports, "run string, assigned long, successful long, failed long, complete boolean")


def k6_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    config = F.struct(F.struct(F.col("lang").alias("b"), F.col("source").alias("a")).alias("z"), F.array(F.struct(F.col("doc_id").alias("y"), F.col("n_chars").alias("x"))).alias("a"), F.map_from_arrays(F.array(F.lit("q"), F.lit("p")), F.array(F.col("doc_id") % 2 == 0, F.lit(None).cast("boolean"))).alias("m"))
    rows = docs.select("doc_id", config.alias("config"))
    return rows.select("doc_id", K.nested_digest(rows, "config").alias("config"))


def _changing(row: dict) -> dict:
    with open(row["path"].removeprefix("file:").replace("///", "/"), "r+") as file:
        times = [float(x) for x in file.read().split()]
        if row["video"] % 5 == 0:
            file.write("\n0.0")  # someone writes to it meanwhile
    return {"frames": len(times), "last": times[-1]}


def x3_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Files of times, some of which change while they are read; what is done is not listed as pending again."""
    folder = K.scratch(spark, "times")
    rows = timelines(spark, d).groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pts")), lambda x: x.cast("string")), "\n").alias("content"))
    _written(archives.write_files(rows.select(F.format_string("%d.txt", "video").alias("name"), "content"), folder))
    files = R.list_media(spark, folder, [".txt"]).withColumn("video", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))
    out = T.StructType([T.StructField("frames", T.LongType()), T.StructField("last", T.DoubleType()), T.StructField("fingerprint", T.StringType())])
    ok, failures, _ = K.quarantine_report(files, X.unchanged(_changing, "path", stamp=True), out, "video")
    left = K.pending(files.select("video"), ok.select("video"), ["video"]).withColumn("pending", F.lit(True))
    good = ok.select("video", F.lit("ok").alias("status"), "frames")
    bad = failures.select("video", F.concat_ws(": ", "error_type", "message").alias("status"), F.lit(None).cast("long").alias("frames"))
    return good.unionByName(bad).join(left, "video", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


def _files(spark: SparkSession, d: str, table: str, key: str) -> tuple[str, DataFrame]:
    folder = K.scratch(spark, table)
    rows = read(spark, d, table).withColumn("part", (F.col(key) % 5).cast("int")).repartition("part")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, 5)  # a task streams its rows into a file a part; without it, it would first sort a fifth of the table
    try:
        rows.write.partitionBy("part").parquet(folder)
    finally:
        spark.conf.set(name, before)
    files = kept.listed(spark, folder)
    return K.scratch(spark, "states"), files.withColumn("_part", F.regexp_extract("path", r"part=([0-9]+)", 1).cast("int"))


def a8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Moments of line items in five files: two come, two more, the last while one goes. `read` says how many files the last step read."""
    states, files = _files(spark, d, "lineitem", "l_orderkey")
    axes, by = ["l_quantity", "l_extendedprice"], ["l_linestatus"]
    at = lambda *parts: files.filter(F.col("_part").isin(*parts)).drop("_part")
    for parts in ((0, 1), (0, 1, 2, 3)):
        kept.refresh(at(*parts), states, lambda rows: kept.partial_moments(rows, [*kept.FILE, *by], axes))
    n = kept.refresh(at(0, 2, 3, 4), states, lambda rows: kept.partial_moments(rows, [*kept.FILE, *by], axes))
    out = kept.kept_moments(at(0, 2, 3, 4), states, by, axes)
    return out.select("l_linestatus", "axis", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "greatest", F.lit(n).alias("read"))


def r2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Counts of orders in five files, of which one goes and comes back."""
    states, files = _files(spark, d, "orders", "o_orderkey")
    counters = {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 150000, "all": F.lit(True)}
    for parts in ((0, 1, 2), (0, 2, 3), (0, 1, 2, 3, 4)):
        out = kept.kept_counts(files.filter(F.col("_part").isin(*parts)).drop("_part"), states, ["o_orderpriority"], counters)
    return out


LATE, STREAM_PARTS = "1 hour", 4


def r1_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Events in files by time, one a batch, but every fiftieth event comes in the last: keys when they are new, and rows that come too late."""
    e = read(spark, d, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * STREAM_PARTS / (last - first + 1)).cast("int")
    folder, out, state = (K.scratch(spark, n) for n in ("parts", "unseen", "state"))
    rows = e.withColumn("part", F.when(F.col("event_id") % 50 == 0, STREAM_PARTS - 1).otherwise(part))
    with Scratch(spark) as temp:
        rows = temp.stored(rows, "rows")
        for k in range(STREAM_PARTS):  # one after the other, so that the stream takes them in this order
            rows.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, unseen.ROCKS)
    try:
        stream = spark.readStream.schema("event_id long, event_type string, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        unseen.ingest_unseen(stream, ["event_type", "user_id"], "ts", out, state, keep="1000 days", late=LATE).awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out).select("event_type", "user_id", F.unix_micros("at").alias("at"), "status")


def j2_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Line items and parts bucketed by part: joins and groups on it move no rows."""
    with Scratch(spark) as temp:
        parts = temp.bucketed(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "parts", ["l_partkey"], 16)
        lines = temp.bucketed(read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), "lines", ["l_partkey"], 16)
        hit, miss = J.attach_features(lines, parts.filter("p_size > 10"), ["l_partkey"])
        by = hit.groupBy("l_partkey", "p_brand").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
        none = miss.groupBy("l_partkey").agg(F.lit("none").alias("p_brand"), F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
        return stored(by.unionByName(none).withColumn("quantity", F.round("quantity", 2)), "bucketed")


def a2_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Requests bucketed by (dataset, video), summed up by video and joined with lengths bucketed alike."""
    frames = read(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("user_id").alias("video"), (F.col("event_id") % 100).alias("frame"))
    lengths = read(spark, d, "events").groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("video")).agg((F.count(F.lit(1)) * 10).alias("pts_frames"))
    with Scratch(spark) as temp:
        asked = temp.bucketed(frames, "frames", ["dataset", "video"], 16)
        held = temp.bucketed(lengths, "lengths", ["dataset", "video"], 16)
        return stored(A.video_summary(asked.select("dataset", "video", "frame").distinct(), held), "bucketed")


def x5_windows(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    lengths = timelines(spark, d).groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("length"))
    out = spark.sql("SELECT v.video, w.* FROM {lengths} v, LATERAL kt_windows(v.length, 6, 16) w", lengths=lengths)
    ends = lambda c: (F.get(c, 0).alias(f"{c}_first"), F.element_at(c, -1).alias(f"{c}_last"))
    return out.select("video", "start", "anchor_index", *ends("history_indices"), *ends("future_indices"), F.round(F.element_at("future_time_seconds", -1), 6).alias("ahead"))


def x5_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").filter("role <> 'system'")
    spans = turns.select(F.col("conv_id").alias("episode"), F.when(F.col("role") == "user", "left").otherwise("right").alias("hand"), F.col("turn").alias("place"), (F.col("turn") * 3).alias("start"), (F.col("turn") * 3 + 5).alias("end"), "text")
    tables.register(spark)
    return spark.sql("SELECT episode, prompt FROM kt_prompts(TABLE({spans}))", spans=tables.boundaries(spans))


def p20_visual(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as samples of 4 history and 2 future steps; some have images of another shape, features of other lengths, or too few joints."""
    v = read(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    k = F.col("vec_id")
    several = lambda x, n: F.array_repeat(x, n)
    rows = v.select(
        "vec_id", several(F.lit(0.0), F.lit(4)).alias("history_time"), several(F.lit(0.0), F.lit(2)).alias("future_time"),
        F.when(k % 11 != 0, several(F.array(F.when(k % 5 == 0, 1).otherwise(3), F.lit(8), F.lit(8)), F.when(k % 7 == 0, 3).otherwise(4).cast("int"))).alias("context_image_shapes"),
        F.when(k % 13 != 0, several(F.slice("v", 1, 8), F.when(k % 3 == 0, 5).otherwise(4).cast("int"))).alias("context_visual_features"),
        F.when(k % 2 == 0, F.slice("v", 1, 16)).alias("context_text_features"), several(F.slice("v", 1, 4), F.when(k % 17 == 0, 1).otherwise(2).cast("int")).alias("future_visual_latents"),
        several(several(F.lit(0.0), F.when(k % 19 == 0, 29).otherwise(30).cast("int")), F.lit(4)).alias("history_fingertips"), F.lit(None).cast("array<array<double>>").alias("future_fingertips"),
        several(several(F.lit(0.0), F.lit(126)), F.when(k % 23 == 0, 2).otherwise(4).cast("int")).alias("history_hand_joints_local"), F.lit(None).cast("array<array<double>>").alias("future_hand_joints_local"),
    )
    rules = E.visual_checks(text_size=16)
    return rows.select("vec_id", *[ok.alias(n) for n, ok in rules.items()])


def p20_record(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as feature records of 4 frames with 2 x 8 features, some of them broken."""
    k = F.col("vec_id")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = read(spark, d, "embeddings").select(
        "vec_id", F.when(k % 7 == 0, "a.txt").otherwise("src/a.npy").alias("annotation_member"), F.when(k % 5 == 0, F.upper(F.sha2(k.cast("string"), 256))).otherwise(F.sha2(k.cast("string"), 256)).alias("annotation_sha256"),
        F.lit("d").alias("dataset_name"), F.when(k % 11 == 0, "").otherwise("v").alias("video_name"), F.sha2(F.lit("x"), 256).alias("extractor_id"),
        F.when(k % 13 == 0, F.array(*map(F.lit, (1, 1, 2, 3)))).when(k % 17 == 0, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (1, 2, 5, 9)))).alias("frame_ids"),
        F.when(k % 19 == 0, F.array(*map(F.lit, (0.0, 0.1, 0.05, 0.3)))).otherwise(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3)))).alias("frame_times_seconds"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.when(k % 3 == 0, i % 2).otherwise(1)), lambda j: F.slice(v, i * 16 + j * 8 + 1, F.lit(8)))).alias("pooled_features"),
        F.array(F.lit(True), F.lit(True), F.lit(True), k % 2 == 0).alias("valid_mask"),
    )
    rules = E.feature_record_checks()
    return rows.select("vec_id", *[ok.alias(n) for n, ok in rules.items()])


QUERIES = {
    "s1_read_episodes": s1, "s5_clip_archives": s5_archives, "s8_read_segments": s8, "s8_read_odometry": s8_odometry, "k3_publish_observed": k3_observed, "k2_resume": k2_resume, "k5_complete": k5_complete, "k6_nested_config": k6_nested,
    "x3_unchanged_sources": x3_unchanged, "a8_kept_moments": a8_kept, "r2_kept_counts": r2_kept, "r1_unseen_keys_stream": r1_unseen, "j2_bucketed_join": j2_bucketed, "a2_bucketed_summary": a2_bucketed,
    "x5_sql_windows": x5_windows, "x5_sql_prompts": x5_prompts, "p20_visual_rules": p20_visual, "p20_feature_record": p20_record,
}

_USERS = "u AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(value ORDER BY event_id) AS vs FROM events GROUP BY 1)"

ORACLE = {
    "s1_read_episodes": f"""
WITH {_USERS} SELECT 'group' || (user_id % 3) || '/' || user_id || '.npy' AS member, 'group' || (user_id % 3) AS source, 'user ' || user_id AS video_name, CASE WHEN user_id % 2 = 0 THEN 'even' END AS anno_type, array_to_string(ids, ',') AS frames FROM u""",
    "s5_clip_archives": """
SELECT printf('clip-%02d', user_id % 24) AS clip, event_id AS frame, CASE WHEN event_id % 4 = 0 THEN event_id * 1000 ELSE event_id * 10 END AS time_ns, CASE WHEN event_id % 3 <> 0 THEN value + 1 END AS camera_x,
       CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS left_x, event_type <> 'error' AND event_id % 2 = 0 AS left_valid,
       CASE WHEN event_type <> 'error' AND event_id % 2 = 1 THEN value END AS right_x, event_type <> 'error' AND event_id % 2 = 1 AS right_valid FROM events""",
    "s8_read_segments": f"""
WITH {_USERS}, s AS (SELECT *, len(ids) // 2 AS h, len(ids) AS n FROM u)
SELECT user_id::VARCHAR AS clip, 'left' AS hand, 0 AS segment, 0 AS start, h::INT AS "end", h::INT AS steps, round(coalesce(list_sum(vs[1:h]), 0), 4) AS x FROM s
UNION ALL SELECT user_id::VARCHAR, 'right', 1, h::INT, n::INT, (n - h)::INT, round(list_sum(vs[h + 1:n]), 4) FROM s""",
    "s8_read_odometry": f"WITH {_USERS} SELECT user_id::VARCHAR AS clip, unnest(range(len(vs))) AS step, unnest(vs) AS x, unnest(vs) + 4 AS total FROM u",
    "k2_resume": """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT i // 5000 AS shard, count(*) AS rows, count(*) AS stored, CASE WHEN i // 5000 < 2 THEN 'kept' ELSE 'written' END AS state, min(o_orderkey) AS least, sum(i)::BIGINT AS places FROM o GROUP BY 1, 4""",
    "k3_publish_observed": """
WITH m AS (SELECT count(*) AS n, min(o_totalprice) AS least, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders),
a AS (SELECT 1 AS attempt, 0.0 AS bound UNION ALL SELECT 2, 1e9),
r AS (SELECT attempt, n, unnest(['rows', 'open', 'least']) AS c, unnest([n > 0, o > 0 AND o < n, least >= bound]) AS p FROM m, a)
SELECT attempt, c AS "check", p AS passed, CASE WHEN bool_and(p) OVER (PARTITION BY attempt) THEN n ELSE 0 END AS published FROM r""",
    "k5_complete": """
WITH k AS (SELECT (props->>'k')::INT % 7 = 0 AS bad FROM events)
SELECT 'all' AS run, count(*) AS assigned, count(*) FILTER (NOT bad) AS successful, count(*) FILTER (bad) AS failed, count(*) FILTER (bad) = 0 AS complete FROM k
UNION ALL SELECT 'fine', count(*) FILTER (NOT bad), count(*) FILTER (NOT bad), 0, true FROM k""",
    "k6_nested_config": """
SELECT doc_id, sha256('{"a":[{"x":' || coalesce(n_chars::VARCHAR, 'null') || ',"y":' || doc_id || '}],"m":{"p":null,"q":' || (doc_id % 2 = 0) || '},"z":{"a":' || coalesce(to_json(source)::VARCHAR, 'null') || ',"b":' || coalesce(to_json(lang)::VARCHAR, 'null') || '}}') AS config FROM documents""",
    "x3_unchanged_sources": """
SELECT user_id AS video, CASE WHEN user_id % 5 = 0 THEN 'ValueError: the source changed while it was read' ELSE 'ok' END AS status, CASE WHEN user_id % 5 <> 0 THEN count(*) END AS frames, user_id % 5 = 0 AS pending FROM events GROUP BY user_id""",
    "a8_kept_moments": """
WITH l AS (SELECT l_linestatus, unnest(['l_quantity', 'l_extendedprice']) AS axis, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE]) AS v FROM lineitem WHERE l_orderkey % 5 <> 1)
SELECT l_linestatus, axis, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS greatest, 1 AS read FROM l GROUP BY ALL""",
    "r2_kept_counts": """
WITH o AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS a, count(*) FILTER (o_totalprice > 150000) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, unnest(['all', 'open', 'large']) AS counter, unnest([n, a, b]) AS n FROM o""",
    "r1_unseen_keys_stream": f"""
WITH e AS (SELECT event_type, user_id, event_id, epoch_us(ts) AS us FROM events), x AS (SELECT min(us) AS a, max(us) AS b FROM e),
p AS (SELECT e.*, CASE WHEN event_id % 50 = 0 THEN {STREAM_PARTS - 1} ELSE floor((us - a) * {STREAM_PARTS} / (b - a + 1)::DOUBLE)::INT END AS part FROM e, x),
m AS (SELECT k AS part, coalesce((SELECT max(us // 1000) FROM p WHERE part < k) - 3600000, 0) AS mark FROM (SELECT unnest(range({STREAM_PARTS})) AS k)),
q AS (SELECT p.*, us // 1000 < mark AS late FROM p JOIN m USING (part)),
f AS (SELECT event_type, user_id, min(part) AS part FROM q WHERE NOT late GROUP BY ALL)
SELECT event_type, user_id, us // 1000 * 1000 AS at, 'late' AS status FROM q WHERE late
UNION ALL SELECT q.event_type, q.user_id, min(us) // 1000 * 1000, 'new' FROM q JOIN f USING (event_type, user_id, part) WHERE NOT late GROUP BY ALL""",
    "j2_bucketed_join": """
SELECT l_partkey, coalesce(p_brand, 'none') AS p_brand, count(*) AS rows, round(sum(l_quantity), 2)::DOUBLE AS quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY ALL""",
    "a2_bucketed_summary": """
WITH r AS (SELECT DISTINCT event_type AS dataset, user_id AS video, event_id % 100 AS frame FROM events), n AS (SELECT event_type AS dataset, user_id AS video, count(*) * 10 AS pts_frames FROM events GROUP BY ALL)
SELECT dataset, video, count(*) AS requested, min(frame) AS first, max(frame) AS last, any_value(pts_frames) AS pts_frames, max(frame) < any_value(pts_frames) AS inside FROM r JOIN n USING (dataset, video) GROUP BY dataset, video""",
    "x5_sql_windows": f"""
WITH {FRAMES}, w AS (SELECT DISTINCT video, unnest(list_concat(range(0, n - 21, 16), [n - 22]))::INT AS start FROM (SELECT video, count(*)::INT AS n FROM frames GROUP BY 1) WHERE n >= 22)
SELECT video, start, start + 5 AS anchor_index, start AS history_indices_first, start + 5 AS history_indices_last, start + 6 AS future_indices_first, start + 21 AS future_indices_last, round(16 / 30, 6) AS ahead FROM w""",
    "x5_sql_prompts": """
WITH i AS (SELECT conv_id AS e, CASE role WHEN 'user' THEN 'Left' ELSE 'Right' END AS hand, turn, turn * 3 AS a, turn * 3 + 5 AS b, text FROM conversations WHERE role <> 'system'),
cuts AS (SELECT DISTINCT e, x FROM (SELECT e, unnest([a, b, 0]) AS x FROM i)), starts AS (SELECT c.e, x FROM cuts c JOIN (SELECT e, max(b) AS m FROM i GROUP BY e) m ON c.e = m.e AND x < m.m),
shown AS (SELECT s.e, s.x, hand, arg_min(text, turn) AS text FROM starts s JOIN i ON i.e = s.e AND a <= x AND x < b GROUP BY ALL)
SELECT DISTINCT s.e AS episode, coalesce(string_agg(hand || ' hand: ' || text, ' ' ORDER BY hand || ' hand: ' || text), '') AS prompt FROM starts s LEFT JOIN shown USING (e, x) GROUP BY s.e, s.x""",
    "p20_visual_rules": """
SELECT vec_id, vec_id % 11 = 0 OR (vec_id % 5 <> 0 AND vec_id % 7 <> 0) AS context_images, vec_id % 13 = 0 OR vec_id % 3 <> 0 AS context_visual_features, true AS context_text_features, vec_id % 17 <> 0 AS future_visual_latents,
       vec_id % 19 <> 0 AS history_fingertips, true AS future_fingertips, vec_id % 23 <> 0 AS history_hand_joints_local, true AS future_hand_joints_local FROM embeddings""",
    "p20_feature_record": """
SELECT vec_id, vec_id % 7 <> 0 AS member, vec_id % 5 <> 0 OR upper(sha256(vec_id::VARCHAR)) = sha256(vec_id::VARCHAR) AS digests, vec_id % 11 <> 0 AS names, vec_id % 13 <> 0 AND vec_id % 17 <> 0 AS frame_ids,
       vec_id % 19 <> 0 AND (vec_id % 17 <> 0 OR vec_id % 13 = 0) AS times, vec_id % 3 <> 0 AND (vec_id % 17 <> 0 OR vec_id % 13 = 0) AS features, vec_id % 2 = 0 AND (vec_id % 17 <> 0 OR vec_id % 13 = 0) AS valid FROM embeddings""",
}
