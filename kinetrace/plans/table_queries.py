"""Queries over sources, sinks, orders, set operations, streams and plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrace.operators import aggregates as A
from kinetrace.operators import features as X
from kinetrace.operators import publish as K
from kinetrace.operators import sets as S
from kinetrace.operators import windows as W
from kinetrace.plans.proxy import FRAMES, read, timelines
from kinetrace.sources import readers as R
from kinetrace.streaming import jobs


def s2(spark: SparkSession, d: str) -> DataFrame:
    return R.scan_members(read(spark, d, "documents"), "doc_id", "source")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    lengths = timelines(spark, d).groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("length"))
    w = W.make_windows(lengths)
    return w.select(
        F.lit(1).alias("schema_version"), F.lit("h6_k16").alias("protocol"), F.lit("events").alias("dataset"), F.when(F.col("video") % 5 == 0, "val").otherwise("train").alias("split"),
        F.concat_ws(":", "video", "start").alias("sample_id"), F.col("video").cast("string").alias("source_group"), F.lit("").alias("video_path"), F.lit(30.0).alias("fps"), F.lit(6).alias("history_steps"), F.lit(16).alias("future_steps"),
        "anchor_index", "history_indices", "future_indices", "history_time_seconds", "future_time_seconds", F.col("start").alias("trajectory_window_start"),
    )


def s3(spark: SparkSession, d: str) -> DataFrame:
    """A manifest damaged in every way that the audit knows but being empty."""
    path = K.scratch(spark, "manifest")
    v = F.col("source_group").cast("int")
    damaged = {"history_steps": F.when(v % 7 == 0, 5).otherwise(F.col("history_steps")), "protocol": F.when(v % 11 == 0, "other").otherwise(F.col("protocol")), "dataset": F.when(v % 13 == 0, "other").otherwise(F.col("dataset")), "sample_id": F.when(v % 9 == 0, "again").otherwise(F.col("sample_id"))}
    _manifest(spark, d).withColumns(damaged).write.json(path)
    return R.audit_manifest(R.read_manifest(spark, path), "h6_k16", "train")


def s4(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a CSV of action segments, under one spelling of the headers."""
    path = K.scratch(spark, "actions")
    o = read(spark, d, "orders")
    view = F.when(F.col("o_custkey") % 3 == 0, "C10095_rgb.mp4").otherwise("HMC_1.mp4")
    start = F.col("o_orderkey") % 300
    o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("rec/"), view).alias("video"), start.alias("start_frame"), (start + F.col("o_custkey") % 50).alias("end"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("action_id"), (F.col("o_custkey") % 17).alias("verb"), (F.col("o_custkey") % 90).alias("noun"), F.col("o_orderpriority").alias("toy_id"), (F.col("o_orderkey") % 2).alias("is_shared")).write.csv(path, header=True)
    return R.read_action_csv(spark, path, "C10095", labelled=True)


def s5(spark: SparkSession, d: str) -> DataFrame:
    pose = F.struct(F.struct(F.struct(F.array("value", F.col("event_id").cast("double"), F.lit(0.0)).alias("translation_xyz")).alias("T_world_from_wrist")).alias("umetrack_pose"))
    hands = F.to_json(F.map_from_entries(F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "left").otherwise("right"), pose))))
    k = F.try_element_at(F.from_json("props", "MAP<STRING, INT>"), F.lit("k")).alias("k")
    rows = read(spark, d, "events").select("event_id", k, *R.hand_poses(F.when(F.col("event_type") != "error", hands)))
    return rows.select("event_id", "k", F.get("left_xyz", 0).alias("left_x"), "left_valid", F.get("right_xyz", 0).alias("right_x"), "right_valid")


def s6(spark: SparkSession, d: str) -> DataFrame:
    by = timelines(spark, d).groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.array("value", F.lit(1.0))))).alias("m"))
    whole = by.groupBy("video").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), "m")))).alias("j"))
    return R.frame_keyed_json(whole, "j", ["video"]).select("video", "frame", "name", F.get("value", 0).alias("value"))


def s7(spark: SparkSession, d: str) -> DataFrame:
    names, flags = K.scratch(spark, "names"), K.scratch(spark, "flags")
    read(spark, d, "region").select(F.concat(F.lit("  "), "r_name", F.lit(" "))).unionByName(spark.sql("SELECT '' AS x").toDF("concat(  , r_name,  )")).write.text(names)
    read(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") == 1, " NotShared").otherwise("shared")).write.csv(flags, sep="\t")
    return R.read_key_list(spark, names).unionByName(R.read_flagged_keys(spark, flags, "notshared"))


def s9(spark: SparkSession, d: str) -> DataFrame:
    urls = read(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return R.media_only(urls, "path", ["1", "2", ".MP4"])


def s10(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("epoch "), F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, F.lit('{"step": 3, "lr"')).when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"step": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"step": '), F.col("event_id").cast("string"), F.lit(', "lr": 0.5, "loss": '), F.col("value").cast("string"), F.lit("}")))
    # the marker has no space before its number
    return R.training_log(e.select(F.regexp_replace(line, '"step": ', '"step":').alias("value")))


def k1(spark: SparkSession, d: str) -> DataFrame:
    return K.write_manifests(_manifest(spark, d), K.scratch(spark, "manifests"))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def k2(spark: SparkSession, d: str) -> DataFrame:
    return K.reshard(read(spark, d, "lineitem").select(*ORDER), ORDER, 2048).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("index").alias("first"), F.max("index").alias("last"), F.min("l_orderkey").alias("least"), F.max("l_orderkey").alias("most"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def k2_sources(spark: SparkSession, d: str) -> DataFrame:
    return K.shard_counts(K.reshard(read(spark, d, "lineitem").select(*ORDER, "l_returnflag"), [*ORDER, "l_returnflag"], 2048), "l_returnflag")


def k3(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    n = orders.count()
    checks = lambda df: df.agg((F.count(F.lit(1)) == n).alias("count"), (F.count_distinct("o_orderkey") == F.count(F.lit(1))).alias("unique"), F.bool_and(F.col("o_totalprice") > 0).alias("positive")).select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in ("count", "unique", "positive")])))
    path = K.scratch(spark, "orders")
    results = K.publish_if_valid(orders, path, checks)
    published = K.published(spark, path)
    return results.withColumn("published", F.lit(published.count() if published is not None else 0))


def k4(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.lit("v2").alias("extractor"))
    done = read(spark, d, "labels").join(docs, "doc_id").select("doc_id", "fingerprint", F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("extractor"))
    return K.pending(docs, done, ["doc_id", "fingerprint", "extractor"]).select("doc_id")


def _parse(row: dict) -> dict:
    import json

    k = json.loads(row["props"])["k"]
    if k % 7 == 0:
        raise ValueError("k divides by seven")
    return {"k": int(k)}


def k5(spark: SparkSession, d: str) -> DataFrame:
    ok, failures = K.quarantine(read(spark, d, "events").select("event_id", "props"), _parse, T.StructType([T.StructField("k", T.LongType())]), "event_id")
    total = ok.agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("rows"), F.sum("k").alias("k"))
    return total.unionByName(failures.groupBy(F.concat_ws(": ", "error_type", "message").alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("long").alias("k")))


def k6(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    content = F.col("text").cast("binary")
    return docs.select("doc_id", F.sha2(content, 256).alias("content"), K.sampled_digest(content, 64).alias("sampled"), K.config_digest({"source": F.col("source"), "lang": F.col("lang")}).alias("config"))


def k7(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_returnflag")
    expected = items.groupBy("l_returnflag").agg((F.count(F.lit(1)) + F.when(F.first("l_returnflag") == "A", 5).otherwise(0)).alias("expected")).filter("l_returnflag <> 'R'")
    return K.reconcile_counts(items, expected, "l_returnflag")


def t1(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_k(F.col("embedding"), 3)
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(top).alias("rank", "class"))


def t2(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("member"))
    return S.bounded_sample(members, "sample-v1", 40)


def t3(spark: SparkSession, d: str) -> DataFrame:
    return S.probe_rows(read(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


def t4(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    return S.order_check(K.global_index(part.select("p_partkey", "p_name"), ["p_name", "p_partkey"]), K.global_index(part.select("p_partkey", "p_size"), ["p_size", "p_partkey"]), "p_partkey")


def t5(spark: SparkSession, d: str) -> DataFrame:
    return S.seeded_shuffle(read(spark, d, "documents").select("doc_id"), "doc_id", "shuffle-v1", 2)


def t6(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_buckets(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("load"))


def t7(spark: SparkSession, d: str) -> DataFrame:
    return S.examples(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20)


def u1(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    parts = [(k, items.filter(F.pmod(F.col("l_orderkey") + F.col("l_suppkey"), F.lit(4)) == k).select("l_suppkey", "l_returnflag"), True) for k in range(4)]
    return S.merge_partitions(parts)


def u2(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("lang", "source", F.sha2("text", 256).alias("text"))
    marks = read(spark, d, "benchmark").select(F.lit("benchmark").alias("lang"), F.lit(None).cast("string").alias("source"), F.sha2("text", 256).alias("text"))
    return S.leakage(docs.unionByName(marks), "lang", ["source", "text"])


def u3(spark: SparkSession, d: str) -> DataFrame:
    return S.set_diff(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


def u4(spark: SparkSession, d: str) -> DataFrame:
    return S.union_keys([read(spark, d, "nation").select(F.col("n_regionkey").alias("k")), read(spark, d, "region").select((F.col("r_regionkey") + 3).alias("k"))], "k")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    # as a pattern, since a stream's plain path has to be a folder and the table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")


def r1(spark: SparkSession, d: str) -> DataFrame:
    keyed = _stream(spark, d).select(F.col("event_type").alias("dataset"), F.col("user_id").alias("video"), (F.col("event_id") % 10).alias("frame_id"))
    out, state = K.scratch(spark, "requests"), K.scratch(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_requests(keyed, ["dataset", "video", "frame_id"], out, state).awaitTermination()
    return spark.read.parquet(out)


def r2(spark: SparkSession, d: str) -> DataFrame:
    out, state = K.scratch(spark, "counters"), K.scratch(spark, "state")
    jobs.incremental_counters(_stream(spark, d), "event_type", F.when(F.col("value") < 2, "short"), out, state).awaitTermination()
    return jobs.latest_counters(spark, out)


def x1(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    frames = read(spark, d, "embeddings").withColumn("video", F.col("vec_id") % 7)
    twice = frames.unionByName(frames)
    out = X.extract_features(twice.select("video", "vec_id", "embedding"), ["video", "vec_id"], "embedding", lambda: lambda rows: np.stack(rows), "identity-v1")
    return out.select("video", "vec_id", F.size("features").alias("size"), (F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4) + F.lit(0.0)).alias("total"), "extractor_id")


def x2(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    prompts = read(spark, d, "documents").select(F.col("text").alias("prompt")).filter("prompt <> ''")
    out = X.extract_text_features(prompts, "prompt", lambda: lambda rows: np.array([[len(t), t.count(" ") + 1] for t in rows], float), "counts-v1")
    return out.select("prompt", F.round(F.get("features", 0), 6).alias("x"), F.round(F.get("features", 1), 6).alias("y"), "extractor_id")


def _first_reader(row: dict) -> tuple[list[float], str]:
    if row["video"] % 5 == 0:
        raise OSError("no packets")
    return list(row["times"]), "packets"


def _second_reader(row: dict) -> tuple[list[float], str]:
    if row["video"] % 15 == 0:
        raise OSError("no frames")
    return list(row["times"]), "frames"


def x3(spark: SparkSession, d: str) -> DataFrame:
    videos = timelines(spark, d).groupBy("video").agg(F.collect_list(F.floor(F.col("pts") / 3600) * 3600.0).alias("times"), F.count(F.lit(1)).alias("declared_frames"))
    out = T.StructType([T.StructField("pts", T.ArrayType(T.DoubleType())), T.StructField("method", T.StringType())])
    ok, failures = K.quarantine(videos, X.build_timelines([_first_reader, _second_reader], 60.0), out, "video")
    good = ok.select("video", "method", F.size("pts").alias("frames"), F.round(F.aggregate("pts", F.lit(0.0), lambda s, x: s + x - 1704067200), 2).alias("total"))
    return good.unionByName(failures.select("video", F.concat_ws(": ", "error_type", "message").alias("method"), F.lit(None).cast("int").alias("frames"), F.lit(None).cast("double").alias("total")))


QUERIES = {
    "s2_scan_members": s2, "s3_read_manifest": s3, "s4_read_action_csv": s4, "s5_read_clip_json": s5, "s6_read_frame_keyed_json": s6, "s7_read_key_list": s7, "s9_list_media": s9, "s10_read_training_log": s10,
    "k1_write_manifests": k1, "k2_reshard": k2, "k2_shard_counts": k2_sources, "k3_publish_if_valid": k3, "k4_pending": k4, "k5_quarantine": k5, "k6_fingerprint": k6, "k7_reconcile_counts": k7,
    "t1_topk_per_row": t1, "t2_bounded_sample": t2, "t3_probe_rows": t3, "t4_order_check": t4, "t5_seeded_shuffle": t5, "t6_balanced_buckets": t6, "t7_examples": t7,
    "u1_merge_partitions": u1, "u2_leakage": u2, "u3_set_diff": u3, "u4_union_keys": u4, "r1_ingest_requests_stream": r1, "r2_incremental_counters_stream": r2,
    "x1_extract_features": x1, "x2_extract_text_features": x2, "x3_build_timelines": x3,
}

_WINDOWS = f"""{FRAMES}, w AS (SELECT DISTINCT video, unnest(list_concat(range(0, n - 21, 16), [n - 22])) AS start FROM (SELECT video, count(*) AS n FROM frames GROUP BY 1) WHERE n >= 22)"""

ORACLE = {
    "s2_scan_members": "SELECT doc_id AS member, source FROM documents",
    "s3_read_manifest": f"""
WITH {_WINDOWS}, m AS (SELECT video, CASE WHEN video % 9 = 0 THEN 'again' ELSE video || ':' || start END AS id FROM w)
SELECT 'empty' AS "check", (count(*) = 0)::BIGINT AS violations FROM m UNION ALL SELECT 'protocol', count(*) FROM m WHERE video % 11 = 0 UNION ALL SELECT 'split', count(*) FROM m WHERE video % 5 = 0
UNION ALL SELECT 'mixed datasets', count(DISTINCT video % 13 = 0) - 1 FROM m UNION ALL SELECT 'lengths', count(*) FROM m WHERE video % 7 = 0 UNION ALL SELECT 'duplicate ids', count(*) - count(DISTINCT id) FROM m""",
    "s4_read_action_csv": """
SELECT o_orderkey::INT AS id, 'rec/C10095_rgb.mp4' AS video, (o_orderkey % 300)::INT AS start, (o_orderkey % 300 + o_custkey % 50)::INT AS "end", o_custkey::INT AS action, (o_custkey % 17)::INT AS verb, (o_custkey % 90)::INT AS object,
       o_orderpriority AS toy, (o_orderkey % 2)::INT AS shared, (o_orderkey % 300 - 30)::INT AS anchor FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 300 - 30 >= 60 AND o_orderstatus <> 'P'""",
    "s5_read_clip_json": """
SELECT event_id, (props->>'k')::INT AS k, CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS left_x, event_type <> 'error' AND event_id % 2 = 0 AS left_valid,
       CASE WHEN event_type <> 'error' AND event_id % 2 = 1 THEN value END AS right_x, event_type <> 'error' AND event_id % 2 = 1 AS right_valid FROM events""",
    "s6_read_frame_keyed_json": f"WITH {FRAMES} SELECT video, frame::BIGINT AS frame, event_type AS name, value FROM frames",
    "s7_read_key_list": "SELECT r_name AS key FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1",
    "s9_list_media": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '(1|2|\\.mp4)$')",
    "s10_read_training_log": "SELECT event_id AS step, 0.5::DOUBLE AS lr, value AS loss FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0",
    "k1_write_manifests": f"WITH {_WINDOWS} SELECT 'events' AS dataset, CASE WHEN video % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS records FROM w GROUP BY ALL",
    "k2_reshard": f"""
WITH i AS (SELECT *, row_number() OVER (ORDER BY {", ".join(ORDER)}) - 1 AS i FROM lineitem)
SELECT i // 2048 AS shard, count(*) AS rows, min(i) AS first, max(i) AS last, min(l_orderkey) AS least, max(l_orderkey) AS most, round(sum(l_quantity), 2) AS quantity FROM i GROUP BY 1""",
    "k2_shard_counts": f"""
SELECT shard, l_returnflag, count(*) AS rows FROM (SELECT l_returnflag, (row_number() OVER (ORDER BY {", ".join(ORDER)}, l_returnflag) - 1) // 2048 AS shard FROM lineitem) GROUP BY ALL""",
    "k3_publish_if_valid": "SELECT unnest(['count', 'unique', 'positive']) AS \"check\", true AS passed, count(*) AS published FROM orders",
    "k4_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "k5_quarantine": """
WITH k AS (SELECT (props->>'k')::BIGINT AS k FROM events)
SELECT 'ok' AS status, count(*) AS rows, sum(k)::BIGINT AS k FROM k WHERE k % 7 <> 0 UNION ALL SELECT 'ValueError: k divides by seven', count(*), NULL FROM k WHERE k % 7 = 0""",
    "k6_fingerprint": """
SELECT doc_id, sha256(text) AS content, sha256(encode(strlen(text)::VARCHAR) || encode(text)[1:64] || encode(text)[greatest(strlen(text) - 64, 0) + 1:]) AS sampled,
       sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS config FROM documents""",
    "k7_reconcile_counts": """
WITH o AS (SELECT l_returnflag, count(*) AS observed, CASE l_returnflag WHEN 'A' THEN count(*) + 5 WHEN 'R' THEN 0 ELSE count(*) END AS expected FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT * FROM o UNION ALL SELECT NULL, sum(observed)::BIGINT, sum(expected)::BIGINT FROM o) WHERE observed <> expected""",
    "t1_topk_per_row": """
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) - 1)::INT AS rank, c::INT AS class FROM (SELECT vec_id, c, embedding[c + 1] AS s FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS c FROM embeddings))
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) <= 3""",
    "t2_bounded_sample": """
SELECT o_orderpriority AS source, o_orderkey AS member FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('sample-v1' || chr(0) || o_orderpriority || chr(0) || o_orderkey)) <= 40""",
    "t3_probe_rows": "WITH i AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, p_name, i AS index FROM i WHERE i IN (0, n // 2, n - 1)",
    "t4_order_check": """
WITH i AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS a, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS b FROM part) SELECT p_partkey, a AS stored, b AS listed FROM i WHERE a <> b""",
    "t5_seeded_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle-v1|2|' || doc_id), doc_id) - 1 AS index FROM documents",
    "t6_balanced_buckets": """
WITH i AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents)
SELECT CASE WHEN i // 8 % 2 = 0 THEN i % 8 ELSE 7 - i % 8 END AS bucket, count(*) AS rows, sum(n_chars)::BIGINT AS load FROM i GROUP BY 1""",
    "t7_examples": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20",
    "u1_merge_partitions": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "u2_leakage": """
WITH d AS (SELECT lang, source, text FROM documents UNION ALL SELECT 'benchmark', NULL, text FROM benchmark),
l AS (SELECT DISTINCT lang, 'source' AS key, source AS value FROM d WHERE source IS NOT NULL UNION SELECT DISTINCT lang, 'text', text FROM d WHERE text IS NOT NULL)
SELECT a.key, a.lang AS a, b.lang AS b, count(*) AS shared FROM l a JOIN l b ON a.key = b.key AND a.value = b.value AND a.lang < b.lang GROUP BY ALL""",
    "u3_set_diff": """
SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "u4_union_keys": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region",
    "r1_ingest_requests_stream": "SELECT DISTINCT event_type AS dataset, user_id AS video, event_id % 10 AS frame_id FROM events",
    "r2_incremental_counters_stream": "SELECT event_type, CASE WHEN value < 2 THEN 'short' END AS reason, count(*) AS rows FROM events GROUP BY ALL",
    "x1_extract_features": "SELECT vec_id % 7 AS video, vec_id, 64 AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0::DOUBLE AS total, 'identity-v1' AS extractor_id FROM embeddings",
    "x2_extract_text_features": """
WITH p AS (SELECT DISTINCT text AS prompt FROM documents WHERE text <> ''), c AS (SELECT prompt, length(prompt) AS a, length(prompt) - length(replace(prompt, ' ', '')) + 1 AS b FROM p)
SELECT prompt, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y, 'counts-v1' AS extractor_id FROM c""",
    "x3_build_timelines": f"""
WITH {FRAMES}, h AS (SELECT video, floor(pts / 3600) * 3600 AS t, frame FROM frames), k AS (SELECT video, t + 60.0 * (row_number() OVER (PARTITION BY video, t ORDER BY frame) - 1) AS t FROM h)
SELECT video, CASE WHEN video % 15 = 0 THEN 'OSError: no frames' WHEN video % 5 = 0 THEN 'frames' ELSE 'packets' END AS method, CASE WHEN video % 15 <> 0 THEN count(*)::INT END AS frames, CASE WHEN video % 15 <> 0 THEN round(sum(t - 1704067200), 2) END AS total FROM k GROUP BY video""",
}
