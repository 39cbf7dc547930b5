"""Queries over counters, statistics, audits and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import aggregates as A
from kinetrace.plans.proxy import FRAMES, read, timelines


def _r(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 4) + F.lit(0.0) for n in names}


def a1(spark: SparkSession, d: str) -> DataFrame:
    """Line items as frames: flag is the dataset, supplier the video, part the frame; flag A is an alias of N."""
    frames = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("video"), F.col("l_partkey").alias("frame"))
    aliases = spark.sql("SELECT 'A' AS logical, 'N' AS physical")
    logical, physical = A.frame_requests(frames, aliases)
    count = lambda df, kind: df.groupBy("dataset").agg(F.count(F.lit(1)).alias("frames")).select(F.lit(kind).alias("kind"), "dataset", "frames")
    return count(logical, "logical").unionByName(count(physical, "physical"))


def a2(spark: SparkSession, d: str) -> DataFrame:
    requests = read(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 1000).alias("frame")).distinct()
    lengths = read(spark, d, "customer").crossJoin(F.broadcast(spark.sql("SELECT explode(array('F', 'O', 'P')) AS dataset"))).select("dataset", F.col("c_custkey").alias("video"), (F.floor("c_acctbal") % 1000 + 500).alias("pts_frames"))
    return A.video_summary(requests, lengths)


def a3(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 1, "short")
    return A.counters(read(spark, d, "events"), "event_type", reason)


def a4(spark: SparkSession, d: str) -> DataFrame:
    return A.storage_estimate(read(spark, d, "documents").select("n_chars"), F.col("n_chars") * 196608)


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d).select("video", "frame", "pts", (F.col("value") >= 5).alias("kept"))
    videos = frames.select("video").distinct()
    intervals = videos.select("video", F.inline(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 20), (15, 40), (40, 90))])))
    return A.episode_capacity(frames, intervals, 6)


def a5(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).withColumns(_r("horizon"))


def a6(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("targets"))
    matrix = A.support_matrix(per, "targets")
    mask = per.agg(F.bit_or(A.reach_mask(F.col("targets"))).alias("mask"))
    return matrix.crossJoin(F.broadcast(mask)).withColumns(_r("percent"))


def a7(spark: SparkSession, d: str) -> DataFrame:
    return A.quantiles(read(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").withColumns(_r("value"))


def a8(spark: SparkSession, d: str) -> DataFrame:
    return A.population_moments(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_linestatus").withColumns(_r("mean", "std"))


def a9(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(A.masked_mean(F.col("l_extendedprice"), F.col("l_quantity") > 25), 4).alias("masked_mean"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Events in runs of eight frames: the error is the distance to the run's first value."""
    frames = timelines(spark, d).withColumn("window", F.floor(F.col("frame") / 8))
    first = frames.filter("frame % 8 = 0").select("video", "window", F.col("value").alias("_f"))
    return frames.join(first, ["video", "window"]).select("video", "window", (F.col("frame") % 8).alias("step"), "event_type", F.abs(F.col("value") - F.col("_f")).alias("error"), (F.col("event_type") != "error").alias("valid"), (F.col("event_id") % 3).alias("draw"), F.lit("m").alias("model"))


def a10(spark: SparkSession, d: str) -> DataFrame:
    scored = A.ade_fde(_errors(spark, d), ["video", "window"], ["model", "event_type"])
    return A.macro_micro(scored, "model").withColumns(_r("ade", "fde"))


def a11(spark: SparkSession, d: str) -> DataFrame:
    return A.ade_fde(_errors(spark, d), ["video", "window"], ["event_type"]).select("event_type", "steps", "windows", *[(F.round(c, 4)).alias(c) for c in ("ade", "fde", "selection")])


def a11_camera(spark: SparkSession, d: str) -> DataFrame:
    """Windows of eight frames by video: distance to the first value, and a tenth of it for the camera, valid at other frames."""
    frames = timelines(spark, d).withColumn("window", F.floor(F.col("frame") / 8))
    first = frames.filter("frame % 8 = 0").select("video", "window", F.col("value").alias("_f"))
    moved = F.abs(F.col("value") - F.col("_f"))
    errors = frames.join(first, ["video", "window"]).select("video", "window", (F.col("frame") % 8).alias("step"), moved.alias("error"), (F.col("value") >= 8).alias("valid"), (moved / 10).alias("camera"), (F.col("event_type") != "error").alias("camera_ok"))
    return A.ade_fde(errors, ["window"], ["video"], ("camera", "camera_ok")).select("video", "steps", "windows", *[F.round(c, 8).alias(c) for c in ("ade", "fde", "selection", "camera_error")])


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = read(spark, d, "embeddings")
    nxt = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    return vectors, vectors.join(nxt, "vec_id")


def a13(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _vectors(spark, d)
    joint = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint"), "embedding", "target")
    at = lambda c, k: F.get(c, F.col("joint") * 3 + k).cast("double")
    return A.joint_errors(joint.select("joint", *[at("embedding", k).alias(f"p{a}") for k, a in enumerate("xyz")], *[at("target", k).alias(f"t{a}") for k, a in enumerate("xyz")])).withColumns(_r("joint_error", "fingertip_error", "p90"))


def a13_repeat_last(spark: SparkSession, d: str) -> DataFrame:
    """Windows of eight vectors, steps -3 to 4, each a hand of 21 joints."""
    v = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("window"), (F.col("vec_id") % 8 - 3).alias("step"), (F.get("embedding", 63) > -0.1).alias("valid"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint"))
    joints = v.select("window", "step", "valid", "joint", *[F.get("embedding", F.col("joint") * 3 + k).cast("double").alias(a) for k, a in enumerate("xyz")])
    return A.joint_errors(A.repeat_last(joints, ["window"])).withColumns(_r("joint_error", "fingertip_error", "p90"))


def a15(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _vectors(spark, d)
    wide = pairs.select(F.transform("embedding", lambda x: x.cast("double")).alias("p"), F.transform("target", lambda x: x.cast("double")).alias("t"))
    mse = A.stream_mse(wide, {"camera": (1, 9), "left_wrist": (10, 9), "right_wrist": (19, 9), "hands": (28, 37)}, "p", "t")
    mean = wide.agg(F.avg(A.cosine(F.col("p"), F.col("t"))).alias("mse")).select(F.lit("cosine").alias("stream"), "mse")
    return mse.unionByName(mean).withColumns(_r("mse"))


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Components as scores for as many labels."""
    vectors = read(spark, d, "embeddings")
    return vectors.select("vec_id", F.col("label").alias("target"), F.array_contains(A.top_k(F.col("embedding"), k), F.col("label")).alias("hit"))


def a16(spark: SparkSession, d: str) -> DataFrame:
    return A.topk_accuracy(_hits(spark, d, 3))


def a17(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, 5)
    subsets = F.explode(F.array_compact(F.array(F.lit("overall"), F.when(F.col("vec_id") % 5 == 0, "tail"), F.when(F.col("vec_id") % 7 == 0, "unseen"))))
    return A.class_mean_recall(hits.withColumn("subset", subsets), ["subset"]).withColumns(_r("recall"))


def a18(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").filter("role <> 'system'")
    spans = turns.select(F.col("conv_id").alias("episode"), F.when(F.col("role") == "user", "left").otherwise("right").alias("hand"), F.col("turn").alias("place"), (F.col("turn") * 3).alias("start"), (F.col("turn") * 3 + 5).alias("end"), "text")
    return A.distinct_prompts(spans)


def a19(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("video"), (F.col("o_custkey") % 7 == 0).alias("held_out"), (F.col("o_orderkey") % 2 == 0).alias("listed"))
    return A.split_statistics(members)


def a20(spark: SparkSession, d: str) -> DataFrame:
    stems = read(spark, d, "pages").select(F.regexp_extract("url", r"//([^/?#]+)", 1).alias("host"))
    return A.duplicate_keys(stems, ["host"])


def a21(spark: SparkSession, d: str) -> DataFrame:
    return A.dependency_violations(read(spark, d, "customer"), "c_mktsegment", "c_nationkey")


def a22(spark: SparkSession, d: str) -> DataFrame:
    return A.domain_check(read(spark, d, "part"), {"p_size": (0, 50), "p_retailprice": (900, 2000)})


def a23(spark: SparkSession, d: str) -> DataFrame:
    return A.split_profile(read(spark, d, "documents"), "lang", ["source", "doc_id"])


def a24(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    rows = read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count_if(F.col("n").isNull()).alias("without"), F.count_if(F.col("n") < 5).alias("truncated"), F.count_if(F.col("most") > 200000).alias("beyond"), F.count(F.lit(1)).alias("segments"))


def a24_windows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as segments of their customers' recordings: events as wrists of the user of the same number."""
    frames = timelines(spark, d)
    segments = read(spark, d, "orders").select(F.col("o_custkey").alias("recording"), "o_orderpriority", (F.col("o_orderkey") % 120).cast("int").alias("anchor"), (F.col("o_orderkey") % 120 + 16).cast("int").alias("last"))
    wrists = frames.select(F.col("video").alias("recording"), "frame", (F.col("value") >= 5).alias("hand0"), (F.col("event_type") == "click").alias("hand1"))
    return A.coverage_report(segments, frames.groupBy(F.col("video").alias("recording")).agg(F.count(F.lit(1)).alias("frames")), wrists, "o_orderpriority")


def a25(spark: SparkSession, d: str) -> DataFrame:
    """Greatest distance from the anchor (frame 31 of each 64) by phase, then its median and 90 % quantile over segments."""
    frames = timelines(spark, d).select("video", F.floor(F.col("frame") / 64).alias("segment"), (F.col("frame") % 64 - 31).alias("t"), "value")
    anchor = frames.filter("t = 0").select("video", "segment", F.col("value").alias("_a"))
    phase = F.when(F.col("t") <= 0, "history").when(F.col("t") <= 8, "gap").otherwise("execution")
    moved = frames.join(anchor, ["video", "segment"]).groupBy("video", "segment", phase.alias("phase")).agg(F.max(F.abs(F.col("value") - F.col("_a"))).alias("motion"))
    return A.quantiles(moved, "motion", "phase", (0.5, 0.9)).withColumns(_r("value"))


def a26(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d).select(F.col("video").alias("group"), F.col("frame").cast("int").alias("frame"), "value", "pts")
    bins = spark.createDataFrame(A.temporal_bins([(2.5, 5), (1.6, 2), (0.8, 2)]), "span int, bin int, low int, high int")
    return A.temporal_bin_pool(frames, bins, ["value", "pts"]).withColumns(_r("pts"))


def a27(spark: SparkSession, d: str) -> DataFrame:
    pooled = A.grid_mean_pool(F.transform("embedding", lambda x: x.cast("double")), 8, 4)
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(pooled).alias("cell", "mean")).withColumns(_r("mean"))


def a28(spark: SparkSession, d: str) -> DataFrame:
    rate = A.effective_rate(timelines(spark, d), "video", "pts", 30.0)
    return rate.select("video", F.round("rate", 8).alias("rate"))


def a29(spark: SparkSession, d: str) -> DataFrame:
    return A.select_best(read(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey", "s_name"), ["s_nationkey"], "s_acctbal", "s_suppkey")


def a30(spark: SparkSession, d: str) -> DataFrame:
    return A.early_stop_scan(timelines(spark, d).select("video", "frame", "value"), "video", "frame", "value", 8, 0.5)


def a31(spark: SparkSession, d: str) -> DataFrame:
    maps = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.create_map("l_returnflag", "n").alias("counts"))
    return A.sum_map(maps, "counts").select(F.explode("counts").alias("flag", "n"))


def a32(spark: SparkSession, d: str) -> DataFrame:
    return A.single_value_check(read(spark, d, "lineitem").withColumn("extractor", F.lit("v1")), ["extractor", "l_returnflag", "l_linenumber"])


def a33(spark: SparkSession, d: str) -> DataFrame:
    return A.best_of_n(_errors(spark, d).withColumn("step", F.col("window") * 8 + F.col("step")), "video", "draw").withColumns(_r("ade", "fde"))


def a34(spark: SparkSession, d: str) -> DataFrame:
    metrics = read(spark, d, "supplier").groupBy("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("run")).agg(F.avg("s_acctbal").alias("v"))
    return A.compare_runs(metrics, ["s_nationkey"], "run", "even", "odd", "v").withColumns(_r("old", "new", "change", "relative"))


QUERIES = {
    "a1_frame_requests": a1, "a2_video_summary": a2, "a3_counters": a3, "a4_storage_estimate": a4, "a5_episode_capacity": a5, "a6_support_matrix": a6, "a7_quantiles": a7,
    "a8_population_moments": a8, "a9_masked_mean": a9, "a10_macro_micro": a10, "a11_ade_fde": a11, "a11_ade_fde_camera": a11_camera, "a13_joint_errors": a13, "a13_repeat_last": a13_repeat_last, "a15_stream_mse": a15, "a16_topk_accuracy": a16,
    "a17_class_mean_recall": a17, "a18_distinct_prompts": a18, "a19_split_statistics": a19, "a20_unique_key_check": a20, "a21_functional_dependency": a21, "a22_domain_check": a22,
    "a23_split_profile": a23, "a24_coverage_report": a24, "a24_coverage_of_windows": a24_windows, "a25_motion_by_phase": a25, "a26_temporal_bin_pool": a26, "a27_grid_mean_pool": a27, "a28_effective_rate": a28,
    "a29_select_best": a29, "a30_early_stop_scan": a30, "a31_sum_map": a31, "a32_single_value_check": a32, "a33_best_of_n": a33, "a34_compare_runs": a34,
}

_ERRORS = f"""{FRAMES}, win AS (SELECT *, frame // 8 AS w FROM frames),
errors AS (SELECT a.video, a.w, a.frame % 8 AS step, a.event_type, abs(a.value - b.value) AS error, a.event_type <> 'error' AS valid, a.event_id % 3 AS draw
  FROM win a JOIN win b ON a.video = b.video AND a.w = b.w AND b.frame % 8 = 0),
each AS (SELECT video, w, event_type, sum(error) AS s, count(*) AS n, arg_max(error, step) AS l FROM errors WHERE valid GROUP BY ALL),
scored AS (SELECT event_type, sum(s) AS s, sum(n) AS n, sum(l) AS l, count(*) AS windows, sum(s) / sum(n) AS ade, sum(l) / count(*) AS fde FROM each GROUP BY event_type)"""
_PAIRS = "pairs AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS p, list_transform(b.embedding, lambda x: x::DOUBLE) AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_HITS = """hits AS (
  SELECT vec_id, label, label IN (SELECT unnest(r[1:{k}])) AS hit FROM (
    SELECT vec_id, label, list_transform(list_sort(list_transform(range(0, len(embedding)), lambda i: {{'s': -embedding[i + 1], 'i': i}})), lambda x: x.i) AS r FROM embeddings))"""
_QS = "[0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]"

ORACLE = {
    "a1_frame_requests": """
SELECT 'logical' AS kind, l_returnflag AS dataset, count(*) AS frames FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM lineitem) GROUP BY ALL
UNION ALL SELECT 'physical', f, count(*) FROM (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'N' ELSE l_returnflag END AS f, l_suppkey, l_partkey FROM lineitem) GROUP BY ALL""",
    "a2_video_summary": """
WITH r AS (SELECT DISTINCT o_orderstatus AS dataset, o_custkey AS video, o_orderkey % 1000 AS frame FROM orders)
SELECT dataset, video, count(*) AS requested, min(frame) AS first, max(frame) AS last, (floor(any_value(c_acctbal)) % 1000 + 500)::BIGINT AS pts_frames,
       coalesce(max(frame) < floor(any_value(c_acctbal)) % 1000 + 500, false) AS inside
FROM r LEFT JOIN customer ON c_custkey = video GROUP BY dataset, video""",
    "a3_counters": """
SELECT event_type, reason, count(*) AS rows, reason IS NULL AS kept
FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 1 THEN 'short' END AS reason FROM events) GROUP BY ALL""",
    "a4_storage_estimate": "SELECT count(*) AS units, (sum(n_chars) * 196608)::BIGINT AS bytes, sum(n_chars) * 196608 / 1073741824.0::DOUBLE AS gib, sum(n_chars) * 196608 / 1099511627776.0::DOUBLE AS tib FROM documents",
    "a5_episode_capacity": f"""
WITH {FRAMES}, i(a, b) AS (VALUES (0, 20), (15, 40), (40, 90)),
per AS (SELECT video, a, count(*) - 1 AS targets, max(pts) - arg_min(pts, frame) AS horizon FROM frames JOIN i ON frame >= greatest(a, 5) AND frame < b WHERE value >= 5 GROUP BY video, a HAVING count(*) >= 2)
SELECT video, targets, round(horizon, 4) + 0.0::DOUBLE AS horizon FROM per QUALIFY row_number() OVER (PARTITION BY video ORDER BY targets DESC, horizon DESC) = 1""",
    "a6_support_matrix": """
WITH per AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1), t(threshold, bit) AS (VALUES (4, 1), (8, 2), (12, 4), (16, 8), (24, 16), (32, 32), (48, 64), (60, 128))
SELECT count(*) AS n, threshold::DOUBLE AS threshold, count(*) FILTER (c >= threshold) AS reach, round(100.0 * count(*) FILTER (c >= threshold) / greatest(count(*), 1), 4)::DOUBLE AS percent,
       (SELECT bit_or(m)::INT FROM (SELECT sum(CASE WHEN c >= threshold THEN bit ELSE 0 END)::INT AS m FROM per, t GROUP BY o_custkey)) AS mask
FROM per, t GROUP BY threshold""",
    "a7_quantiles": f"""
SELECT source, n, unnest(v) AS value, unnest({_QS})::DOUBLE AS q FROM (
  SELECT coalesce(l_returnflag, 'all') AS source, count(*) AS n, list_transform(quantile_cont(l_extendedprice, {_QS}), lambda x: round(x, 4)) AS v FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ()))""",
    "a8_population_moments": """
SELECT axis, source, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS least, max(v) AS greatest FROM (
  SELECT l_linestatus AS source, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS axis, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
GROUP BY GROUPING SETS ((axis, source), (axis))""",
    "a9_masked_mean": "SELECT l_returnflag, round(coalesce(sum(l_extendedprice) FILTER (l_quantity > 25), 0) / greatest(count(*) FILTER (l_quantity > 25), 1), 4) AS masked_mean FROM lineitem GROUP BY 1",
    "a10_macro_micro": f"""
WITH {_ERRORS} SELECT 'm' AS model, 'macro' AS source, round(avg(ade), 4) AS ade, round(avg(fde), 4) AS fde, sum(windows)::BIGINT AS windows FROM scored
UNION ALL SELECT 'm', 'micro', round(sum(s) / sum(n), 4), round(sum(l) / sum(windows), 4), sum(windows)::BIGINT FROM scored""",
    "a11_ade_fde": f"WITH {_ERRORS} SELECT event_type, n::BIGINT AS steps, windows, round(ade, 4) AS ade, round(fde, 4) AS fde, round((ade + fde) / 2, 4) AS selection FROM scored",
    "a11_ade_fde_camera": f"""
WITH {FRAMES}, e AS (SELECT a.video, a.frame // 8 AS w, a.frame % 8 AS step, abs(a.value - b.value) AS error, a.value >= 8 AS valid, a.event_type <> 'error' AS cam FROM frames a JOIN frames b ON a.video = b.video AND b.frame = a.frame // 8 * 8),
each AS (SELECT video, w, sum(error) FILTER (valid) AS s, count(*) FILTER (valid) AS n, arg_max(error, step) FILTER (valid) AS l, coalesce(sum(error / 10) FILTER (cam), 0) AS cs, count(*) FILTER (cam) AS cn FROM e GROUP BY ALL HAVING count(*) FILTER (valid) > 0)
SELECT video, sum(n)::BIGINT AS steps, count(*) AS windows, round(sum(s) / sum(n), 8) AS ade, round(avg(l), 8) AS fde, round((sum(s) / sum(n) + avg(l)) / 2, 8) AS selection, round(sum(cs) / greatest(sum(cn), 1), 8) AS camera_error FROM each GROUP BY video""",
    "a13_repeat_last": """
WITH j AS (SELECT vec_id // 8 AS w, vec_id % 8 - 3 AS step, embedding[64] > -0.1 AS valid, j, embedding[j * 3 + 1]::DOUBLE AS x, embedding[j * 3 + 2]::DOUBLE AS y, embedding[j * 3 + 3]::DOUBLE AS z FROM (SELECT *, unnest(range(0, 21)) AS j FROM embeddings)),
d AS (SELECT j, sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2) + pow(n.z - p.z, 2)) AS e FROM j n JOIN j p USING (w, j) WHERE p.step = 0 AND n.step > 0 AND n.valid)
SELECT round(avg(e), 4) AS joint_error, round(avg(e) FILTER (j IN (4, 8, 12, 16, 20)), 4) AS fingertip_error, round(quantile_cont(e, 0.9), 4) AS p90 FROM d""",
    "a13_joint_errors": f"""
WITH {_PAIRS}, d AS (SELECT j, sqrt(pow(p[j * 3 + 1] - t[j * 3 + 1], 2) + pow(p[j * 3 + 2] - t[j * 3 + 2], 2) + pow(p[j * 3 + 3] - t[j * 3 + 3], 2)) AS e FROM (SELECT p, t, unnest(range(0, 21)) AS j FROM pairs))
SELECT round(avg(e), 4) AS joint_error, round(avg(e) FILTER (j IN (4, 8, 12, 16, 20)), 4) AS fingertip_error, round(quantile_cont(e, 0.9), 4) AS p90 FROM d""",
    "a15_stream_mse": f"""
WITH {_PAIRS}, x AS (SELECT i, pow(p[i] - t[i], 2) AS s FROM (SELECT p, t, unnest(range(1, 65)) AS i FROM pairs))
SELECT CASE WHEN i <= 9 THEN 'camera' WHEN i <= 18 THEN 'left_wrist' WHEN i <= 27 THEN 'right_wrist' ELSE 'hands' END AS stream, round(avg(s), 4) AS mse FROM x GROUP BY 1
UNION ALL SELECT 'cosine', round(avg(list_cosine_similarity(p, t)), 4) FROM pairs""",
    "a16_topk_accuracy": f"WITH {_HITS.format(k=3)} SELECT avg(hit::INT) AS accuracy, count(*) AS rows FROM hits",
    "a17_class_mean_recall": f"""
WITH {_HITS.format(k=5)}, s AS (SELECT *, unnest(list_filter(['overall', CASE WHEN vec_id % 5 = 0 THEN 'tail' END, CASE WHEN vec_id % 7 = 0 THEN 'unseen' END], lambda x: x IS NOT NULL)) AS subset FROM hits)
SELECT subset, round(avg(r), 4) AS recall, count(*) AS classes, sum(n)::BIGINT AS rows FROM (SELECT subset, label, avg(hit::INT) AS r, count(*) AS n FROM s GROUP BY ALL) GROUP BY subset""",
    "a18_distinct_prompts": """
WITH i AS (SELECT conv_id AS e, CASE role WHEN 'user' THEN 'Left' ELSE 'Right' END AS hand, turn, turn * 3 AS a, turn * 3 + 5 AS b, text FROM conversations WHERE role <> 'system'),
cuts AS (SELECT DISTINCT e, x FROM (SELECT e, unnest([a, b, 0]) AS x FROM i)), starts AS (SELECT c.e, x FROM cuts c JOIN (SELECT e, max(b) AS m FROM i GROUP BY e) m ON c.e = m.e AND x < m.m),
shown AS (SELECT s.e, s.x, hand, arg_min(text, turn) AS text FROM starts s JOIN i ON i.e = s.e AND a <= x AND x < b GROUP BY ALL)
SELECT DISTINCT coalesce(string_agg(hand || ' hand: ' || text, ' ' ORDER BY hand || ' hand: ' || text), '') AS prompt FROM starts s LEFT JOIN shown USING (e, x) GROUP BY s.e, s.x""",
    "a19_split_statistics": """
SELECT o_orderpriority AS source, count(DISTINCT o_custkey) AS videos, count(*) AS episodes, count(DISTINCT o_custkey) FILTER (o_custkey % 7 = 0) AS held_out_videos,
       count(*) FILTER (o_custkey % 7 = 0) AS held_out_episodes, count(*) FILTER (o_custkey % 7 = 0 AND o_orderkey % 2 = 0) AS evaluated FROM orders GROUP BY 1""",
    "a20_unique_key_check": "SELECT regexp_extract(url, '//([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1",
    "a21_functional_dependency": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS \"values\" FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1",
    "a22_domain_check": """
SELECT c AS "column", min(v) AS least, max(v) AS greatest, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (v < a OR v >= b) AS outside
FROM (SELECT 'p_size' AS c, p_size::DOUBLE AS v, 0 AS a, 50 AS b FROM part UNION ALL SELECT 'p_retailprice', p_retailprice, 900, 2000 FROM part) GROUP BY c""",
    "a23_split_profile": "SELECT lang, count(*) AS records, count(DISTINCT source) AS n_source, count(DISTINCT doc_id) AS n_doc_id FROM documents GROUP BY lang",
    "a24_coverage_report": """
SELECT c_mktsegment, count(*) FILTER (n IS NULL) AS "without", count(*) FILTER (n < 5) AS truncated, count(*) FILTER (most > 200000) AS beyond, count(*) AS segments
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""",
    "a24_coverage_of_windows": f"""
WITH {FRAMES}, n AS (SELECT video, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT o_custkey AS r, o_orderpriority, o_orderkey % 120 AS a, o_orderkey % 120 + 16 AS z FROM orders)
SELECT o_orderpriority, count(*) AS segments, count(*) FILTER (n IS NULL) AS without_pose, count(*) FILTER (a >= n) AS anchor_beyond, count(*) FILTER (z >= n) AS truncated, count(*) FILTER (z < n) AS whole,
       count(*) FILTER (value >= 5) AS hand0, count(*) FILTER (event_type = 'click') AS hand1, count(*) FILTER (value >= 5 OR event_type = 'click') AS any_hand, count(*) FILTER (value >= 5 AND event_type = 'click') AS both_hands
FROM s LEFT JOIN n ON n.video = r LEFT JOIN frames f ON f.video = r AND f.frame = a GROUP BY 1""",
    "a25_motion_by_phase": f"""
WITH {FRAMES}, s AS (SELECT video, frame // 64 AS seg, frame % 64 - 31 AS t, value FROM frames),
m AS (SELECT s.video, s.seg, CASE WHEN s.t <= 0 THEN 'history' WHEN s.t <= 8 THEN 'gap' ELSE 'execution' END AS phase, max(abs(s.value - a.value)) AS motion
  FROM s JOIN s a ON a.video = s.video AND a.seg = s.seg AND a.t = 0 GROUP BY ALL)
SELECT source, n, unnest(v) AS value, unnest([0.5, 0.9])::DOUBLE AS q FROM (SELECT coalesce(phase, 'all') AS source, count(*) AS n, list_transform(quantile_cont(motion, [0.5, 0.9]), lambda x: round(x, 4)) AS v FROM m GROUP BY GROUPING SETS ((phase), ()))""",
    "a26_temporal_bin_pool": f"""
WITH {FRAMES}, spans(span, last, n) AS (VALUES (0, 75, 5), (1, 48, 2), (2, 24, 2)), bins AS (SELECT span, last, n, unnest(range(0, n)) AS bin FROM spans),
edges AS (SELECT span, bin, floor(last * bin / n) AS lo, floor(last * (bin + 1) / n) AS hi FROM bins)
SELECT video AS "group", span, bin::INT AS bin, max(value) AS value, round(max(pts), 4) AS pts FROM frames JOIN edges ON frame BETWEEN lo AND hi GROUP BY ALL""",
    "a27_grid_mean_pool": """
SELECT vec_id, c::INT AS cell, round((embedding[o + 1]::DOUBLE + embedding[o + 2]::DOUBLE + embedding[o + 9]::DOUBLE + embedding[o + 10]::DOUBLE) / 4, 4) + 0.0::DOUBLE AS mean
FROM (SELECT *, (c // 4) * 16 + (c % 4) * 2 AS o FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS c FROM embeddings))""",
    "a28_effective_rate": f"WITH {FRAMES} SELECT video, round(coalesce(1 / median(s), 30), 8) AS rate FROM (SELECT video, pts - lag(pts) OVER (PARTITION BY video ORDER BY pts) AS s FROM frames) GROUP BY video",
    "a29_select_best": "SELECT s_nationkey, s_acctbal, s_suppkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) = 1",
    "a30_early_stop_scan": f"""
WITH RECURSIVE {FRAMES}, fold AS (
  SELECT video, -1 AS frame, 'infinity'::DOUBLE AS best, NULL::BIGINT AS best_step, 0 AS stale, NULL::BIGINT AS stop FROM (SELECT DISTINCT video FROM frames)
  UNION ALL
  SELECT f.video, x.frame, CASE WHEN x.value < best - 0.5 THEN x.value ELSE best END, CASE WHEN x.value < best - 0.5 THEN x.frame ELSE best_step END,
         CASE WHEN x.value < best - 0.5 THEN 0 ELSE stale + 1 END, CASE WHEN NOT x.value < best - 0.5 AND stale + 1 >= 8 THEN x.frame END
  FROM fold f JOIN frames x ON x.video = f.video AND x.frame = f.frame + 1 WHERE stop IS NULL)
SELECT video, best, best_step, stop FROM fold QUALIFY row_number() OVER (PARTITION BY video ORDER BY frame DESC) = 1""",
    "a31_sum_map": "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1",
    "a32_single_value_check": """
SELECT unnest(['extractor', 'l_returnflag', 'l_linenumber']) AS "column", unnest([1, f, n]) AS "values", unnest([true, f = 1, n = 1]) AS single
FROM (SELECT count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linenumber) AS n FROM lineitem)""",
    "a33_best_of_n": f"""
WITH {_ERRORS}, d AS (SELECT video, draw, avg(error) AS ade, arg_max(error, w * 8 + step) AS fde FROM (SELECT * FROM errors WHERE valid) GROUP BY ALL)
SELECT video, draw, round(ade, 4) AS ade, round(fde, 4) AS fde, 'least ade' AS rule FROM d QUALIFY row_number() OVER (PARTITION BY video ORDER BY ade, draw) = 1""",
    "a34_compare_runs": """
WITH m AS (SELECT s_nationkey, avg(s_acctbal) FILTER (s_suppkey % 2 = 0) AS o, avg(s_acctbal) FILTER (s_suppkey % 2 = 1) AS n FROM supplier GROUP BY 1)
SELECT s_nationkey, round(o, 4) AS old, round(n, 4) AS new, round(n - o, 4) AS change, round((n - o) / o, 4) AS relative FROM m""",
}
