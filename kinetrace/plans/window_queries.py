"""Queries over window operators, and the forecast slice: windows, anchors, trivial forecasts, displacement errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.operators import aggregates as A
from kinetrace.operators import windows as W
from kinetrace.plans.proxy import FRAMES, read, seconds, timelines

H, K = 6, 16


def _lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("length"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = timelines(spark, sf_dir)
    windows = W.make_windows(_lengths(frames), H, K).select("video", "start")
    return W.window_frames(windows, frames.select("video", "frame", "pts", "value", "event_type"), H, K)


def forecast_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = W.trivial_forecasts(_long(spark, sf_dir))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.abs(F.col(m) - F.col("value")).alias("error")) for m in ("persistence", "constant_velocity")])
    errors = steps.select("video", "start", "step", "anchor_type", F.inline(models)).withColumn("valid", F.lit(True))
    scored = A.ade_fde(errors, ["video", "start"], ["model", "anchor_type"])
    whole = A.macro_micro(scored, "model")
    rows = scored.select("model", F.col("anchor_type").alias("source"), "ade", "fde", "windows").unionByName(whole)
    return rows.withColumns({"ade": F.round("ade", 4), "fde": F.round("fde", 4)})


def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.check_monotonic(timelines(spark, sf_dir))


def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = timelines(spark, sf_dir).withColumn("pts", (F.floor(F.col("pts") / 3600) * 3600).cast("double"))
    return W.repair_duplicates(frames, 60.0).select("video", "frame", "pts", "repaired", "clash")


def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.make_windows(_lengths(timelines(spark, sf_dir)), H, K)
    return w.select("video", "length", "start", "anchor_index", F.element_at("history_indices", 1).alias("first"), F.element_at("future_indices", -1).alias("last"), F.round(F.element_at("future_time_seconds", -1), 6).alias("horizon"))


def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = timelines(spark, sf_dir).withColumn("valid", F.col("value") >= 2)
    starts = W.make_windows(_lengths(frames), H, K, stride=1).select("video", "start")
    return W.complete_windows(starts, frames.select("video", "frame", "valid"), H + K).groupBy("video").agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("rejected"))


def _anchors(spark: SparkSession, sf_dir: str, future: int) -> DataFrame:
    frames = timelines(spark, sf_dir).select("video", "frame", F.floor(F.col("frame") / 40).alias("interval"), (F.col("value") >= 5).alias("kept"))
    return W.native_anchors(frames, H, future)


def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir, 8).select("video", "interval", "frame", "targets")


def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sample_window(_anchors(spark, sf_dir, 1).select("video", "frame", "targets"), 11)


def w6_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = timelines(spark, sf_dir).select("video", "frame", F.floor(F.col("frame") / 40).alias("interval"), (F.col("value") >= 5).alias("kept"))
    out = W.window_targets(w6(spark, sf_dir), frames, 11, H)
    return out.select("video", "interval", "anchor", "target_count", "mode", F.get("history", 0).cast("long").alias("first"), F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", W.sample_start(F.col("o_orderkey"), F.col("o_custkey")).alias("start"))


def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = W.context_indices(F.col("l_linenumber") * 40)
    keyed = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("at"))
    return keyed.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last"), F.size("at").alias("n"), F.size(F.filter("at", lambda x: x == 0)).alias("repeats"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97 + 60).alias("start"), (F.col("event_id") % 97 + 60 + F.col("user_id") % 45).alias("end"), (F.col("event_id") % 120 + 20).alias("stream"))


def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = W.oracle_window(_segments(spark, sf_dir), F.col("stream"))
    return steps.groupBy("event_id", "phase").agg(F.count(F.lit(1)).alias("steps"), F.count_if("valid").alias("valid"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum("frame").alias("total"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines(spark, sf_dir).select("video", F.col("frame").alias("step"), F.col("pts").alias("time"), "value", (F.col("event_type") != "error").alias("valid"))


def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.velocity(_steps(spark, sf_dir), ["video"]).select("video", "step", (F.round("velocity", 6) + F.lit(0.0)).alias("velocity"))


def w10_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame 10 is step 0 of each video: times count from there."""
    frames = timelines(spark, sf_dir)
    zero = frames.filter("frame = 10").select("video", F.col("pts").alias("_zero"))
    steps = frames.join(zero, "video").select("video", (F.col("frame") - 10).alias("step"), (F.col("pts") - F.col("_zero")).alias("time"), "value", (F.col("event_type") != "error").alias("valid"))
    return W.velocity(steps, ["video"], from_history=True).select("video", "step", (F.round("velocity", 6) + F.lit(0.0)).alias("velocity"))


def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_valid_step(_steps(spark, sf_dir), ["video"])


def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "events").select("user_id", (seconds() - 1704067200).alias("time"), F.col("value").alias("error"), (F.col("event_type") != "error").alias("valid"))
    return W.horizon_weighted_error(base, ["user_id"], 2.0).withColumn("weighted_error", F.round("weighted_error", 6))


def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.moving_average(timelines(spark, sf_dir), ["video"], ["frame"], "value", 5)
    return out.select("video", "frame", F.round("moving_average", 6).alias("moving_average"))


def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"))
    groups = customers.join(rows, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("group"), "rows")
    return W.holdout_groups(groups, "holdout-v1", 5, 120)


def w15_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held out by order priority; two priorities share a physical source."""
    groups = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("group")).agg(F.count(F.lit(1)).alias("rows"))
    first = F.array(*[F.struct(F.lit(a).alias("logical"), F.lit("1-URGENT").alias("physical")) for a in ("2-HIGH", "5-LOW")])
    aliases = read(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.inline(first))
    return W.union_over_aliases(W.holdout_groups(groups, "holdout-v1", 5, 20), aliases)


def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetrace.operators.publish import global_index

    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return global_index(docs, ["source", "doc_id"]).select("doc_id", "index", (F.col("index") % 8).alias("worker"))


QUERIES = {
    "forecast_baselines": forecast_baselines, "w1_check_monotonic": w1, "w2_repair_duplicates": w2, "w3_make_windows": w3, "w4_complete_windows": w4,
    "w5_native_anchors": w5, "w6_sample_window": w6, "w6_window_targets": w6_targets, "w7_sample_start": w7, "w8_context_indices": w8, "w9_oracle_window": w9, "w10_velocity": w10, "w10_velocity_from_history": w10_history,
    "w11_last_valid_step": w11, "w12_horizon_weighted_error": w12, "w14_moving_average": w14, "w15_holdout_groups": w15, "w15_union_over_aliases": w15_aliases, "w16_round_robin": w16,
}

_WINDOWS = f"""windows AS (
  SELECT DISTINCT video, n AS length, unnest(list_concat(range(0, n - {H + K} + 1, {K}), [n - {H + K}]))::INT AS start
  FROM (SELECT video, count(*)::INT AS n FROM frames GROUP BY video) WHERE n >= {H + K})"""
_ANCHORS = f"""anchors AS (
  SELECT * FROM (
    SELECT video, frame, interval, kept, coalesce(count(*) FILTER (kept) OVER (PARTITION BY video, interval ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS targets
    FROM (SELECT video, frame, (frame // 40)::BIGINT AS interval, value >= 5 AS kept FROM frames))
  WHERE kept AND frame >= {H - 1})"""
_DRAW = "(('0x' || substr(sha256({0}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"

ORACLE = {
    "forecast_baselines": f"""
WITH {FRAMES}, {_WINDOWS},
long AS (SELECT w.video, w.start, f.frame - w.start - {H - 1} AS step, f.value, f.event_type FROM windows w JOIN frames f ON f.video = w.video AND f.frame BETWEEN w.start AND w.start + {H + K - 1}),
anchored AS (SELECT *, max(value) FILTER (step = 0) OVER w AS now, max(value) FILTER (step = -1) OVER w AS was, max(event_type) FILTER (step = 0) OVER w AS anchor_type FROM long WINDOW w AS (PARTITION BY video, start)),
errors AS (
  SELECT 'persistence' AS model, anchor_type, step, abs(now - value) AS error FROM anchored WHERE step > 0
  UNION ALL SELECT 'constant_velocity', anchor_type, step, abs(now + step * (now - was) - value) FROM anchored WHERE step > 0),
scored AS (SELECT model, anchor_type AS source, avg(error) AS ade, avg(error) FILTER (step = {K}) AS fde, count(*) FILTER (step = {K}) AS windows, sum(error) AS s, count(*) AS n, sum(error) FILTER (step = {K}) AS sf FROM errors GROUP BY ALL),
rows AS (
  SELECT model, source, ade, fde, windows FROM scored
  UNION ALL SELECT model, 'macro', avg(ade), avg(fde), sum(windows)::BIGINT FROM scored GROUP BY model
  UNION ALL SELECT model, 'micro', sum(s) / sum(n), sum(sf) / sum(windows), sum(windows)::BIGINT FROM scored GROUP BY model)
SELECT model, source, round(ade, 4) AS ade, round(fde, 4) AS fde, windows FROM rows""",
    "w1_check_monotonic": f"""
WITH {FRAMES}, steps AS (SELECT *, pts - lag(pts) OVER (PARTITION BY video ORDER BY frame) AS step FROM frames)
SELECT video, count(*) AS frames, count(*) FILTER (pts IS NULL OR NOT isfinite(pts)) AS not_finite, count(*) FILTER (step <= 0) AS not_rising,
       count(*) >= 2 AND count(*) FILTER (pts IS NULL OR NOT isfinite(pts)) = 0 AND count(*) FILTER (step <= 0) = 0 AS valid FROM steps GROUP BY video""",
    "w2_repair_duplicates": f"""
WITH {FRAMES}, hours AS (SELECT video, frame, floor(pts / 3600) * 3600 AS pts FROM frames),
nth AS (SELECT *, row_number() OVER (PARTITION BY video, pts ORDER BY frame) - 1 AS k, lag(pts) OVER (PARTITION BY video ORDER BY frame) AS was FROM hours),
following AS (SELECT video, pts, lead(pts) OVER (PARTITION BY video ORDER BY pts) AS nxt FROM (SELECT DISTINCT video, pts FROM hours))
SELECT video, frame, pts, pts + k * 60.0 AS repaired, coalesce((pts + k * 60.0 >= nxt AND k > 0) OR pts < was, false) AS clash FROM nth JOIN following USING (video, pts)""",
    "w3_make_windows": f"""
WITH {FRAMES}, {_WINDOWS} SELECT video, length, start, start + {H - 1} AS anchor_index, start AS first, start + {H + K - 1} AS last, round({K} / 30.0, 6)::DOUBLE AS horizon FROM windows""",
    "w4_complete_windows": f"""
WITH {FRAMES}, good AS (SELECT video, frame AS start, count(*) FILTER (value >= 2) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND {H + K - 1} FOLLOWING) = {H + K} AS complete,
  count(*) OVER (PARTITION BY video) AS n FROM frames)
SELECT video, count(*) FILTER (complete) AS complete, count(*) FILTER (NOT complete) AS rejected FROM good WHERE start <= n - {H + K} GROUP BY video""",
    "w5_native_anchors": f"WITH {FRAMES}, {_ANCHORS} SELECT video, interval, frame, targets FROM anchors WHERE targets >= 8",
    "w6_sample_window": f"""
WITH {FRAMES}, {_ANCHORS}, able AS (SELECT * FROM anchors WHERE targets >= 1),
support AS (SELECT video, max(targets) AS most, list_filter([8, 16], lambda k: k <= max(targets)) AS fits FROM able GROUP BY video),
chosen AS (
  SELECT video, CASE WHEN ({_DRAW.format("'11|' || video")} < 0.1 OR len(fits) = 0) AND most >= 24 THEN 24
                     WHEN len(fits) > 0 THEN fits[floor({_DRAW.format("'12|' || video")} * len(fits))::INT + 1] END AS target_count FROM support)
SELECT video, frame AS anchor, target_count FROM able JOIN chosen USING (video) WHERE target_count IS NOT NULL AND targets >= target_count
QUALIFY row_number() OVER (PARTITION BY video ORDER BY {_DRAW.format("'13|' || video || '|' || frame")}, frame) = 1""",
    "w6_window_targets": f"""
WITH {FRAMES}, {_ANCHORS}, able AS (SELECT * FROM anchors WHERE targets >= 1),
support AS (SELECT video, max(targets) AS most, list_filter([8, 16], lambda k: k <= max(targets)) AS fits FROM able GROUP BY video),
chosen AS (
  SELECT video, CASE WHEN ({_DRAW.format("'11|' || video")} < 0.1 OR len(fits) = 0) AND most >= 24 THEN 24
                     WHEN len(fits) > 0 THEN fits[floor({_DRAW.format("'12|' || video")} * len(fits))::INT + 1] END AS k FROM support),
picks AS (SELECT video, frame AS anchor, k FROM able JOIN chosen USING (video) WHERE k IS NOT NULL AND targets >= k QUALIFY row_number() OVER (PARTITION BY video ORDER BY {_DRAW.format("'13|' || video || '|' || frame")}, frame) = 1),
later AS (SELECT p.video, anchor, k, anchor // 40 AS interval, list(f.frame ORDER BY f.frame) AS l, {_DRAW.format("'14|' || p.video")} < 0.5 AS dense
  FROM picks p JOIN frames f ON f.video = p.video AND f.frame > anchor AND f.frame // 40 = anchor // 40 AND f.value >= 5 GROUP BY ALL)
SELECT video, interval::BIGINT AS interval, anchor, k AS target_count, CASE WHEN dense THEN 'consecutive' ELSE 'spread' END AS mode, (anchor - {H - 1})::BIGINT AS first,
       array_to_string(CASE WHEN dense THEN l[1:k] ELSE list_transform(range(0, k), lambda i: l[i * (len(l) - 1) // (k - 1) + 1]) END, ',') AS targets FROM later""",
    "w7_sample_start": "SELECT o_orderkey, o_orderkey * 104729 % (o_custkey + 1) AS start FROM orders",
    "w8_context_indices": """
SELECT l_orderkey, l_linenumber, l_partkey, list_min(a)::INT AS first, list_max(a)::INT AS last, len(a)::INT AS n, len(list_filter(a, lambda x: x = 0))::INT AS repeats, list_sum(a)::BIGINT AS total
FROM (SELECT *, list_transform(range(l_linenumber * 40 - 180, l_linenumber * 40 + 1), lambda x: greatest(x, 0)) AS a FROM lineitem)""",
    "w9_oracle_window": """
WITH segments AS (SELECT event_id, event_id % 97 + 60 AS start, event_id % 97 + 60 + user_id % 45 AS stop, event_id % 120 + 20 AS stream FROM events),
steps AS (SELECT *, unnest(range(-31, 17)) AS step FROM segments),
exact AS (SELECT *, start - 30 + round_even(step * 3.75, 0)::BIGINT AS e FROM steps),
placed AS (SELECT *, CASE WHEN step <= 0 THEN greatest(e, 0) ELSE least(e, stop) END AS frame, CASE WHEN step <= 0 THEN 'history' WHEN step <= 8 THEN 'gap' ELSE 'execution' END AS phase FROM exact)
SELECT event_id, phase, count(*) AS steps, count(*) FILTER (start - 30 < stream AND (step <= 8 OR e <= stop) AND frame < stream) AS valid, min(frame) AS first, max(frame) AS last, sum(frame)::BIGINT AS total
FROM placed GROUP BY ALL""",
    "w10_velocity": f"""
WITH {FRAMES}, was AS (SELECT video, frame, pts, value, event_type <> 'error' AS valid, last_value(CASE WHEN event_type <> 'error' THEN pts END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER w AS v0
  FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT video, frame AS step, round(CASE WHEN valid THEN (value - v0) / greatest(pts - t0, 1e-4) END, 6) + 0.0::DOUBLE AS velocity FROM was""",
    "w10_velocity_from_history": f"""
WITH {FRAMES}, s AS (SELECT video, f.frame - 10 AS step, f.pts - z.pts AS t, value, event_type <> 'error' AS valid FROM frames f JOIN (SELECT video, pts FROM frames WHERE frame = 10) z USING (video)),
was AS (SELECT *, last_value(CASE WHEN valid THEN step END IGNORE NULLS) OVER w AS s0, last_value(CASE WHEN valid THEN t END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER w AS v0
  FROM s WINDOW w AS (PARTITION BY video ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT video, step, round(CASE WHEN valid AND step > 0 THEN (value - v0) / greatest(t - CASE WHEN s0 <= 0 THEN 0 ELSE t0 END, 1e-4) END, 6) + 0.0::DOUBLE AS velocity FROM was""",
    "w11_last_valid_step": f"WITH {FRAMES} SELECT video, arg_max(value, frame) AS value, max(frame) AS step FROM frames WHERE event_type <> 'error' GROUP BY video",
    "w12_horizon_weighted_error": """
WITH steps AS (SELECT user_id, epoch_us(ts) / 1e6 - 1704067200 AS t, value, event_type <> 'error' AS valid FROM events),
placed AS (SELECT *, max(t) FILTER (valid) OVER (PARTITION BY user_id) AS last FROM steps), weighed AS (SELECT *, pow(least(greatest(t / last, 0), 1), 2) AS w FROM placed WHERE valid)
SELECT user_id, round(sum(w * value) / sum(w), 6) AS weighted_error FROM weighed GROUP BY user_id""",
    "w14_moving_average": f"""
WITH {FRAMES} SELECT video, frame, round(CASE WHEN frame >= 4 THEN avg(value) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS moving_average FROM frames""",
    "w15_holdout_groups": """
WITH g AS (SELECT c_mktsegment AS source, c_custkey AS "group", count(*) AS rows FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum(rows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  count(*) OVER (PARTITION BY source) >= 5 AND sum(rows) OVER (PARTITION BY source) >= 120 AS enough FROM g
  WINDOW w AS (PARTITION BY source ORDER BY sha256('holdout-v1' || chr(0) || source || chr(0) || "group")))
SELECT source, "group", rows, enough FROM ranked WHERE k < 5 OR before < 120""",
    "w15_union_over_aliases": """
WITH g AS (SELECT o_orderpriority AS source, o_custkey AS "group", count(*) AS rows FROM orders GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum(rows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g
  WINDOW w AS (PARTITION BY source ORDER BY sha256('holdout-v1' || chr(0) || source || chr(0) || "group")))
SELECT CASE WHEN source IN ('2-HIGH', '5-LOW') THEN '1-URGENT' ELSE source END AS physical, "group", count(DISTINCT source) AS sources FROM ranked WHERE k < 5 OR before < 20 GROUP BY ALL""",
    "w16_round_robin": 'SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS "index", (row_number() OVER (ORDER BY source, doc_id) - 1) % 8 AS worker FROM documents',
}
