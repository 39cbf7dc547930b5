"""Queries over join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import poses as P
from kinetrace.operators import joins as J
from kinetrace.operators import matching as M
from kinetrace.operators import odometry as O
from kinetrace.operators import windows as W
from kinetrace.plans.proxy import FRAMES, LONG, one_long_video, read, timelines
from kinetrace.plans.shared import stored

OFFSETS, TOLERANCE = [-7200.0, 0.0, 7200.0, 14400.0], 5400.0


def j1(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d)
    lines = frames.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "pts"))), lambda x: x["pts"]).alias("pts"))
    asked = frames.select("event_id", "video", (F.col("event_id") % 90).alias("frame"))
    return J.attach_pts(asked, lines, ["video"]).select("event_id", F.round("pts", 4).alias("pts"), "pts_status")


def j2(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    hit, miss = J.attach_features(read(spark, d, "lineitem").select("l_partkey", "l_suppkey"), parts, ["l_partkey"])
    return hit.groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows")).unionByName(miss.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("none").alias("p_brand"), "rows"))


def j3(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("split"))
    labels = read(spark, d, "labels")
    return J.attach_sample_features(samples, labels.select(F.col("doc_id").alias("sample_id"), "quality"), labels.select(F.col("doc_id").alias("sample_id"), "toxic"), ["en", "de"])


def j4(spark: SparkSession, d: str) -> DataFrame:
    prompts = read(spark, d, "benchmark").select(F.col("text").alias("prompt")).groupBy("prompt").agg(F.count(F.lit(1)).alias("weight"))
    hit, miss = J.attach_features(read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt")), prompts, ["prompt"])
    return hit.select("doc_id", "prompt", "weight").unionByName(miss.select("doc_id", "prompt", F.lit(None).cast("long").alias("weight")))


def j5(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return J.align_one_to_one(docs, read(spark, d, "labels").select("doc_id", "quality"), "doc_id", ["quality"])


def j6(spark: SparkSession, d: str) -> DataFrame:
    return J.drop_excluded(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").filter("toxic = 1"), "doc_id")


def j7(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("physical"), F.col("o_custkey").alias("video"), F.col("o_orderpriority").alias("logical"), F.col("o_orderkey").alias("member"))
    return J.split_membership(rows, rows.filter("video % 7 = 0"), rows.filter("member % 2 = 0")).select("member", "split")


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames = timelines(spark, d)
    spans = frames.filter("event_type = 'error'").select("video", F.col("frame").alias("start"), (F.col("frame") + 4 + F.col("event_id") % 9).alias("end"), F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("text"))
    return frames.select("video", "frame"), spans


def j8_first(spark: SparkSession, d: str) -> DataFrame:
    return J.interval_join(*_intervals(spark, d), "video", "frame")


def j8_all(spark: SparkSession, d: str) -> DataFrame:
    return J.interval_join(*_intervals(spark, d), "video", "frame", "all").select("video", "frame", F.array_join("texts", ",").alias("texts"))


def j9(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d).select("video", "frame", "pts")
    out = J.nearest_time_join(frames.select("video", F.col("frame").alias("anchor"), "pts"), frames, OFFSETS, TOLERANCE)
    return out.select("video", "anchor", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), F.round("worst", 3).alias("worst"), "eligible")


def j10(spark: SparkSession, d: str) -> DataFrame:
    return J.densify_nearest(timelines(spark, d).select("video", "frame", "value"), "video", 2)


def j9_long(spark: SparkSession, d: str) -> DataFrame:
    """The same on timelines of which one holds half of all rows."""
    frames = one_long_video(spark, d).select("video", "frame", "pts")
    out = J.nearest_time_join(frames.select("video", F.col("frame").alias("anchor"), "pts"), frames, OFFSETS, TOLERANCE)
    return out.select("video", "anchor", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), F.round("worst", 3).alias("worst"), "eligible")


def j10_long(spark: SparkSession, d: str) -> DataFrame:
    """A grid over every third event number of videos of which one holds half of all rows, with gaps."""
    frames = one_long_video(spark, d).filter("event_id % 3 = 0").select("video", "frame", "value")
    return J.densify_nearest(frames, "video", 2)


def j11(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    lines = read(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("k")).distinct()
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return J.intersect_streams([orders, lines, parts], ["k"], "k")


def j12(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d).withColumn("valid", F.col("event_type") != "error")
    lengths = frames.groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("length"))
    steps = W.window_frames(W.make_windows(lengths).select("video", "start"), frames.select("video", "frame", "value", "valid"))
    return J.to_anchor_frame(steps, ["video", "start"], ["value"]).select("video", "start", "step", (F.round("value", 4) + F.lit(0.0)).alias("value"), "valid")


def pose_at(v: Column, k: int) -> Column:
    """The pose that a vector's components k to k + 6 (from 1) make: a quaternion and a translation."""
    return P.rigid(F.slice(v, k, 4), F.slice(v, k + 4, 3))


def j12_poses(spark: SparkSession, d: str) -> DataFrame:
    """Windows of eight vectors, steps -3 to 4: camera and left wrist from the last camera of history, the right wrist from its own pose there, in millimetres."""
    v = read(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    steps = v.select(
        F.floor(F.col("vec_id") / 8).alias("window"), (F.col("vec_id") % 8 - 3).cast("int").alias("step"), pose_at(F.col("v"), 1).alias("camera"), pose_at(F.col("v"), 11).alias("left"), pose_at(F.col("v"), 21).alias("right"),
        F.lit(True).alias("camera_ok"), (F.get("v", 40) > -0.1).alias("left_ok"), (F.get("v", 41) > -0.1).alias("right_ok"),
    )
    out = J.poses_to_anchor(steps, ["window"], {"camera": "camera_ok", "left": "left_ok", "right": "right_ok"}, own=("right",), metres=0.001)
    cell = lambda c, i: (F.round(F.get(c, i), 6) + F.lit(0.0)).alias(f"{c}_{i}")
    return out.select("window", "step", "left_ok", "right_ok", *[cell(c, i) for c in ("camera", "left", "right") for i in (0, 3, 6, 11)])


def j13(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 22 frames; each frame's transform turns by value / 100 about z and moves by (value, 1, 0)."""
    c, s, v = F.cos(F.col("value") / 100), F.sin(F.col("value") / 100), F.col("value")
    o, i = F.lit(0.0), F.lit(1.0)
    matrix = F.array(c, -s, o, v, s, c, o, i, o, o, i, o, o, o, o, i)
    steps = timelines(spark, d).select("video", F.floor(F.col("frame") / 22).alias("window"), (F.col("frame") % 22).cast("int").alias("step"), matrix.alias("transform"))
    poses = J.compose_odometry(steps, ["video", "window"], 5)
    return poses.select("video", "window", "step", (F.round(F.get("pose", 3), 4) + F.lit(0.0)).alias("x"), (F.round(F.get("pose", 7), 4) + F.lit(0.0)).alias("y"))


def j13_long(spark: SparkSession, d: str) -> DataFrame:
    """Whole videos, one of half of all rows, relative to the frame in the middle; each frame's transform turns by value / 1000 about z and moves by (value, 1, 0)."""
    c, s, v = F.cos(F.col("value") / 1000), F.sin(F.col("value") / 1000), F.col("value")
    o, i = F.lit(0.0), F.lit(1.0)
    frames = one_long_video(spark, d)
    steps = frames.select("video", F.col("frame").alias("step"), F.array(c, -s, o, v, s, c, o, i, o, o, i, o, o, o, o, i).alias("transform"))
    anchors = frames.groupBy("video").agg(F.floor(F.max("frame") / 2).alias("anchor"))
    cell = lambda k: (F.round(F.get("pose", k), 3) + F.lit(0.0))
    return O.episode_poses(steps, ["video"], anchors).select("video", "anchor", "step", cell(0).alias("turn"), cell(3).alias("x"), cell(7).alias("y"))


def j14_arrays(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items of two return flags as arrays of five numbers, paired inside a part."""
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    value = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 2000, F.col("l_discount").cast("double") * 100, F.col("l_tax").cast("double") * 100, days / 50)
    rows = read(spark, d, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), value.alias("value"))
    rows = rows.groupBy("l_partkey", "l_returnflag", "id").agg(F.min("value").alias("value"))
    a, b = (rows.filter(F.col("l_returnflag") == flag).select("l_partkey", "id", "value") for flag in "AR")
    return a, b, M.match_arrays(a, b, ["l_partkey"], "value", 14.0)


def j14_whole(spark: SparkSession, d: str) -> DataFrame:
    return j14_arrays(spark, d)[2].select("l_partkey", "a", "b", F.round("error", 6).alias("error"))


def j14_whole_report(spark: SparkSession, d: str) -> DataFrame:
    a, b, pairs = j14_arrays(spark, d)
    return J.match_report(pairs, a, b, ["l_partkey"]).withColumn("value", F.round("value", 4))


def _sides(spark: SparkSession, d: str) -> list[DataFrame]:
    rows = read(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_extendedprice").alias("value"))
    return [rows.filter(F.col("l_returnflag") == flag).select("l_partkey", "id", "value") for flag in "AR"]


def j14(spark: SparkSession, d: str) -> DataFrame:
    return J.match_windows(*_sides(spark, d), ["l_partkey"], "value", 2000.0).select("l_partkey", "a", "b", F.round("error", 4).alias("error"), "within")


def j14_report(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    pairs = stored(J.match_windows(a, b, ["l_partkey"], "value", 2000.0), "matched")  # the report takes them four times
    return J.match_report(pairs, a, b, ["l_partkey"]).withColumn("value", F.round("value", 4))


def j15(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "part")
    b = read(spark, d, "part").withColumns({"p_retailprice": F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5) * 1e-5), "p_size": F.col("p_size") + (F.col("p_partkey") % 50 == 0).cast("int")})
    return J.compare_tables(a, b, ["p_partkey"], ["p_retailprice", "p_size"]).withColumn("max_error", F.round("max_error", 6))


def j15_by_source(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "part")
    b = a.withColumns({"p_retailprice": F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5) * 1e-5), "p_size": F.col("p_size") + (F.col("p_partkey") % 50 == 0).cast("int")})
    return J.compare_tables(a, b, ["p_partkey"], ["p_retailprice", "p_size"], by="p_brand").withColumn("max_error", F.round("max_error", 6))


def j16(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return J.existence_counters(read(spark, d, "customer"), {"orders": orders, "open": orders.filter("o_orderstatus = 'O'")}, "c_custkey", "c_mktsegment")


def j17(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").alias("work"))
    out = J.fan_out_once(read(spark, d, "lineitem").select("l_partkey", "l_returnflag"), ["l_partkey"], lambda keys: keys.join(parts, "l_partkey"))
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("work").alias("work"))


def j18(spark: SparkSession, d: str) -> DataFrame:
    official = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    ok, unknown = J.eligible_set(official, read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), "k")
    return ok.select("k", F.lit("eligible").alias("status")).unionByName(unknown.select("k", F.lit("unknown").alias("status")))


def j18_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Customers who ordered: the list is those with a balance, the device their market segment, and archives are those of nations with suppliers."""
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_nationkey", "c_acctbal")
    held = customers.join(read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi")
    asked = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return J.eligibility(customers.filter("c_acctbal > 0"), asked, "k", {"c_mktsegment": F.lit("BUILDING")}, held)


def j19(spark: SparkSession, d: str) -> DataFrame:
    return J.attach_or_mask(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id", {"quality": F.lit(0), "toxic": F.lit(0)})


QUERIES = {
    "j1_attach_pts": j1, "j2_attach_frame_features": j2, "j3_attach_sample_features": j3, "j4_attach_prompt_features": j4, "j5_align_one_to_one": j5, "j6_drop_excluded": j6,
    "j7_split_membership": j7, "j8_interval_join_first": j8_first, "j8_interval_join_all": j8_all, "j9_nearest_time_join": j9, "j10_densify_nearest": j10, "j11_intersect_streams": j11,
    "j12_to_anchor_frame": j12, "j12_poses_to_anchor": j12_poses, "j13_compose_odometry": j13, "j9_nearest_time_long": j9_long, "j10_densify_long": j10_long, "j13_episode_poses": j13_long, "j14_match_arrays": j14_whole, "j14_match_arrays_report": j14_whole_report, "j14_match_windows": j14, "j14_match_report": j14_report, "j15_compare_tables": j15, "j15_compare_by_source": j15_by_source, "j16_existence_counters": j16, "j17_fan_out_once": j17,
    "j18_eligible_set": j18, "j18_eligibility": j18_eligibility, "j19_attach_or_mask": j19,
}

_SPANS = f"""{FRAMES}, spans AS (SELECT video, frame AS a, frame + 4 + event_id % 9 AS b, event_id FROM frames WHERE event_type = 'error'),
held AS (SELECT f.video, f.frame, a, b, s.event_id FROM frames f JOIN spans s ON f.video = s.video AND a <= f.frame AND f.frame < b)"""



def pose_sql(name: str, k: int, v: str = "v") -> str:
    """SQL columns name_r (9 numbers) and name_t (3) of the pose in components k to k + 6 of the list v."""
    n = f"sqrt({' + '.join(f'{v}[{k + i}] * {v}[{k + i}]' for i in range(4))})"
    w, x, y, z = (f"({v}[{k + i}] / {n})" for i in range(4))
    cells = [
        f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {w} * {z})", f"2 * ({x} * {z} + {w} * {y})",
        f"2 * ({x} * {y} + {w} * {z})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {w} * {x})",
        f"2 * ({x} * {z} - {w} * {y})", f"2 * ({y} * {z} + {w} * {x})", f"1 - 2 * ({x} * {x} + {y} * {y})",
    ]
    return f"[{', '.join(cells)}] AS {name}_r, {v}[{k + 4}:{k + 6}] AS {name}_t"


def turned_sql(a: str, b: str, i: int, j: int) -> str:
    """Cell (i, j) of transpose(a) times b, of lists of 9."""
    return "(" + " + ".join(f"{a}[{3 * k + i + 1}] * {b}[{3 * k + j + 1}]" for k in range(3)) + ")"


def moved_sql(a: str, at: str, t: str, i: int) -> str:
    """Component i of transpose(a) times (t - at)."""
    return "(" + " + ".join(f"{a}[{3 * k + i + 1}] * ({t}[{k + 1}] - {at}[{k + 1}])" for k in range(3)) + ")"


def _seen(name: str, base: str, ok: str) -> str:
    cells = {0: turned_sql(f"{base}_r", f"{name}_r", 0, 0), 6: turned_sql(f"{base}_r", f"{name}_r", 1, 2), 3: f"0.001 * {moved_sql(f'{base}_r', f'{base}_t', f'{name}_t', 0)}", 11: f"0.001 * {moved_sql(f'{base}_r', f'{base}_t', f'{name}_t', 2)}"}
    return ", ".join(f"round(CASE WHEN {ok} THEN {c} END, 6) + 0.0::DOUBLE AS {name}_{i}" for i, c in cells.items())


_ARRAYS = """r AS MATERIALIZED (
  SELECT l_partkey, l_returnflag, l_orderkey * 10 + l_linenumber AS id,
         min([l_quantity::DOUBLE, l_extendedprice::DOUBLE / 2000, l_discount::DOUBLE * 100, l_tax::DOUBLE * 100, (l_shipdate::DATE - DATE '1992-01-01') / 50]) AS v FROM lineitem GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT * FROM (
    SELECT x.l_partkey, x.id AS a, y.id AS b, list_max(list_transform(list_zip(x.v, y.v), lambda z: abs(z[1] - z[2]))) AS e
    FROM r x JOIN r y ON x.l_partkey = y.l_partkey AND x.l_returnflag = 'A' AND y.l_returnflag = 'R') WHERE e <= 14),
rounds AS (
  SELECT l_partkey, a, b, e, false AS taken FROM edges
  UNION ALL
  SELECT l_partkey, a, b, e, row_number() OVER (PARTITION BY l_partkey, a ORDER BY e, a, b) = 1 AND row_number() OVER (PARTITION BY l_partkey, b ORDER BY e, a, b) = 1
  FROM (SELECT *, bool_or(taken) OVER (PARTITION BY l_partkey, a) OR bool_or(taken) OVER (PARTITION BY l_partkey, b) AS gone FROM rounds) WHERE NOT gone),
pairs AS MATERIALIZED (SELECT l_partkey, a, b, e FROM rounds WHERE taken)"""

ORACLE = {
    "j9_nearest_time_long": f"""
WITH {LONG}, placed AS (SELECT video, frame AS anchor, k, pts + {OFFSETS}[k + 1] AS t FROM frames, (SELECT unnest(range(0, 4)) AS k)),
times AS (SELECT video, pts, min(frame) AS lo, max(frame) AS hi FROM frames GROUP BY ALL),
x AS (SELECT p.*, b.hi AS fb, b.pts AS tb FROM placed p ASOF LEFT JOIN times b ON p.video = b.video AND p.t > b.pts),
y AS (SELECT x.*, a.lo AS fa, a.pts AS ta FROM x ASOF LEFT JOIN times a ON x.video = a.video AND x.t <= a.pts),
near AS (SELECT *, CASE WHEN tb IS NOT NULL AND (ta IS NULL OR t - tb <= ta - t) THEN fb ELSE fa END AS f, CASE WHEN tb IS NOT NULL AND (ta IS NULL OR t - tb <= ta - t) THEN t - tb ELSE ta - t END AS e FROM y),
per AS (SELECT video, anchor, list(f ORDER BY k) AS l, max(e) AS worst FROM near GROUP BY ALL)
SELECT video, anchor, array_to_string(l, ',') AS frames, round(worst, 3) AS worst, worst <= {TOLERANCE} AND l[1] < l[2] AND l[2] < l[3] AND l[3] < l[4] AND l[2] = anchor AS eligible FROM per""",
    "j10_densify_long": f"""
WITH {LONG}, f AS (SELECT video, frame, value FROM frames WHERE event_id % 3 = 0),
grid AS (SELECT video, unnest(range(0, max(frame) + 1, 2)) AS g FROM f GROUP BY video),
x AS (SELECT grid.*, b.frame AS fb, b.value AS vb FROM grid ASOF LEFT JOIN f b ON grid.video = b.video AND grid.g >= b.frame),
y AS (SELECT x.*, a.frame AS fa, a.value AS va FROM x ASOF LEFT JOIN f a ON x.video = a.video AND x.g <= a.frame),
z AS (SELECT *, fb IS NOT NULL AND (fa IS NULL OR g - fb <= fa - g) AS early FROM y)
SELECT video, g AS frame, CASE WHEN early THEN fb ELSE fa END AS source, CASE WHEN early THEN vb ELSE va END AS value, coalesce(CASE WHEN early THEN fb ELSE fa END = g, false) AS valid FROM z""",
    "j13_episode_poses": f"""
WITH {LONG}, h AS (SELECT *, sum(value / 1000) OVER w AS theta, coalesce(sum(value / 1000) OVER p, 0) AS theta0 FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame), p AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, sum(cos(theta0) * value - sin(theta0)) OVER (PARTITION BY video ORDER BY frame) AS x, sum(sin(theta0) * value + cos(theta0)) OVER (PARTITION BY video ORDER BY frame) AS y FROM h),
a AS (SELECT video, max(frame) // 2 AS anchor FROM frames GROUP BY 1)
SELECT w.video, a.anchor, w.frame AS step, round(cos(w.theta - c.theta), 3) + 0.0::DOUBLE AS turn,
       round(cos(c.theta) * (w.x - c.x) + sin(c.theta) * (w.y - c.y), 3) + 0.0::DOUBLE AS x, round(cos(c.theta) * (w.y - c.y) - sin(c.theta) * (w.x - c.x), 3) + 0.0::DOUBLE AS y
FROM w JOIN a USING (video) JOIN w c ON c.video = w.video AND c.frame = a.anchor""",
    "j14_match_arrays": f"WITH RECURSIVE {_ARRAYS} SELECT l_partkey, a, b, round(e, 6) AS error FROM pairs",
    "j14_match_arrays_report": f"""
WITH RECURSIVE {_ARRAYS}
SELECT measure, round(value, 4)::DOUBLE AS value FROM (
  SELECT 'pairs' AS measure, count(*) AS value FROM pairs UNION ALL SELECT 'within', count(*) FROM pairs UNION ALL SELECT 'max', max(e) FROM pairs
  UNION ALL SELECT 'p50', quantile_cont(e, 0.5) FROM pairs UNION ALL SELECT 'p95', quantile_cont(e, 0.95) FROM pairs
  UNION ALL SELECT 'unmatched a', count(*) FROM r WHERE l_returnflag = 'A' AND (l_partkey, id) NOT IN (SELECT (l_partkey, a) FROM pairs)
  UNION ALL SELECT 'unmatched b', count(*) FROM r WHERE l_returnflag = 'R' AND (l_partkey, id) NOT IN (SELECT (l_partkey, b) FROM pairs))""",
    "j12_poses_to_anchor": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT vec_id // 8 AS win, (vec_id % 8 - 3)::INT AS step, {pose_sql("camera", 1)}, {pose_sql("left", 11)}, {pose_sql("right", 21)}, v[41] > -0.1 AS l, v[42] > -0.1 AS r FROM e),
p AS (SELECT s.*, a.camera_r AS a_r, a.camera_t AS a_t, a.right_r AS o_r, a.right_t AS o_t, s.l AND coalesce(a.l, false) AS left_ok, s.r AND coalesce(a.r, false) AS right_ok
  FROM s LEFT JOIN (SELECT * FROM s WHERE step <= 0 QUALIFY row_number() OVER (PARTITION BY win ORDER BY step DESC) = 1) a ON a.win = s.win)
SELECT win AS "window", step, left_ok, right_ok, {_seen("camera", "a", "a_r IS NOT NULL")}, {_seen("left", "a", "left_ok")}, {_seen("right", "o", "right_ok")} FROM p""",
    "j1_attach_pts": f"""
WITH {FRAMES}, n AS (SELECT video, count(*) AS n FROM frames GROUP BY 1)
SELECT q.event_id, round(f.pts, 4) AS pts, CASE WHEN n.n IS NULL THEN 'missing video' WHEN q.event_id % 90 >= n.n THEN 'out of range' ELSE 'ok' END AS pts_status
FROM frames q LEFT JOIN n USING (video) LEFT JOIN frames f ON f.video = q.video AND f.frame = q.event_id % 90 AND n.n IS NOT NULL""",
    "j2_attach_frame_features": "SELECT coalesce(p_brand, 'none') AS p_brand, count(*) AS rows FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1",
    "j3_attach_sample_features": "SELECT doc_id AS sample_id, lang AS split, quality, CASE WHEN lang IN ('en', 'de') THEN toxic END AS toxic FROM documents JOIN labels USING (doc_id)",
    "j4_attach_prompt_features": """
SELECT doc_id, text AS prompt, weight FROM documents LEFT JOIN (SELECT text AS p, count(*) AS weight FROM benchmark GROUP BY 1) ON p = text""",
    "j5_align_one_to_one": """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right only' WHEN b.doc_id IS NULL THEN 'left only' ELSE 'both' END AS side, a.q IS NOT DISTINCT FROM b.quality AS same_quality
FROM (SELECT doc_id, doc_id % 2 AS q FROM documents) a FULL JOIN labels b ON a.doc_id = b.doc_id""",
    "j6_drop_excluded": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "j7_split_membership": "SELECT o_orderkey AS member, CASE WHEN o_custkey % 7 <> 0 THEN 'train' WHEN o_orderkey % 2 = 0 THEN 'validation' END AS split FROM orders",
    "j8_interval_join_first": f"WITH {_SPANS} SELECT f.video, f.frame, coalesce(min(h.event_id)::VARCHAR, '') AS text FROM frames f LEFT JOIN held h USING (video, frame) GROUP BY f.event_id, f.video, f.frame",
    "j8_interval_join_all": f"WITH {_SPANS} SELECT f.video, f.frame, coalesce(string_agg(h.event_id::VARCHAR, ',' ORDER BY a, b, h.event_id::VARCHAR), '') AS texts FROM frames f LEFT JOIN held h USING (video, frame) GROUP BY f.event_id, f.video, f.frame",
    "j9_nearest_time_join": f"""
WITH {FRAMES}, targets AS (SELECT video, frame AS anchor, unnest(range(0, 4)) AS k, pts FROM frames),
placed AS (SELECT video, anchor, k, pts + {OFFSETS}[k + 1] AS t FROM targets),
near AS (SELECT p.*, f.frame, abs(f.pts - p.t) AS e FROM placed p JOIN frames f ON f.video = p.video QUALIFY row_number() OVER (PARTITION BY p.video, anchor, k ORDER BY abs(f.pts - p.t), f.pts) = 1),
per AS (SELECT video, anchor, list(frame ORDER BY k) AS l, max(e) AS worst FROM near GROUP BY ALL)
SELECT video, anchor, array_to_string(l, ',') AS frames, round(worst, 3) AS worst, worst <= {TOLERANCE} AND l[1] < l[2] AND l[2] < l[3] AND l[3] < l[4] AND l[2] = anchor AS eligible FROM per""",
    "j10_densify_nearest": f"""
WITH {FRAMES}, f AS (SELECT video, frame, value FROM frames), grid AS (SELECT video, unnest(range(0, max(frame) + 1, 2)) AS g FROM f GROUP BY video)
SELECT grid.video, g AS frame, f.frame::BIGINT AS source, value, f.frame = g AS valid FROM grid JOIN f ON f.video = grid.video QUALIFY row_number() OVER (PARTITION BY grid.video, g ORDER BY abs(f.frame - g), f.frame) = 1""",
    "j11_intersect_streams": "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) AND o_orderkey IN (SELECT p_partkey FROM part)",
    "j12_to_anchor_frame": f"""
WITH {FRAMES}, w AS (SELECT DISTINCT video, unnest(list_concat(range(0, n - 21, 16), [n - 22]))::INT AS start FROM (SELECT video, count(*)::INT AS n FROM frames GROUP BY 1) WHERE n >= 22)
SELECT w.video, start, f.frame - start - 5 AS step, round(CASE WHEN a.event_type <> 'error' THEN f.value - a.value END, 4) + 0.0::DOUBLE AS value, f.event_type <> 'error' AND a.event_type <> 'error' AS valid
FROM w JOIN frames f ON f.video = w.video AND f.frame BETWEEN start AND start + 21 JOIN frames a ON a.video = w.video AND a.frame = start + 5""",
    "j13_compose_odometry": f"""
WITH RECURSIVE {FRAMES}, t AS (SELECT video, frame // 22 AS win, frame % 22 AS step, cos(value / 100) AS c, sin(value / 100) AS s, value AS v FROM frames),
fwd AS (
  SELECT video, win, step, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM t WHERE step = 5
  UNION ALL SELECT t.video, t.win, t.step, f.c * t.c - f.s * t.s, f.s * t.c + f.c * t.s, f.c * t.v - f.s + f.x, f.s * t.v + f.c + f.y FROM fwd f JOIN t ON t.video = f.video AND t.win = f.win AND t.step = f.step + 1),
bwd AS (
  SELECT video, win, step, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM t WHERE step = 5
  UNION ALL SELECT t.video, t.win, t.step - 1, b.c * t.c + b.s * t.s, b.s * t.c - b.c * t.s,
    b.x - (b.c * t.c + b.s * t.s) * t.v - (b.c * t.s - b.s * t.c), b.y - (b.s * t.c - b.c * t.s) * t.v - (b.s * t.s + b.c * t.c)
  FROM bwd b JOIN t ON t.video = b.video AND t.win = b.win AND t.step = b.step WHERE t.step > 0)
SELECT video, win AS "window", step::INT AS step, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd WHERE step < 5)""",
    "j14_match_windows": """
WITH r AS (SELECT l_partkey, l_returnflag, l_orderkey * 10 + l_linenumber AS id, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT x.l_partkey, x.id AS a, y.id AS b, abs(x.v - y.v) AS e FROM r x JOIN r y USING (l_partkey) WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'R')
SELECT l_partkey, a, b, round(e, 4) AS error, e <= 2000 AS within FROM p
QUALIFY row_number() OVER (PARTITION BY l_partkey, a ORDER BY e, b) = 1 AND row_number() OVER (PARTITION BY l_partkey, b ORDER BY e, a) = 1""",
    "j15_compare_tables": """
WITH j AS (SELECT a.k AS ak, b.k AS bk, a.p AS ap, b.p AS bp, a.s AS s, b.s AS bs FROM (SELECT p_partkey AS k, p_retailprice AS p, p_size AS s FROM part) a
  FULL JOIN (SELECT p_partkey AS k, p_retailprice * (1 + (p_partkey % 5) * 1e-5) AS p, p_size + (p_partkey % 50 = 0)::INT AS s FROM part) b ON a.k = b.k),
l AS (SELECT 'p_retailprice' AS c, abs(ap - bp) AS e, abs(bp) AS m, ak IS NULL OR bk IS NULL AS alone FROM j UNION ALL SELECT 'p_size', abs(s - bs), abs(bs), ak IS NULL OR bk IS NULL FROM j)
SELECT c AS "column", round(max(e), 6)::DOUBLE AS max_error, count(*) FILTER (e > 1e-5 + 1e-5 * m) AS not_close, count(*) FILTER (alone) AS unmatched FROM l GROUP BY c""",
    "j14_match_report": """
WITH r AS (SELECT l_partkey, l_returnflag, l_orderkey * 10 + l_linenumber AS id, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT x.l_partkey, x.id AS a, y.id AS b, abs(x.v - y.v) AS e FROM r x JOIN r y USING (l_partkey) WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'R'),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_partkey, a ORDER BY e, b) = 1 AND row_number() OVER (PARTITION BY l_partkey, b ORDER BY e, a) = 1)
SELECT measure, round(value, 4)::DOUBLE AS value FROM (
  SELECT 'pairs' AS measure, count(*) AS value FROM m UNION ALL SELECT 'within', count(*) FILTER (e <= 2000) FROM m UNION ALL SELECT 'max', max(e) FROM m
  UNION ALL SELECT 'p50', quantile_cont(e, 0.5) FROM m UNION ALL SELECT 'p95', quantile_cont(e, 0.95) FROM m
  UNION ALL SELECT 'unmatched a', count(*) FROM r WHERE l_returnflag = 'A' AND (l_partkey, id) NOT IN (SELECT (l_partkey, a) FROM m)
  UNION ALL SELECT 'unmatched b', count(*) FROM r WHERE l_returnflag = 'R' AND (l_partkey, id) NOT IN (SELECT (l_partkey, b) FROM m))""",
    "j15_compare_by_source": """
WITH l AS (
  SELECT p_brand, 'p_retailprice' AS c, abs(p_retailprice - b) AS e, abs(b) AS m FROM (SELECT *, p_retailprice * (1 + (p_partkey % 5) * 1e-5) AS b FROM part)
  UNION ALL SELECT p_brand, 'p_size', abs(p_size - b), b FROM (SELECT *, p_size + (p_partkey % 50 = 0)::INT AS b FROM part))
SELECT p_brand, c AS "column", round(max(e), 6)::DOUBLE AS max_error, count(*) FILTER (e > 1e-5 + 1e-5 * m) AS not_close, 0::BIGINT AS unmatched FROM l GROUP BY ALL""",
    "j18_eligibility": """
SELECT o.k, CASE WHEN c_custkey IS NULL OR c_acctbal <= 0 THEN 'not listed' WHEN c_mktsegment <> 'BUILDING' THEN 'wrong device'
  WHEN c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) THEN 'absent archive' ELSE 'eligible' END AS status
FROM (SELECT DISTINCT o_custkey AS k FROM orders) o LEFT JOIN customer ON c_custkey = o.k""",
    "j16_existence_counters": """
SELECT c_mktsegment, count(*) AS rows, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing_orders,
       count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS missing_open FROM customer GROUP BY 1""",
    "j17_fan_out_once": "SELECT l_returnflag, count(*) AS rows, sum(length(p_name))::BIGINT AS work FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "j18_eligible_set": "SELECT DISTINCT o_custkey AS k, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'eligible' ELSE 'unknown' END AS status FROM orders",
    "j19_attach_or_mask": "SELECT d.doc_id, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
}
