"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.functions import exprs as E
from kinetrace.functions import poses as P
from kinetrace.operators import pose_metrics as M
from kinetrace.plans.join_queries import moved_sql, pose_at, pose_sql, turned_sql
from kinetrace.plans.proxy import FRAMES, read, timelines


def _wide(column: str, size: int):
    """`size` numbers from a vector, going round."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(column, (i % F.size(column)).cast("int")).cast("double"))


def p1(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.regexp_replace(F.regexp_extract("url", r"//([^/?#]+)", 1), r"\.", "-"), F.lit("/Set_"), F.lower(F.regexp_extract("url", r"//[^/]*/(\w+)", 1)), F.lit("_x_ep_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".npy"))
    return read(spark, d, "pages").select("page_id", E.member_identity(name).alias("m")).select("page_id", "m.*")


def p2(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", E.mapped(F.col("n_name"), {"NATION_1": "NATION_0", "NATION_7": "NATION_5"}).alias("physical"))


def p3(spark: SparkSession, d: str) -> DataFrame:
    reason = E.exclusion_reason(F.col("l_returnflag"), F.col("l_orderkey"), ["A"], ["N"], 10000)
    return read(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def p4(spark: SparkSession, d: str) -> DataFrame:
    state = read(spark, d, "embeddings").select("vec_id", _wide("embedding", E.STATE_SIZE).alias("s"))
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("entity"), E.total(v).alias("total"), F.size(v).alias("size")) for n, v in E.entities(F.col("s"))]))
    back = E.pack_state(E.split_state(F.col("s")))
    return state.select("vec_id", (back == F.col("s")).alias("round_trip"), rows).withColumn("total", F.round("total", 4) + F.lit(0.0))


def p5(spark: SparkSession, d: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    valid = E.stream_validity(role == "user", role == "assistant", turn < 4, turn > 1)
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(valid).alias("stream", "valid"))


def p6(spark: SparkSession, d: str) -> DataFrame:
    mask = E.coordinate_mask(E.expand_mask(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get("embedding", i) > 0)))
    return read(spark, d, "embeddings").select("vec_id", F.size(mask).alias("size"), F.size(F.filter(mask, lambda x: x)).alias("kept"), F.get(mask, 9).alias("left_x"), F.get(mask, 12).alias("left_rotation"))


def p7(spark: SparkSession, d: str) -> DataFrame:
    fx, cx, cy = F.col("p_retailprice"), F.col("p_size") + 320.0, F.col("p_size") + 200.0
    w, h = F.lit(700.0), F.lit(500.0)
    kinds = {"given": E.normalized_intrinsics(fx, fx, cx, cy, w, h), "inferred": E.normalized_intrinsics(fx, fx, cx, cy), "cropped": E.normalized_intrinsics(fx, fx, cx, cy, w, h, (F.lit(10.0), F.lit(20.0), F.lit(600.0), F.lit(400.0))), "turned": E.normalized_intrinsics(fx, fx, cx, cy, w, h, clockwise=True)}
    rows = read(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()])).alias("r"))
    return rows.select("p_partkey", "r.kind", *[F.round(f"r.v.{c}", 6).alias(c) for c in ("fx", "fy", "cx", "cy")])


def p8(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d)
    start = frames.filter("frame = 0").select("video", F.col("pts").alias("t0"))
    return frames.join(start, "video").select("event_id", E.relative_time(F.col("pts"), F.col("t0")).alias("t"))


def p9(spark: SparkSession, d: str) -> DataFrame:
    frames = timelines(spark, d)
    lines = frames.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "pts"))), lambda x: x["pts"]).alias("pts"))
    t = E.frame_time(F.col("frame"), F.col("pts"), 30.0)
    return frames.select("event_id", "video", (F.col("event_id") % 90).alias("frame")).join(lines, "video").select("event_id", t.alias("t")).select("event_id", F.round("t.t", 4).alias("t"), "t.source")


def p10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", E.map_rate(F.col("l_linenumber")).alias("doubled"), E.grid_index(F.col("l_linenumber") * 2).alias("grid"))


def p11(spark: SparkSession, d: str) -> DataFrame:
    gate = E.confidence_gate(F.col("c_acctbal"), F.col("c_acctbal") / 5000)
    return read(spark, d, "customer").select("c_custkey", gate.alias("g")).select("c_custkey", "g.value", "g.valid", F.round("g.confidence", 6).alias("confidence"))


def p12(spark: SparkSession, d: str) -> DataFrame:
    said = lambda role: F.coalesce(F.min(F.when(F.col("role") == role, F.struct("turn", F.col("text").alias("t"))))["t"], F.lit(""))
    by = read(spark, d, "conversations").groupBy("conv_id").agg(said("system").alias("l"), said("user").alias("r"))
    return by.select("conv_id", E.compose_prompt(F.col("l"), F.col("r"), F.when(F.col("conv_id") % 2 == 0, "left").otherwise("right")).alias("prompt"))


def p13(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", E.safe_name(F.concat(F.lit(" -"), "p_name", F.lit("/#"), "p_brand", F.lit("! "))).alias("name"))


def p14(spark: SparkSession, d: str) -> DataFrame:
    return timelines(spark, d).groupBy(E.phase((F.col("frame") - 31) / F.lit(8.0)).alias("phase")).agg(F.count(F.lit(1)).alias("rows"))


def p15(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "embeddings")
    wrist_ok, hand_ok = F.get("embedding", 0) > 0, F.get("embedding", 1) > 0
    arrays = (_wide("embedding", 9), _wide("embedding", 18), _wide("embedding", 126))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), E.assemble_features(m, *arrays, wrist_ok, hand_ok).alias("f")) for m in ("c", "w", "h", "wh", "cw", "ch", "cwh")])).alias("r")
    return base.select("vec_id", modes).select("vec_id", "r.mode", F.size("r.f.features").alias("size"), (F.round(E.total(F.col("r.f.features")), 4) + F.lit(0.0)).alias("total"), "r.f.valid")


def p15_past_only(spark: SparkSession, d: str) -> DataFrame:
    """Validity by side; every fourth vector is the future."""
    above = lambda i: F.get("embedding", i) > 0
    arrays = (_wide("embedding", 9), _wide("embedding", 18), _wide("embedding", 126))
    made = lambda m: E.assemble_features(m, *arrays, (above(0), above(2)), (above(1), above(3)), F.col("vec_id") % 4 == 3)
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), made(m).alias("f")) for m in ("c", "w", "h", "wh", "cw", "ch", "cwh")])).alias("r")
    return read(spark, d, "embeddings").select("vec_id", modes).select("vec_id", "r.mode", F.size("r.f.features").alias("size"), (F.round(E.total(F.col("r.f.features")), 4) + F.lit(0.0)).alias("total"), "r.f.valid")


def p16(spark: SparkSession, d: str) -> DataFrame:
    v = E.token_layer_norm(F.transform("embedding", lambda x: x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.round("x", 5) + F.lit(0.0))


def p17(spark: SparkSession, d: str) -> DataFrame:
    v = E.l2_normalize(F.transform("embedding", lambda x: x.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.round("x", 5) + F.lit(0.0))


def p18(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of rows with flag R alone (the train split), applied to all."""
    items = read(spark, d, "lineitem")
    stats = items.filter("l_returnflag = 'R'").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    z = E.standardize(F.col("l_extendedprice"), F.col("m"), F.col("s"))
    rows = items.crossJoin(F.broadcast(stats)).withColumn("z", z)
    return rows.groupBy("l_returnflag").agg(F.round(F.avg("z"), 6).alias("mean"), F.round(F.stddev_pop("z"), 6).alias("std"), F.round(F.max(F.abs(E.unstandardize(F.col("z"), F.col("m"), F.col("s")) - F.col("l_extendedprice"))), 4).alias("round_trip"))


def p19(spark: SparkSession, d: str) -> DataFrame:
    """Unit quaternions from four components: to a matrix, to six numbers and back, and the angle to no rotation."""
    r = P.quaternion_to_matrix(_wide("embedding", 4))
    rows = read(spark, d, "embeddings").select("vec_id", r.alias("r")).withColumn("back", P.rot6d_decode(P.rot6d_encode(F.col("r"))))
    none = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    worst = F.array_max(F.zip_with("r", "back", lambda a, b: F.abs(a - b)))
    return rows.select("vec_id", F.round(P.geodesic_angle(F.col("r"), none), 5).alias("angle"), (worst < 1e-9).alias("round_trip"))


def a12(spark: SparkSession, d: str) -> DataFrame:
    """Pose errors of each vector against the next, by label: translation in cm, rotation in degrees; and of the wrist seen from the camera."""
    pose = lambda c, k: pose_at(F.col(c), k)
    v = read(spark, d, "embeddings").select("vec_id", "label", _wide("embedding", 64).alias("v"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t"))
    both = v.join(nxt, "vec_id").select("label", pose("v", 1).alias("ca"), pose("t", 1).alias("cb"), pose("v", 11).alias("wa"), pose("t", 11).alias("wb"))
    distance = lambda a, b: F.sqrt(E.total(F.zip_with(P.translation_of(a), P.translation_of(b), lambda x, y: (x - y) * (x - y))))
    errors = both.select("label", (distance(F.col("ca"), F.col("cb")) * 100).alias("camera_cm"), F.degrees(P.geodesic_angle(P.rotation_of(F.col("ca")), P.rotation_of(F.col("cb")))).alias("camera_deg"), P.relative_pose_errors(*map(F.col, ("ca", "wa", "cb", "wb"))).alias("w"))
    return errors.groupBy("label").agg(F.round(F.avg("camera_cm"), 4).alias("camera_cm"), F.round(F.avg("camera_deg"), 4).alias("camera_deg"), F.round(F.avg("w.translation") * 100, 4).alias("wrist_cm"), F.round(F.avg("w.rotation"), 4).alias("wrist_deg"))


def a12_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is a step that predicts the next one; quaternions from component 28 on are the 15 rotations of either hand's fingers."""
    v = read(spark, d, "embeddings").select("vec_id", "label", _wide("embedding", 64).alias("v"))
    poses = lambda c: {"camera": pose_at(c, 1), "left": pose_at(c, 11), "right": pose_at(c, 21), "left_fingers": turns(c, 28), "right_fingers": turns(c, 30)}
    turns = lambda c, k: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: P.quaternion_to_matrix(F.slice(c, i * 2 + k, F.lit(4))))
    named = lambda df, c, to: df.select("vec_id", *[x for x in ("label", "v") if to == "p"], *[p.alias(f"{to}_{n}") for n, p in poses(F.col(c)).items()])
    nxt = named(v.withColumn("vec_id", F.col("vec_id") - 1), "v", "t")
    ok = {n: F.get("v", 40 + i) > -0.1 for i, n in enumerate(("camera_ok", "left_ok", "right_ok", "left_fingers_ok", "right_fingers_ok"))}
    steps = named(v, "v", "p").join(nxt, "vec_id").withColumns(ok | {"step": F.col("vec_id") % 4 + 1, "horizon_seconds": F.col("vec_id") % 16 / F.lit(4.0)})
    return M.pose_metrics(steps, "label").withColumn("value", F.round("value", 4) + F.lit(0.0))


def p20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", E.all_finite(F.col("embedding"), 64).alias("ok"))


def p20_sample(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two history steps and one later one, of ten coordinates in two streams, cut from each vector; signs of other components make masks."""
    v = read(spark, d, "embeddings").select("vec_id", "label", _wide("embedding", 64).alias("v"))
    part = lambda k, n: F.slice("v", k, n)
    sign = lambda k, n: F.transform(part(k, n), lambda x: x > 0)
    rows = v.select(
        "vec_id", F.array(part(1, 10), F.when(F.col("label") == 0, part(11, 9)).otherwise(part(11, 10))).alias("history_state"), F.array(part(21, 10)).alias("future_state"), part(1, 2).alias("history_time"), F.transform(part(1, 1), lambda x: F.when(F.col("label") == 1, F.lit(float("inf"))).otherwise(x)).alias("future_time"),
        F.array(sign(41, 2), sign(43, 2)).alias("history_stream_mask"), F.array(sign(45, 2)).alias("future_stream_mask"), F.array(sign(47, 2)).alias("future_query_mask"),
        F.array(F.array_repeat(F.lit(False), 10), F.concat(F.array_repeat(F.get("v", 42) > 0.05, 4), F.array_repeat(F.get("v", 44) > 0, 6))).alias("history_state_mask"), F.array(F.array_repeat(F.lit(False), 10)).alias("future_state_mask"), part(1, 4).alias("intrinsics"),
    )
    checks = E.sample_checks(10, {"camera": (0, 4), "wrist": (4, 6)})
    return rows.select("vec_id", F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in checks.items()]))), ",").alias("broken"))


def p21(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.array("turn", F.length("text"))).alias("qpos"), F.collect_list("turn").alias("qvel"), F.collect_list(F.when(F.col("role") == "assistant", F.array("turn"))).alias("_a"), F.collect_list(F.array("turn")).alias("target"))
    rows = by.withColumn("actual", F.when(F.size("_a") > 1, F.col("_a")))
    return rows.select("conv_id", *[c.alias(n) for n, c in E.robot_contract({"qpos": 2, "qvel": None, "target": 1}, "actual", "target", True).items()])


def p22(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"), F.when(F.col("role") == "assistant", F.array("turn")).alias("extra"))
    out = E.pad_group(rows, "conv_id", {"words": F.lit(""), "extra": F.lit(0).cast("long")})
    return out.select("conv_id", "turn", F.size("words").alias("size"), F.size(F.filter("words", lambda w: w == "")).alias("padding"), F.array_join("partial", ",").alias("partial"))


def p23(spark: SparkSession, d: str) -> DataFrame:
    rules = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("suffix"), F.when(F.col("n_regionkey") < 3, "train").otherwise("test").alias("split")).filter("suffix <> '7'")
    rows = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("scene_"), "s_nationkey").alias("name"))
    return E.assign_split(rows, "name", rules).select("s_suppkey", "split", "matches")


def p23_prefix(spark: SparkSession, d: str) -> DataFrame:
    rules = read(spark, d, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("prefix"), F.when(F.col("n_regionkey") < 3, "train").otherwise("test").alias("split"))
    rules = rules.unionByName(rules.filter("prefix = 'P3'").withColumn("split", F.lit("val")))
    rows = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("P"), "c_nationkey", F.lit("_"), "c_custkey").alias("name"))
    return E.assign_split(rows, "name", rules, "prefix").select("c_custkey", "split", "matches")


QUERIES = {
    "p1_member_identity": p1, "p2_to_physical": p2, "p3_exclusion_reason": p3, "p4_pack_state": p4, "p5_stream_validity": p5, "p6_coordinate_mask": p6, "p7_normalize_intrinsics": p7,
    "p8_relative_time": p8, "p9_frame_time": p9, "p10_map_rate": p10, "p11_confidence_gate": p11, "p12_compose_prompt": p12, "p13_safe_name": p13, "p14_phase": p14,
    "p15_assemble_features": p15, "p15_past_only": p15_past_only, "p16_token_layer_norm": p16, "p17_l2_normalize": p17, "p18_standardize": p18, "p19_pose_expressions": p19, "a12_pose_errors": a12, "a12_pose_metrics": a12_metrics, "p20_check_finite": p20, "p20_sample_checks": p20_sample,
    "p21_robot_contract": p21, "p22_pad_group": p22, "p23_assign_split": p23, "p23_assign_by_prefix": p23_prefix,
}


def _apart(name: str, a: str, b: str) -> str:
    """SQL columns name_m, name_deg: how far translations are apart, and the angle between rotations, of a_r, a_t and b_r, b_t."""
    cell = lambda i, j: turned_sql(f"{a}_r", f"{b}_r", i, j)
    sine = " + ".join(f"power({cell(i, j)} - {cell(j, i)}, 2)" for i, j in ((2, 1), (0, 2), (1, 0)))
    return f"sqrt({' + '.join(f'power({a}_t[{i}] - {b}_t[{i}], 2)' for i in (1, 2, 3))}) AS {name}_m, degrees(atan2(sqrt({sine}) / 2, ({cell(0, 0)} + {cell(1, 1)} + {cell(2, 2)} - 1) / 2)) AS {name}_deg"


def _relative(name: str, camera: str, wrist: str) -> str:
    cells = ", ".join(turned_sql(f"{camera}_r", f"{wrist}_r", i, j) for i in range(3) for j in range(3))
    return f"[{cells}] AS {name}_r, [{', '.join(moved_sql(f'{camera}_r', f'{camera}_t', f'{wrist}_t', i) for i in range(3))}] AS {name}_t"


ORACLE = {
    "a12_pose_errors": f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.label, {pose_sql("ca", 1, "a.v")}, {pose_sql("cb", 1, "b.v")}, {pose_sql("wa", 11, "a.v")}, {pose_sql("wb", 11, "b.v")} FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
q AS MATERIALIZED (SELECT *, {_relative("ra", "ca", "wa")}, {_relative("rb", "cb", "wb")} FROM p),
d AS (SELECT label, {_apart("camera", "ca", "cb")}, {_apart("wrist", "ra", "rb")} FROM q)
SELECT label, round(avg(camera_m) * 100, 4) AS camera_cm, round(avg(camera_deg), 4) AS camera_deg, round(avg(wrist_m) * 100, 4) AS wrist_cm, round(avg(wrist_deg), 4) AS wrist_deg FROM d GROUP BY label""",
    "a12_pose_metrics": f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id, a.label, a.v, b.v AS u, {pose_sql("ca", 1, "a.v")}, {pose_sql("cb", 1, "b.v")}, {pose_sql("la", 11, "a.v")}, {pose_sql("lb", 11, "b.v")}, {pose_sql("ra", 21, "a.v")}, {pose_sql("rb", 21, "b.v")} FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
q AS MATERIALIZED (SELECT *, {_relative("sla", "ca", "la")}, {_relative("slb", "cb", "lb")}, {_relative("sra", "ca", "ra")}, {_relative("srb", "cb", "rb")} FROM p),
d AS MATERIALIZED (SELECT vec_id, label, v, u, {_apart("c", "ca", "cb")}, {_apart("l", "la", "lb")}, {_apart("r", "ra", "rb")}, {_apart("sl", "sla", "slb")}, {_apart("sr", "sra", "srb")},
  {", ".join(f"degrees(list_avg(list_transform(range(0, 15), lambda k: 2 * acos(least(1, abs(list_cosine_similarity(v[{o} + 2 * k:{o + 3} + 2 * k], u[{o} + 2 * k:{o + 3} + 2 * k]))))))) AS {n}" for n, o in (("fl", 28), ("fr", 30)))} FROM q),
m AS (SELECT label, unnest([
  {", ".join(f"{{'m': '{m}', 'v': ({x})::DOUBLE, 'ok': {ok}}}" for m, x, ok in (
    ("camera_cm", "c_m * 100", "v[41] > -0.1"), ("camera_deg", "c_deg", "v[41] > -0.1"), ("horizon_seconds", "vec_id % 16 / 4.0", "vec_id % 4 = 0"), ("wrist_cm", "l_m * 100", "v[42] > -0.1"), ("wrist_deg", "l_deg", "v[42] > -0.1"),
    ("wrist_cm", "r_m * 100", "v[43] > -0.1"), ("wrist_deg", "r_deg", "v[43] > -0.1"), ("finger_deg", "fl", "v[44] > -0.1"), ("finger_deg", "fr", "v[45] > -0.1"), ("relative_cm", "sl_m * 100", "v[41] > -0.1 AND v[42] > -0.1"),
    ("relative_deg", "sl_deg", "v[41] > -0.1 AND v[42] > -0.1"), ("relative_cm", "sr_m * 100", "v[41] > -0.1 AND v[43] > -0.1"), ("relative_deg", "sr_deg", "v[41] > -0.1 AND v[43] > -0.1")))}]) AS x FROM d)
SELECT label, x.m AS measure, round(coalesce(avg(x.v) FILTER (x.ok), 0), 4) + 0.0::DOUBLE AS value, count(*) FILTER (x.ok) AS n FROM m GROUP BY ALL""",
    "p1_member_identity": r"""
SELECT page_id, replace(regexp_extract(url, '//([^/?#]+)', 1), '.', '-') AS source, lower(regexp_extract(url, '//[^/]*/(\w+)', 1)) || '_x' AS video, page_id::INT AS episode FROM pages""",
    "p2_to_physical": "SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'NATION_0' WHEN 'NATION_7' THEN 'NATION_5' ELSE n_name END AS physical FROM nation",
    "p3_exclusion_reason": "SELECT CASE WHEN l_returnflag = 'A' THEN 'missing video' WHEN l_returnflag = 'N' AND l_orderkey >= 10000 THEN 'truncated video' END AS reason, count(*) AS rows FROM lineitem GROUP BY 1",
    "p4_pack_state": """
WITH e(entity, a, n) AS (SELECT * FROM (VALUES ('camera', 0, 9), ('left_wrist', 9, 9), ('right_wrist', 18, 9)) UNION ALL SELECT h || '_hand_finger' || k, o + k * 18, 18 FROM (VALUES ('left', 27), ('right', 117)) t(h, o), (SELECT unnest(range(0, 5)) AS k))
SELECT vec_id, true AS round_trip, entity, round(list_sum(list_transform(range(a, a + n), lambda i: embedding[(i % 64 + 1)::INT]::DOUBLE)), 4) + 0.0::DOUBLE AS total, n::INT AS size FROM embeddings, e""",
    "p5_stream_validity": """
SELECT conv_id, turn, i::INT AS stream, CASE WHEN i = 0 THEN true WHEN i % 2 = 1 THEN role = 'user' AND turn < 4 ELSE role = 'assistant' AND turn > 1 END AS valid FROM conversations, (SELECT unnest(range(0, 5)) AS i)""",
    "p6_coordinate_mask": "SELECT vec_id, 207 AS size, 3 * (embedding[2] > 0)::INT + 3 * (embedding[3] > 0)::INT AS kept, embedding[2] > 0 AS left_x, false AS left_rotation FROM embeddings",
    "p7_normalize_intrinsics": """
WITH b AS (SELECT p_partkey, p_retailprice AS f, p_size + 320.0::DOUBLE AS cx, p_size + 200.0::DOUBLE AS cy FROM part),
k AS (SELECT p_partkey, 'given' AS kind, f / 700 AS fx, f / 500 AS fy, cx / 700 AS cx, cy / 500 AS cy FROM b UNION ALL SELECT p_partkey, 'inferred', f / (2 * cx), f / (2 * cy), 0.5, 0.5 FROM b
  UNION ALL SELECT p_partkey, 'cropped', f / 600, f / 400, (cx - 10) / 600, (cy - 20) / 400 FROM b UNION ALL SELECT p_partkey, 'turned', f / 500, f / 700, (500 - cy) / 500, cx / 700 FROM b)
SELECT p_partkey, kind, round(fx, 6) AS fx, round(fy, 6) AS fy, round(cx, 6) AS cx, round(cy, 6) AS cy FROM k""",
    "p8_relative_time": f"WITH {FRAMES} SELECT f.event_id, (f.pts - a.pts)::FLOAT AS t FROM frames f JOIN frames a ON a.video = f.video AND a.frame = 0",
    "p9_frame_time": f"""
WITH {FRAMES} SELECT q.event_id, round(coalesce(f.pts, q.event_id % 90 / 30.0), 4)::DOUBLE AS t, CASE WHEN f.pts IS NULL THEN 'fallback' ELSE 'pts' END AS source
FROM frames q LEFT JOIN frames f ON f.video = q.video AND f.frame = q.event_id % 90""",
    "p10_map_rate": "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 2 AS doubled, round_even(l_linenumber * 2 * 3.75, 0)::BIGINT AS grid FROM lineitem",
    "p11_confidence_gate": """
WITH c AS (SELECT c_custkey, c_acctbal, least(greatest(c_acctbal / 5000, 0), 1) AS c FROM customer)
SELECT c_custkey, CASE WHEN c >= 0.25 THEN c_acctbal ELSE 0 END AS value, c >= 0.25 AS valid, round(c, 6) AS confidence FROM c""",
    "p12_compose_prompt": """
WITH s AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS l, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS r FROM conversations GROUP BY 1),
c AS (SELECT conv_id, CASE WHEN l <> '' THEN 'Left hand: ' || l END AS l, CASE WHEN r <> '' THEN 'Right hand: ' || r END AS r FROM s)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN concat_ws(' ', l, r) ELSE concat_ws(' ', r, l) END AS prompt FROM c""",
    "p13_safe_name": "SELECT p_partkey, trim(regexp_replace(lower(' -' || p_name || '/#' || p_brand || '! '), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part",
    "p14_phase": f"WITH {FRAMES} SELECT CASE WHEN frame <= 31 THEN 'history' WHEN frame <= 39 THEN 'gap' ELSE 'execution' END AS phase, count(*) AS rows FROM frames GROUP BY 1",
    "p15_assemble_features": """
WITH b AS (SELECT vec_id, embedding[1] > 0 AS w, embedding[2] > 0 AS h, list_sum(list_transform(range(0, 9), lambda i: embedding[i + 1]::DOUBLE)) AS cs,
  list_sum(list_transform(range(0, 18), lambda i: embedding[i + 1]::DOUBLE)) AS ws, list_sum(list_transform(range(0, 126), lambda i: embedding[i % 64 + 1]::DOUBLE)) AS hs FROM embeddings),
m(mode) AS (VALUES ('c'), ('w'), ('h'), ('wh'), ('cw'), ('ch'), ('cwh'))
SELECT vec_id, mode, 9 * contains(mode, 'c')::INT + 20 * contains(mode, 'w')::INT + 128 * contains(mode, 'h')::INT AS size,
       round(CASE WHEN contains(mode, 'c') THEN cs ELSE 0 END + CASE WHEN contains(mode, 'w') AND w THEN ws + 2 ELSE 0 END + CASE WHEN contains(mode, 'h') AND h THEN hs + 2 ELSE 0 END, 4) + 0.0::DOUBLE AS total,
       contains(mode, 'c') OR (contains(mode, 'w') AND w) OR (contains(mode, 'h') AND h) AS valid FROM b, m""",
    "p15_past_only": """
WITH s AS (SELECT vec_id, vec_id % 4 = 3 AS f, embedding[1] > 0 AS w0, embedding[3] > 0 AS w1, embedding[2] > 0 AS h0, embedding[4] > 0 AS h1, list_transform(range(0, 126), lambda i: embedding[i % 64 + 1]::DOUBLE) AS v FROM embeddings),
b AS (SELECT *, list_sum(v[1:9]) AS c, CASE WHEN w0 THEN list_sum(v[1:9]) + 1 ELSE 0 END + CASE WHEN w1 THEN list_sum(v[10:18]) + 1 ELSE 0 END AS ws, CASE WHEN h0 THEN list_sum(v[1:63]) + 1 ELSE 0 END + CASE WHEN h1 THEN list_sum(v[64:126]) + 1 ELSE 0 END AS hs FROM s),
m(mode) AS (VALUES ('c'), ('w'), ('h'), ('wh'), ('cw'), ('ch'), ('cwh')),
g AS (SELECT *, NOT f AND (contains(mode, 'c') OR (contains(mode, 'w') AND (w0 OR w1)) OR (contains(mode, 'h') AND (h0 OR h1))) AS valid FROM b, m)
SELECT vec_id, mode, 9 * contains(mode, 'c')::INT + 20 * contains(mode, 'w')::INT + 128 * contains(mode, 'h')::INT AS size,
       round(CASE WHEN valid THEN CASE WHEN contains(mode, 'c') THEN c ELSE 0 END + CASE WHEN contains(mode, 'w') THEN ws ELSE 0 END + CASE WHEN contains(mode, 'h') THEN hs ELSE 0 END ELSE 0 END, 4) + 0.0::DOUBLE AS total, valid FROM g""",
    "p16_token_layer_norm": """
WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
SELECT vec_id, i::INT AS i, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-6), 5) + 0.0::DOUBLE AS x FROM x WINDOW w AS (PARTITION BY vec_id)""",
    "p17_l2_normalize": """
WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
SELECT vec_id, i::INT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 5) + 0.0::DOUBLE AS x FROM x""",
    "p18_standardize": """
WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R')
SELECT l_returnflag, round(avg((l_extendedprice - m) / s), 6) AS mean, round(stddev_pop((l_extendedprice - m) / s), 6) AS std, 0.0::DOUBLE AS round_trip FROM lineitem, s GROUP BY 1""",
    "p19_pose_expressions": """
WITH q AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS w, sqrt(pow(embedding[2]::DOUBLE, 2) + pow(embedding[3]::DOUBLE, 2) + pow(embedding[4]::DOUBLE, 2)) AS v FROM embeddings)
SELECT vec_id, round(2 * atan2(v, w), 5) AS angle, true AS round_trip FROM q""",
    "p20_check_finite": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM embeddings",
    "p20_sample_checks": """
SELECT vec_id, array_to_string(list_filter([CASE WHEN label = 1 THEN 'future_finite' END,
  CASE WHEN v[45] > 0 AND NOT v[44] > 0 THEN 'history_coordinates_in_streams' END,
  CASE WHEN label = 0 THEN 'history_shape' END, CASE WHEN (v[45] > 0 AND NOT v[47] > 0) OR (v[46] > 0 AND NOT v[48] > 0) THEN 'supervision_is_asked' END], lambda x: x IS NOT NULL), ',') AS broken FROM (SELECT vec_id, label, embedding AS v FROM embeddings)""",
    "p21_robot_contract": """
SELECT conv_id, count(*)::INT AS length, true AS same_length, true AS sizes_ok, CASE WHEN count(*) FILTER (role = 'assistant') > 1 THEN 'actual' ELSE 'commanded' END AS pose_source FROM conversations GROUP BY 1""",
    "p22_pad_group": """
WITH w AS (SELECT conv_id, turn, role, string_split(text, ' ') AS words FROM conversations),
m AS (SELECT *, max(len(words)) OVER c AS m, count(*) FILTER (role = 'assistant') OVER c AS a, count(*) OVER c AS n FROM w WINDOW c AS (PARTITION BY conv_id))
SELECT conv_id, turn, m::INT AS size, (m - len(words) + len(list_filter(words, lambda x: x = '')))::INT AS padding, CASE WHEN a > 0 AND a < n THEN 'extra' ELSE '' END AS partial FROM m""",
    "p23_assign_split": """
SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN NULL WHEN n_regionkey < 3 THEN 'train' ELSE 'test' END AS split, (n_nationkey IS NOT NULL)::BIGINT AS matches
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey <> 7""",
    "p23_assign_by_prefix": """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL WHEN n_regionkey < 3 THEN 'train' WHEN n_regionkey IS NOT NULL THEN 'test' END AS split, CASE WHEN c_nationkey = 3 THEN 2 WHEN n_nationkey IS NULL THEN 0 ELSE 1 END::BIGINT AS matches
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
}
