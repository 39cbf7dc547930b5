"""Column functions: identities, states and masks, times, text, vectors. All of them stay inside Spark's expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.matrices import bound

#: The state vector: stream, first place (from 1), length.
STREAMS = (("camera", 1, 9), ("left_wrist", 10, 9), ("right_wrist", 19, 9), ("left_hand", 28, 90), ("right_hand", 118, 90))
STATE_SIZE = 207
#: Five finger chains of 18 numbers in each hand.
CHAIN = 18


def member_identity(name: Column, pattern: str = r"^(?:.*/)?([^/]+)/(?:[A-Za-z0-9]+_)?([^/]+)_ep_(\d+)\.npy$") -> Column:
    """(source, video, episode) of a member name; raises on a malformed one."""
    part = lambda k: F.regexp_extract(name, pattern, k)
    bad = F.raise_error(F.concat(F.lit("malformed member: "), name)).cast("struct<source:string,video:string,episode:int>")
    return F.when(name.rlike(pattern), F.struct(part(1).alias("source"), part(2).alias("video"), part(3).cast("int").alias("episode"))).otherwise(bad)


def mapped(value: Column, table: dict[str, str]) -> Column:
    """A literal map that falls back to the value itself."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(entries, value), value)


def exclusion_reason(video: Column, last_frame: Column, missing: list[str], truncated: list[str], first_lost: int = 15788) -> Column:
    """Missing videos first; of truncated ones, what reaches the lost part."""
    return F.when(video.isin(*missing), "missing video").when(video.isin(*truncated) & (last_frame >= first_lost), "truncated video")


def pack_state(streams: dict[str, Column]) -> Column:
    return F.concat(*[streams[name] for name, _, _ in STREAMS])


def split_state(state: Column) -> dict[str, Column]:
    return {name: F.slice(state, at, n) for name, at, n in STREAMS}


def expand_mask(stream_valid: Column) -> Column:
    """One flag a stream, in order, to one a coordinate."""
    return F.concat(*[F.array_repeat(F.get(stream_valid, i), n) for i, (_, _, n) in enumerate(STREAMS)])


def entities(state: Column) -> list[tuple[str, Column]]:
    """The thirteen entities: camera, wrists, five finger chains a hand."""
    s = split_state(state)
    hands = [(f"{h}_finger{k}", F.slice(s[h], k * CHAIN + 1, CHAIN)) for h in ("left_hand", "right_hand") for k in range(5)]
    return [("camera", s["camera"]), ("left_wrist", s["left_wrist"]), ("right_wrist", s["right_wrist"]), *hands]


def stream_validity(left_tracked: Column, right_tracked: Column, left_inside: Column, right_inside: Column, left_policy: str = "as_stored") -> Column:
    left = F.coalesce(left_tracked & left_inside, F.lit(False)) if left_policy == "as_stored" else F.lit(False)
    right = F.coalesce(right_tracked & right_inside, F.lit(False))
    return F.array(F.lit(True), left, right, left, right)


def coordinate_mask(mask: Column, target: str = "xyz") -> Column:
    """Of a coordinate mask, for an xyz target, only the first three coordinates of each wrist; nothing is switched on."""
    if target != "xyz":
        return mask
    wrists = [at for name, at, _ in STREAMS if name.endswith("wrist")]
    keep = F.transform(F.sequence(F.lit(1), F.lit(STATE_SIZE)), lambda i: reduce(lambda a, b: a | b, [(i >= w) & (i < w + 3) for w in wrists]))
    return F.zip_with(mask, keep, lambda a, b: a & b)


def normalized_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column | None = None, height: Column | None = None, crop: tuple[Column, Column, Column, Column] | None = None, clockwise: bool = False) -> Column:
    """fx, fy, cx, cy over the canvas, and where the canvas is from: given, cropped (x, y, w, h), or inferred as twice the centre. A turn clockwise swaps the axes."""
    w, h, kind = (2 * cx, 2 * cy, "inferred") if width is None or height is None else (width, height, "given")
    if crop:
        cx, cy, w, h, kind = cx - crop[0], cy - crop[1], crop[2], crop[3], "cropped"
    if clockwise:
        fx, fy, cx, cy, w, h = fy, fx, h - cy, cx, h, w
    return F.struct((fx / w).alias("fx"), (fy / h).alias("fy"), (cx / w).alias("cx"), (cy / h).alias("cy"), F.lit(kind).alias("canvas"))


def relative_time(t: Column, anchor: Column) -> Column:
    """Subtracted in double precision, then narrowed."""
    return (t - anchor).cast("float")


def frame_time(frame: Column, pts: Column, fps: float | None) -> Column:
    """(seconds, source): from the pts array, else frame / fps if a rate is given, else an error."""
    from_pts = F.get(pts, frame.cast("int"))
    if fps is None:
        return F.when(from_pts.isNotNull(), F.struct(from_pts.alias("t"), F.lit("pts").alias("source"))).otherwise(F.raise_error(F.lit("no time for frame")).cast("struct<t:double,source:string>"))
    return F.struct(F.coalesce(from_pts, frame / F.lit(fps)).alias("t"), F.when(from_pts.isNotNull(), "pts").otherwise("fallback").alias("source"))


def map_rate(frame: Column, factor: int = 2) -> Column:
    return frame * factor


def grid_index(step: Column, fps: float = 30.0, rate: float = 8.0) -> Column:
    """The frame of a step of a slower grid; halves go to the even frame."""
    return F.bround(step * F.lit(fps / rate)).cast("long")


def confidence_gate(value: Column, confidence: Column, threshold: float = 0.25) -> Column:
    c = F.coalesce(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.struct(F.when(c >= threshold, value).otherwise(F.lit(0.0)).alias("value"), (c >= threshold).alias("valid"), c.alias("confidence"))


def compose_prompt(left: Column, right: Column, primary: Column) -> Column:
    """The primary hand's clause first; empty if there is none."""
    l, r = F.when(left != "", F.concat(F.lit("Left hand: "), left)), F.when(right != "", F.concat(F.lit("Right hand: "), right))  # noqa: E741
    return F.when(primary == "left", F.concat_ws(" ", l, r)).otherwise(F.concat_ws(" ", r, l))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def phase(t: Column, gap: float = 1.0) -> Column:
    return F.when(t <= 0, "history").when(t <= gap, "gap").otherwise("execution")


def assemble_features(mode: str, camera: Column, wrists: Column, hands: Column, wrist_valid: Column | tuple, hand_valid: Column | tuple, future: Column | None = None) -> Column:
    """(features, valid) for a subset: c(amera) 9, w(rists) 18 + 2 flags, h(ands) 126 + 2 flags, or several. Validity is of both sides, or a (left, right) pair.

    Invalid parts are zero, and so are components that aren't numbers. With the camera a row is valid if its camera is finite;
    without it a row needs a valid wrist or hand among the parts asked for. future: the past-only control, in which rows for
    which it is true aren't valid. A row that isn't valid is zero throughout.
    """
    sides = lambda ok: ok if isinstance(ok, tuple) else (ok, ok)
    finite = lambda x: F.transform(x, lambda v: F.nanvl(v, F.lit(0.0)))
    zeroed = lambda x, ok, n: F.concat(*[F.when(side, F.slice(x, 1 + n * i, n)).otherwise(F.array_repeat(F.lit(0.0), n)) for i, side in enumerate(sides(ok))])
    flags = lambda ok: F.array(*[side.cast("double") for side in sides(ok)])
    parts = {"c": [finite(camera)], "w": [finite(zeroed(wrists, wrist_valid, 9)), flags(wrist_valid)], "h": [finite(zeroed(hands, hand_valid, 63)), flags(hand_valid)]}
    some = [side for m, ok in (("w", wrist_valid), ("h", hand_valid)) if m in mode for side in sides(ok)]
    valid = all_finite(camera, 9) if "c" in mode else reduce(lambda a, b: a | b, some)
    valid = valid & ~future if future is not None else valid
    features = F.transform(F.concat(*[p for m in mode for p in parts[m]]), lambda x: F.when(valid, x).otherwise(0.0))
    return F.struct(features.alias("features"), valid.alias("valid"))


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def token_layer_norm(vector: Column, eps: float = 1e-6) -> Column:
    """Zero mean and unit population variance. Mean and scale are bound: inside a lambda they would be worked out anew for each component."""
    centred = bound(vector, lambda v: bound(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean)))
    scale = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + eps)
    return bound(centred, lambda c: bound(scale(c), lambda s: F.transform(c, lambda x: x / s)))


def l2_normalize(vector: Column) -> Column:
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return bound(vector, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def standardize(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def unstandardize(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def all_finite(vector: Column, size: int | None = None) -> Column:
    """No null, NaN or infinite component, and the right length."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(vector) == size) if size is not None else ok, F.lit(False))


def sample_checks(width: int, streams: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Rules of a training sample, each true where it holds; a null part breaks its rules.

    For p in history, future: p_state (rows of `width` numbers), p_time, p_stream_mask (rows of a boolean a stream), p_state_mask
    (as p_state, booleans); future_query_mask (as future_stream_mask): streams that are asked for; intrinsics (4 numbers).
    streams: first coordinate (from 0) and size of each.
    """
    n = len(streams)
    shaped = lambda c, like, size: (F.size(c) == F.size(like)) & F.forall(c, lambda r: F.size(r) == size)
    inside = lambda mask, limit: F.forall(F.flatten(F.zip_with(mask, limit, lambda a, b: F.zip_with(a, b, lambda x, y: ~x | y))), lambda x: x)
    widened = lambda m: F.transform(m, lambda row: F.concat(*[F.array_repeat(F.get(row, i), size) for i, (_, size) in enumerate(sorted(streams.values()))]))
    out = {}
    for p in ("history", "future"):
        out[f"{p}_shape"] = F.forall(f"{p}_state", lambda r: F.size(r) == width) & (F.size(f"{p}_time") == F.size(f"{p}_state"))
        out[f"{p}_mask_shape"] = shaped(f"{p}_stream_mask", f"{p}_state", n) & shaped(f"{p}_state_mask", f"{p}_state", width)
        out[f"{p}_coordinates_in_streams"] = inside(F.col(f"{p}_state_mask"), widened(F.col(f"{p}_stream_mask")))
        out[f"{p}_finite"] = F.forall(f"{p}_state", lambda r: all_finite(r)) & all_finite(F.col(f"{p}_time"))
    out["supervision_is_asked"] = inside(F.col("future_stream_mask"), F.col("future_query_mask"))
    out["intrinsics"] = F.size("intrinsics") == 4
    return {name: F.coalesce(ok, F.lit(False)) for name, ok in out.items()}


def visual_checks(text_size: int, fingertips: int = 30, joints: int = 126, channels: int = 3) -> dict[str, Column]:
    """Rules of a training sample's optional parts, each true where the part is absent (null) or fits history_time or future_time.

    context_image_shapes: (channels, height, width) of an image a history step, all alike; context_visual_features,
    future_visual_latents: a row of numbers a step, all of one length; context_text_features: `text_size` numbers;
    p_fingertips and p_hand_joints_local: `fingertips` (2 x 5 x 3) and `joints` (2 x 21 x 3) numbers a step.
    """
    steps = lambda c, p: F.size(c) == F.size(f"{p}_time")
    wide = lambda c, n: F.forall(c, lambda r: F.size(r) == n)
    even = lambda c: wide(c, F.size(F.get(c, 0)))
    shapes = "context_image_shapes"
    out = {
        "context_images": (shapes, steps(shapes, "history") & wide(shapes, F.lit(3)) & F.forall(shapes, lambda s: (F.get(s, 0) == channels) & (s == F.get(shapes, 0)))),
        "context_visual_features": ("context_visual_features", steps("context_visual_features", "history") & even("context_visual_features")),
        "context_text_features": ("context_text_features", F.size("context_text_features") == text_size),
        "future_visual_latents": ("future_visual_latents", steps("future_visual_latents", "future") & even("future_visual_latents")),
    }
    for p in ("history", "future"):
        out[f"{p}_fingertips"] = (f"{p}_fingertips", steps(f"{p}_fingertips", p) & wide(f"{p}_fingertips", F.lit(fingertips)))
        out[f"{p}_hand_joints_local"] = (f"{p}_hand_joints_local", steps(f"{p}_hand_joints_local", p) & wide(f"{p}_hand_joints_local", F.lit(joints)))
    return {name: F.col(c).isNull() | F.coalesce(ok, F.lit(False)) for name, (c, ok) in out.items()}


def feature_record_checks() -> dict[str, Column]:
    """Rules of an episode's feature record, each true where it holds; a null part breaks its rule.

    annotation_member (an .npy in a folder), annotation_sha256 and extractor_id (64 lower-case hexadecimal digits), dataset_name,
    video_name, frame_ids (not empty, not negative, rising), frame_times_seconds (finite, rising), pooled_features (frames x
    tokens x numbers, finite), valid_mask (all true: a record is whole or not written).
    """
    rising = lambda c: F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i) > F.get(c, i - 1))
    rises = lambda c: F.when(F.size(c) > 1, rising(c)).otherwise(F.lit(True))
    frames = F.size("frame_ids")
    first = F.get("pooled_features", 0)
    even = F.forall("pooled_features", lambda t: (F.size(t) == F.size(first)) & F.forall(t, lambda v: (F.size(v) == F.size(F.get(first, 0))) & (F.size(v) > 0) & all_finite(v)))
    out = {
        "member": F.col("annotation_member").rlike(r"^[^/]+(/[^/]+)*\.npy$"),
        "digests": F.col("annotation_sha256").rlike("^[0-9a-f]{64}$") & F.col("extractor_id").rlike("^[0-9a-f]{64}$"),
        "names": (F.col("dataset_name") != "") & (F.col("video_name") != ""),
        "frame_ids": (frames > 0) & F.forall("frame_ids", lambda x: x >= 0) & rises("frame_ids"),
        "times": (F.size("frame_times_seconds") == frames) & all_finite(F.col("frame_times_seconds")) & rises("frame_times_seconds"),
        "features": (F.size("pooled_features") == frames) & (F.size(first) > 0) & even,
        "valid": (F.size("valid_mask") == frames) & F.forall("valid_mask", lambda x: x),
    }
    return {name: F.coalesce(ok, F.lit(False)) for name, ok in out.items()}


def robot_contract(columns: dict[str, int | None], actual: str, commanded: str, allow_commanded: bool) -> dict[str, Column]:
    """Column checks of a robot episode: arrays of one length, fixed sizes inside, and which end effector pose is used."""
    first = next(iter(columns))
    length = F.size(first)
    lengths = reduce(lambda a, b: a & b, [F.size(c) == length for c in columns])
    wide = lambda n: lambda x: F.size(x) == n
    widths = reduce(lambda a, b: a & b, [F.forall(c, wide(n)) for c, n in columns.items() if n], F.lit(True))
    pose = F.when(F.col(actual).isNotNull(), "actual").when(F.col(commanded).isNotNull() & F.lit(allow_commanded), "commanded")
    return {"length": length, "same_length": F.coalesce(lengths, F.lit(False)), "sizes_ok": F.coalesce(widths, F.lit(False)), "pose_source": pose}


def pad_group(rows: DataFrame, key: str, arrays: dict[str, Column]) -> DataFrame:
    """Pad arrays to the longest of their group with the value given; `partial` lists columns that only some rows of a group have."""
    whole = Window.partitionBy(key)
    out = rows.withColumns({f"_m_{c}": F.max(F.size(c)).over(whole) for c in arrays} | {f"_n_{c}": F.count(c).over(whole) for c in arrays} | {"_all": F.count(F.lit(1)).over(whole)})
    partial = F.array_compact(F.array(*[F.when((F.col(f"_n_{c}") > 0) & (F.col(f"_n_{c}") < F.col("_all")), F.lit(c)) for c in arrays]))
    padded = {c: F.concat(c, F.array_repeat(v, (F.col(f"_m_{c}") - F.size(c)).cast("int"))) for c, v in arrays.items()}
    return out.withColumn("partial", partial).withColumns(padded).drop("_all", *[f"_{x}_{c}" for x in "mn" for c in arrays])


def assign_split(rows: DataFrame, name: str, rules: DataFrame, by: str = "suffix") -> DataFrame:
    """The split of a name by its part after the last underscore (by: suffix) or before the first (prefix); `matches` other than 1 is an error to report. rules: that part, split (a small table)."""
    known = rules.groupBy(by).agg(F.count(F.lit(1)).alias("matches"), F.min("split").alias("split"))
    joined = rows.withColumn(by, F.substring_index(name, "_", -1 if by == "suffix" else 1)).join(known, by, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.withColumn("split", F.when(F.col("matches") == 1, F.col("split")))
