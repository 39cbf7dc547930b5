"""Window construction and window functions over timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.plans.shared import running_before


def check_monotonic(frames: DataFrame, video: str = "video", frame: str = "frame", pts: str = "pts") -> DataFrame:
    """One row a video: rows, non-finite values, steps that don't rise, and whether the timeline is good."""
    step = F.col(pts) - F.lag(pts).over(Window.partitionBy(video).orderBy(frame))
    rows = frames.withColumn("_step", step).withColumn("_bad", F.isnan(pts) | (F.abs(F.col(pts)) == float("inf")) | F.col(pts).isNull())
    out = rows.groupBy(video).agg(F.count(F.lit(1)).alias("frames"), F.count_if("_bad").alias("not_finite"), F.count_if(F.col("_step") <= 0).alias("not_rising"))
    return out.withColumn("valid", (F.col("frames") >= 2) & (F.col("not_finite") == 0) & (F.col("not_rising") == 0))


def repair_duplicates(frames: DataFrame, tick: float, video: str = "video", frame: str = "frame", pts: str = "pts") -> DataFrame:
    """The n-th repeat of a time becomes time + n * tick; `clash` marks a repair that reaches the next distinct time, or a time that goes back."""
    same = Window.partitionBy(video, pts).orderBy(frame)
    order = Window.partitionBy(video).orderBy(frame)
    nth = F.row_number().over(same) - 1
    rows = frames.withColumn("_nth", nth).withColumn("_before", F.lag(pts).over(order))
    distinct = frames.select(video, pts).distinct().withColumn("_next", F.lead(pts).over(Window.partitionBy(video).orderBy(pts)))
    rows = rows.join(distinct, [video, pts]).withColumn("repaired", F.col(pts) + F.col("_nth") * tick)
    clash = (F.col("repaired") >= F.col("_next")) & (F.col("_nth") > 0) | (F.col(pts) < F.col("_before"))
    return rows.withColumn("clash", F.coalesce(clash, F.lit(False))).drop("_nth", "_before", "_next")


def window_starts(length: Column, history: int, future: int, stride: int | None = None, tail: bool = True) -> Column:
    """Starts 0, stride, .. of windows of exactly history + future steps, and the end-aligned one if it is missed; none if too short."""
    last = (length - (history + future)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride or future))
    starts = F.array_union(starts, F.array(last)) if tail else starts
    return F.when(last >= 0, starts).otherwise(F.array().cast("array<int>"))


def make_windows(lengths: DataFrame, history: int = 6, future: int = 16, stride: int | None = None, tail: bool = True, fps: float = 30.0, length: str = "length") -> DataFrame:
    """One row a window: start, anchor, frame indices and times relative to the anchor."""
    out = lengths.withColumn("start", F.explode(window_starts(F.col(length), history, future, stride, tail)))
    steps = lambda a, n, f: F.transform(F.sequence(F.lit(a), F.lit(a + n - 1)), f)
    return out.withColumns({
        "anchor_index": F.col("start") + history - 1,
        "history_indices": steps(0, history, lambda i: F.col("start") + i), "future_indices": steps(history, future, lambda i: F.col("start") + i),
        "history_time_seconds": steps(1 - history, history, lambda i: i / F.lit(fps)), "future_time_seconds": steps(1, future, lambda i: i / F.lit(fps)),
    })


def window_frames(windows: DataFrame, frames: DataFrame, history: int = 6, future: int = 16) -> DataFrame:
    """Windows in long form: one row a step (step 0 is the anchor), with the frame's columns; equi-join on (video, frame)."""
    steps = windows.select("video", "start", F.explode(F.sequence(F.lit(1 - history), F.lit(future))).alias("step"))
    return steps.withColumn("frame", F.col("start") + history - 1 + F.col("step")).join(frames, ["video", "frame"])


def complete_windows(starts: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Starts whose `size` frames exist and are all valid, and the others: complete says which. frames has video, frame, valid."""
    ahead = Window.partitionBy("video").orderBy("frame").rowsBetween(0, size - 1)
    good = frames.select("video", F.col("frame").alias("start"), (F.count_if("valid").over(ahead) == size).alias("complete"))
    return starts.join(good, ["video", "start"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def native_anchors(frames: DataFrame, history: int, future: int) -> DataFrame:
    """Anchors inside an interval: kept, with history - 1 earlier frames and at least `future` kept later ones. frames has video, interval, frame, kept."""
    later = Window.partitionBy("video", "interval").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("targets", F.coalesce(F.count_if("kept").over(later), F.lit(0))).filter(F.col("kept") & (F.col("frame") >= history - 1) & (F.col("targets") >= future))


def spread_indices(indices: Column, count: Column | int) -> Column:
    """`count` of an array's values, at places floor(i * (n - 1) / (count - 1)); one alone is the last."""
    k = count if isinstance(count, Column) else F.lit(count)
    at = lambda i: F.floor(i * (F.size(indices) - 1) / F.greatest(k - 1, F.lit(1))).cast("int")
    return F.when(k == 1, F.slice(indices, -1, 1)).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get(indices, at(i))))


def hex_draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, from a SHA-256, so that other engines repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def sample_window(anchors: DataFrame, seed: int, core: tuple[int, ...] = (8, 16), rare: int = 24, rare_share: float = 0.1) -> DataFrame:
    """One window an episode: a target count (core, or the rare one by chance or where no core one fits), and one anchor that has it.

    anchors has video, frame, targets (kept later frames). Draws are hashes of (seed, video), so any order of work gives the same picks.
    """
    support = anchors.groupBy("video").agg(F.max("targets").alias("_most"))
    fits = F.filter(F.array(*[F.lit(k) for k in core]), lambda k: k <= F.col("_most"))
    pick = F.get(fits, F.floor(hex_draw(seed + 1, "video") * F.size(fits)).cast("int"))
    rare_now = ((hex_draw(seed, "video") < rare_share) | (F.size(fits) == 0)) & (F.col("_most") >= rare)
    chosen = support.select("video", F.when(rare_now, F.lit(rare)).when(F.size(fits) > 0, pick).alias("target_count")).filter("target_count IS NOT NULL")
    able = anchors.join(chosen, "video").filter("targets >= target_count")
    place = F.row_number().over(Window.partitionBy("video").orderBy(hex_draw(seed + 2, "video", "frame"), "frame"))
    return able.withColumn("_place", place).filter("_place = 1").select("video", F.col("frame").alias("anchor"), "target_count")


def window_targets(picks: DataFrame, frames: DataFrame, seed: int, history: int = 6, consecutive: float = 0.5) -> DataFrame:
    """The frames of sampled windows: history up to the anchor, and target_count kept later frames of the anchor's interval.

    By a draw on (seed, video) the targets are the next ones, or are spread over all that the interval still has. picks:
    video, anchor, target_count. frames: video, interval, frame, kept. An interval's later frames are gathered in a row: an
    action's length bounds them.
    """
    at = picks.join(frames.select("video", "interval", F.col("frame").alias("anchor")), ["video", "anchor"])
    later = at.join(frames.filter("kept").select("video", "interval", "frame"), ["video", "interval"]).filter("frame > anchor")
    rows = later.groupBy("video", "interval", "anchor", "target_count").agg(F.array_sort(F.collect_list("frame")).alias("_f")).filter(F.size("_f") >= F.col("target_count"))
    mode = F.when(hex_draw(seed + 3, "video") < consecutive, "consecutive").otherwise("spread")
    rows = rows.withColumns({"mode": mode, "history": F.sequence(F.col("anchor") - (history - 1), F.col("anchor"))})
    return rows.withColumn("targets", F.when(F.col("mode") == "consecutive", F.slice("_f", F.lit(1), F.col("target_count"))).otherwise(spread_indices(F.col("_f"), F.col("target_count")))).drop("_f")


def sample_start(index: Column, last_start: Column) -> Column:
    return F.pmod(index * 104729, last_start + 1)


def context_indices(anchor: Column, size: int = 181) -> Column:
    """The last `size` frames up to the anchor; frame 0 repeats where there are fewer."""
    return F.transform(F.sequence(anchor - (size - 1), anchor), lambda x: F.greatest(x, F.lit(0)))


def oracle_window(segments: DataFrame, stream_frames: Column, fps: float = 30.0, rate: float = 8.0, history: int = 32, gap: int = 8, execution: int = 8) -> DataFrame:
    """Steps at `rate` around each segment's start: history up to the anchor, a gap, then the segment itself, with the frame and whether it is valid.

    segments has start, end; the anchor is start - fps. Frames round half to even; history stops at frame 0; execution frames
    stop at the segment's end, and are not valid beyond it; nothing is valid if the anchor is beyond the stream.
    """
    steps = segments.withColumn("step", F.explode(F.sequence(F.lit(1 - history), F.lit(gap + execution))))
    exact = F.col("start") - F.lit(int(fps)) + F.bround(F.col("step") * F.lit(fps / rate))
    frame = F.when(F.col("step") <= 0, F.greatest(exact, F.lit(0))).otherwise(F.least(exact, F.col("end")))
    phase = F.when(F.col("step") <= 0, "history").when(F.col("step") <= gap, "gap").otherwise("execution")
    valid = (F.col("start") - F.lit(int(fps)) < stream_frames) & ((F.col("step") <= gap) | (exact <= F.col("end"))) & (frame < stream_frames)
    return steps.withColumns({"phase": phase, "frame": frame.cast("long"), "valid": valid})


def velocity(steps: DataFrame, group: list[str], least_step: float = 1e-4, from_history: bool = False) -> DataFrame:
    """Difference to the step before over max(dt, least_step), among valid steps; the first valid step has none. steps has step, time, value, valid.

    from_history: steps <= 0 are history, whose times end at 0. Only later steps have a velocity, the first of them from the
    last valid point of history over its own time.
    """
    order = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(F.when(F.col("valid"), F.struct("step", "time", "value")), ignorenulls=True).over(order)
    since = F.when(F.lit(from_history) & (F.col("_was.step") <= 0), F.lit(0.0)).otherwise(F.col("_was.time"))
    speed = (F.col("value") - F.col("_was.value")) / F.greatest(F.col("time") - since, F.lit(least_step))
    asked = F.col("valid") & (F.col("step") > 0) if from_history else F.col("valid")
    return steps.withColumn("_was", was).withColumn("velocity", F.when(asked, speed)).drop("_was")


def last_valid_step(steps: DataFrame, group: list[str]) -> DataFrame:
    return steps.filter("valid").groupBy(*group).agg(F.max_by("value", "step").alias("value"), F.max("step").alias("step"))


def horizon_weighted_error(steps: DataFrame, group: list[str], power: float) -> DataFrame:
    """Mean error weighted by (time / last valid time) ** power, clamped to [0, 1]. steps has time, error, valid."""
    last = F.max(F.when(F.col("valid"), F.col("time"))).over(Window.partitionBy(*group))
    weight = F.pow(F.least(F.greatest(F.col("time") / F.col("_last"), F.lit(0.0)), F.lit(1.0)), F.lit(power))
    rows = steps.withColumn("_last", last).filter("valid").withColumn("_w", weight)
    return rows.groupBy(*group).agg((F.sum(F.col("_w") * F.col("error")) / F.sum("_w")).alias("weighted_error"))


def trivial_forecasts(long: DataFrame) -> DataFrame:
    """Window steps with the value at the anchor, and two predictions for each later step: repeat it, or go on at the last velocity."""
    window = Window.partitionBy("video", "start")
    at = lambda s: F.max(F.when(F.col("step") == s, F.col("value"))).over(window)
    rows = long.withColumns({"_now": at(0), "_was": at(-1), "anchor_type": F.max(F.when(F.col("step") == 0, F.col("event_type"))).over(window)})
    future = rows.filter("step > 0").withColumns({"persistence": F.col("_now"), "constant_velocity": F.col("_now") + F.col("step") * (F.col("_now") - F.col("_was"))})
    return future.withColumn("relative", F.col("value") - F.col("_now")).drop("_now", "_was")


def moving_average(rows: DataFrame, group: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Trailing mean; null until there are `width` rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("moving_average", F.when(F.row_number().over(w) >= width, F.avg(value).over(w.rowsBetween(1 - width, 0))))


def stable_rank(seed: str, namespace: Column, key: Column) -> Column:
    """Hex SHA-256 of seed, namespace and key with NUL between; its order is the order of the bytes."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), namespace.cast("string"), key.cast("string")), 256)


def holdout_groups(groups: DataFrame, seed: str, min_groups: int, target_rows: int) -> DataFrame:
    """(source, group, rows): for each source the shortest prefix in stable rank order with enough groups and enough rows; `enough` says whether there is one.

    The first digits of the rank deal a source into buckets that rise with it, so that few sources make no long windows.
    """
    ranked = groups.withColumn("_rank", stable_rank(seed, F.col("source"), F.col("group"))).withColumn("_bucket", F.substring("_rank", 1, 3))
    ranked = running_before(ranked, ["source"], "_bucket", ["_rank"], F.lit(1), "_n", "_groups")
    ranked = running_before(ranked, ["source"], "_bucket", ["_rank"], F.col("rows"), "_rows", "_all")
    enough = (F.col("_groups") >= min_groups) & (F.col("_all") >= target_rows)
    return ranked.withColumn("enough", enough).filter((F.col("_n") < min_groups) | (F.col("_rows") < target_rows)).drop("_n", "_rows", "_rank", "_bucket", "_groups", "_all")


def union_over_aliases(chosen: DataFrame, aliases: DataFrame) -> DataFrame:
    """Held-out groups of physical sources: one that is chosen for any logical source is held out for all that share its physical one. aliases: logical, physical."""
    mapped = chosen.join(aliases, F.col("source") == F.col("logical"), "left").select(F.coalesce("physical", "source").alias("physical"), "group", "source")
    return mapped.groupBy("physical", "group").agg(F.count_distinct("source").alias("sources"))
