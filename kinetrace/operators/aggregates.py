"""Counters, statistics, audits and forecast metrics. All are plain two-phase aggregates unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.operators.table_functions import prompts_by_sweep
from kinetrace.plans.shared import carried, cut, in_ranges, running_before, same

QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
STEP_THRESHOLDS = (4, 8, 12, 16, 24, 32, 48, 60)


def frame_requests(frames: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (dataset, video, frame) requests, and the same with logical datasets mapped to physical ones (aliases: logical, physical)."""
    logical = frames.select("dataset", "video", "frame").distinct()
    mapped = logical.join(aliases, logical["dataset"] == aliases["logical"], "left")
    physical = mapped.select(F.coalesce("physical", "dataset").alias("dataset"), "video", "frame").distinct()
    return logical, physical


def video_summary(requests: DataFrame, lengths: DataFrame) -> DataFrame:
    """Requested frames, first and last, and whether the last is inside the timeline (lengths: dataset, video, pts_frames)."""
    by = requests.groupBy("dataset", "video").agg(F.count(F.lit(1)).alias("requested"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    return by.join(lengths, ["dataset", "video"], "left").withColumn("inside", F.coalesce(F.col("last") < F.col("pts_frames"), F.lit(False)))


def counters(rows: DataFrame, source: str, reason: Column) -> DataFrame:
    """Total, kept and excluded rows by source, and the excluded by reason (a null reason keeps the row)."""
    tagged = rows.withColumn("_reason", reason)
    return tagged.groupBy(source, "_reason").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("_reason", "reason").withColumn("kept", F.col("reason").isNull())


def storage_estimate(units: DataFrame, bytes_each: Column) -> DataFrame:
    total = F.sum(bytes_each)
    return units.agg(F.count(F.lit(1)).alias("units"), total.alias("bytes"), (total / 2**30).alias("gib"), (total / 2**40).alias("tib"))


def episode_capacity(frames: DataFrame, intervals: DataFrame, history: int) -> DataFrame:
    """An episode's best (targets, horizon) over its intervals: the anchor is the first kept frame not before max(start, history - 1), targets are kept frames after it.

    frames: video, frame, pts (rising with frame), kept. intervals: video, start, end (half open). An interval needs two kept frames from the anchor on.

    A sweep, not a join: interval ends are sorted in among the kept frames, in ranges of (video, frame). Each end takes the
    kept frame next to it, with its rank, from what is carried over the ranges; so the work is linear in frames and intervals,
    however many frames an interval holds or intervals a frame.
    """
    point = frames.filter("kept").select("video", F.col("frame").cast("long").alias("at"), F.lit(1).alias("kind"), "pts", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    ends = F.inline(F.array(*[F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind")) for at, kind in ((F.greatest("start", F.lit(history - 1)), -1), (F.col("end"), 0))]))
    spans = intervals.select("video", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    rows = in_ranges(point.unionByName(spans.select("video", "start", "end", ends).withColumn("pts", F.lit(None).cast(frames.schema["pts"].dataType))), ["video", "at", "kind", "start", "end"])
    order = ["at", "kind", "start", "end"]
    rows = running_before(rows, ["video"], "_part", order, F.when(F.col("kind") == 1, 1).otherwise(0), "_rank")
    held = F.when(F.col("kind") == 1, F.struct("_rank", "pts"))
    rows = carried(carried(rows, ["video"], order, held, "_next", backward=True), ["video"], order, held, "_before")
    both = rows.filter("kind <> 1").groupBy("video", "start", "end").agg(F.max(F.when(F.col("kind") == -1, F.col("_next"))).alias("_a"), F.max(F.when(F.col("kind") == 0, F.col("_before"))).alias("_b"))
    by = both.select("video", (F.col("_b._rank") - F.col("_a._rank")).alias("targets"), (F.col("_b.pts") - F.col("_a.pts")).alias("horizon")).filter("targets >= 1")
    best = by.groupBy("video").agg(F.max(F.struct("targets", "horizon")).alias("_b"))
    return best.select("video", "_b.targets", "_b.horizon")


def support_matrix(episodes: DataFrame, value: str, thresholds: tuple = STEP_THRESHOLDS) -> DataFrame:
    """How many, and what percentage of at least one, reach each threshold; one pass, then unpivoted."""
    wide = episodes.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("reach")) for i, t in enumerate(thresholds)]))
    return wide.select("n", rows).withColumn("percent", 100.0 * F.col("reach") / F.greatest("n", F.lit(1)))


def reach_mask(value: Column, thresholds: tuple = STEP_THRESHOLDS) -> Column:
    """Bit i is set where the value reaches threshold i."""
    bits = [F.when(value >= t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds)]
    return sum(bits[1:], bits[0])


def quantiles(rows: DataFrame, value: str, by: str | None = None, qs: tuple = QUANTILES) -> DataFrame:
    """Exact quantiles, linear between ranks, in long form; groups without values are absent. With `by`, rows of source 'all' come too.

    Equal values of a group are counted first, then dealt into ranges of (group, value); sums by range give each value the
    ranks it covers, and only the two values around each asked rank go on. No task holds a group.
    """
    rows = rows.filter(F.col(value).isNotNull())
    groups = F.array(F.struct(F.lit(0).alias("_all"), F.col(by).cast("string").alias("source")), F.struct(F.lit(1).alias("_all"), F.lit("all").alias("source"))) if by else F.array(F.struct(F.lit(1).alias("_all"), F.lit("all").alias("source")))
    counted = rows.select(F.col(value).cast("double").alias("_v"), F.inline(groups)).groupBy("_all", "source", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = cut(counted.repartitionByRange("_all", "source", "_v").withColumn("_part", F.spark_partition_id()))  # the ranges are sampled anew if the plan runs again
    ranked = running_before(dealt, ["_all", "source"], "_part", ["_v"], F.col("_c"), "_before", "n")
    asked = F.explode(F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.struct(q.alias("q"), (q * (F.col("n") - 1)).alias("at"))))
    held = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
    near = ranked.withColumn("_a", asked).select("_all", "source", "n", "_v", "_a.q", "_a.at", held(F.floor("_a.at")).alias("_low"), held(F.ceil("_a.at")).alias("_high")).filter("_low OR _high")
    ends = near.groupBy("_all", "source", "n", "q", "at").agg(F.max(F.when(F.col("_low"), F.col("_v"))).alias("_l"), F.max(F.when(F.col("_high"), F.col("_v"))).alias("_h"))
    part = F.col("at") - F.floor("at")
    return ends.select(*(["source"] if by else []), "n", ((1 - part) * F.col("_l") + part * F.col("_h")).alias("value"), "q")


def population_moments(rows: DataFrame, axes: list[str], by: str) -> DataFrame:
    """Count, mean, population deviation, least and greatest of each axis, by group and overall (group null), in one pass of grouping sets."""
    long = rows.select(by, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes])))
    out = long.groupingSets([["axis", by], ["axis"]], "axis", by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return out.withColumnRenamed(by, "source")


def masked_mean(value: Column, mask: Column) -> Column:
    """sum(value where mask) / max(count of mask, 1)."""
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def ade_fde(errors: DataFrame, window: list[str], by: list[str], camera: tuple[str, str] | None = None) -> DataFrame:
    """Mean error over all valid steps, pooled, and mean error at each window's last valid step; windows without valid steps don't count.

    errors has step, error, valid and the columns named. The sums for pooling further are kept. camera names an error and its
    validity: camera_error is its mean over the valid steps of the windows that count.
    """
    ok = F.col("valid")
    rows = errors if camera else errors.filter("valid")
    seen = [F.sum(F.when(F.col(camera[1]), F.col(camera[0]))).alias("_cs"), F.count_if(camera[1]).alias("_cn")] if camera else []
    each = rows.groupBy(*window, *by).agg(F.sum(F.when(ok, F.col("error"))).alias("_sum"), F.count_if(ok).alias("_n"), F.max_by(F.when(ok, F.col("error")), F.when(ok, F.col("step"))).alias("_last"), *seen).filter("_n > 0")
    mean = [(F.sum("_cs") / F.greatest(F.sum("_cn"), F.lit(1))).alias("camera_error")] if camera else []
    out = each.groupBy(*by).agg(F.sum("_sum").alias("error_sum"), F.sum("_n").alias("steps"), F.sum("_last").alias("last_sum"), F.count(F.lit(1)).alias("windows"), *mean)
    return out.withColumns({"ade": F.col("error_sum") / F.col("steps"), "fde": F.col("last_sum") / F.col("windows")}).withColumn("selection", (F.col("ade") + F.col("fde")) / 2)


def macro_micro(scored: DataFrame, model: str) -> DataFrame:
    """Unweighted mean over sources that have data, and the pooled mean."""
    by = scored.groupBy(model).agg(F.avg("ade").alias("_a"), F.avg("fde").alias("_f"), (F.sum("error_sum") / F.sum("steps")).alias("_pa"), (F.sum("last_sum") / F.sum("windows")).alias("_pf"), F.sum("windows").alias("windows"))
    kinds = F.array(F.struct(F.lit("macro").alias("source"), F.col("_a").alias("ade"), F.col("_f").alias("fde")), F.struct(F.lit("micro").alias("source"), F.col("_pa").alias("ade"), F.col("_pf").alias("fde")))
    return by.select(model, F.inline(kinds), "windows").select(model, "source", "ade", "fde", "windows")


def best_of_n(errors: DataFrame, sample: str, draw: str) -> DataFrame:
    """Each sample's draw with the least mean error (the first draw in a tie), and the rule's name."""
    each = errors.filter("valid").groupBy(sample, draw).agg(F.avg("error").alias("ade"), F.max_by("error", "step").alias("fde"))
    return each.groupBy(sample).agg(F.min(F.struct("ade", draw, "fde")).alias("_b")).select(sample, f"_b.{draw}", "_b.ade", "_b.fde", F.lit("least ade").alias("rule"))


def joint_errors(joints: DataFrame, fingertips: tuple[int, ...] = (4, 8, 12, 16, 20)) -> DataFrame:
    """joint, px, py, pz, tx, ty, tz to mean distance over all joints and over fingertips, and the 90 % quantile of the displacement."""
    distance = F.sqrt(sum(((F.col(f"p{a}") - F.col(f"t{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    rows = joints.withColumn("_d", distance)
    means = rows.agg(F.avg("_d").alias("joint_error"), F.avg(F.when(F.col("joint").isin(*fingertips), F.col("_d"))).alias("fingertip_error"))
    return means.join(quantiles(rows, "_d", None, (0.9,)).select(F.col("value").alias("p90")), how="left")  # one row each


def repeat_last(joints: DataFrame, window: list[str]) -> DataFrame:
    """Each valid later joint beside where it was at the anchor (step 0), for joint_errors: how far a forecast that repeats it is off. joints: step, joint, x, y, z, valid."""
    last = joints.filter("step = 0").select(*window, "joint", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    return joints.filter("step > 0 AND valid").select(*window, "step", "joint", *[F.col(a).alias(f"t{a}") for a in "xyz"]).join(last, [*window, "joint"])


def stream_mse(pairs: DataFrame, streams: dict[str, tuple[int, int]], prediction: str, target: str) -> DataFrame:
    """Mean squared error over each stream's slice (from 1) of two arrays."""
    square = lambda a, n: F.aggregate(F.zip_with(F.slice(prediction, a, n), F.slice(target, a, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("stream"), square(a, n).alias("_s"), F.lit(n).alias("_n")) for s, (a, n) in streams.items()]))
    return pairs.select(rows).groupBy("stream").agg((F.sum("_s") / F.sum("_n")).alias("mse"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(scores: Column, k: int) -> Column:
    """Places (from 0) of the k highest scores, the lowest place first in a tie."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def topk_accuracy(hits: DataFrame) -> DataFrame:
    """Share of rows that hit; NaN if there are none."""
    return hits.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(float("nan"))).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def class_mean_recall(hits: DataFrame, by: list[str], target: str = "target") -> DataFrame:
    """Mean over the classes that occur of the share of their rows that hit."""
    each = hits.groupBy(*by, target).agg(F.avg(F.col("hit").cast("double")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*by).agg(F.avg("_r").alias("recall"), F.count(F.lit(1)).alias("classes"), F.sum("_n").alias("rows"))


def distinct_prompts(intervals: DataFrame) -> DataFrame:
    """All prompts that some segment of an episode shows: boundaries cut it into segments, and each hand shows the first listed interval that holds the segment's start.

    intervals: episode, hand, place, start, end, text; length: the episode's frames. The empty prompt is one too. A sweep over each episode's boundaries: no segment is joined with an interval.
    """
    return prompts_by_sweep(intervals).select("prompt").distinct()


def split_statistics(members: DataFrame) -> DataFrame:
    """Videos and episodes, held out and evaluated ones among them, by source. members: source, video, held_out, listed."""
    return members.groupBy("source").agg(
        F.count_distinct("video").alias("videos"), F.count(F.lit(1)).alias("episodes"), F.count_distinct(F.when(F.col("held_out"), F.col("video"))).alias("held_out_videos"),
        F.count_if("held_out").alias("held_out_episodes"), F.count_if(F.col("held_out") & F.col("listed")).alias("evaluated"),
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dependency_violations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a that go with more than one value of b."""
    return rows.groupBy(a).agg(F.count_distinct(b).alias("values")).filter("values > 1")


def domain_check(rows: DataFrame, domains: dict[str, tuple[float, float]]) -> DataFrame:
    """Least, greatest, nulls and values outside [low, high) of each column."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for c, (a, b) in domains.items()])))
    return long.groupBy("column").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if((F.col("v") < F.col("a")) | (F.col("v") >= F.col("b"))).alias("outside"))


def split_profile(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("records"), *[F.count_distinct(k).alias(f"n_{k}") for k in keys])


def coverage_report(segments: DataFrame, streams: DataFrame, wrists: DataFrame, by: str) -> DataFrame:
    """How many segments of each split have no pose stream, an anchor beyond it, a window cut short by it, a whole window, and a wrist at the anchor: either hand, any, both.

    segments: recording, anchor, last (frames) and the split. streams: recording, frames. wrists: recording, frame, hand0, hand1.
    """
    at = wrists.groupBy("recording", F.col("frame").alias("anchor")).agg(F.bool_or("hand0").alias("_0"), F.bool_or("hand1").alias("_1"))
    rows = segments.join(streams.select("recording", F.col("frames").alias("_n")), "recording", "left").join(at, ["recording", "anchor"], "left")
    here = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("_n").isNull()).alias("without_pose"), F.count_if(F.col("anchor") >= F.col("_n")).alias("anchor_beyond"), F.count_if(F.col("last") >= F.col("_n")).alias("truncated"),
        F.count_if(F.col("last") < F.col("_n")).alias("whole"), F.count_if(here("_0")).alias("hand0"), F.count_if(here("_1")).alias("hand1"), F.count_if(here("_0") | here("_1")).alias("any_hand"), F.count_if(here("_0") & here("_1")).alias("both_hands"),
    )


def temporal_bins(spans: list[tuple[float, int]], fps: float = 30.0) -> list[tuple[int, int, int, int]]:
    """(span, bin, low, high) frame ranges over the last seconds of each span, integer-truncated and evenly spaced; neighbours share a frame, ends count."""
    out = []
    for s, (length, n) in enumerate(spans):
        last = int(length * fps)
        edges = [int(last * i / n) for i in range(n + 1)]
        out += [(s, i, edges[i], edges[i + 1]) for i in range(n)]
    return out


def temporal_bin_pool(frames: DataFrame, bins: DataFrame, dims: list[str]) -> DataFrame:
    """The greatest of each dimension over each bin. frames: group, frame; bins: span, bin, low, high. A bin's frames are listed, so it is an equi-join."""
    listed = bins.withColumn("frame", F.explode(F.sequence("low", "high")))
    return frames.join(listed, "frame").groupBy("group", "span", "bin").agg(*[F.max(d).alias(d) for d in dims])


def grid_mean_pool(tokens: Column, side: int, cells: int) -> Column:
    """Mean of a side x side grid of numbers over cells x cells squares, row-major."""
    w = side // cells
    at = lambda c, k: (F.floor(c / cells) * w + F.floor(k / w)) * side + (c % cells) * w + k % w
    total = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(w * w - 1)), F.lit(0.0), lambda s, k: s + F.get(tokens, at(c, k).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda c: total(c) / (w * w))


def effective_rate(frames: DataFrame, group: str, pts: str, declared: float) -> DataFrame:
    """Frames a second of each group: one over the median step between times in order; the declared rate where there is no step.

    Times are sorted in ranges of (group, time), steps taken from the time before, also across ranges, and the median is that of `quantiles`: no task holds a group.
    """
    rows = in_ranges(frames.select(F.col(group).alias("_g"), F.col(pts).alias("_p"), F.monotonically_increasing_id().alias("_i")).filter("_p IS NOT NULL"), ["_g", "_p", "_i"])
    inner = Window.partitionBy("_g", "_part").orderBy("_p", "_i")
    last = rows.groupBy("_g", "_part").agg(F.max("_p").alias("_end"))
    ends = last.select("_g", "_part", F.lag("_end").over(Window.partitionBy("_g").orderBy("_part")).alias("_before"))
    steps = same(rows.withColumn("_own", F.lag("_p").over(inner)), ends, ["_g", "_part"]).withColumn("_s", F.col("_p") - F.coalesce("_own", "_before"))
    named = lambda g: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null"))
    median = quantiles(steps.select(named("_g").alias("_k"), "_s"), "_s", "_k", (0.5,)).filter("source <> 'all'")  # no group is called that
    groups = frames.select(F.col(group)).distinct().withColumn("_k", named(group))
    return groups.join(median.select(F.col("source").alias("_k"), "value"), "_k", "left").select(group, F.coalesce(1 / F.col("value"), F.lit(declared)).alias("rate"))


def select_best(candidates: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """The row with the least score, the first candidate in a tie."""
    rest = [c for c in candidates.columns if c not in (*by, score, order)]
    best = candidates.groupBy(*by).agg(F.min(F.struct(score, order, *rest)).alias("_b"))
    return best.select(*by, *[f"_b.{c}" for c in (score, order, *rest)])


def early_stop_scan(log: DataFrame, run: str, step: str, score: str, patience: int, min_delta: float) -> DataFrame:
    """Where each run would stop: an improvement must beat the best by min_delta; after `patience` rows without one it stops. A run's log is folded in order, in its row."""
    rows = log.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("i"), F.col(score).alias("v")))).alias("_l"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_step"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stop"))

    def fold(s: Column, x: Column) -> Column:
        better = x["v"] < s["best"] - min_delta
        stale = F.when(better, F.lit(0)).otherwise(s["stale"] + 1)
        now = F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(better, x["i"].cast("long")).otherwise(s["best_step"]).alias("best_step"), stale.alias("stale"), F.when(stale >= patience, x["i"].cast("long")).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(now)

    return rows.withColumn("_s", F.aggregate("_l", zero, fold)).select(run, "_s.best", "_s.best_step", "_s.stop")


def sum_map(rows: DataFrame, column: str) -> DataFrame:
    """Sum maps of counts key by key into one map, keys in order."""
    summed = rows.select(F.explode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return summed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(column))


def single_value_check(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each column has one value throughout."""
    wide = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values"), (F.col(c) == 1).alias("single")) for c in columns])))


def compare_runs(metrics: DataFrame, keys: list[str], run: str, old: str, new: str, value: str) -> DataFrame:
    wide = metrics.groupBy(*keys).pivot(run, [old, new]).agg(F.first(value))
    change = F.col(new) - F.col(old)
    return wide.select(*keys, F.col(old).alias("old"), F.col(new).alias("new"), change.alias("change"), (change / F.col(old)).alias("relative"))
