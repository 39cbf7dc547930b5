"""Joins of timelines, features, intervals and splits. Every one is an equi-join on an entity key; ranges and tolerances are residuals inside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.matrices import IDENTITY, matmul, rigid_inverse
from kinetrace.operators.aggregates import quantiles
from kinetrace.plans.shared import carried, in_ranges


def attach_pts(frames: DataFrame, timelines: DataFrame, keys: list[str]) -> DataFrame:
    """Frame ids to seconds by place in the video's pts array; `pts_status` is ok, missing video or out of range."""
    joined = frames.join(timelines.select(*keys, F.col("pts").alias("_pts")), keys, "left")
    inside = (F.col("frame") >= 0) & (F.col("frame") < F.size("_pts"))
    status = F.when(F.col("_pts").isNull(), "missing video").when(~inside, "out of range").otherwise("ok")
    return joined.withColumns({"pts": F.when(inside, F.get("_pts", F.col("frame").cast("int"))), "pts_status": status}).drop("_pts")


def attach_features(rows: DataFrame, features: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exact match on keys; returns (rows with features, rows without any)."""
    return rows.join(features, keys), rows.join(features.select(*keys), keys, "left_anti")


def attach_sample_features(samples: DataFrame, history: DataFrame, future: DataFrame, splits: list[str], strict: bool = False) -> DataFrame:
    """History features for every sample that has them, future ones only in the listed splits. strict: a feature key that repeats, or a sample without history, is an error."""
    if strict:
        for name, features in (("history", history), ("future", future)):
            if not features.groupBy("sample_id").count().filter("count > 1").isEmpty():
                raise ValueError(f"{name} features have more than one row for a sample")
        if not samples.join(history, "sample_id", "left_anti").isEmpty():
            raise ValueError("samples without history features")
    with_history = samples.join(history, "sample_id")
    return with_history.join(future.withColumn("_s", F.lit(True)), "sample_id", "left").withColumns({c: F.when(F.col("split").isin(*splits), F.col(c)) for c in future.columns if c != "sample_id"}).drop("_s")


def align_one_to_one(left: DataFrame, right: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """One row a key of either side: on which sides it is, and whether each column agrees."""
    a = left.select(F.col(key).alias("_lk"), *[F.col(c).alias(f"_l_{c}") for c in equal])
    b = right.select(F.col(key).alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in equal])
    joined = a.join(b, F.col("_lk") == F.col("_rk"), "full_outer")
    side = F.when(F.col("_lk").isNull(), "right only").when(F.col("_rk").isNull(), "left only").otherwise("both")
    return joined.select(F.coalesce("_lk", "_rk").alias(key), side.alias("side"), *[F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")).alias(f"same_{c}") for c in equal])


def drop_excluded(rows: DataFrame, excluded: DataFrame, key: str, marker: DataFrame | None = None) -> DataFrame:
    """Rows whose key isn't excluded. marker: one row that says whether the index of exclusions is `complete`; if it doesn't, nothing may be read by it."""
    if marker is not None and marker.agg(F.bool_and("complete")).first()[0] is not True:
        raise ValueError("the index of exclusions is not complete")
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def split_membership(rows: DataFrame, videos: DataFrame, members: DataFrame) -> DataFrame:
    """train: the physical video isn't held out; validation: it is, and the member is listed; others have no split. rows has physical, video, logical, member."""
    held = videos.select("physical", "video").distinct().withColumn("_held", F.lit(True))
    listed = members.select("logical", "member").distinct().withColumn("_listed", F.lit(True))
    joined = rows.join(held, ["physical", "video"], "left").join(listed, ["logical", "member"], "left")
    return joined.withColumn("split", F.when(F.col("_held").isNull(), "train").when(F.col("_listed").isNotNull(), "validation")).drop("_held", "_listed")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point: str, mode: str = "first", width: int = 64) -> DataFrame:
    """Every row of points, equal ones too, with the half-open intervals of its key that hold it: the first listed (by place), or all, ordered by (start, end).

    A point that none holds has an empty text, or no texts. Intervals are cut into cells of `width` points, so the join is on
    (key, cell) and a residual, also for keys with very many of both; it is done once for each distinct point.
    """
    cells = intervals.filter("start < end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    asked = points.select(key, point).distinct().withColumn("_cell", F.floor(F.col(point) / width))
    near = asked.join(cells, [key, "_cell"]).filter(f"start <= {point} AND {point} < end").groupBy(key, point)
    if mode == "all":
        found = near.agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_a")).select(key, point, F.col("_a.text").alias("_texts"))
        return points.join(found, [key, point], "left").select(*[points[c] for c in points.columns], F.coalesce("_texts", F.array().cast("array<string>")).alias("texts"))
    found = near.agg(F.min(F.struct("place", "text")).alias("_f")).select(key, point, F.col("_f.text").alias("_text"))
    return points.join(found, [key, point], "left").select(*[points[c] for c in points.columns], F.coalesce("_text", F.lit("")).alias("text"))


def nearest_time_join(anchors: DataFrame, frames: DataFrame, offsets: list[float], tolerance: float) -> DataFrame:
    """For each anchor and offset the nearest frame in time; the earlier one in a tie. One row an anchor: frames, worst error, eligible.

    Targets are sorted in among the frames, before frames of the same time, in ranges of (video, time); the last frame before
    and the first after each are carried over the ranges, so a video of any length is spread over many tasks. Of frames of one
    time the last counts as before a target and the first as after it. Eligible: every error is within the tolerance, frames
    rise strictly, and offset 0 picks the anchor. anchors: video, anchor, pts. frames: video, frame, pts.
    """
    targets = anchors.select("video", "anchor", F.posexplode(F.array(*map(F.lit, offsets))).alias("place", "_offset"), "pts")
    targets = targets.select("video", (F.col("pts") + F.col("_offset")).alias("t"), F.lit(0).alias("kind"), "anchor", "place", F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), F.lit(None).cast("double").alias("ft"))
    rows = frames.select("video", F.col("pts").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(anchors.schema["anchor"].dataType).alias("anchor"), F.lit(None).cast("int").alias("place"), "frame", F.col("pts").alias("ft"))
    both = in_ranges(targets.unionByName(rows), ["video", "t", "kind", "frame", "anchor", "place"])
    held = F.when(F.col("kind") == 1, F.struct("frame", "ft"))
    both = carried(both, ["video"], ["t", "kind", "frame"], held, "_b")
    both = carried(both, ["video"], ["t", "kind", "frame"], held, "_a", backward=True).filter("kind = 0")
    earlier = F.col("_a").isNull() | (F.col("t") - F.col("_b.ft") <= F.col("_a.ft") - F.col("t"))
    picked = both.withColumn("_p", F.when(F.col("_b").isNotNull() & earlier, F.col("_b")).otherwise(F.col("_a")))
    by = picked.groupBy("video", "anchor").agg(F.array_sort(F.collect_list(F.struct("place", "_p.frame"))).alias("_l"), F.max(F.abs(F.col("_p.ft") - F.col("t"))).alias("worst"))
    by = by.withColumn("frames", F.col("_l.frame"))
    rising = F.forall(F.sequence(F.lit(1), F.size("frames") - 1), lambda i: F.get("frames", i) > F.get("frames", i - 1)) if len(offsets) > 1 else F.lit(True)
    zero = F.get("frames", offsets.index(0.0)) == F.col("anchor") if 0.0 in offsets else F.lit(True)
    return by.withColumn("eligible", (F.col("worst") <= tolerance) & rising & zero).drop("_l")


def densify_nearest(frames: DataFrame, key: str, step: int) -> DataFrame:
    """A dense grid 0, step, .. up to the last frame, each with the nearest frame's value (the earlier in a tie); valid where it is exact. frames: key, frame, value.

    Grid and frames are sorted in ranges of (key, frame) and values carried over them, so a key of any length is spread over many tasks.
    """
    run = step * 4096  # the grid is written out in runs, so that no array grows with the key
    last = frames.groupBy(key).agg(F.max("frame").cast("long").alias("_m")).filter("_m >= 0")
    runs = last.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"), F.lit(run).cast("long"))))
    grid = runs.select(key, F.explode(F.sequence("_r", F.least(F.col("_r") + run - step, F.col("_m")), F.lit(step).cast("long"))).alias("frame"), F.lit(True).alias("_g"), F.lit(None).cast(frames.schema["value"].dataType).alias("value"))
    both = in_ranges(grid.unionByName(frames.select(key, F.col("frame").cast("long").alias("frame"), F.lit(False).alias("_g"), "value")), [key, "frame", "_g"])
    held = F.when(~F.col("_g"), F.struct("frame", "value"))
    both = carried(both, [key], ["frame", "_g"], held, "_a", backward=True)  # a grid point comes after the frame of its own number
    both = carried(both, [key], ["frame", "_g"], held, "_b").filter("_g")
    use = F.when(F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("frame") - F.col("_b.frame") <= F.col("_a.frame") - F.col("frame"))), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_u", use).select(key, "frame", F.col("_u.frame").cast("long").alias("source"), F.col("_u.value").alias("value"), (F.col("_u.frame") == F.col("frame")).alias("valid"))


def intersect_streams(streams: list[DataFrame], keys: list[str], even: str | None = None) -> DataFrame:
    """Keys that all streams have; of the frame column `even`, even numbers alone."""
    out = streams[0]
    for s in streams[1:]:
        out = out.join(s, keys)
    return out.filter(F.col(even) % 2 == 0) if even else out


def to_anchor_frame(steps: DataFrame, group: list[str], values: list[str], anchor_step: int = 0) -> DataFrame:
    """Subtract each group's values at the anchor step (translations; poses use functions.poses). A group whose anchor isn't valid is not valid at all."""
    window = Window.partitionBy(*group)
    at = lambda c: F.max(F.when((F.col("step") == anchor_step) & F.col("valid"), F.col(c))).over(window)
    ok = F.max(F.when(F.col("step") == anchor_step, F.col("valid").cast("int"))).over(window) == 1
    rows = steps.withColumns({f"_a_{c}": at(c) for c in values} | {"_ok": F.coalesce(ok, F.lit(False))})
    return rows.withColumns({c: F.when(F.col("_ok"), F.col(c) - F.col(f"_a_{c}")) for c in values} | {"valid": F.col("valid") & F.col("_ok")}).drop("_ok", *[f"_a_{c}" for c in values])


def poses_to_anchor(steps: DataFrame, group: list[str], poses: dict[str, str], anchor: str = "last_observed", own: tuple[str, ...] = (), frame: str = "camera", metres: float = 1.0) -> DataFrame:
    """inv(T_anchor) @ T_t for each pose column (16 numbers), in windows `group` of steps; history is step <= 0.

    poses names each pose column's validity column. The anchor is `frame`'s pose at the last or the first step of history
    (last_observed, first_observed); a pose in `own` is taken relative to itself there. A pose whose own step there, or whose
    frame's, isn't valid is not valid in the whole window, and null where it isn't. Translations are multiplied by `metres` (0.001 for millimetres).
    """
    at = (F.max if anchor == "last_observed" else F.min)(F.when(F.col("step") <= 0, F.col("step"))).over(Window.partitionBy(*group))
    rows = steps.withColumn("_here", F.col("step") == at)
    whole = Window.partitionBy(*group)
    held = {f"_at_{c}": F.max(F.when(F.col("_here") & F.col(valid), F.col(c))).over(whole) for c, valid in poses.items()}
    rows = rows.withColumns(held)
    scaled = lambda m: F.transform(m, lambda x, i: F.when((i % 4 == 3) & (i < 12), x * metres).otherwise(x))
    out, ok = {}, {}
    for c, valid in poses.items():
        base = f"_at_{c if c in own else frame}"
        ok[valid] = F.coalesce(F.col(valid), F.lit(False)) & F.col(f"_at_{c}").isNotNull() & F.col(base).isNotNull()
        out[c] = F.when(ok[valid], scaled(matmul(rigid_inverse(F.col(base)), F.col(c))))
    return rows.withColumns(out | ok).drop("_here", *held)


def compose_odometry(steps: DataFrame, group: list[str], anchor: int) -> DataFrame:
    """Poses relative to the anchor step from transforms of each step to the one before: products after it, inverses before it. steps: step, transform (16 numbers).

    Groups are windows of bounded length: each is folded, in order, in its row (operators.odometry is for whole episodes). A group without the anchor step has no poses.
    """
    rows = steps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("step", "transform"))).alias("_s")).filter(F.exists("_s", lambda x: x["step"] == anchor))
    identity = F.array(*map(F.lit, IDENTITY))
    zero = F.struct(identity.alias("now"), F.expr("CAST(array() AS ARRAY<STRUCT<step: INT, pose: ARRAY<DOUBLE>>>)").alias("out"))

    def onward(state: Column, x: Column) -> Column:
        now = F.when(x["step"] == anchor, identity).otherwise(matmul(state["now"], x["transform"]))
        return F.struct(now.alias("now"), F.concat(state["out"], F.array(F.struct(x["step"].cast("int").alias("step"), now.alias("pose")))).alias("out"))

    def back(state: Column, x: Column) -> Column:
        now = matmul(state["now"], rigid_inverse(x["transform"]))
        return F.struct(now.alias("now"), F.concat(state["out"], F.array(F.struct((x["step"] - 1).cast("int").alias("step"), now.alias("pose")))).alias("out"))

    after = F.aggregate(F.filter("_s", lambda x: x["step"] >= anchor), zero, onward, lambda s: s["out"])
    before = F.aggregate(F.reverse(F.filter("_s", lambda x: x["step"] <= anchor)), zero, back, lambda s: s["out"])
    first = F.get("_s", 0)["step"]
    return rows.select(*group, F.inline(F.concat(F.filter(before, lambda x: x["step"] >= first), after)))


def match_windows(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Pairs of one key that are each other's nearest by absolute error (ties by id), and whether they are within the tolerance. a, b: id and value.

    Mutual nearest instead of first come, first served: the result doesn't depend on the order of rows. Of equal values of a
    side only the least id can be chosen; rows without a value never are. Values of both sides are sorted into one order, where
    two that choose each other are neighbours, so no pairs of a key are listed. There only the ends of a run of one side can
    be chosen: of what lies between them nothing is nearest to a value of the other side. Of an end, the nearest values of the
    other side are then one or two ends away. So one sort is enough.
    """
    side = lambda df, k: df.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"), F.col("id").alias("_id"), F.lit(k).alias("_side"))
    rows = side(a, 0).unionByName(side(b, 1)).groupBy(*key, "_v", "_side").agg(F.min("_id").alias("_id"))
    order = Window.partitionBy(*key).orderBy("_v", "_side")
    other = lambda shift: ~F.col("_side").eqNullSafe(shift("_side").over(order))
    rows = rows.withColumns({"_first": other(F.lag), "_last": other(F.lead)}).filter("_first OR _last")
    at = lambda shift, n: F.struct(*[shift(c, n).over(order).alias(c) for c in ("_side", "_v", "_id")])
    rows = rows.withColumns({"_b1": at(F.lag, 1), "_b2": at(F.lag, 2), "_a1": at(F.lead, 1), "_a2": at(F.lead, 2)})
    nearest = lambda c: [F.when(F.col(f"{c}{n}._side") != F.col("_side"), F.struct(F.abs(F.col(f"{c}{n}._v") - F.col("_v")).alias("error"), F.col(f"{c}{n}._id").alias("id"))) for n in (1, 2)]
    rows = rows.select(*key, "_v", "_side", "_id", F.least(F.coalesce(*nearest("_b")), F.coalesce(*nearest("_a"))).alias("_pick"))
    after = F.lead(F.struct("_side", "_id", "_pick")).over(order)
    pairs = rows.withColumn("_next", after).filter("_next._side <> _side AND _pick.id = _next._id AND _next._pick.id = _id")
    first = F.col("_side") == 0
    found = pairs.select(*key, F.when(first, F.col("_id")).otherwise(F.col("_next._id")).alias("a"), F.when(first, F.col("_next._id")).otherwise(F.col("_id")).alias("b"), F.col("_pick.error").alias("error"))
    return found.withColumn("within", F.col("error") <= tolerance)


def match_report(pairs: DataFrame, a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(measure, value) of matched windows: pairs, how many are within the tolerance, rows of either side without a partner, greatest error, and its 50 and 95 % quantiles."""
    one = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("within").alias("within"), F.max("error").alias("max"))
    names = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("pairs", "within", "max")])
    alone = lambda df, side: df.select(*key, F.col("id").alias(side)).join(pairs.select(*key, side), [*key, side], "left_anti").agg(F.lit(f"unmatched {side}").alias("measure"), F.count(F.lit(1)).cast("double").alias("value"))
    spread = quantiles(pairs, "error", None, (0.5, 0.95)).select(F.format_string("p%d", F.round(F.col("q") * 100).cast("int")).alias("measure"), "value")
    return one.select(F.inline(names)).unionByName(alone(a, "a")).unionByName(alone(b, "b")).unionByName(spread)


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], rtol: float = 1e-5, atol: float = 1e-5, by: str | None = None) -> DataFrame:
    """One row a value column, or a source (the column `by` of both tables) and value column: greatest error, values that aren't close, and keys on one side alone."""
    own = [by] if by else []
    x = a.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(v).alias(f"_x_{v}") for v in values], *[F.col(c).alias("_a_by") for c in own])
    y = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(v).alias(f"_y_{v}") for v in values], *[F.col(c).alias("_b_by") for c in own])
    on = [F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in keys]
    joined = x.join(y, on, "full_outer").withColumn("_alone", F.col(f"_a_{keys[0]}").isNull() | F.col(f"_b_{keys[0]}").isNull())
    sources = [F.coalesce("_a_by", "_b_by").alias(c) for c in own]
    long = joined.select("_alone", *sources, F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.abs(F.col(f"_x_{v}") - F.col(f"_y_{v}")).alias("_e"), F.abs(F.col(f"_y_{v}")).alias("_m")) for v in values])))
    return long.groupBy(*own, "column").agg(F.max("_e").alias("max_error"), F.count_if(F.col("_e") > atol + rtol * F.col("_m")).alias("not_close"), F.count_if("_alone").alias("unmatched"))


def existence_counters(wanted: DataFrame, listings: dict[str, DataFrame], key: str, by: str) -> DataFrame:
    """For each group how many wanted rows are missing in each listing."""
    out = wanted
    for name, there in listings.items():
        out = out.join(there.select(key).distinct().withColumn(f"_{name}", F.lit(1)), key, "left")
    return out.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"_{n}").isNull()).alias(f"missing_{n}") for n in listings])


def fan_out_once(asks: DataFrame, keys: list[str], work) -> DataFrame:
    """Do `work` (DataFrame of distinct keys to keys and results) once for each distinct key, and put results back at every row that asked."""
    return asks.join(work(asks.select(*keys).distinct()), keys)


def eligible_set(official: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Asked rows on the official list, and asked rows that aren't."""
    listed = official.select(key).distinct()
    return asked.join(listed, key, "left_semi"), asked.join(listed, key, "left_anti")


def eligibility(official: DataFrame, asked: DataFrame, key: str, wanted: dict[str, Column] | None = None, archives: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Asked keys with their status: not listed, wrong device (a column of the official list isn't what is wanted), absent archive, or eligible. strict: anything but eligible is an error."""
    fits = F.coalesce(F.bool_and(reduce(lambda x, y: x & y, [F.col(c) == v for c, v in (wanted or {}).items()], F.lit(True))), F.lit(False))
    rows = asked.join(official.groupBy(key).agg(fits.alias("_fits")), key, "left")
    rows = rows.join(archives.select(key, F.lit(True).alias("_there")).distinct(), key, "left") if archives is not None else rows.withColumn("_there", F.lit(True))
    status = F.when(F.col("_fits").isNull(), "not listed").when(~F.col("_fits"), "wrong device").when(F.col("_there").isNull(), "absent archive").otherwise("eligible")
    out = rows.withColumn("status", status).drop("_fits", "_there")
    if strict and not out.filter("status <> 'eligible'").isEmpty():
        raise ValueError("not every asked key is eligible")
    return out


def attach_or_mask(rows: DataFrame, optional: DataFrame, key: str, zeros: dict[str, Column]) -> DataFrame:
    """Left join; what is missing becomes typed zeros, and `present` says so. No row is lost."""
    joined = rows.join(optional.select(key, *zeros, F.lit(True).alias("_p")), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), z) for c, z in zeros.items()} | {"present": F.col("_p").isNotNull()}).drop("_p")
