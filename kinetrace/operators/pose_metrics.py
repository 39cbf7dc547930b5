"""Errors of predicted poses against true ones, in pooled means over masked steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.functions import poses as P
from kinetrace.operators.aggregates import masked_mean


def turned(a: Column, b: Column) -> Column:
    """Degrees between the rotations of two poses."""
    return F.degrees(P.geodesic_angle(P.rotation_of(a), P.rotation_of(b)))


def fingers_turned(a: Column, b: Column) -> Column:
    """Mean degrees between two lists of rotations."""
    return F.degrees(F.aggregate(F.zip_with(a, b, P.geodesic_angle), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def pose_metrics(steps: DataFrame, by: str) -> DataFrame:
    """(source, measure, value, n): camera and wrist translation in cm and rotation in degrees, mean finger rotation, the wrists seen from the camera, and the horizon.

    A row is a step of a sample. For x in p (predicted), t (true): x_camera, x_left, x_right (poses), x_left_fingers and
    x_right_fingers (lists of rotations). camera_ok, left_ok, right_ok, left_fingers_ok, right_fingers_ok: a null is false. Both hands
    are pooled. A wrist seen from the camera needs both to be valid. horizon_seconds is the sample's, taken at its step 1.
    A measure without valid steps is 0 with n = 0.
    """
    true = lambda *names: F.coalesce(F.col(names[0]), F.lit(False)) if len(names) == 1 else true(names[0]) & true(*names[1:])
    pair = lambda c: (F.col(f"p_{c}"), F.col(f"t_{c}"))
    measures = [("camera_cm", P.distance(*pair("camera")) * 100, true("camera_ok")), ("camera_deg", turned(*pair("camera")), true("camera_ok")), ("horizon_seconds", F.col("horizon_seconds"), F.col("step") == 1)]
    rows = steps
    for side in ("left", "right"):
        seen = P.relative_pose_errors(F.col("p_camera"), F.col(f"p_{side}"), F.col("t_camera"), F.col(f"t_{side}"))
        rows = rows.withColumn(f"_{side}", F.when(true("camera_ok", f"{side}_ok"), seen))
        measures += [
            ("wrist_cm", P.distance(*pair(side)) * 100, true(f"{side}_ok")), ("wrist_deg", turned(*pair(side)), true(f"{side}_ok")), ("finger_deg", fingers_turned(*pair(f"{side}_fingers")), true(f"{side}_fingers_ok")),
            ("relative_cm", F.col(f"_{side}.translation") * 100, true("camera_ok", f"{side}_ok")), ("relative_deg", F.col(f"_{side}.rotation"), true("camera_ok", f"{side}_ok")),
        ]
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.when(ok, v).alias("_v"), ok.alias("_ok")) for m, v, ok in measures])
    return rows.select(by, F.inline(listed)).groupBy(by, "measure").agg(masked_mean(F.col("_v"), F.col("_ok")).alias("value"), F.count_if("_ok").alias("n"))
