"""Rotations and rigid poses as arrays of numbers, row by row: 9 for a rotation, 16 for a pose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetrace.functions.matrices import bound, matmul, rigid_inverse

__all__ = ["cross", "distance", "geodesic_angle", "joints_to_wrist", "matmul", "quaternion_to_matrix", "relative_pose_errors", "rigid", "rigid_inverse", "rot6d_decode", "rot6d_encode", "rotation_of", "transform_point", "translation_of"]


def quaternion_to_matrix(q: Column) -> Column:
    """(w, x, y, z), normalised first."""

    def of(m: Column) -> Column:
        w, x, y, z = (F.get(m["q"], i) / m["norm"] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return bound(F.struct(q.alias("q"), F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, v: s + v * v)).alias("norm")), of)


def rot6d_encode(rotation: Column) -> Column:
    """The first two rows."""
    return F.slice(rotation, 1, 6)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(v: list[Column]) -> list[Column]:
    norm = F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(1e-8))
    return [x / norm for x in v]


def rot6d_decode(six: Column) -> Column:
    """Gram-Schmidt on the two rows; the third is their cross product."""
    a = _unit([F.get(six, i) for i in range(3)])
    b = [F.get(six, i) for i in range(3, 6)]
    along = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b = _unit([y - along * x for x, y in zip(a, b, strict=True)])
    return F.array(*a, *b, *cross(a, b))


def rotation_of(pose: Column) -> Column:
    return F.concat(F.slice(pose, 1, 3), F.slice(pose, 5, 3), F.slice(pose, 9, 3))


def translation_of(pose: Column) -> Column:
    return F.array(F.get(pose, 3), F.get(pose, 7), F.get(pose, 11))


def rigid(quaternion: Column, translation: Column) -> Column:
    """The 16 numbers of a pose; null unless both parts are there."""
    rows = lambda turn: [F.concat(F.slice(turn, 3 * i + 1, 3), F.array(F.get(translation, i))) for i in range(3)]
    pose = bound(quaternion_to_matrix(quaternion), lambda turn: F.concat(*rows(turn), F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])))
    return F.when(quaternion.isNotNull() & translation.isNotNull(), pose)


def transform_point(pose: Column, point: Column) -> Column:
    at = [F.get(pose, i) for i in range(16)]
    p = [F.get(point, i) for i in range(3)]
    return F.array(*[at[4 * i] * p[0] + at[4 * i + 1] * p[1] + at[4 * i + 2] * p[2] + at[4 * i + 3] for i in range(3)])


def joints_to_wrist(wrist: Column, joints: Column) -> Column:
    """Points (arrays of 3) as seen from the wrist of the same instant."""
    back = rigid_inverse(wrist)
    return F.transform(joints, lambda p: transform_point(back, p))


def geodesic_angle(a: Column, b: Column) -> Column:
    """Angle between two rotations, as atan2 of sine and cosine, which is exact near 0 and near a half turn."""

    def of(m: Column) -> Column:
        x, y = [F.get(m["a"], i) for i in range(9)], [F.get(m["b"], i) for i in range(9)]
        r = [[x[i] * y[j] + x[3 + i] * y[3 + j] + x[6 + i] * y[6 + j] for j in range(3)] for i in range(3)]
        cosine = (r[0][0] + r[1][1] + r[2][2] - 1) / 2
        skew = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
        sine = F.sqrt(skew[0] * skew[0] + skew[1] * skew[1] + skew[2] * skew[2]) / 2
        return F.atan2(sine, cosine)

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def distance(a: Column, b: Column) -> Column:
    """Between the translations of two poses."""
    gap = F.zip_with(translation_of(a), translation_of(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def relative_pose_errors(camera_a: Column, wrist_a: Column, camera_b: Column, wrist_b: Column) -> Column:
    """Errors of the wrist seen from the camera: translation, and rotation angle in degrees."""
    seen = F.struct(matmul(rigid_inverse(camera_a), wrist_a).alias("a"), matmul(rigid_inverse(camera_b), wrist_b).alias("b"))
    return bound(seen, lambda m: F.struct(distance(m["a"], m["b"]).alias("translation"), F.degrees(geodesic_angle(rotation_of(m["a"]), rotation_of(m["b"]))).alias("rotation")))
