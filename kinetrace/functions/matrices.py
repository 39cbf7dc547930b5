"""4 x 4 matrices held as arrays of 16 numbers, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def matmul(a: Column, b: Column) -> Column:
    """Product of two 4 x 4 matrices held as arrays of 16 numbers, row by row."""
    cell = lambda m, i, j: sum((F.get(m["a"], 4 * i + k) * F.get(m["b"], 4 * k + j) for k in range(1, 4)), F.get(m["a"], 4 * i) * F.get(m["b"], j))
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda m: F.array(*[cell(m, i, j) for i in range(4) for j in range(4)]))


IDENTITY = [float(i % 5 == 0) for i in range(16)]


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rotation and translation held as 16 numbers."""

    def of(x: Column) -> Column:
        rows = [F.get(x, i) for i in range(16)]
        turned = [[rows[4 * j + i] for j in range(3)] for i in range(3)]
        moved = [-(turned[i][0] * rows[3] + turned[i][1] * rows[7] + turned[i][2] * rows[11]) for i in range(3)]
        return F.array(*[v for i in range(3) for v in (*turned[i], moved[i])], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])

    return bound(m, of)
