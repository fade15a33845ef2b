"""Expressions over ARRAY<DOUBLE> columns. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A metric takes two array columns and gives a number column; pass any such function to the operators.
Metric = Callable[[Column, Column], Column]


def doubles(x: Column | str) -> Column:
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + e)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def dot(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def sqdist(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def l1(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: F.abs(x - y)))


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def normalise_sum(a: Column) -> Column:
    """Sum 1; null where the sum is 0."""
    s = total(a)
    return F.when(s != 0, F.transform(a, lambda x: x / s))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def matvec(m: Column, a: Column) -> Column:
    """Product of a matrix (array of rows) and a vector."""
    return F.transform(m, lambda row: dot(row, a))


def mahalanobis_root(w: Sequence[Sequence[float]]) -> Metric:
    """Length of W'(a - b)."""
    columns = matrix(list(zip(*w, strict=True)))
    return lambda a, b: norm(matvec(columns, subtract(a, b)))


def mahalanobis(w: Sequence[Sequence[float]]) -> Metric:
    """Root of (a - b)'W'(a - b)."""
    columns = matrix(list(zip(*w, strict=True)))
    return lambda a, b: F.sqrt(dot(subtract(a, b), matvec(columns, subtract(a, b))))


def cross(a: Column, b: Column) -> Column:
    """Cross product of 3-vectors."""
    g = lambda x, i: F.get(x, F.lit(i))
    return F.array(*(g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))))


def hat(a: Column) -> Column:
    """The skew matrix whose product with b is the cross product a x b."""
    x, y, z = (F.get(a, F.lit(i)) for i in range(3))
    zero = F.lit(0.0)
    return F.array(F.array(zero, -z, y), F.array(z, zero, -x), F.array(-y, x, zero))


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, in radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def plane_residual(x: Column, center: Column, basis: Column) -> Column:
    """Squared distance of a point to a plane given by its centre and orthonormal directions (rows)."""
    y = subtract(x, center)
    return F.greatest(F.lit(0.0), dot(y, y) - total(F.transform(basis, lambda b: dot(b, y) * dot(b, y))))


# Kernels: of the squared distance, with a scale; each is 0 beyond it.


def epanechnikov(d2: Column, s: float, dim: int) -> Column:
    return F.when(d2 <= s * s, (1 - d2 / (s * s)) * 0.75**dim).otherwise(0.0)


def triangle(d2: Column, s: float) -> Column:
    return F.when(d2 <= s * s, (s - F.sqrt(d2)) / s).otherwise(0.0)


def triweight(d2: Column, s: float) -> Column:
    return F.when(d2 <= s * s, F.pow((s * s - d2) / (s * s), 3)).otherwise(0.0)


def gaussian(d2: Column, s: float) -> Column:
    return F.exp(-d2 / (2.0 * s * s))


# Quaternions (x, y, z, w).


def quat_mult(a: Column, b: Column) -> Column:
    ax, ay, az, aw = (F.get(a, F.lit(i)) for i in range(4))
    bx, by, bz, bw = (F.get(b, F.lit(i)) for i in range(4))
    return F.array(
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by + ay * bw + az * bx - ax * bz,
        aw * bz + az * bw + ax * by - ay * bx,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def quat_conjugate(a: Column) -> Column:
    return F.transform(a, lambda v, i: F.when(i < 3, -v).otherwise(v))


def axis_angle_to_quat(axis: Column, theta: Column) -> Column:
    u = normalise(axis)
    return F.concat(F.transform(u, lambda v: v * F.sin(theta / 2)), F.array(F.cos(theta / 2)))


def rotate_by_quat(v: Column, q: Column) -> Column:
    turned = quat_mult(quat_mult(q, F.concat(v, F.array(F.lit(0.0)))), quat_conjugate(q))
    return F.slice(turned, 1, 3)
