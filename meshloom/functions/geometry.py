"""Vectors and quaternions as tuples of columns; plain expressions that stay in generated code (MA1-MA18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scaled(a: Vec, k: Column | float) -> Vec:
    return tuple(x * k for x in a)


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    n = length(a)
    return tuple(F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in a)


def lowest(a: Vec, b: Vec) -> Vec:
    return tuple(F.least(x, y) for x, y in zip(a, b))


def highest(a: Vec, b: Vec) -> Vec:
    return tuple(F.greatest(x, y) for x, y in zip(a, b))


def determinant(a: Vec, b: Vec, c: Vec) -> Column:
    """Of the matrix with columns a, b, c."""
    return dot(a, cross(b, c))


def conjugate(q: Quat) -> Quat:
    return (-q[0], -q[1], -q[2], q[3])


def product(p: Quat, q: Quat) -> Quat:
    """Hamilton product; parts in the order x, y, z, w."""
    (a, b, c, d), (e, f, g, h) = p, q
    return (d * e + a * h + b * g - c * f, d * f - a * g + b * h + c * e, d * g + a * f - b * e + c * h, d * h - a * e - b * f - c * g)


def rotate(q: Quat, v: Vec) -> Vec:
    """q v q* for a unit quaternion: v + 2w (u x v) + 2 u x (u x v)."""
    u, w = q[:3], q[3]
    t = scaled(cross(u, v), 2.0)
    return add(add(v, scaled(t, w)), cross(u, t))


def is_identity(q: Quat, eps: float = 1e-6) -> Column:
    return F.abs(F.abs(q[3]) - 1) < eps


def matrix(q: Quat) -> tuple[Vec, Vec, Vec]:
    """Columns of the rotation matrix."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return rotate(q, (one, zero, zero)), rotate(q, (zero, one, zero)), rotate(q, (zero, zero, one))


def snapped_matrix(q: Quat, eps: float = 1e-9) -> tuple[Vec, Vec, Vec]:
    """matrix with entries within eps of -1, 0 and 1 set to these."""

    def snap(x: Column) -> Column:
        near = F.round(x)
        return F.when(F.abs(x - near) < eps, near + F.lit(0.0)).otherwise(x)

    return tuple(tuple(snap(x) for x in c) for c in matrix(q))


def tangent(n: Vec) -> Vec:
    """A unit vector at right angles to the unit vector n: the cross product with the axis that n leans on least. With n and
    cross(n, tangent) it makes a frame."""
    ax, ay, az = (F.abs(x) for x in n)
    one, zero = F.lit(1.0), F.lit(0.0)
    pick = lambda c: F.when(c, one).otherwise(zero)
    x = (ax <= ay) & (ax <= az)
    y = ~x & (ay <= az)
    return unit(cross(n, (pick(x), pick(y), pick(~x & ~y))))


def clip(origin: Vec, along: Vec, lo: Vec, hi: Vec) -> tuple[Column, Column]:
    """Whether a ray meets a box, and where it enters, in lengths of `along` (0 where it begins inside; null where it misses).
    `along` must have no zero component."""
    first = [(a - o) / d for a, o, d in zip(lo, origin, along)]
    last = [(b - o) / d for b, o, d in zip(hi, origin, along)]
    enters = F.greatest(*[F.least(a, b) for a, b in zip(first, last)])
    leaves = F.least(*[F.greatest(a, b) for a, b in zip(first, last)])
    hit = (enters <= leaves) & (leaves >= 0)
    return hit, F.when(hit, F.greatest(enters, F.lit(0.0)))


def from_matrix(c0: Vec, c1: Vec, c2: Vec) -> Quat:
    """Unit quaternion of a rotation given by its columns; branches on the largest of trace and diagonal."""
    (a, d, g), (b, e, h), (c, f, i) = c0, c1, c2
    best = F.greatest(a + e + i, a, e, i)

    def by(own: Column, top: Column, rest: tuple[Column, Column, Column], place: int) -> list[Column]:
        s = F.sqrt(F.greatest(top, F.lit(1e-12))) * 2
        parts = [x / s for x in rest]
        parts.insert(place, s / 4)
        return parts

    options = (
        (best == a + e + i, by(a, 1 + a + e + i, (h - f, c - g, d - b), 3)),
        (best == a, by(a, 1 + a - e - i, (b + d, c + g, h - f), 0)),
        (best == e, by(e, 1 + e - a - i, (b + d, f + h, c - g), 1)),
        (F.lit(True), by(i, 1 + i - a - e, (c + g, f + h, d - b), 2)),
    )
    return tuple(F.coalesce(*[F.when(cond, q[j]) for cond, q in options]) for j in range(4))


def packed(q: Quat) -> Vec:
    """A turn as three numbers: the unit quaternion with w not negative, without w (MA16)."""
    n = length(q)
    sign = F.when(q[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(x * sign / n for x in q[:3])


def unpacked(v: Vec) -> Quat:
    """The quaternion of three numbers: w makes it one of length 1 (MA16)."""
    return (*v, F.sqrt(F.greatest(1 - dot(v, v), F.lit(0.0))))
