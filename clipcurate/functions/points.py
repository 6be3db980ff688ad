"""Geometry of points that are packed in one array: x, y, z, x, y, z, ..."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipcurate.functions.numbers import unrolled


def off_axis_deg(name: str, points: int) -> Column:
    """Angle between the camera's viewing direction, -z, and the direction of the points' sum, which is that of their centroid.
    Arrays of ``points`` points are summed in generated code, others by a function of each point."""
    degrees = lambda x, y, z: f"degrees(atan2(sqrt({x} * {x} + {y} * {y}), -{z}))"
    sums = ["(0D + " + " + ".join(f"get({name}, {3 * i + k})" for i in range(points)) + ")" for k in range(3)]
    add = ", ".join(f"'{a}', s.{a} + get({name}, i * 3 + {k})" for k, a in enumerate("xyz"))
    each = f"aggregate(sequence(0, size({name}) div 3 - 1), named_struct('x', 0D, 'y', 0D, 'z', 0D), (s, i) -> named_struct({add}), s -> {degrees('s.x', 's.y', 's.z')})"
    return unrolled(name, 3 * points, degrees(*sums), each)


def aperture(name: str, points: int) -> Column:
    """Mean distance of all points (the first included) to the first."""
    far = lambda i: "sqrt(" + " + ".join(f"power(get({name}, {i} * 3 + {k}) - get({name}, {k}), 2D)" for k in range(3)) + ")"
    known = "(0D + " + " + ".join(far(i) for i in range(points)) + f") / {points}"
    return unrolled(name, 3 * points, known, f"aggregate(sequence(0, size({name}) div 3 - 1), 0D, (s, i) -> s + {far('i')}) / (size({name}) div 3)")


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]


def into_head(p: list[Column], head: list[Column]) -> list[Column]:
    """World point p as a head pose (x, y, z and a quaternion x, y, z, w) sees it: turned back by the conjugate quaternion, with
    two cross products. A null rotation turns nothing."""
    length = F.sqrt(sum(c * c for c in head[3:]))
    part = lambda c, none: F.when(length < 1e-12, F.lit(none)).otherwise(c / length)
    axis, w = [-part(c, 0.0) for c in head[3:6]], part(head[6], 1.0)
    d = [a - b for a, b in zip(p, head[:3], strict=True)]
    t = [2 * c for c in _cross(axis, d)]
    return [a + w * b + c for a, b, c in zip(d, t, _cross(axis, t), strict=True)]


def pinhole(p: list[Column], f: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """(u, v, valid): image place of a point in camera space; only points more than 1 cm in front are valid."""
    x, y, z = p
    ok = F.coalesce(z > 0.01, F.lit(False))
    return F.when(ok, f * x / z + cx), F.when(ok, f * y / z + cy), ok
