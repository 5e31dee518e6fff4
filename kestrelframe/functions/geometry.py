"""Planar and solid geometry, cameras and pixels, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def angle_between(a: Vec, b: Vec) -> Column:
    """Degrees between two directions."""
    c = dot(a, b) / (norm(a) * norm(b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def face_weight(centre: Vec, normal: Vec, camera: Vec) -> Column:
    """Facing cosine over squared distance, 0 for faces turned away."""
    to = sub(camera, centre)
    d = norm(to)
    facing = dot(normal, to) / (norm(normal) * d)
    return F.greatest(F.lit(0.0), facing) / (d * d)


def closest_on_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    """The closest point of a triangle, and its distance: three corners, three edges, the face."""
    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    bp, cp = sub(p, b), sub(p, c)
    d1, d2 = dot(ab, ap), dot(ac, ap)
    d3, d4 = dot(ab, bp), dot(ac, bp)
    d5, d6 = dot(ab, cp), dot(ac, cp)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    # barycentric weights (of b, of c) by region; the first that fits holds
    in_a, in_b, in_c = (d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (d6 >= 0) & (d5 <= d6)
    # an edge without length is no edge: a flat triangle is met by its other edges
    bc = sub(c, b)
    on_ab, on_ac = (dot(ab, ab) > 0) & (vc <= 0) & (d1 >= 0) & (d3 <= 0), (dot(ac, ac) > 0) & (vb <= 0) & (d2 >= 0) & (d6 <= 0)
    on_bc = (dot(bc, bc) > 0) & (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)
    k_ab, k_ac, k_bc = F.try_divide(d1, d1 - d3), F.try_divide(d2, d2 - d6), F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6))
    total = va + vb + vc

    def pick(in_a_: float, in_b_: float, in_c_: float, ab_: Column, ac_: Column, bc_: Column, inside: Column) -> Column:
        return F.when(in_a, F.lit(in_a_)).when(in_b, F.lit(in_b_)).when(on_ab, ab_).when(in_c, F.lit(in_c_)).when(on_ac, ac_).when(on_bc, bc_).otherwise(F.try_divide(inside, total))

    zero = F.lit(0.0)
    v = pick(0.0, 1.0, 0.0, k_ab, zero, 1 - k_bc, vb)
    w = pick(0.0, 0.0, 1.0, zero, k_ac, k_bc, vc)
    q = tuple(a[i] + v * ab[i] + w * ac[i] for i in range(3))
    return q, distance(p, q)  # type: ignore[return-value, arg-type]


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Nearest pixel of a point in camera coordinates, half to even; null behind the camera."""
    front = F.when(z > 0, z)
    return F.rint(fx * x / front + cx).cast("long"), F.rint(fy * y / front + cy).cast("long")


def scaled_camera(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, new_width: Column, new_height: Column) -> tuple[Column, Column, Column, Column]:
    sx, sy = new_width / width, new_height / height
    return fx * sx, fy * sy, cx * sx, cy * sy


def cropped_camera(cx: Column, cy: Column, left: Column, top: Column) -> tuple[Column, Column]:
    return cx - left, cy - top


def camera_parameters(model: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: list[Column]) -> Column:
    """Comma-separated parameters in the order that each camera model takes."""
    text = lambda *c: F.concat_ws(",", *(x.cast("double").cast("string") for x in c))
    k = k + [F.lit(0.0)] * (4 - len(k))
    return (
        F.when(model == "SIMPLE_PINHOLE", text(fx, cx, cy))
        .when(model == "PINHOLE", text(fx, fy, cx, cy))
        .when(model == "SIMPLE_RADIAL", text(fx, cx, cy, k[0]))
        .when(model == "RADIAL", text(fx, cx, cy, k[0], k[1]))
        .otherwise(text(fx, fy, cx, cy, *k[:4]))
    )


def density(kth_distance: Column, k: int) -> Column:
    """Points per volume of the ball that reaches the k-th neighbour; 0 where there is none."""
    r = F.greatest(kth_distance, F.lit(1e-6))
    return F.coalesce(k / (4.0 / 3.0 * math.pi * r * r * r), F.lit(0.0))


def slope_degrees(horizontal: Column, vertical: Column) -> Column:
    return F.degrees(F.atan2(vertical, horizontal))


def polygon_area(xs: Column, ys: Column, zs: Column) -> Column:
    """Newell area of a closed polygon whose corners are given as three arrays."""
    n = F.size(xs)

    def term(u: Column, v: Column):
        return lambda i: (F.get(u, i) - F.get(u, (i + 1) % n)) * (F.get(v, i) + F.get(v, (i + 1) % n))

    at = F.sequence(F.lit(0), n - 1)
    total = lambda u, v: F.aggregate(F.transform(at, term(u, v)), F.lit(0.0), lambda s, t: s + t)
    nx, ny, nz = total(ys, zs), total(zs, xs), total(xs, ys)
    return F.sqrt(nx * nx + ny * ny + nz * nz) / 2


def camera_centre(r: list[list[Column]], t: Vec) -> Vec:
    """Where a camera stands: minus the transposed rotation times the translation."""
    return tuple(-sum((r[i][j] * t[i] for i in range(1, 3)), r[0][j] * t[0]) for j in range(3))
