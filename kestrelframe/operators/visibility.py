"""Which faces of a mesh a camera sees: inside its image, and first on the ray to their centroid.

All faces go into one grid over each view's image, at the level of their own size: a
face of up to ``2**l`` pixels stands in at most four cells of that side. The ray to a
centroid passes one cell of each level in use, so it meets by equality just those
faces whose boxes it may cross, and each is cut exactly. Work follows the mesh's depth
(how many faces lie behind one another), not the product of faces: small faces meet in
small cells, down to ``2**-8`` pixel. Both sides of the join are written tables, so
adaptive execution can split a crowded cell, and hits are summed by face before they
are shuffled.

A face that reaches behind the camera has no box; it stands in one cell of the whole
view. Faces that touch at the very depth of the centroid do not hide it. Faces with a
null corner are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import materialise
from .mesh import points_of

FINEST = -8
_EVERYWHERE = 64
_NEAR = 1e-9
_SLACK = 1e-6


@dataclass(frozen=True)
class View:
    """A pinhole camera: ``rotation @ p + translation`` is in front of it along z; pixels are ``f x / z + c``."""

    view: int
    rotation: tuple[tuple[float, float, float], ...]
    translation: tuple[float, float, float]
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int

    def as_column(self) -> Column:
        numbers = {f"r{i}{j}": self.rotation[i][j] for i in range(3) for j in range(3)} | {f"t{i}": self.translation[i] for i in range(3)}
        numbers |= {n: float(getattr(self, n)) for n in ("fx", "fy", "cx", "cy")}
        return F.struct(F.lit(self.view).alias("view"), *(F.lit(float(x)).alias(n) for n, x in numbers.items()), F.lit(self.width).alias("width"), F.lit(self.height).alias("height"))


def _seen(p: G.Vec) -> G.Vec:
    """A point in the camera's own axes."""
    return tuple(sum((F.col(f"c.r{i}{j}") * p[j] for j in (1, 2)), F.col(f"c.r{i}0") * p[0]) + F.col(f"c.t{i}") for i in range(3))  # type: ignore[return-value]


def _pixel(p: G.Vec) -> tuple[Column, Column]:
    return F.col("c.fx") * p[0] / p[2] + F.col("c.cx"), F.col("c.fy") * p[1] / p[2] + F.col("c.cy")


def in_views(cornered: DataFrame, views: Sequence[View]) -> DataFrame:
    """Each of :func:`mesh.corners`' faces in each view: corners ``p0x .. p2z`` in the camera's axes, ``inside`` if all are in front and a pixel inside the image."""
    each = cornered.withColumn("c", F.explode(F.array(*(v.as_column() for v in views))))
    corners = [_seen(p) for p in points_of()]
    each = each.select("fid", "c", *(v.alias(f"p{k}{n}") for k, p in enumerate(corners) for n, v in zip("xyz", p, strict=True)))
    ok = F.lit(True)
    for p in _corners():
        u, v = _pixel(p)
        ok = ok & (p[2] > 0) & u.between(1, F.col("c.width") - 2) & v.between(1, F.col("c.height") - 2)
    return each.withColumn("inside", F.when(F.least(*(p[2] for p in _corners())) > _NEAR, ok).otherwise(F.lit(False)))


def _corners(of: str = "p") -> list[G.Vec]:
    return [(F.col(f"{of}{k}x"), F.col(f"{of}{k}y"), F.col(f"{of}{k}z")) for k in range(3)]


def _cells(faces: DataFrame) -> DataFrame:
    """``(view, level, bx, by, gid, g*)`` of every face that a ray through the image may cross."""
    pixels = [_pixel(p) for p in _corners()]
    front = F.least(*(p[2] for p in _corners())) > _NEAR
    box = {"u0": F.least(*(u for u, _ in pixels)), "u1": F.greatest(*(u for u, _ in pixels)), "v0": F.least(*(v for _, v in pixels)), "v1": F.greatest(*(v for _, v in pixels))}
    out = faces.where(F.greatest(*(p[2] for p in _corners())) > 0).withColumn("front", front).withColumns({n: F.when(F.col("front"), b) for n, b in box.items()})
    out = out.withColumns({"u0": F.greatest("u0", F.lit(0.0)) - _SLACK, "u1": F.least("u1", F.col("c.width").cast("double")) + _SLACK, "v0": F.greatest("v0", F.lit(0.0)) - _SLACK, "v1": F.least("v1", F.col("c.height").cast("double")) + _SLACK})
    out = out.where("NOT front OR (u0 <= u1 AND v0 <= v1)")
    size = F.greatest(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"), F.lit(2.0**FINEST))
    out = out.withColumn("level", F.when(F.col("front"), F.ceil(F.log2(size))).otherwise(_EVERYWHERE).cast("int"))
    side = F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.explode(F.when(F.col("front"), F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side))).otherwise(F.array(F.lit(0).cast("long"))))
    out = out.withColumn("bx", span("u0", "u1")).withColumn("by", span("v0", "v1"))
    return out.select("c.view", "level", "bx", "by", F.col("fid").alias("gid"), *(F.col(f"p{k}{n}").alias(f"g{k}{n}") for k in range(3) for n in "xyz"))


def unoccluded(cornered: DataFrame, views: Sequence[View]) -> DataFrame:
    """``(fid, view)`` of the faces that a view holds whole and that no other face hides at the centroid."""
    each = materialise(in_views(cornered, views), "faces_in_views")
    cells = materialise(_cells(each), "image_cells")
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # some twenty at most
    a, b, c = _corners()
    ray = [(a[i] + b[i] + c[i]) / 3 for i in range(3)]
    targets = each.where("inside").select("fid", "c", *(r.alias(f"d{n}") for r, n in zip(ray, "xyz", strict=True)))
    if not levels:
        return targets.select("fid", "c.view")
    u, v = _pixel((F.col("dx"), F.col("dy"), F.col("dz")))
    side = F.pow(F.lit(2.0), F.col("level"))
    at = lambda x: F.when(F.col("level") == _EVERYWHERE, 0).otherwise(F.floor(x / side)).cast("long")
    rays = targets.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)))).select("fid", "c.view", "dx", "dy", "dz", "level", at(u).alias("bx"), at(v).alias("by"))
    rays = materialise(rays, "rays")
    met = rays.join(cells, ["view", "level", "bx", "by"]).where("fid <> gid")
    d, (p, q, r) = (F.col("dx"), F.col("dy"), F.col("dz")), _corners("g")
    sides = [G.dot(d, G.cross(x, y)) for x, y in ((p, q), (q, r), (r, p))]
    inside = (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)
    normal = G.cross(G.sub(q, p), G.sub(r, p))
    along = G.dot(d, normal)
    depth = F.when(along != 0, G.dot(p, normal) / along)
    hidden = met.where(inside & (depth > 0) & (depth < 1 - 1e-9)).groupBy(F.col("fid").alias("_f"), F.col("view").alias("_v")).agg(F.count("*").alias("hits"))
    return targets.select("fid", "c.view").join(hidden, (F.col("fid") == F.col("_f")) & (F.col("view") == F.col("_v")), "left_anti")


def best_views(cornered: DataFrame, views: Sequence[View]) -> DataFrame:
    """``(fid, view)``: of the views that see a face, the one with the largest |cos| of the viewing angle over squared distance, the first on ties; null if none sees it."""
    from .mesh import best_view

    seen = unoccluded(cornered, views)
    each = in_views(cornered, views).select(F.col("fid").alias("_f"), F.col("c.view").alias("_v"), *(f"p{k}{n}" for k in range(3) for n in "xyz"))
    a, b, c = _corners()
    normal, centre = G.cross(G.sub(b, a), G.sub(c, a)), tuple((a[i] + b[i] + c[i]) / 3 for i in range(3))
    far = G.norm(centre)
    weight = F.abs(G.dot(normal, centre)) / (G.norm(normal) * (far + 1e-9)) / (far * far + 1e-9)
    weighed = seen.join(each, (F.col("fid") == F.col("_f")) & (F.col("view") == F.col("_v"))).select("fid", "view", F.coalesce(weight, F.lit(0.0)).alias("weight"))
    return cornered.select("fid").join(best_view(weighed), "fid", "left")
