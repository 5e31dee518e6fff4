"""Triangle meshes as tables: ``vertices(vid, x, y, z)`` and ``faces(fid, v0, v1, v2)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .components import components


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners, ``x0 .. z2``; faces with unknown corners drop."""
    out = faces
    for k in range(3):
        v = vertices.select(F.col("vid").alias(f"_v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
        out = out.join(v, F.col(f"v{k}") == F.col(f"_v{k}")).drop(f"_v{k}")
    return out


def points_of() -> tuple[G.Vec, G.Vec, G.Vec]:
    return tuple((F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")) for k in range(3))  # type: ignore[return-value]


def measures(cornered: DataFrame) -> DataFrame:
    """Adds ``area`` and the centroid ``cx, cy, cz``."""
    a, b, c = points_of()
    return cornered.withColumns({"area": G.triangle_area(a, b, c), **{f"c{n}": (a[i] + b[i] + c[i]) / 3 for i, n in enumerate("xyz")}})


def edges(faces: DataFrame) -> DataFrame:
    """Three rows a face: ``(fid, a, b)`` with a < b."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))))
    return faces.select("fid", F.explode(pairs).alias("e")).select("fid", "e.a", "e.b")


def adjacency(faces: DataFrame) -> DataFrame:
    """Links ``(f, g)`` that connect all faces of each edge: to the edge's least face, so an edge of many faces gives a star, not all pairs."""
    e = edges(faces)
    low = e.groupBy("a", "b").agg(F.min("fid").alias("f"))
    return e.join(low, ["a", "b"]).where("fid <> f").select("f", F.col("fid").alias("g")).distinct()


def clusters(faces: DataFrame, label: str = "clusters") -> DataFrame:
    """``(fid, cluster)`` of every face that shares an edge with another; cluster is the least fid."""
    return components(adjacency(faces).select(F.col("f").alias("a"), F.col("g").alias("b")), label).select(F.col("node").alias("fid"), F.col("root").alias("cluster"))


def large_clusters(faces: DataFrame, least: int = 25, share: float = 0.002) -> DataFrame:
    """Faces in clusters of at least ``least`` faces and that share of all; lone faces are clusters of one."""
    c = faces.join(clusters(faces), "fid", "left").withColumn("cluster", F.coalesce("cluster", "fid"))
    size = c.groupBy("cluster").agg(F.count("*").alias("_n"))
    total = faces.agg(F.count("*").alias("_t"))
    return c.join(size, "cluster").crossJoin(F.broadcast(total)).where((F.col("_n") >= least) & (F.col("_n") >= share * F.col("_t"))).drop("cluster", "_n", "_t")


def heights(faces: DataFrame, vertices: DataFrame, chosen: Column, least: float = 2.0) -> DataFrame:
    """Height range of every connected region of chosen faces, kept above ``least``; faces without a neighbour do not count."""
    some = faces.where(chosen)
    c = corners(some, vertices).join(clusters(some), "fid")
    top, low = F.max(F.greatest("z0", "z1", "z2")), F.min(F.least("z0", "z1", "z2"))
    return c.groupBy("cluster").agg((top - low).alias("height"), F.count("*").alias("faces")).where(F.col("height") > least)


def health(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: isolated vertices, faces with unknown corners, degenerate faces, edges of more than two faces."""
    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    isolated = vertices.join(used, "vid", "left_anti").agg(F.count("*").alias("isolated_vertices"))
    unknown = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(vertices, "vid", "left_anti").agg(F.count_distinct("fid").alias("invalid_faces"))
    flat = faces.agg(F.count_if((F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))).alias("degenerate_faces"))
    crowded = edges(faces).groupBy("a", "b").agg(F.count_distinct("fid").alias("n")).where("n > 2").agg(F.count("*").alias("non_manifold_edges"))
    return isolated.crossJoin(unknown).crossJoin(flat).crossJoin(crowded)  # one row each


def visible(cornered: DataFrame, project, width: int, height: int) -> DataFrame:
    """Faces whose three corners lie in front of a camera and a pixel inside its image. ``project(x, y, z)`` gives (u, v, depth)."""
    ok = F.lit(True)
    for p in points_of():
        u, v, depth = project(*p)
        ok = ok & (depth > 0) & u.between(1, width - 2) & v.between(1, height - 2)
    return cornered.where(F.coalesce(ok, F.lit(False)))


def best_view(weights: DataFrame) -> DataFrame:
    """From ``(fid, view, weight)``: the heaviest view of each face, the first on ties, none without weight."""
    best = F.max(F.struct("weight", (-F.col("view")).alias("v")))
    return weights.groupBy("fid").agg(best.alias("b")).select("fid", F.when(F.col("b.weight") > 0, -F.col("b.v")).alias("view"))


def surface_matches(points: DataFrame, faces: DataFrame, vertices: DataFrame, radius: float, side: float | None = None) -> DataFrame:
    """Closest surface point of each of ``points(id, x, y, z)`` on faces that have a corner within ``radius``: ``(id, fid, distance)``; points without one drop.

    Corners are dealt into cubes of the radius and met by equality in a cube and its neighbours, never all by all.
    """
    h = side or radius
    cells = [F.floor(F.col(c) / h) for c in "xyz"]
    v = vertices.select("vid", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), *(c.alias(f"k{n}") for c, n in zip(cells, "xyz", strict=True)))
    q = points.select("id", "x", "y", "z", *(c.alias(f"c{n}") for c, n in zip(cells, "xyz", strict=True)))
    reach = int(-(-radius // h))
    for n in "xyz":
        q = q.withColumn(f"k{n}", F.explode(F.sequence(F.col(f"c{n}") - reach, F.col(f"c{n}") + reach)))
    p, w = (F.col("x"), F.col("y"), F.col("z")), (F.col("vx"), F.col("vy"), F.col("vz"))
    near = q.join(v, ["kx", "ky", "kz"]).where(G.distance(p, w) <= radius).select("id", "x", "y", "z", "vid")
    faces = faces.groupBy("v0", "v1", "v2").agg(F.min("fid").alias("fid"))  # of faces with equal corners the least is the closest
    corner = faces.select("fid", "v0", "v1", "v2", F.explode(F.array_distinct(F.array("v0", "v1", "v2"))).alias("vid"))
    some = near.join(corner, "vid").select("id", "x", "y", "z", "fid", "v0", "v1", "v2").distinct()
    _, d = G.closest_on_triangle(p, *points_of())
    return corners(some, vertices).groupBy("id").agg(F.min(F.struct(d.alias("distance"), "fid")).alias("m")).select("id", "m.fid", "m.distance")
