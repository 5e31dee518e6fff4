"""Normals of a cloud, turned to one side, and registration of one cloud on another.

*Normals* are the directions in which a point's neighbours spread least. To give all of
a piece of surface one side, Borůvka's rounds build the spanning tree of the neighbour
graph whose edges bend least: every component takes its least edge (a grouped minimum),
the two ends of a mutual choice get one root, and roots are found by pointer jumping,
which carries the sign along. Components at least halve in number a round, and nothing
but the point table and the edge table is rewritten. The highest point of each
component then decides which side is out.

*Registration* repeats a neighbour join and a rigid fit to its pairs; a step sends one
row of moments to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .space import LEAF, neighbours
from .transform import Similarity, moments, solve

_AXES = "xyz"


def _smallest_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("xx", "xy", "xz", "yy", "yz", "zz")}
            m = np.stack([np.stack([c["xx"], c["xy"], c["xz"]], 1), np.stack([c["xy"], c["yy"], c["yz"]], 1), np.stack([c["xz"], c["yz"], c["zz"]], 1)], 1)
            n = np.linalg.eigh(m)[1][:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(n[:, k]) for k in range(3))], ["id", "nx", "ny", "nz"])


def normals(points: DataFrame, k: int = 12, leaf_rows: int = LEAF) -> DataFrame:
    """``(id, x, y, z, nx, ny, nz)``: unit normals, each connected piece with one side out. Points need two neighbours at least."""
    points = materialise(points.select("id", *(F.col(c).cast("double").alias(c) for c in _AXES)), "cloud")
    there = points.withColumns({f"p{c}": F.col(c) for c in _AXES})
    near = materialise(neighbours(points, there, k + 1, leaf_rows, keep=[f"p{c}" for c in _AXES]), "near")
    cov = [F.covar_pop(f"p{a}", f"p{b}").alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    rows = near.groupBy("id").agg(F.count("*").alias("n"), *cov).where("n > 2").drop("n")
    plain = materialise(rows.mapInArrow(_smallest_axis, f"id {dict(points.dtypes)['id']}, nx double, ny double, nz double"), "normals")
    at = lambda n, other: plain.select(F.col("id").alias(n), *(F.col(f"n{c}").alias(f"{other}{c}") for c in _AXES))
    pairs = near.where("id <> point_id").select(F.least("id", "point_id").alias("a"), F.greatest("id", "point_id").alias("b")).distinct()
    along = sum((F.col(f"u{c}") * F.col(f"v{c}") for c in "yz"), F.col("ux") * F.col("vx"))
    edges = pairs.join(at("a", "u"), "a").join(at("b", "v"), "b").select("a", "b", (1 - F.abs(along)).alias("w"), F.when(along < 0, -1).otherwise(1).alias("turn"))
    signed = turned(plain.select("id"), materialise(edges, "edges"))
    found = points.join(plain, "id").join(signed, F.col("id") == F.col("node"))
    top = found.groupBy(F.col("root").alias("r")).agg(F.max(F.struct("z", "id", (F.col("nz") * F.col("sign")).alias("up"))).alias("t"))
    sign = F.col("sign") * F.when(F.col("t.up") < 0, -1).otherwise(1)
    return found.join(top, F.col("root") == F.col("r")).select("id", *_AXES, *((F.col(f"n{c}") * sign).alias(f"n{c}") for c in _AXES))


def turned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root, sign)`` of ``nodes(id)``: signs that agree with ``turn`` along a minimum spanning forest of ``edges(a, b, w, turn)``."""
    now = materialise(nodes.select(F.col("id").alias("node"), F.col("id").alias("root"), F.lit(1).alias("sign")), "forest")
    while True:
        end = lambda n, r, s: now.select(F.col("node").alias(n), F.col("root").alias(r), F.col("sign").alias(s))
        out = edges.join(end("a", "ra", "sa"), "a").join(end("b", "rb", "sb"), "b").where("ra <> rb")
        out = out.select("a", "b", "w", "ra", "rb", (F.col("sa") * F.col("sb") * F.col("turn")).alias("rel"))
        both = out.select(F.col("ra").alias("c"), F.struct("w", "a", "b", F.col("rb").alias("to"), "rel").alias("e")).unionByName(out.select(F.col("rb").alias("c"), F.struct("w", "a", "b", F.col("ra").alias("to"), "rel").alias("e")))
        best = materialise(both.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.to", "e.rel"), "least_edges")
        if best.isEmpty():
            return now
        back = best.select(F.col("c").alias("d"), F.col("to").alias("d_to"))
        # edges are in one strict order, so the only rings are mutual choices
        root = (F.col("d_to") == F.col("c")) & (F.col("c") < F.col("to"))
        up = best.join(back, F.col("to") == F.col("d")).select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to"), F.when(root, 1).otherwise(F.col("rel")).alias("rel"))
        up = materialise(up, "parents")
        while True:
            above = up.select(F.col("c").alias("d"), F.col("to").alias("d_to"), F.col("rel").alias("d_rel"))
            met = up.join(above, F.col("to") == F.col("d")).select("c", F.col("d_to").alias("to"), (F.col("rel") * F.col("d_rel")).alias("rel"), (F.col("d_to") != F.col("to")).alias("moved"))
            met = materialise(met, "parents")
            up = met.drop("moved")
            if met.where("moved").isEmpty():
                break
        moved = now.join(up, F.col("root") == F.col("c"), "left")
        now = materialise(moved.select("node", F.coalesce("to", "root").alias("root"), (F.col("sign") * F.coalesce("rel", F.lit(1))).alias("sign")), "forest")


def register(source: DataFrame, target: DataFrame, within: float, start: Similarity | None = None, rounds: int = 30, settled: float = 1e-6, leaf_rows: int = LEAF) -> tuple[Similarity, float, float]:
    """Rigid motion of ``source(id, x, y, z)`` onto ``target``, the share of source points with a target point ``within`` reach, and their RMSE.

    Ends when share and RMSE change by less than ``settled``; without any pair the start is returned, with 0 and 0.
    """
    t = start or Similarity.identity()
    source = materialise(source.select("id", *(F.col(c).cast("double").alias(c) for c in _AXES)), "source")
    there = target.select("id", *_AXES, *(F.col(c).alias(f"d{c}") for c in _AXES))
    total, before = source.count(), (-1.0, -1.0)
    for step in range(rounds + 1):
        moved = source.select("id", *(c.alias(n) for c, n in zip(t.apply(*(F.col(c) for c in _AXES)), _AXES, strict=True)))
        near = neighbours(moved, there, 1, leaf_rows, keep=["dx", "dy", "dz"]).where(F.col("distance") <= within)
        pairs = near.join(source.select("id", *(F.col(c).alias(f"s{c}") for c in _AXES)), "id")
        row = moments(pairs).crossJoin(near.agg(F.count("*").alias("pairs"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse"))).first().asDict()
        now = (row["pairs"] / total if total else 0.0, row["rmse"] or 0.0)
        fitted = solve(row) if row["pairs"] else None
        if fitted is None or step == rounds or max(abs(a - b) for a, b in zip(now, before, strict=True)) < settled:
            return t, *now
        mean_s, mean_d = (np.array([row[f"{v}{c}"] for c in _AXES]) / row["w"] for v in "sd")
        t, before = Similarity(1.0, fitted.rotation, mean_d - fitted.rotation @ mean_s), now
    return t, *before
