"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def components(edges: DataFrame, label: str = "components", peel: bool = False) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``, root being the component's smallest node.

    Self-loops and repeated edges are allowed; null ends are left out. ``peel`` is for
    graphs whose nodes mostly have one neighbour. Such leaves join nothing, so only edges
    between other nodes go through the rounds; a leaf gives its neighbour its name, if
    smaller, and takes the neighbour's root.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    return _peeled(materialise(edges, f"{label}_edges"), label) if peel else _rounds(edges, label)


def _peeled(edges: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` of ``edges(a, b)`` without nulls, leaves last."""
    # every node with its neighbours; a pair of equal ends stands for a lone node
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("one"), (F.min("b") == F.max("b")).alias("leaf"))
    nodes = materialise(nodes, f"{label}_nodes")
    leaves = nodes.where("leaf").select(F.col("node").alias("l"), F.col("one").alias("hub"))
    # a leaf whose neighbour is a leaf is half a pair
    hubs = nodes.where("NOT leaf").select(F.col("node").alias("h"))
    met = materialise(leaves.join(hubs, F.col("hub") == F.col("h"), "left").select("l", "hub", F.col("h").isNull().alias("pair")), f"{label}_leaves")
    pairs = met.where("pair").select(F.col("l").alias("node"), F.least("l", "hub").alias("root"))
    hung = met.where("NOT pair")
    inner = edges.where("a <> b").join(hubs, F.col("a") == F.col("h"), "left_semi").join(hubs, F.col("b") == F.col("h"), "left_semi")
    core = _rounds(inner, label)
    # hubs of leaves alone have no inner edge: they are their own component
    core = hubs.join(core, F.col("h") == F.col("node"), "left").select(F.col("h").alias("node"), F.coalesce("root", "h").alias("part"))
    core = materialise(core, f"{label}_core")
    least = hung.groupBy("hub").agg(F.min("l").alias("low"))
    roots = core.join(least, F.col("node") == F.col("hub"), "left").groupBy(F.col("part").alias("_part")).agg(F.min(F.least("part", "low")).alias("root"))
    named = materialise(core.join(roots, F.col("part") == F.col("_part")).select("node", "root"), f"{label}_roots")
    taken = hung.join(named, F.col("hub") == F.col("node")).select(F.col("l").alias("node"), "root")
    lone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(nodes.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return named.unionByName(taken).unionByName(pairs).unionByName(lone.select("node", F.col("node").alias("root")))


def _rounds(edges: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` of ``edges(a, b)`` without nulls, by rounds.

    Each round writes its edges to the shared folder, so lineage stays short and a
    lost executor costs a re-read. A node with very many neighbours is met as partial
    minima and in equi-joins that adaptive execution splits. Rounds grow with the
    logarithm of the longest path.
    """
    # every edge from its larger to its smaller end; loops keep lone nodes
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("k"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        now = materialise(small.where("u >= v").distinct(), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        seen = state
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
