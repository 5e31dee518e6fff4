"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has a bit set where over half of its word shingles' XXH64
hashes have it. Fingerprints link at ``radius`` or fewer differing bits, and the
components of links are the near-duplicate groups.

Search runs over distinct fingerprints. A vantage-point tree, built on the driver
from a bounded sample (``SAMPLE``), splits the space by Hamming distance to its
vantage points into at most ``2**DEPTH`` leaf shards. A fingerprint lives in one
leaf and also visits, as a query, every later leaf that the triangle bound
``|d(x, v) - mu| <= radius`` does not exclude, so each linking pair meets in
exactly the later one's leaf. Leaves are dealt in units of at most ``HOMES``
residents and about ``GUESTS`` visitors (counted beforehand, hash-dealt), so no
task holds an unbounded group; each unit prunes with a vantage-point tree of its
own, verifies distances exactly, and reports a star per local group instead of
pairs. Stars are joined by :func:`components`.

In a space of random 64-bit fingerprints a radius of 4 covers about a standard
deviation of the distances, so a binary split sends some two thirds of queries both
ways: work grows as about N**1.75, not N log N (see README for figures).

Edge cases: null and empty texts have fingerprint zero and link like any other;
texts shorter than a shingle hash as a whole; equal fingerprints share a group;
rows with a null doc_id get their group's id but never name one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .storage import materialise, table
from .textkernel import LOWER, mix64

SHINGLE = 4
RADIUS = 4
SEED = 42
SAMPLE = 8192
LEAF_TARGET = 16384
DEPTH = 12
HOMES = 32768
GUESTS = 1 << 18
_LOWER = LOWER.tobytes()
_BLOCK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 bytes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        value = digest(line, SEED)
        return value - (1 << 64) if value >> 63 else value
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h)).view(np.int64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fp = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hamming(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


@dataclass
class Tree:
    """A vantage-point tree. ``items``: of a leaf, positions in the points it was built from; ``leaf``: its number."""

    vantage: np.uint64 | None = None
    mu: int = 0
    inner: Tree | None = None
    outer: Tree | None = None
    items: np.ndarray | None = None
    leaf: int = -1


def build(points: np.ndarray, leaf_size: int, depth: int = 64) -> tuple[Tree, int]:
    """A tree over ``points`` and its number of leaves. The vantage point and radius with the least mass near the boundary win."""
    count = 0

    def grow(at: np.ndarray, left: int) -> Tree:
        nonlocal count
        if len(at) > leaf_size and left > 0:
            p, best = points[at], None
            for c in at[:: max(1, len(at) // 4)][:4]:
                d = hamming(p, points[c])
                mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
                for m in (mu - 1, mu):
                    share = float((d <= m).mean())
                    if 0.1 <= share <= 0.9:
                        cost = float((np.abs(d - m) <= RADIUS).mean()) + abs(share - 0.5) / 2
                        if best is None or cost < best[0]:
                            best = (cost, points[c], m, d <= m)
            if best is not None:
                _, v, m, near = best
                return Tree(v, m, grow(at[near], left - 1), grow(at[~near], left - 1))
        count += 1
        return Tree(items=at, leaf=count - 1)

    return grow(np.arange(len(points)), depth), count


def visit(tree: Tree, queries: np.ndarray, radius: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Leaves with the positions of the queries whose ball may reach into them."""
    stack = [(tree, np.arange(len(queries)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node.vantage is None:
            yield node, at
            continue
        d = hamming(queries[at], node.vantage)
        stack.append((node.outer, at[d + radius > node.mu]))
        stack.append((node.inner, at[d - radius <= node.mu]))


def homes_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf in whose region each point lies."""
    out = np.zeros(len(points), np.int64)
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if node.vantage is None:
            out[at] = node.leaf
        elif len(at):
            near = hamming(points[at], node.vantage) <= node.mu
            stack += [(node.inner, at[near]), (node.outer, at[~near])]
    return out


def local_stars(homes: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars ``(point, smallest point of its group)`` of the links home-home and guest-home."""
    every = np.concatenate([homes, guests])
    n = len(every)
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while True:
            up = parent[r]
            if (up == r).all():
                parent[x] = r
                return r
            r = up

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    linked = np.zeros(n, bool)
    tree, _ = build(homes, 64)
    for leaf, at in visit(tree, every, radius):
        side = homes[leaf.items]
        step = max(1, _BLOCK // len(side))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            q, h = np.nonzero(np.bitwise_count(every[part][:, None] ^ side[None, :]) <= radius)
            q, h = part[q], leaf.items[h]
            other = q != h
            q, h = q[other], h[other]
            if not len(q):
                continue
            linked[q] = linked[h] = True
            rq, rh = roots(q), roots(h)
            apart = rq != rh
            if apart.any():
                for x, y in np.unique(np.stack([rq[apart], rh[apart]], 1), axis=0).tolist():
                    x, y = find(x), find(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
    at = np.flatnonzero(linked)
    r = roots(at) if len(at) else at
    signed = every.view(np.int64)
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, r, signed[at])
    return signed[at], low[r]


def _deal(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix64(keys) % parts.astype(np.uint64)).astype(np.int64)


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars ``(a, b)`` that connect exactly the distinct fingerprints ``nodes(fp)`` which links connect."""
    spark = nodes.sparkSession
    count = nodes.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, count) / LEAF_TARGET)))))
    taken = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree, n_leaves = build(taken, 1, depth)

    def guests_of(fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for leaf, at in visit(tree, fp, radius):
            yield leaf.leaf, at[home[at] < leaf.leaf]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_home, n_guest = np.zeros(n_leaves, np.int64), np.zeros(n_leaves, np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            home = homes_of(tree, fp)
            n_home += np.bincount(home, minlength=n_leaves)
            for leaf, at in guests_of(fp, home):
                n_guest[leaf] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_leaves)), pa.array(n_home), pa.array(n_guest)], ["leaf", "h", "g"])

    sizes = nodes.select("fp").mapInArrow(tally, "leaf long, h long, g long").groupBy("leaf").agg(F.sum("h").alias("h"), F.sum("g").alias("g")).collect()  # one row per leaf
    n_home, n_guest = np.zeros(n_leaves, np.int64), np.zeros(n_leaves, np.int64)
    for r in sizes:
        n_home[r["leaf"]], n_guest[r["leaf"]] = r["h"], r["g"]
    home_parts = np.maximum(1, -(-n_home // HOMES))
    guest_parts = np.maximum(1, -(-(n_guest + n_home * (home_parts > 1)) // GUESTS))
    base = np.concatenate([[0], np.cumsum(home_parts * guest_parts)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            home = homes_of(tree, fp)
            part = _deal(fp, home_parts[home])

            sent: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
            for g in range(int(guest_parts.max(initial=1))):  # residents go to every share of the guests
                at = np.flatnonzero(g < guest_parts[home])
                sent[True].append((base[home[at]] + part[at] * guest_parts[home[at]] + g, fp[at]))
            for p in range(1, int(home_parts.max(initial=1))):  # and visit the later parts of their own leaf
                at = np.flatnonzero((p < home_parts[home]) & (part < p))
                sent[False].append((base[home[at]] + p * guest_parts[home[at]] + _deal(fp[at] + np.uint64(1), guest_parts[home[at]]), fp[at]))
            for leaf, at in guests_of(fp, home):
                g = _deal(fp[at] + np.uint64(1), guest_parts[np.full(len(at), leaf)])
                sent[False] += [(base[leaf] + p * guest_parts[leaf] + g, fp[at]) for p in range(int(home_parts[leaf]))]
            for resident, parts in sent.items():
                unit, item = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), fp[:0])
                order = np.argsort(unit, kind="stable")
                units, first = np.unique(unit[order], return_index=True)
                packs = [x.tobytes() for x in np.split(item[order], first[1:])] if len(units) else []
                yield pa.RecordBatch.from_arrays([pa.array(units.astype(np.int64)), pa.array(packs, pa.binary()), pa.array([resident] * len(units), pa.bool_())], ["unit", "pack", "resident"])

    def search(units: pa.Table) -> pa.Table:
        side = {True: [np.zeros(0, np.uint64)], False: [np.zeros(0, np.uint64)]}
        for pack, resident in zip(units.column("pack"), units.column("resident").to_pylist(), strict=True):
            side[resident].append(np.frombuffer(pack.as_buffer(), np.uint64))
        homes, guests = np.concatenate(side[True]), np.concatenate(side[False])
        a, b = local_stars(homes, guests, radius) if len(homes) else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a, "b": b})

    # fingerprints travel packed: a row for each unit and batch, eight bytes a fingerprint
    dealt = nodes.select("fp").mapInArrow(deal, "unit long, pack binary, resident boolean")
    # units are light in bytes and heavy in work: a stated number keeps them from being put together by size
    parts = max(1, min(4 * int(base[-1]), 1 << 14))
    return dealt.repartition(parts, "unit").groupBy("unit").applyInArrow(search, "a long, b long")


def groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document."""
    prints = materialise(fingerprints(documents, shingle), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(near_links(nodes, radius), "near").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp").select("fp", "root", "first_id")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = rooted.join(named, "root").select("fp", "component_id")
    ids = nodes.join(linked, "fp", "left").select(F.col("fp").alias("k"), F.coalesce("component_id", "first_id").alias("component_id"))
    ids = materialise(ids, "ids")  # a plain scan on either side lets a hot fingerprint's partition be split
    return prints.join(ids, F.col("fp") == F.col("k")).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_simhash_near_dedup``: every document's fingerprint and group."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows without an id stay."""
    keep = groups(documents, shingle, radius).where("doc_id = component_id").select("doc_id")
    stay = documents.join(keep, documents["doc_id"] == keep["doc_id"], "left_semi")
    return stay.unionByName(documents.where(documents["doc_id"].isNull()))
