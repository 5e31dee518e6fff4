"""One document of each group of near copies: five-word shingle sets of Jaccard similarity 0.8 or more.

Every pair at or above the bound is linked and no other, so the components do not
depend on a search radius. Candidates come in two ways, and each link is verified
on the whole shingle sets:

* SimHash stars of the vantage-point search (:mod:`simhash`) join copies that are nearly equal;
* prefix filtering finds the pairs that SimHash misses. With shingles in one global
  order, two sets of similarity t share one of the first ``n - ceil(t n) + 1``. The
  order puts shingles that are common in a sample last; any order gives the same
  pairs, so the sample bears on time only.

A candidate pair first meets as two bitmaps (2 to 4 bits a shingle): a bit of one that
the other lacks is a shingle that the other lacks, so the bitmaps bound the common
shingles from above and no similar pair is lost. Whole sets are built, from the
texts, only for the few pairs that pass.

Pairs of buckets of at most ``FEW`` sets are listed. Larger ones are met leader by leader:
a round compares some members with all others, links what passes, and takes them out. A
bucket ends when one component holds all that is left in it, so a large group of copies
costs a star and not all its pairs; leaders grow fourfold, so rounds grow with the
logarithm of the largest bucket of unlike texts.

Edge cases: words are as in :mod:`simhash` (ASCII case folded); texts of fewer than
five words are one shingle; null, empty and blank texts are copies of each other;
of equal rows one stays; a row without an id stays if no row of its group has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .simhash import RADIUS, near_links
from .storage import materialise
from .textkernel import LOWER, Texts, mix64, slices

SHINGLE = 5
SAMPLE = 16384
SLOTS = 1 << 25
FEW = 8
BEFORE = 4
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _chain(words: list[np.ndarray]) -> np.ndarray:
    return mix64(reduce(lambda h, w: mix64(h * _ODD + w), words))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text; nothing for a text without words."""
    for _, _, t in slices(column):
        low = Texts(LOWER[t.buf], t.off)
        starts, ends = low.words()
        w = low.span_hash(low.prefix_hash(), starts, ends)
        at = np.searchsorted(starts, t.off).tolist()
        every = _chain([w[k : len(w) - shingle + 1 + k] for k in range(shingle)]) if len(w) >= shingle else w[:0]
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= shingle:
                yield np.unique(every[a : b - shingle + 1])
            else:
                yield _chain([w[k : k + 1] for k in range(a, b)]) if b > a else w[:0]


def key_of(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    return int(mix64(np.array([mix64(s ^ _ODD).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _fingerprint(s: np.ndarray) -> int:
    if not len(s):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(s)).view(np.int64)[0])


def _texts(documents: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``; ``row`` names a row by its id and text, so equal rows share it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(_row(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")


def _row(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"), doc_id.isNull(), text.isNull())


def _common(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more of a bounded sample of rows have, ascending, and their counts."""
    n = max(1, documents.count())
    some = _texts(documents).where(F.pmod("row", F.lit(n)) < SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    rows = some.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 1").toArrow()
    h, count = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def bitmap(s: np.ndarray) -> bytes:
    """A set as 2 to 4 bits a shingle, 64 at least."""
    bits = 1 << max(6, (2 * max(1, len(s)) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) | (x & ((1 << bits) - 1))
    return x


def may_match(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Can sets of ``n`` and ``m`` shingles with these bitmaps be similar? Never False for similar ones."""
    bits = 8 * min(len(x), len(y))
    a, b = _folded(int.from_bytes(x, "little"), 8 * len(x), bits), _folded(int.from_bytes(y, "little"), 8 * len(y), bits)
    both = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 9 * both >= 4 * (n + m)


def _rank(order: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """How often the sample has each shingle; 0 for what it has once or never. The global order is by this, then by value."""
    common, counts = order
    if not len(common):
        return np.zeros(len(s), np.int64)
    k = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return np.where(common[k] == s, counts[k], 0)


def _prints(documents: DataFrame, order: Broadcast) -> DataFrame:
    """``(row, doc_id, key, n, fp, bits, prefix)``: name, size, fingerprint and bitmap of the set, and the first of its shingles in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps, maps, firsts = [], [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                keys.append(key_of(s))
                sizes.append(n)
                fps.append(_fingerprint(s))
                maps.append(bitmap(s))
                firsts.append(s[np.argsort(_rank(order.value, s), kind="stable")][: n - (4 * n + 4) // 5 + 1].view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(maps, pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "key", "n", "fp", "bits", "prefix"])

    return _texts(documents).mapInArrow(run, "row long, doc_id long, key long, n long, fp long, bits binary, prefix array<long>")


def _slots(values: DataFrame) -> np.ndarray:
    """A packed bitmap with the slot of every value of a one-column table set: at most ``SLOTS / 64`` rows reach the driver.

    It only thins what comes next; values that share a slot with a wanted one are told apart later.
    """
    slot = F.pmod(F.col(values.columns[0]), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    rows = values.select(F.floor(slot / 64).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _in_slots(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values % SLOTS
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _buckets(prints: DataFrame, order: Broadcast) -> DataFrame:
    """``(token, rank, key, n, rest)`` of prefix shingles that several sets have (and a few others); ``rest`` counts the set's shingles from it on."""
    several = prints.select(F.explode("prefix").alias("token"), "key").groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    shared = prints.sparkSession.sparkContext.broadcast(_slots(several.select("token")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(off))
            at = np.flatnonzero(_in_slots(shared.value, flat))
            token, n = flat[at], batch.column("n").to_numpy()[row[at]]
            columns = (token, _rank(order.value, token.view(np.uint64)), batch.column("key").to_numpy()[row[at]], n, n - (at - off[row[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "rank", "key", "n", "rest"])

    return prints.select("key", "n", "prefix").mapInArrow(run, "token long, rank long, key long, n long, rest long").distinct()


def _sets(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``(key, hashes)`` of the sets of all wanted ``rows(row)`` (and a few others), each once."""
    wanted = documents.sparkSession.sparkContext.broadcast(_slots(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_in_slots(wanted.value, batch.column("row").to_numpy())))
            found = [(key_of(s), s.tobytes()) for s in shingle_sets(some.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["key", "hashes"])

    found = _texts(documents).select("row", "text").mapInArrow(run, "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
    found = materialise(found, "shingle_sets")
    wanted.destroy()
    return found


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Is the Jaccard similarity of two ascending sets 0.8 or more?"""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _verified(documents: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are similar; ``sets(key, row, n, bits)`` has each set once."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(c).to_pylist() for c in ("n", "x", "m", "y"))
            yield batch.select(["a", "b", "ra", "rb"]).filter(pa.array(list(map(may_match, n, x, m, y)), pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = [similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("n"), F.col("bits").alias("x"), F.col("row").alias("ra"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"), F.col("row").alias("rb"))
    likely = materialise(pairs.join(one, "a").join(two, "b").select("a", "n", "x", "ra", "b", "m", "y", "rb").mapInArrow(screen, "a long, b long, ra long, rb long"), "likely_pairs")
    rows = likely.select(F.explode(F.array("ra", "rb")).alias("row"))
    whole = _sets(documents, rows)
    one, two = whole.select(F.col("key").alias("a"), F.col("hashes").alias("x")), whole.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    return materialise(likely.join(one, "a").join(two, "b").select("a", "x", "b", "y").mapInArrow(compare, "a long, b long"), "links")


def _stars(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of every set with the least one of its SimHash group."""
    nodes = materialise(prints.groupBy("key").agg(F.first("fp").alias("fp")), "sets_fp")
    fps = materialise(nodes.select("fp").distinct(), "fps")
    roots = components(near_links(fps, RADIUS), "near").withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("group"))
    low = named.groupBy("group").agg(F.min("key").alias("b"))
    return named.join(low, "group").where("key <> b").select(F.col("key").alias("a"), "b")


def _met(rows: DataFrame, others: DataFrame, apart: str) -> DataFrame:
    """Distinct pairs ``(a, b)`` that share a bucket and whose sizes and places in the order leave room for enough common shingles.

    The places tell at the first bucket that both share; a pair that shares one just
    before is met there.
    """
    a, b = rows.alias("a"), others.alias("b")
    enough = f"{apart} AND 9 * least(a.rest, b.rest) >= 4 * (a.n + b.n) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) AND NOT arrays_overlap(a.before, b.before)"
    return a.join(b, F.col("a.token") == F.col("b.token")).where(enough).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _merged(rows: DataFrame) -> DataFrame:
    """Buckets of one set go, and buckets with the same sets become one: ``(token, key, n, rest, m, before)``, ``m``
    being their number and ``before`` the last few buckets of the set in the global order of their first shingles.

    Copies share some hundred tokens each, so this leaves a few rows of each hundred. A
    bucket is named by the sum and parity of its sets' names; should two unlike ones get
    one name, their union is looked at.
    """
    name = F.xxhash64("key")
    members = rows.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("m"), F.sum(name % (1 << 40)).alias("s"), F.bit_xor(name).alias("x")).where("m > 1")
    # stored order is by unsigned value: the sign bit is turned
    place = F.struct("rank", F.col("t").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("value"))
    named = rows.join(members, F.col("token") == F.col("t")).select(F.xxhash64("m", "s", "x").alias("token"), "key", "n", "rest", "m", place.alias("place"))
    named = named.groupBy("token", "key").agg(F.first("n").alias("n"), F.max("rest").alias("rest"), F.first("m").alias("m"), F.min("place").alias("place"))
    before = Window.partitionBy("key").orderBy("place").rowsBetween(-BEFORE, -1)
    return named.withColumn("before", F.collect_list("token").over(before)).drop("place")


def groups(documents: DataFrame, prints: DataFrame, order: Broadcast) -> DataFrame:
    """``(node, root)`` of every set with a near copy of another set."""
    sets = prints.groupBy("key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = materialise(sets, "sets")
    rows = materialise(_merged(_buckets(prints, order)), "buckets")
    few = rows.where(F.col("m") <= FEW)
    pairs = _met(few, few, "a.key < b.key")  # at most FEW * (FEW - 1) / 2 a bucket
    found = _verified(documents, pairs.unionByName(_stars(prints)).distinct(), sets)
    roots = components(found, "copies")
    rows = rows.where(F.col("m") > FEW)
    leaders, turn = FEW, 0
    while True:
        named = rows.select("token", "key", "n", "rest", "before").join(roots, F.col("key") == F.col("node"), "left").select("token", "key", "n", "rest", "before", F.coalesce("root", "key").alias("root"))
        live = named.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        drawn = F.pmod(F.xxhash64("key", F.lit(turn)), F.col("m")) < leaders
        rows = materialise(named.join(live, F.col("token") == F.col("t")).select("token", "key", "n", "rest", "before", "root", drawn.alias("leads")), "live")
        if rows.isEmpty():
            return roots
        links = _verified(documents, _met(rows, rows.where("leads"), "a.root <> b.root"), sets)
        if not links.isEmpty():
            roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "copies")
        rows = rows.where("NOT leads")
        leaders, turn = 4 * leaders, turn + 1


def first_of_copies(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, one with the smallest doc_id.

    Only rows that go, those that repeat, and the few that share a slot with them are
    shuffled with their texts; all others stay where they are.
    """
    order = documents.sparkSession.sparkContext.broadcast(_common(documents))
    prints = materialise(_prints(documents, order), "shingle_prints")
    roots = groups(documents, prints, order)
    ids = prints.groupBy("key", "doc_id", "row").agg(F.count("*").alias("copies"))
    named = ids.join(roots, F.col("key") == F.col("node"), "left")
    first = named.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")).alias("f"))
    stay = materialise(first.select(F.col("f.row").alias("_first"), F.col("f.copies").alias("_copies")), "first")
    gone = ids.join(stay, F.col("row") == stay["_first"], "left_anti").select("row")
    doubt = documents.sparkSession.sparkContext.broadcast(_slots(gone.unionByName(stay.where("_copies > 1").select(F.col("_first").alias("row")))))
    name = "_near_copy_row"
    keyed = documents.withColumn(name, _row(F.col("doc_id"), F.col("text")))

    def part(doubtful: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_in_slots(doubt.value, batch.column(name).to_numpy()) == doubtful))

        return keyed.mapInArrow(run, keyed.schema)

    left = part(True)
    left = left.join(stay, left[name] == stay["_first"], "left_semi").dropDuplicates([name])
    return part(False).unionByName(left).select(*documents.columns)
