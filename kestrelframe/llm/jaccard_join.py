"""Exact Jaccard self-join of word n-gram sets by set-relation skipping.

Two sets link at a Jaccard similarity of ``NUM / DEN`` or more. With shingles in one
global order (rare ones first), linked sets share one of the first ``n - ceil(t n) + 1``
of either, so an inverted index over these prefixes finds every link. Two relations
between sets keep most of that index, and most comparisons, from being looked at:

* *Block skipping.* An index list is cut into blocks by set size and by the position
  that the shingle has in its sets. Position and size bound the overlap of whatever
  two blocks can hold (the shingle being the first that a pair shares), and pairs of
  blocks below the bound are never opened.
* *Answers from answers.* Within a pair of blocks, a set's overlaps are computed once
  for a pivot. For sets that differ from the pivot in few shingles, the pivot's
  overlaps bound theirs from both sides, which settles most answers; the others come
  from the pivot's overlap plus the change that the differing shingles make, counted
  for all of them in one matrix product. So a group of near copies costs one scan and
  products over the few shingles in which they differ, and not a comparison a pair.

Plan: equal sets are one class (named by 128 bits). Shingles are ordered by counts of
all documents in ``SLOTS`` counters, which decide the time and never the result.
Lists with the same members become one. A block has at most about ``ROWS`` sets and
``SHINGLES`` shingles, larger lists being dealt by hash, and a unit of work is a pair
of blocks: none holds more than two. Units first meet as parity signatures of a bit or two a shingle,
which bound the symmetric difference from below, and with each set's ``EARLY`` first
lists: a pair that shares an earlier list is met there. Only sets with a possible
partner left are sent whole. A unit returns a row for each of its sets: the least set it reaches
and its number of links, each link being counted at the first list that the pair
shares. Texts are read again for the sets that are sent whole.

Edge cases: A-Z are lower-cased; a text with fewer words than a shingle is one
shingle; null, empty and blank texts have an empty set and link with nothing, not
even each other. Copies link. Rows with a null doc_id get their group's id but never
name one (null if no row of the group has an id). An empty table gives no rows. Extra
columns are ignored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .near_copies import _in_slots, _slots, shingle_sets
from .storage import materialise, table
from .textkernel import mix64

SHINGLE = 3
NUM, DEN = 9, 10
SLOTS = 1 << 20
ROWS = 1024
SHINGLES = 1 << 20
#: Position classes of a list, in equal shares of the prefix.
PLACES = 4
#: Lists of a set that are looked through for an earlier meeting before it is sent whole; sets that were sent are compared by all.
EARLY = 8
_SLICE = 1 << 12
_WORDS = 8
_CHUNK = 2048


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return a, b


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles in 64 * ``_WORDS`` slots, or one to two a shingle: two signatures differ in no more bits than the sets in shingles."""
    bits = max(64 * _WORDS, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((mix64(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    """The signature of ``to`` words: slots of a longer one fall together modulo its length."""
    while len(words) > to:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


# ---- the global order ----


def shingle_ranks(documents: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """A byte for each slot that grows with the number of documents' shingles in it: ``SLOTS`` bytes for any input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), shingle):
                held.append((s % np.uint64(SLOTS)).astype(np.int64))
                size += len(s)
                if size >= SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
        for k in range(SLOTS // _SLICE):
            part = total[k * _SLICE : (k + 1) * _SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                totals.setdefault(k, np.zeros(_SLICE, np.int64))
                totals[k] += np.frombuffer(counts.as_buffer(), np.int64)
        for k, total in totals.items():
            rank = np.minimum(255, np.floor(6 * np.log2(1 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rank.tobytes()], pa.binary())], ["slice", "rank"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slice long, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in counted.repartition("slice").mapInArrow(added, "slice long, rank binary").collect():  # SLOTS bytes in all
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["rank"], np.uint8)
    return out


def _in_order(ranks: np.ndarray, s: np.ndarray) -> np.ndarray:
    """An ascending set in the global order: by rank, then by value."""
    return s[np.argsort(ranks[(s % np.uint64(SLOTS)).astype(np.int64)], kind="stable")]


# ---- the index ----


def _prints(documents: DataFrame, ranks: Broadcast, shingle: int) -> DataFrame:
    """``(doc_id, k1, k2, n, sig, prefix)`` of every row: its set's name, size, signature and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sigs, firsts = [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle):
                names.append(_name(s))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes())
                firsts.append(_in_order(ranks.value, s)[: prefix_length(len(s))].view(np.int64) if len(s) else s.view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            columns = [pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "k1", "k2", "n", "sig", "prefix"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, sig binary, prefix array<long>")


def _lists(sets: DataFrame, ranks: Broadcast) -> DataFrame:
    """``(list, first, place, set, n, rest)``: index lists of two or more sets, those with the same sets being one.

    ``first`` is the list's first shingle in the global order, ``place`` its place there, ``rest`` the number of the set's shingles from it on.
    """
    shared = sets.select(F.explode("prefix").alias("token")).groupBy("token").count().where("count > 1").select("token")
    slots = sets.sparkSession.sparkContext.broadcast(_slots(shared))  # a few shingles of one set share a slot; their lists hold no pair

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(off))
            at = np.flatnonzero(_in_slots(slots.value, flat))
            rank = ranks.value[(flat[at].view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)].astype(np.int32)
            n = batch.column("n").to_numpy()[row[at]]
            columns = (flat[at], rank, batch.column("set").to_numpy()[row[at]], n, n - (at - off[row[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "rank", "set", "n", "rest"])

    entries = materialise(sets.select("set", "n", "prefix").mapInArrow(listed, "token long, rank int, set long, n long, rest long"), "entries")
    name = F.xxhash64("set")
    tokens = entries.groupBy("token").agg(F.first("rank").alias("rank"), F.count("*").alias("m"), F.sum(name % (1 << 40)).alias("s"), F.bit_xor(name).alias("x")).where("m > 1")
    # stored order is by unsigned value: the sign bit is turned
    turned = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    lists = tokens.groupBy("m", "s", "x").agg(F.min(F.struct("rank", turned(F.col("token")).alias("value"))).alias("place"))
    # the list's first shingle stands for all its shingles; written tables on both sides let a hot one's partition be split
    lists = materialise(lists.select("place", turned(F.col("place.value")).alias("first")).withColumn("list", F.monotonically_increasing_id()), "lists")
    met = entries.join(lists, F.col("token") == F.col("first"))
    return materialise(met.select("list", "first", "place", "set", "n", "rest"), "list_members")


def _blocks(lists: DataFrame, rows: int, shingles: int) -> tuple[DataFrame, DataFrame]:
    """Members ``(list, size, place, part, first, set, n, rest)`` of blocks, and the pairs of blocks that can hold a link.

    Pairs are ``(unit, alone, list, a, b)`` with ``a`` and ``b`` being ``(size, place, part)``. A list is cut
    by size and by position; cells of more than ``rows`` sets or ``shingles`` shingles are dealt by hash.
    """
    size = F.floor(F.log("n") / float(np.log(DEN / NUM))).cast("int")
    place = F.floor((F.col("n") - F.col("rest")) * (PLACES * DEN) / (F.col("n") * (DEN - NUM))).cast("int")
    classed = lists.select("list", "first", "set", "n", "rest", size.alias("size"), place.alias("place"))
    key = ["list", "size", "place"]
    cells = classed.groupBy(*key).agg(F.count("*").alias("count"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    cells = materialise(cells.withColumn("parts", F.greatest(F.ceil(F.col("count") / rows), F.ceil(F.col("total") / shingles))), "cells")
    a, b = cells.alias("a"), cells.alias("b")
    # overlap >= t / (1 + t) of both sizes, whatever two sets the cells hold
    live = f"{NUM + DEN} * least(a.rest, b.rest, a.most, b.most) >= {NUM} * (a.least + b.least)"
    once = "(a.size < b.size OR (a.size = b.size AND (a.place < b.place OR (a.place = b.place AND a.count > 1))))"
    pairs = a.join(b, F.col("a.list") == F.col("b.list")).where(f"{live} AND {once}")
    pairs = materialise(pairs.select(F.col("a.list").alias("list"), *(F.struct(*(F.col(f"{c}.{k}").alias(k) for k in ("size", "place", "parts"))).alias(c) for c in "ab")), "cell_pairs")
    each = lambda c: F.sequence(F.lit(0).cast("long"), F.col(f"{c}.parts") - 1)
    block = lambda c, part: F.struct(F.col(f"{c}.size").alias("size"), F.col(f"{c}.place").alias("place"), F.col(part).alias("part"))
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.place") == F.col("b.place"))
    units = pairs.withColumn("i", F.explode(each("a"))).withColumn("j", F.explode(each("b"))).where(~same | (F.col("i") <= F.col("j")))
    units = units.select((same & (F.col("i") == F.col("j"))).alias("alone"), "list", block("a", "i").alias("a"), block("b", "j").alias("b"))
    units = materialise(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    kept = pairs.select("list", F.explode(F.array("a", "b")).alias("c")).select(F.col("list").alias("l"), F.col("c.size").alias("s"), F.col("c.place").alias("p"), F.col("c.parts").alias("parts")).distinct()
    kept = materialise(kept, "live_cells")
    met = classed.join(kept, (F.col("list") == F.col("l")) & (F.col("size") == F.col("s")) & (F.col("place") == F.col("p")))
    return materialise(met.select(*key, F.pmod(F.xxhash64("set"), F.col("parts")).alias("part"), "first", "set", "n", "rest"), "members"), units


# ---- units of work ----


class Side:
    """One block's sets: sizes, and whole sets as one run of shingles if they were sent."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.rest = np.array([r["rest"] for r in rows], np.int64)
        self.sig = [np.frombuffer(r["sig"], np.uint64) for r in rows]
        self.early = [np.array(_until(r["early"], r["list"]), np.int64) for r in rows]
        if rows and rows[0].get("hashes") is not None:
            self.sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]


def _until(lists: list[int], this: int) -> list[int]:
    """What of a set's first lists stands before the list ``this`` of the set."""
    return lists[: lists.index(this)] if this in lists else lists


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of ``n`` and ``m`` shingles."""
    return -(-NUM * (n[:, None] + m[None, :]) // (NUM + DEN))


def possible(a: Side, b: Side, same: bool) -> np.ndarray:
    """Which pairs sizes, positions and signatures allow; of one block with itself, each pair once."""
    need = _needed(a.n, b.n)
    out = np.minimum(np.minimum(a.n, a.rest)[:, None], np.minimum(b.n, b.rest)[None, :]) >= need
    if same:
        out &= np.arange(len(a.n))[:, None] < np.arange(len(b.n))[None, :]
    apart, words = np.zeros(out.shape, np.int64), min(len(s) for s in a.sig + b.sig)
    x, y = (np.array([_folded(s, words) for s in side.sig]) for side in (a, b))
    for w in range(words):
        apart += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    out &= apart <= a.n[:, None] + b.n[None, :] - 2 * need
    if out.any():  # and none that are met at an earlier list
        x, y = ([np.sort(e) for e in side.early] for side in (a, b))
        out &= _common_counts(x, y, _in_both(x, y, same)) == 0
    return out


def _members_of(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 matrix: which of the ascending ``columns`` each set has."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    if len(columns) and sets:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        hit = columns[at] == flat
        out[row[hit], at[hit]] = 1
    return out


def _common_counts(x: list[np.ndarray], y: list[np.ndarray], columns: np.ndarray, sign: list[np.ndarray] | None = None) -> np.ndarray:
    """How many of ``columns`` each pair has; those that a set has in ``sign`` count as -1."""
    total = np.zeros((len(x), len(y)), np.float64)
    for k in range(0, len(columns), _CHUNK):
        some = columns[k : k + _CHUNK]
        left = _members_of(x, some)
        if sign is not None:
            left -= _members_of(sign, some)
        total += left @ _members_of(y, some).T
    return total


def _in_both(x: list[np.ndarray], y: list[np.ndarray], same: bool) -> np.ndarray:
    """What two of the sets can have in common, ascending."""
    flat = np.concatenate(x)
    if not same:
        return np.intersect1d(flat, np.concatenate(y))
    v, c = np.unique(flat, return_counts=True)
    return v[c > 1]


def _shared_before(a: Side, b: Side, same: bool, ranks: np.ndarray, first: int) -> np.ndarray:
    """Pairs that share a shingle before ``first`` in the global order: they are met at that shingle's list."""
    value = np.uint64(first % (1 << 64))
    mine = int(ranks[int(value) % SLOTS])

    def before(sets: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for s in sets:
            r = ranks[(s % np.uint64(SLOTS)).astype(np.int64)]
            out.append(s[(r < mine) | ((r == mine) & (s < value))])
        return out

    x = before(a.sets)
    y = x if same else before(b.sets)
    return _common_counts(x, y, _in_both(x, y, same)) > 0


def links(a: Side, b: Side, same: bool, ranks: np.ndarray, first: int) -> np.ndarray:
    """The pairs that link and share no shingle before ``first``."""
    open_ = possible(a, b, same)
    if open_.any():
        open_ &= ~_shared_before(a, b, same, ranks, first)
    out = np.zeros(open_.shape, bool)
    while True:
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return out
        pivot = a.sets[rows[0]]
        with_rows = _overlaps(pivot, [a.sets[r] for r in rows])
        extra, lost = a.n[rows] - with_rows, len(pivot) - with_rows
        alike = extra + lost <= len(pivot) // 4  # the pivot itself is one
        rows, extra, lost = rows[alike], extra[alike], lost[alike]
        cols = np.flatnonzero(open_[rows].any(axis=0))
        theirs = [b.sets[c] for c in cols]
        with_cols = _overlaps(pivot, theirs)
        need, ask = _needed(a.n[rows], b.n[cols]), open_[np.ix_(rows, cols)]
        sure = with_cols[None, :] - lost[:, None] >= need
        never = with_cols[None, :] + extra[:, None] < need
        unsure = ask & ~sure & ~never
        found = ask & sure
        r, c = np.flatnonzero(unsure.any(axis=1)), np.flatnonzero(unsure.any(axis=0))
        if len(r):
            more = [np.setdiff1d(a.sets[rows[k]], pivot, assume_unique=True) for k in r]
            less = [np.setdiff1d(pivot, a.sets[rows[k]], assume_unique=True) for k in r]
            change = _common_counts(more, [theirs[k] for k in c], np.unique(np.concatenate([*more, *less])), less)
            exact = with_cols[None, c] + change >= need[np.ix_(r, c)]
            found[np.ix_(r, c)] |= unsure[np.ix_(r, c)] & exact
        out[np.ix_(rows, cols)] |= found
        open_[rows] = False


def _overlaps(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    if not sets:
        return np.zeros(0, np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.bincount(row[pivot[at] == flat], minlength=len(sets))


def _units(rows: DataFrame, work: Callable[[Side, Side, bool, int], Iterator[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``work`` on every unit of ``rows(unit, later, first, set, n, rest, sig, ...)``; the rows of one unit are held at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[dict]) -> Iterator[tuple]:
            sides = [Side([r for r in held if r["later"] == later]) for later in (False, True)]
            same = held[0]["alone"]
            if same or len(sides[1].rows) and len(sides[0].rows):
                yield from ((held[0]["unit"], *x) for x in work(sides[0], sides[0] if same else sides[1], same, held[0]["first"]))

        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["unit"] != held[0]["unit"]:
                    out += done(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if held and (out := list(done(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.repartition("unit").sortWithinPartitions("unit", "later", "set").mapInArrow(run, schema)


def _live(a: Side, b: Side, same: bool, _: int) -> Iterator[tuple]:
    """The sets that have a possible partner."""
    open_ = possible(a, b, same)
    left, right = open_.any(axis=1), open_.any(axis=0)
    if same:
        yield from ((a.rows[k]["set"],) for k in np.flatnonzero(left | right))
    else:
        yield from ((a.rows[k]["set"],) for k in np.flatnonzero(left))
        yield from ((b.rows[k]["set"],) for k in np.flatnonzero(right))


def _answers(found: np.ndarray, a: Side, b: Side, same: bool) -> Iterator[tuple]:
    """``(set, root, links)`` of every linked set: the least set that its links in this unit reach, and its number of linked rows."""
    rows = a.rows if same else a.rows + b.rows
    copies = np.array([r["copies"] for r in rows], np.int64)
    shift = 0 if same else len(a.rows)
    x, y = np.nonzero(found)
    y = y + shift
    count = np.zeros(len(rows), np.int64)
    np.add.at(count, x, copies[y])
    np.add.at(count, y, copies[x])
    label = np.array([r["set"] for r in rows], np.int64)
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        if (low == label).all():
            break
        label = low
    yield from ((rows[k]["set"], int(label[k]), int(count[k])) for k in np.flatnonzero(count))


# ---- the join ----


def linked_sets(documents: DataFrame, sets: DataFrame, ranks: Broadcast, shingle: int = SHINGLE, rows: int = ROWS, shingles: int = SHINGLES) -> DataFrame:
    """``(set, root, links)`` rows, some sets having several: which sets' links connect them, and how many rows each links with."""
    lists = _lists(sets, ranks)
    members, units = _blocks(lists, rows, shingles)
    both = F.array(F.struct(F.col("a").alias("block"), F.lit(False).alias("later")), F.struct(F.col("b").alias("block"), F.lit(True).alias("later")))
    sides = units.select("unit", "alone", F.col("list").alias("l"), F.explode(both).alias("s")).where("NOT (alone AND s.later)")
    sides = sides.select("unit", "alone", "l", "s.later", *(F.col(f"s.block.{c}").alias(f"_{c}") for c in ("size", "place", "part")))
    here = (F.col("list") == F.col("l")) & (F.col("size") == F.col("_size")) & (F.col("place") == F.col("_place")) & (F.col("part") == F.col("_part"))
    dealt = materialise(sides.join(members, here).select("unit", "alone", "later", "list", "first", "set", "n", "rest"), "dealt")
    # a set has at most as many lists as its prefix has shingles
    early = F.slice(F.array_sort(F.collect_list(F.struct("place", "list"))), 1, EARLY)
    asked = dealt.select(F.col("set").alias("d")).distinct()
    early = lists.join(asked, F.col("set") == F.col("d"), "left_semi").groupBy(F.col("set").alias("e")).agg(F.transform(early, lambda x: x["list"]).alias("early"))
    signs = materialise(early.join(sets, F.col("e") == F.col("set")).select(F.col("set").alias("k"), "k1", "k2", "sig", "copies", "early"), "signatures")
    likely = _units(dealt.join(signs.drop("k1", "k2"), F.col("set") == F.col("k")).drop("k"), _live, "unit long, set long", [pa.int64(), pa.int64()])
    likely = materialise(likely.distinct(), "live_sets")
    live = likely.select(F.col("unit").alias("u"), F.col("set").alias("v"))
    sent = dealt.join(live, (F.col("unit") == F.col("u")) & (F.col("set") == F.col("v"))).drop("u", "v")
    sent = materialise(sent.join(signs, F.col("set") == F.col("k")).drop("k"), "sent")
    sent = sent.join(_whole(documents, sent.select("k1"), shingle), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).drop("k1", "k2", "w1", "w2")

    def work(a: Side, b: Side, same: bool, first: int) -> Iterator[tuple]:
        return _answers(links(a, b, same, ranks.value, first), a, b, same)

    return materialise(_units(sent, work, "unit long, set long, root long, links long", [pa.int64()] * 4), "links")


def _whole(documents: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """``(w1, w2, hashes)`` of all sets with a first name of ``names(k1)`` (and a few others), from the texts."""
    slots = documents.sparkSession.sparkContext.broadcast(_slots(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*_name(s), s.tobytes()) for s in shingle_sets(batch.column("text"), shingle)]
            some = np.flatnonzero(_in_slots(slots.value, np.array([f[0] for f in found], np.int64))) if found else []
            found = [found[k] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["w1", "w2", "hashes"])

    texts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w1 long, w2 long, hashes binary")
    return texts.groupBy("w1", "w2").agg(F.first("hashes").alias("hashes"))


def join(documents: DataFrame, shingle: int = SHINGLE, rows: int = ROWS, shingles: int = SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` of every document; ``n_links`` counts the other rows that link with it."""
    ranks = documents.sparkSession.sparkContext.broadcast(shingle_ranks(documents, shingle))
    prints = materialise(_prints(documents, ranks, shingle), "shingle_prints")
    sets = prints.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    sets = materialise(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    found = linked_sets(documents, sets, ranks, shingle, rows, shingles)
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")), "jaccard")
    counts = found.groupBy(F.col("set").alias("c")).agg(F.sum("links").alias("links"))
    ids = sets.select("k1", "k2", "set", "first_id", "copies").join(roots, F.col("set") == F.col("node"), "left").join(counts, F.col("set") == F.col("c"), "left")
    ids = materialise(ids.select("k1", "k2", "first_id", F.coalesce("root", "set").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    named = ids.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    ids = ids.join(named, F.col("root") == F.col("r")).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "component_id", "n_links")
    ids = materialise(ids, "class_ids")  # a plain scan on either side lets a hot class's partition be split
    met = prints.where("n > 0").join(ids, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")))
    met = met.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return met.unionByName(prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_jaccard_join``: every document's set size, component and number of links."""
    return join(table(spark, sf_dir, "documents"))


_SPACE = "\\x20\\x09-\\x0D"

ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+'), []) AS ws FROM documents)
, s AS (SELECT k, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w)
, t AS (SELECT k, len(sh) AS n, unnest(sh) AS g FROM s)
, p AS (SELECT a.k AS i, b.k AS j FROM t a JOIN t b ON a.g = b.g AND a.k < b.k AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*)))
, e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p)
, r AS (SELECT k, k AS o FROM s UNION SELECT r.k, e.j FROM r JOIN e ON r.o = e.i)
, c AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN s d ON r.o = d.k GROUP BY r.k)
, l AS (SELECT i AS k, count(*) AS n FROM e GROUP BY i)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM s JOIN c USING (k) LEFT JOIN l USING (k)
"""
