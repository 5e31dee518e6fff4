"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are compared with ASCII letters in lower case and runs of ASCII
white space as single spaces. An item may occur, anywhere in a text, with up to ``budget``
edits, one for every ``CHARS_PER_EDIT`` of its characters, whatever its length. Cut into budget + 1
pieces, some piece must then occur unchanged: an Aho-Corasick automaton finds
every exact piece hit in one pass over the whole text, each hit names a window in
which the item can lie, and Myers' bit-parallel algorithm computes the best
distance inside the window. Overlapping windows of one item are verified once, and
an item that stands unchanged needs no dynamic programme.

The benchmark is the stated query set. It is taken in blocks of at most
``BLOCK_PIECES`` pieces, so that each block's automaton has a size bound and can be
sent to every task; documents are read once per block and never shuffled. Pieces
that several items share are listed once in the automaton.

Edge cases: null and empty texts match nothing; items with a null or blank text are
left out, items with a null id match under it; equal items each report; repeated documents report alike; ties in distance go to
the leftmost end; an empty benchmark or table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .textkernel import LOWER

CHARS_PER_EDIT = 13
BLOCK_PIECES = 20_000

_LOWER = LOWER.tobytes()


def normalise(text: str) -> str:
    return b" ".join(text.encode().translate(_LOWER).split()).decode()


def budget_of(item: str) -> int:
    """Edits that still count as the item."""
    return len(item) // CHARS_PER_EDIT


def pieces_of(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget_of(item) + 1
    cut = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Myers:
    """Bit-parallel search of one pattern: edit distance against the best substring end."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.eq: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << k
        self.top, self.full = 1 << (self.m - 1), (1 << self.m) - 1

    def best(self, text: str) -> tuple[int, int]:
        """Least distance of the pattern to a substring, and the leftmost end of one."""
        pv, mv, score = self.full, 0, self.m
        low, end = score, 0
        get, top, full = self.eq.get, self.top, self.full
        for k, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < low:
                low, end = score, k
        return low, end


class Matcher:
    """The automaton and patterns of one block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for offset, piece in pieces_of(item):
                at.setdefault(piece, []).append((k, offset))
        self.words = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.words.add_word(piece, (len(piece), owners))
        self.words.make_automaton()
        self.myers: dict[int, Myers] = {}

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, pieces hit, end)`` of every item within its budget; ``text`` is normalised."""
        hits: dict[int, list[int]] = {}
        for end, (size, owners) in self.words.iter(text):
            for k, offset in owners:
                hits.setdefault(k, []).append(end + 1 - size - offset)
        out = []
        for k, starts in hits.items():
            item_id, item = self.items[k]
            budget = budget_of(item)
            at = text.find(item)
            if at >= 0:
                out.append((item_id, 0, len(starts), at + len(item)))
                continue
            if not budget:
                continue
            best = (budget + 1, 0)
            lo = hi = -1
            for s in [*sorted(set(starts)), None]:
                if s is not None and hi >= 0 and s - budget <= hi:
                    hi = s + len(item) + budget
                    continue
                if hi >= 0:
                    window = text[max(0, lo) : hi]
                    d, end = self._pattern(k).best(window)
                    best = min(best, (d, max(0, lo) + end))
                if s is not None:
                    lo, hi = s - budget, s + len(item) + budget
            if best[0] <= budget:
                out.append((item_id, best[0], len(starts), best[1]))
        return out

    def _pattern(self, k: int) -> Myers:
        if k not in self.myers:
            self.myers[k] = Myers(self.items[k][1])
        return self.myers[k]


def blocks(benchmark: DataFrame, size: int = BLOCK_PIECES) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in bounded blocks, read one partition at a time."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        item = normalise(row["text"] or "")
        if not item:
            continue
        cost = budget_of(item) + 1
        if block and n + cost > size:
            yield block
            block, n = [], 0
        block.append((row["item_id"], item))
        n += cost
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, distance int, pieces_hit int, item_end int"


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it contains within the item's edit budget."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    if text.is_valid:
                        rows += [(doc_id, *m) for m in matcher.match(normalise(text.as_py()))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "pieces_hit", "item_end"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], SCHEMA)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, that contain no item."""
    schema = documents.schema
    out = documents
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for batch in batches:
                yield batch.filter(pa.array([not (t.is_valid and matcher.match(normalise(t.as_py()))) for t in batch.column("text")], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_benchmark_decontamination``: every document against every item."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
