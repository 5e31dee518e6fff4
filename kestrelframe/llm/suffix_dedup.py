"""Repeated 100-byte strings over all texts, by merging shards' Burrows-Wheeler transforms with interleave refinement.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (smaller
doc_id, or the same document further left). Comparing all suffixes of a corpus in
one place is out of the question, so strings that can be equal are brought together
first, then ordered exactly:

1. Every window of ``LENGTH`` bytes has a minimizer, its smallest ``KGRAM``-byte
   hash. Equal windows have equal minimizers, so a minimizer value that stands at one
   place of the corpus only rules its windows out. Values are tallied where they are
   found, so that a frequent one arrives as a row per slice of text.
2. Runs of windows with one repeated value become segments (their text). Copies of a
   segment inside a slice are settled there; the rest meet by value in units of
   bounded size.
3. In a unit, windows whose rolling hash stands once leave; what is left are runs of
   windows, the strings of the merge. They are dealt into shards of ``SHARD`` bytes.
   :func:`transform` gives each shard's Burrows-Wheeler transform (its suffixes in
   order of their first ``LENGTH`` bytes and the symbol before each) and the shard's
   own repeated intervals.
4. :func:`interleave` merges the transforms. The interleave starts as one shard after
   the other, each in its own order; a round takes the symbols before the rows in
   their present order and deals the rows stably by them (the LF step), so that after
   ``k`` symbols rows stand in order of their first ``k``. Rows that part in a round
   have a common prefix as long as the rounds before. Rows that no window can be
   reached from in the rounds left are skipped, an interval of a shard goes as one
   row, and rows whose block holds a single shard leave, as that shard has ordered
   them already. Blocks left after ``LENGTH`` symbols are the repeated intervals of
   the merged collection. The earliest window of an interval stays, the others go.

Edge cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose
none; rows that share a doc_id count as one document given more than once, and equal
places in it are no earlier than each other; null ids come before all others; an
empty table gives no rows; extra columns are ignored. Segments and minimizers are
told apart by 64-bit hashes, windows by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import table
from .textkernel import Texts, mix64, repeated, slices

LENGTH = 100
KGRAM = 32
UNIT_TEXT = 6 << 20  # bytes of input text for each unit
_SPAN = LENGTH - KGRAM + 1
_PACK = 1 << 31
SLICE = 1 << 20  # bytes of text looked at together: copies that stand close are settled there
SHARD = 1 << 18  # bytes of text under one transform
_ROLL = 0x9E3779B97F4A7C15
_ROLL_INV = pow(_ROLL, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``a[i : i + w]``, by doubling."""
    n, k, cur = len(a) - w + 1, 1, a
    while 2 * k <= w:
        cur = op(cur[:-k], cur[k:])
        k *= 2
    return op(cur[:n], cur[w - k : w - k + n]) if k < w else cur


def kgrams(buf: np.ndarray, k: int = KGRAM) -> np.ndarray:
    """A rolling hash (modulo 2**64) of every ``k`` bytes. It only says where strings meet; equality is decided on bytes."""
    n = len(buf)
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _ROLL), ("down", _ROLL_INV)):
            seq = np.full(max(n + 1, SLICE + 4096), base, np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers["up"][:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * _powers["down"][: n - k + 1])


def minimizers(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """K-gram hashes, and each window's minimizer (0 where a window would cross texts)."""
    if len(t.buf) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = np.maximum(kgrams(t.buf), np.uint64(1))
    low = _sliding(g, _SPAN, np.minimum)
    for end in t.off[1:-1]:
        low[max(0, end - LENGTH + 1) : end] = 0
    return g, low


def places(g: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions whose k-gram is the minimizer of some window that covers it."""
    edge = np.zeros(_SPAN - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), _SPAN, np.maximum) == g) if len(low) else np.zeros(0, np.int64)


def runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run with one minimizer."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, len(low)))
    real = low[first] != 0
    return first[real], size[real]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, row, value, n)``: values at one place of a slice ask by key; values at more are known, and only vote."""
    names = ["key", "row", "value", "n"]
    for batch in batches:
        row = batch.column("row").to_numpy()
        for a, b, t in slices(batch.column("text"), SLICE):
            g, low = minimizers(t)
            at = places(g, low)
            if not len(at):
                continue
            value, of = g[at], row[a:b][t.doc_of(at)]
            values, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
            alone = count[inverse] == 1
            many = values[count > 1]
            pair = np.unique(np.stack([value[~alone].view(np.int64), of[~alone]], 1), axis=0)
            keys = [value[alone].view(np.int64), many.view(np.int64), mix64(pair[:, 0].view(np.uint64) ^ mix64(pair[:, 1].copy().view(np.uint64))).view(np.int64)]
            rows = [of[alone], np.zeros(len(many), np.int64), pair[:, 1]]
            known = [np.zeros(len(keys[0]), np.int64), np.zeros(len(many), np.int64), pair[:, 0]]
            votes = [np.ones(len(keys[0]), np.int64), np.full(len(many), 2, np.int64), np.zeros(len(pair), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, rows, known, votes)], names)


def _merge_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of a row become one: ``(row, start * 2**31 + end)``."""
    if not len(row):
        return row, start
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    # running maximum of ends within a row: rows are kept apart by a rising offset
    shift = np.cumsum(fresh) * np.int64(_PACK)
    top = np.maximum.accumulate(end + shift)
    fresh[1:] |= start[1:] + shift[1:] > top[:-1]
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(row)) - 1
    return row[head], start[head] * _PACK + (top[last] - shift[last])


def _later(doc: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, doc, start), and flags (in that order) of entries after a strictly earlier one of their group."""
    order = np.lexsort((start, doc, group))
    d, s, g = doc[order], start[order], group[order]
    fresh = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order, (d != d[head]) | (s != s[head])


_PARTS = "unit long, value long, row long, doc_id long, start long, windows long, mark long, segment binary"


def _cutter(units: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of repeated values, and marks of segments whose copies stand earlier in the slice."""
        names = [c.split()[0] for c in _PARTS.split(", ")]
        for batch in batches:
            rows, docs, wanted = batch.column("row").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("wanted")
            for a, b, t in slices(batch.column("text"), SLICE):
                prefix = t.prefix_hash()
                _, low = minimizers(t)
                first, size = runs(low)
                if not len(first):
                    continue
                of, value = t.doc_of(first), low[first]
                mine = wanted.slice(a, b - a)
                pairs = np.repeat(rows[a:b], np.asarray(pc.list_value_length(mine))).view(np.uint64)
                asked = np.unique(mix64(mine.flatten().to_numpy().view(np.uint64) ^ mix64(pairs)))
                keep = np.isin(mix64(value ^ mix64(rows[a:b][of].view(np.uint64))), asked)
                first, size, of, value = first[keep], size[keep], of[keep], value[keep]
                start, row, doc = first - t.off[of], rows[a:b][of], docs[a:b][of]
                text = mix64(t.span_hash(prefix, first, first + size + LENGTH - 1) + value)
                order, gone = _later(doc, start, text)
                dead = order[gone]
                mark_row, mark = _merge_runs(row[dead], start[dead], start[dead] + size[dead] + LENGTH - 1)
                live = order[~gone]
                new = np.concatenate([[True], text[live][1:] != text[live][:-1]]) if len(live) else np.zeros(0, bool)
                live = live[new]
                if len(live):
                    lo, hi = first[live], first[live] + size[live] + LENGTH - 1
                    off = np.concatenate([[0], np.cumsum(hi - lo)])
                    body = t.buf[np.repeat(lo - off[:-1], hi - lo) + np.arange(off[-1])]
                    segment = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(live), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
                    unit = (value[live] % np.uint64(units)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(value[live].view(np.int64)), pa.array(row[live]), pa.array(doc[live]), pa.array(start[live]), pa.array(size[live]), pa.nulls(len(live), pa.int64()), segment], names)
                if len(mark):
                    unit = (mix64(mark_row.view(np.uint64)) % np.uint64(units)).astype(np.int64)
                    none = pa.nulls(len(mark), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(unit), none, pa.array(mark_row), none, none, none, pa.array(mark), pa.nulls(len(mark), pa.binary())], names)

    return cut


def transform(t: Texts, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard: ``rank`` and ``interval`` of every suffix, by its place in ``t.buf``.

    Suffixes are ordered by their first ``length`` bytes, equal ones in any order, and a
    text's end comes before any byte (inside the first eight bytes it counts as a zero
    byte); the transform's symbol of a row is the byte before its suffix. Suffixes of one ``interval`` agree in all ``length`` bytes (or
    down to their ends). Ranks grow from eight bytes by doubling, among suffixes that
    are not alone.
    """
    n = len(t.buf)
    left = np.repeat(t.off[1:], np.diff(t.off)) - np.arange(n)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate([t.buf, np.zeros(8, np.uint8)])
    for k in range(8):
        word |= padded[k : n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    short = np.flatnonzero(left < 8)
    word[short] &= ~np.uint64(0) << (8 * (8 - left[short])).astype(np.uint64)
    sa = np.argsort(word)
    key, depth = word[sa], 8
    del word
    slot, head = np.arange(n), np.zeros(n, np.int64)
    interval = np.zeros(n, np.int64)
    while True:
        edge = np.ones(len(slot), bool)
        edge[1:] = key[1:] != key[:-1]
        head = slot[np.maximum.accumulate(np.where(edge, np.arange(len(slot)), 0))]
        interval[sa[slot]] = head + 1
        if depth >= length:
            break
        slot = slot[~(edge & np.append(edge[1:], True))]
        if not len(slot):
            break
        step = min(depth, length - depth)
        at = sa[slot]
        follow = np.where(left[at] > step, interval[np.minimum(at + step, n - 1)], 0)
        key = interval[at] << np.int64(32) | follow
        by = np.argsort(key)
        sa[slot], key = at[by], key[by]
        depth += step
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(1, n + 1)
    return rank, interval


def interleave(buf: np.ndarray, end: np.ndarray, shard: np.ndarray, length: int = LENGTH, merge: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Windows in their merged order and the number of the block of each, blocks of two or more only.

    Window ``w`` is ``buf[end[w] - length : end[w]]``. With ``merge``, windows are given
    shard by shard, each shard's in the order of its transform and none twice, and a
    block of one shard is settled; otherwise ``shard`` says which windows are compared
    at all. Two symbols a round, from the last to the first.
    """
    symbol = buf[:-1].astype(np.uint16) | buf[1:].astype(np.uint16) << 8
    if merge:
        order, block = np.arange(len(end)), np.zeros(len(end), np.int64)
    else:
        order = np.argsort(shard, kind="stable")
        block = np.cumsum(np.concatenate([[0], np.diff(shard[order]) != 0])) if len(order) else order
    at = end[order]
    for step in range(length // 2):
        at = at - 2
        c = symbol[at]
        by = np.argsort(c, kind="stable")  # a radix sort: the LF step
        c, order, at, block = c[by], order[by], at[by], block[by]
        edge = np.ones(len(c), bool)
        edge[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge) - 1
        if step in (0, 1, 2, 4, 7, 11, 16, 22, 30, 40) or step == length // 2 - 1:
            if merge:  # rows of a block stand in order of shards
                head = np.flatnonzero(edge)
                last = np.append(head[1:], len(edge)) - 1
                shared = (shard[order[head]] != shard[order[last]])[block]
            else:
                shared = ~(edge & np.append(edge[1:], True))  # not alone
            order, at, block = order[shared], at[shared], block[shared]
            if not len(order):
                break
    return order, block


def window_hashes(bodies: pa.Array) -> np.ndarray:
    """A rolling hash of every window of every body, in order. Equal windows have equal hashes."""
    out = [np.zeros(0, np.uint64)]
    for _, _, part in slices(bodies):
        if len(part.buf) >= LENGTH:
            left = np.repeat(part.off[1:], np.diff(part.off)) - np.arange(len(part.buf))
            out.append(kgrams(part.buf, LENGTH)[left[: 1 - LENGTH] >= LENGTH])
    return np.concatenate(out)


def repeated_windows(bodies: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(body, nth, block)`` of every window that stands twice or more in bodies of ``size`` windows each; equal ones share a block."""
    alike = repeated(window_hashes(bodies))
    body = np.repeat(np.arange(len(size)), size)[alike]
    nth = np.flatnonzero(alike) - (np.cumsum(size) - size)[body]
    if not len(body):
        return body, nth, body
    (_, _, t), = slices(bodies, 1 << 62, 1 << 62)
    first = np.concatenate([[True], (body[1:] != body[:-1]) | (nth[1:] != nth[:-1] + 1)])
    head = np.flatnonzero(first)
    count = np.diff(np.append(head, len(body)))
    length = count + LENGTH - 1
    off = np.concatenate([[0], np.cumsum(length)])
    buf = t.buf[np.repeat(t.off[body[head]] + nth[head] - off[:-1], length) + np.arange(off[-1])]
    place = np.arange(len(body)) + np.repeat(np.arange(len(head)) * (LENGTH - 1), count)  # of each window in buf
    rows, ends, shards, group, a, shard = [], [], [], np.zeros(len(body), np.int64), 0, 0
    while a < len(head):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SHARD, side="right")) - 1)
        w = np.arange(head[a], head[b] if b < len(head) else len(body))
        rank, interval = transform(Texts(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
        at = place[w] - off[a]
        _, one, same = np.unique(interval[at], return_index=True, return_inverse=True)
        # rows enter the merge LENGTH symbols behind their windows; a string's end has the lowest rank
        behind = at[one] + LENGTH
        stops = off[a + 1 : b + 1] - off[a]
        stop = stops[np.searchsorted(stops, at[one], side="right")]
        entry = np.argsort(np.where(behind < stop, rank[np.minimum(behind, len(rank) - 1)], 0), kind="stable")
        done = sum(map(len, rows))
        turn = np.empty(len(one), np.int64)
        turn[entry] = np.arange(len(one))
        group[w] = done + turn[same]
        rows.append(w[one[entry]])
        ends.append(place[rows[-1]] + LENGTH)
        shards.append(np.full(len(one), shard, np.int32))
        a, shard = b, shard + 1
    win, block = interleave(buf, np.concatenate(ends), np.concatenate(shards), merge=True)
    # an interval that met no other shard's is a block of its own
    total = sum(map(len, rows))
    of = np.arange(total, 2 * total)
    of[win] = block
    block = of[group]
    kept = repeated(block)
    return body[kept], nth[kept], block[kept]


def merge_unit(parts: pa.Table) -> pa.Table:
    """Marks ``(row, mark)`` of one unit: those that came along, and those of repeated windows."""
    parts = parts.combine_chunks()
    ready = parts.filter(pc.is_valid(parts.column("mark")))
    out_row, out_mark = [ready.column("row").to_numpy()], [ready.column("mark").to_numpy()]
    parts = parts.filter(pc.is_null(parts.column("mark")))
    if len(parts):
        value, row, doc, start, size = (parts.column(c).to_numpy() for c in ("value", "row", "doc_id", "start", "windows"))
        bodies = parts.column("segment").combine_chunks()
        bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
        # in slices: running sums and powers over a whole unit would be many times its size
        hashes = [part.span_hash(part.prefix_hash(), part.off[:-1], part.off[1:]) for _, _, part in slices(bodies)]
        text = mix64(np.concatenate(hashes) + value.view(np.uint64))
        order, gone = _later(doc, start, text)
        dead = order[gone]
        marks = [(row[dead], start[dead], start[dead] + size[dead] + LENGTH - 1)]
        live = order[~gone]
        live = live[np.concatenate([[True], text[live][1:] != text[live][:-1]])]
        # a value with one distinct segment left can only repeat inside that segment
        _, group, count = np.unique(value[live], return_inverse=True, return_counts=True)
        worth = (count[group] > 1) | (size[live] > 1)
        live = live[worth]
        if len(live):
            body, nth, block = repeated_windows(bodies.take(pa.array(live)), size[live])
            s = live[body]
            by, gone = _later(doc[s], start[s] + nth, block)
            again = by[gone]
            s, nth = s[again], nth[again]
            marks.append((row[s], start[s] + nth, start[s] + nth + LENGTH))
        r, m = _merge_runs(*(np.concatenate(c) for c in zip(*marks, strict=True)))
        out_row.append(r)
        out_mark.append(m)
    return pa.table({"row": np.concatenate(out_row), "mark": np.concatenate(out_mark)})


def repeated_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(row, doc_id, text)`` of all documents (null ids smallest), and their ``(row, mark)`` spans, not yet merged."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // UNIT_TEXT))
    asked = rows.select("row", "text").mapInArrow(_tally, "key long, row long, value long, n long")
    votes = asked.withColumn("votes", F.sum("n").over(Window.partitionBy("key")))
    known = votes.where("n < 2 AND (n = 0 OR votes > 1)").select("row", F.when(F.col("n") == 0, F.col("value")).otherwise(F.col("key")).alias("value"))
    wanted = known.groupBy(F.col("row").alias("r")).agg(F.collect_set("value").alias("wanted"))
    low = F.lit(-(1 << 63)).cast("long")
    cut = rows.join(wanted, F.col("row") == F.col("r")).select("row", F.coalesce("doc_id", low).alias("doc_id"), "text", "wanted").mapInArrow(_cutter(units), _PARTS)
    return rows, cut.groupBy("unit").applyInArrow(merge_unit, "row long, mark long")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document what goes and the hash of what stays; ``keep_text`` adds the remaining bytes (they may cut a code point)."""
    rows, spans = repeated_spans(documents)
    marks = spans.groupBy(F.col("row").alias("r")).agg(F.collect_set("mark").alias("marks"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("marks"), strict=True):
                data = text.as_buffer()
                digest, kept, done, gone, n = hashlib.sha256(), [], 0, 0, 0
                if found.is_valid:
                    packed = np.sort(found.values.to_numpy())
                    zero = np.zeros(len(packed), np.int64)
                    _, packed = _merge_runs(zero, packed // _PACK, packed % _PACK)
                    for m in packed.tolist():
                        a, b = divmod(m, _PACK)
                        digest.update(data[done:a])
                        kept.append(data[done:a])
                        done, gone, n = b, gone + b - a, n + 1
                digest.update(data[done:])
                kept.append(data[done:])
                out.append((data.size, gone, n, digest.hexdigest(), b"".join(kept) if keep_text else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[4], pa.binary())] if keep_text else []), [c.split()[0] for c in SCHEMA.split(", ")] + ["kept"] * keep_text)

    return rows.join(marks, F.col("row") == F.col("r"), "left").select("doc_id", "text", "marks").mapInArrow(remove, SCHEMA + ", kept binary" * keep_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_suffix_dedup``: every document without the strings of 100 bytes that start earlier."""
    return deduplicate(table(spark, sf_dir, "documents"))
