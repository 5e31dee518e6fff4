"""Vectorised text scanning over Arrow string columns.

A column's UTF-8 bytes are taken as one NumPy buffer, so words, lines and their
64-bit hashes are found for thousands of texts at once without a Python object
per word. Work goes in slices of about ``SLICE_BYTES`` and at most ``SLICE_ROWS``
texts (one longer text is a slice of its own), which bounds memory whatever the
batch size. Null texts have no bytes and therefore behave as empty ones.

Hashes are polynomial in the bytes, modulo the prime 2**61 - 1 and with a base drawn
at random once, then mixed. Two different strings of at most n bytes agree for at
most n of the 2**61 bases, whatever their pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SLICE_ROWS = 2048
_PRIME = (1 << 61) - 1
_BASE = 0x0B5A41E8C7D2F963
_U = np.uint64
_M61, _M31, _M30 = _U(_PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
#: Differences of running sums are exact over spans of this many bytes.
_STEP = 1 << 24
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _mod61(x: np.ndarray) -> np.ndarray:
    x = (x & _M61) + (x >> _U(61))
    return np.where(x >= _M61, x - _M61, x)


def _times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of reduced numbers, from their 30 and 31 bit halves."""
    ah, al, bh, bl = a >> _U(31), a & _M31, b >> _U(31), b & _M31
    mid = al * bh + ah * bl
    return _mod61(ah * bh * _U(2) + (mid >> _U(30)) + ((mid & _M30) << _U(31)) + al * bl)


def _power_table(n: int) -> dict[str, np.ndarray]:
    """Powers of the base (high and low half) and of its inverse, ``n`` of each at least."""
    if len(_powers.get("down", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        seq = {}
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, _PRIME))):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, _times61(table, np.full(len(table), pow(base, len(table), _PRIME), np.uint64))])
            seq[name] = table[:size]
        _powers.update(high=seq["up"] >> _U(31), low=seq["up"] & _M31, down=seq["down"].copy())
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise a hash so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Texts:
    """``n`` texts as one byte buffer; text ``i`` is ``buf[off[i]:off[i + 1]]``."""

    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def prefix_hash(self, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the high and low halves of all terms, for :meth:`span_hash`."""
        b = (self.buf if buf is None else buf).astype(np.uint64) + _U(1)
        table = _power_table(len(b) + 1)
        out = np.zeros(len(b) + 1, np.uint64), np.zeros(len(b) + 1, np.uint64)
        for sums, half in zip(out, ("high", "low"), strict=True):
            np.cumsum(b * table[half][: len(b)], out=sums[1:])
        return out

    def span_hash(self, prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes ``[start, end)`` of each span, the same wherever the bytes stand."""
        high, low = prefix
        total, a = np.zeros(len(start), np.uint64), np.asarray(start)
        for _ in range(max(1, -(-int((np.asarray(end) - a).max(initial=0)) // _STEP))):
            b = np.minimum(end, a + _STEP)
            h, v = _mod61(high[b] - high[a]), low[b] - low[a]
            # h * 2**31: the upper 31 bits of h wrap around the modulus
            total = _mod61(total + (((h & _M30) << _U(31)) + (h >> _U(30))) + _mod61(v))
            a = b
        return mix64(_times61(total, _power_table(len(high))["down"][start]))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes; runs never cross texts."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``."""
        return self.spans(~SPACE[self.buf])

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """The text that holds each byte position (empty texts hold none)."""
        return np.searchsorted(self.off, pos, side="right") - 1

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def _string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        null = np.asarray(column.is_null())
        if (np.diff(off)[null] > 0).any():  # Arrow allows bytes below a null
            return _string_parts(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return buf, off


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into runs of rows ``[a, b)`` of about ``limit`` bytes and ``rows`` rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buf, off = _string_parts(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b), a + rows)
        yield a, b, Texts(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur at an earlier position too."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        out[order[1:][k[1:] == k[:-1]]] = True
    return out
