"""Multipart credential linking: strong secrets always, weak parts only when they complete each other.

Base spans are found per kind, leftmost and without overlap: ``assign`` (a
password-like name set to a value of 6 or more characters), ``access`` (an
``AKIA`` key id of 20 or more characters) and ``hex`` (24 or more hex digits).
Weak candidates are names of accounts (``ident``), token-like strings too loose
to report alone (``weak``) and addresses of services (``endpoint``). Candidates
are sorted and interval-joined inside scopes. A part's scope is its block of lines (blocks
end at blank lines) as far as ``SCOPE`` characters before and after the part: an ``ident``
is reported if a secret reaches into its scope, a
``weak`` secret if an identifier does, an ``endpoint`` if both do. Base spans
serve as parts too (``access`` identifies; ``assign`` and ``hex`` are secrets).

Each candidate looks up its nearest complements by binary search, so a text with
very many candidates costs n log n and no pair is listed. Positions are code
points, ends exclusive. Edge cases: null and empty texts have no spans and the
SHA-256 of nothing; repeated rows are scanned alike; ties in start are ordered by
kind as listed in ``KINDS``; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
SCOPE = 200
MASK = "[REDACTED]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""\b(?:user(?:name)?|login|account|client_id|access_key_id|access_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.IGNORECASE | re.ASCII)
_IDENT_NAMES = ("user", "login", "account", "client_id", "access_key_id", "access_id")
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])", re.ASCII)
_LONG_WORD = re.compile(r"[A-Za-z0-9+/_-]{16}", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s\"'<>]{4,}", re.ASCII)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The always reported spans, ordered by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _ASSIGN_NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _near(starts: list[int], reach: list[int], a: int, b: int) -> bool:
    """Does a span that begins before ``b`` end after ``a``? ``reach`` has running maxima of ends."""
    k = bisect_left(starts, b)
    return k > 0 and reach[k - 1] > a


def _index(spans: list[Span]) -> tuple[list[int], list[int]]:
    spans = sorted(spans)
    reach, top = [], -1
    for s in spans:
        top = max(top, s[1])
        reach.append(top)
    return [s[0] for s in spans], reach


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates whose complementary parts co-occur in scope; none lies inside a base span."""
    low = text.lower()
    idents = [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)] if any(n in low for n in _IDENT_NAMES) else []
    strong = any(k != "access" for _, _, k in base)
    known = any(k == "access" for _, _, k in base)
    if not idents and not known:
        return []  # without an identifier nothing links
    weak = [(m.start(), m.end(), "weak") for m in _WEAK.finditer(text)] if _LONG_WORD.search(text) else []
    if not weak and not strong:
        return []
    taken, blocks = _index(base), [0, *(m.end() for m in _BLANK.finditer(text)), len(text)]
    free = lambda s: not _near(*taken, s[0], s[1])

    def scope_of(s: Span) -> tuple[int, int]:
        k = bisect_right(blocks, s[0], hi=len(blocks) - 1)
        return max(s[0] - scope, blocks[k - 1]), min(s[1] + scope, blocks[k])

    idents, weak = [s for s in idents if free(s)], [s for s in weak if free(s)]
    ids = _index(idents + [s for s in base if s[2] == "access"])
    secrets = _index(weak + [s for s in base if s[2] != "access"])
    out = [s for s in idents if _near(*secrets, *scope_of(s))] + [s for s in weak if _near(*ids, *scope_of(s))]
    if "://" in text:
        ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
        out += [s for s in ends if free(s) and _near(*ids, *scope_of(s)) and _near(*secrets, *scope_of(s))]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All spans of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted(base + linked_spans(text, base, scope), key=lambda s: (s[0], KINDS.index(s[2])))
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [c.split()[0] for c in SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(documents: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced; overlapping spans become one mask. ``n_chars`` follows."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [], batch.schema.get_field_index("text")
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    out, done = [], 0
                    for a, b, _ in sorted(base + linked_spans(text, base, scope)):
                        if a >= done:
                            out += [text[done:a], mask]
                        done = max(done, b)
                    text = "".join([*out, text[done:]])
                texts.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                cols[k] = pa.array([None if t is None else len(t) for t in texts], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return documents.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_secret_scans``: spans of every document."""
    return scan(table(spark, sf_dir, "documents"))
