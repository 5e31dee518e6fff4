"""Line sequence labelling: a linear-chain CRF marks each line content or boilerplate.

Whole texts are cut into lines; every line gets a small feature vector; Viterbi
decoding of a two-state linear-chain conditional random field labels the lines,
and the share of words that lie in content lines decides whether a text is kept.
The field is trained here by gradient ascent on its exact log likelihood
(forward-backward). No line labels exist, so lines take the quality label of
their document (distant supervision): noise that the transition weights and the
lines which both kinds of document share even out. It learns from every line of at most
``TRAIN_DOCS`` labelled documents of ``TRAIN_LINES`` lines together (see :mod:`training`);
a text of more than ``SEQUENCE`` lines trains as several sequences.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept. Without training rows the field keeps ``PRIOR`` weights. Repeated rows are
judged one by one. Extra columns are ignored, and input columns are addressed by
name before anything is added, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .textkernel import SPACE, Texts, later_copies, mix64, repeated, slices
from .training import labelled

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
END_MARK = np.zeros(256, bool)
END_MARK[list(b".?:;")] = True

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_SHARE = 0.5
#: Training bounds: labelled documents taken, and how many lines they have in all.
TRAIN_DOCS = 3000
TRAIN_LINES = 400_000
SEQUENCE = 200

FEATURES = ("bias", "symbols", "many_symbols", "upper", "all_upper", "copy", "same_word", "few_words", "one_word", "ends_sentence", "bangs", "digits")
#: Used where no labelled rows exist: symbol-heavy, shouted, repeated lines lean to boilerplate.
PRIOR = np.array([-2.5, 2.0, 3.0, 1.0, 3.0, 2.0, 4.0, 0.3, 0.3, -0.5, 2.0, 0.3])


@dataclass
class Field:
    """Weights of boilerplate against content: emission per feature, start, transition [from, to]."""

    emit: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    @classmethod
    def prior(cls) -> Field:
        return cls(PRIOR.copy(), np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def scan(t: Texts) -> dict[str, np.ndarray]:
    """Counts of the base rules per text, and features per line that has a word."""
    starts, ends = t.words()
    doc = t.doc_of(starts)
    prefix = t.prefix_hash()
    word = t.span_hash(prefix, starts, ends)
    n_words = np.bincount(doc, minlength=t.n)
    space = SPACE[t.buf]
    word_chars = t.counts(((t.buf & 0xC0) != 0x80) & ~space)
    symbol = SYMBOLS[t.buf]
    n_symbols = t.counts(symbol)

    marked = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = doc[2:] == doc[:-2]
        key = mix64(word[:-2] * np.uint64(3) + mix64(word[1:-1] * np.uint64(5) + mix64(word[2:] + doc[2:].astype(np.uint64))))
        at = np.flatnonzero(whole)
        hit = at[repeated(key[at])]
        for k in range(3):
            marked[hit + k] = True
    n_repeat = np.bincount(doc, weights=marked, minlength=t.n).astype(np.int64)

    l0, l1 = t.spans(t.buf != 0x0A)
    of = np.searchsorted(l0, starts, side="right") - 1
    per_line = np.bincount(of, minlength=len(l0)) if len(l0) else np.zeros(0, np.int64)
    real = per_line > 0
    l0, l1, n_in_line = l0[real], l1[real], per_line[real]
    of = (np.cumsum(real) - 1)[of] if len(of) else of
    line_doc = t.doc_of(l0)
    copy = later_copies(mix64(t.span_hash(prefix, l0, l1) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n_dup = np.bincount(line_doc, weights=copy, minlength=t.n).astype(np.int64)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[l1] - total[l0]) / np.maximum(l1 - l0, 1)

    same = np.zeros(len(word), bool)
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    same_share = np.bincount(of, weights=same, minlength=len(l0)) / np.maximum(n_in_line, 1)
    upper, sym = share(UPPER[t.buf]), share(symbol)
    # the last byte of a line that is no white space
    last = ends[np.searchsorted(starts, l1, side="left") - 1] - 1 if len(l0) else np.zeros(0, np.int64)
    x = np.empty((len(l0), len(FEATURES)), np.float32)
    x[:, 0] = 1
    x[:, 1] = sym > 0.02
    x[:, 2] = sym > 0.08
    x[:, 3] = upper > 0.2
    x[:, 4] = upper > 0.5
    x[:, 5] = copy
    x[:, 6] = same_share > 0.3
    x[:, 7] = n_in_line <= 4
    x[:, 8] = n_in_line == 1
    x[:, 9] = END_MARK[t.buf[last]] if len(last) else 0
    x[:, 10] = share(t.buf == ord("!")) > 0.02
    x[:, 11] = share((t.buf >= 0x30) & (t.buf <= 0x39)) > 0.15
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "line_doc": line_doc, "line_words": n_in_line, "x": x}


def _ranks(line_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines per text, and the first line of each text."""
    size = np.bincount(line_doc, minlength=n)
    return size, np.cumsum(size) - size


def viterbi(field: Field, score: np.ndarray, line_doc: np.ndarray, n: int) -> np.ndarray:
    """Best labels (True: boilerplate) of all lines; texts advance side by side, one line a step."""
    size, first = _ranks(line_doc, n)
    order = np.argsort(-size, kind="stable")
    size_s, first_s = size[order], first[order]
    longest = int(size_s[0]) if n else 0
    label = np.zeros(len(score), bool)
    if not longest:
        return label
    back = np.zeros((len(score), 2), bool)
    live = np.searchsorted(-size_s, -np.arange(1, longest + 1), side="right")  # texts with more than k lines
    a = np.full(n, field.start[0])
    b = field.start[1] + np.where(size_s > 0, score[np.minimum(first_s, len(score) - 1)], 0.0)
    (t00, t01), (t10, t11) = field.trans
    for k in range(1, longest):
        m = live[k]
        at = first_s[:m] + k
        pa_, pb = a[:m], b[:m]
        from_b0, from_b1 = pb + t10 > pa_ + t00, pb + t11 > pa_ + t01
        back[at, 0], back[at, 1] = from_b0, from_b1
        na = np.where(from_b0, pb + t10, pa_ + t00)
        nb = np.where(from_b1, pb + t11, pa_ + t01) + score[at]
        a[:m], b[:m] = na, nb
    state = b > a
    for k in range(longest - 1, -1, -1):
        m = live[k]
        at = first_s[:m] + k
        label[at] = state[:m]
        if k:
            state[:m] = np.where(state[:m], back[at, 1], back[at, 0])
    return label


def log_likelihood(field: Field, x: np.ndarray, y: np.ndarray, line_doc: np.ndarray, n: int) -> tuple[float, Field]:
    """Exact log likelihood of the labels and its gradient, by forward-backward in log space."""
    size, first = _ranks(line_doc, n)
    order = np.argsort(-size, kind="stable")
    size_s, first_s = size[order], first[order]
    longest = int(size_s[0]) if n else 0
    live = np.searchsorted(-size_s, -np.arange(1, longest + 1), side="right")
    score = np.stack([np.zeros(len(x)), x @ field.emit], 1)
    fwd, bwd = np.zeros_like(score), np.zeros_like(score)
    for k in range(longest):
        at = first_s[: live[k]] + k
        if k == 0:
            fwd[at] = field.start + score[at]
        else:
            fwd[at] = score[at] + np.logaddexp.reduce(fwd[at - 1][:, :, None] + field.trans, axis=1)
    for k in range(longest - 2, -1, -1):
        at = first_s[: live[k + 1]] + k
        bwd[at] = np.logaddexp.reduce(field.trans[None] + (score[at + 1] + bwd[at + 1])[:, None, :], axis=2)
    has = size > 0
    last = (first + size - 1)[has]
    z = np.logaddexp.reduce(fwd[last], axis=1)
    z_line = np.repeat(z, size[has])
    post = np.exp(fwd + bwd - z_line[:, None])
    head = np.zeros(len(x), bool)
    head[first[has]] = True
    yi = y.astype(np.int64)
    tail = np.flatnonzero(~head)
    pair = np.exp(fwd[tail - 1][:, :, None] + field.trans + (score[tail] + bwd[tail])[:, None, :] - z_line[tail][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (yi[tail - 1], yi[tail]), 1)
    grad = Field(x.T @ (y - post[:, 1]), np.bincount(yi[head], minlength=2) - post[head].sum(0), seen - pair.sum(0))
    total = score[np.arange(len(x)), yi].sum() + field.start[yi[head]].sum() + (seen * field.trans).sum() - z.sum()
    return float(total), grad


def fit(x: np.ndarray, y: np.ndarray, line_doc: np.ndarray, n: int, steps: int = 60, l2: float = 1.0, rate: float = 0.15) -> Field:
    """Adam on the penalised mean log likelihood, from the prior."""
    field = Field.prior()
    if not len(x) or y.all() or not y.any():
        return field
    x = x.astype(np.float64)
    parts = [field.emit, field.start, field.trans]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        _, g = log_likelihood(field, x, y, line_doc, n)
        for k, (p, d) in enumerate(zip(parts, (g.emit, g.start, g.trans), strict=True)):
            d = (d - l2 * p) / n
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return field


def training_lines(documents: DataFrame, labels: DataFrame, docs: int = TRAIN_DOCS, lines: int = TRAIN_LINES, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Features and labels of all lines of a bounded number of labelled documents, the sequence of each line, and their number."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                s = scan(t)
                size, first = _ranks(s["line_doc"], t.n)
                rows = [s["x"][f : f + c].astype(np.uint8).tobytes() for f, c in zip(first, size, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), pa.array(rows, pa.binary())], ["y", "x"])

    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    got = labelled(documents, labels, "quality", docs, lines, size=ends).mapInArrow(extract, "y long, x binary").toArrow()
    xs = [np.frombuffer(r.as_buffer(), np.uint8).reshape(-1, len(FEATURES)) for r in got.column("x")]
    size = np.array([len(r) for r in xs], np.int64)
    x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES)), np.uint8)
    y = np.repeat(got.column("y").to_numpy() == 0, size) if len(xs) else np.zeros(0, bool)
    nth = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    of = np.cumsum(nth % sequence == 0) - 1
    return x.astype(np.float32), y.astype(np.float64), of, int(of[-1]) + 1 if len(of) else 0


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(documents: DataFrame, field: Field, keep_share: float = KEEP_SHARE, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Base counts and the field's verdict for every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                s = scan(t)
                junk = viterbi(field, (s["x"] @ field.emit).astype(np.float64), s["line_doc"], t.n)
                content = np.bincount(s["line_doc"], weights=s["line_words"] * ~junk, minlength=t.n)
                share = content / np.maximum(s["n_words"], 1)
                failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
                cols = [batch.column("doc_id").slice(a, b - a)] + [pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                cols += [pa.array(failed), pa.array(~failed & (share >= keep_share)), pa.array(share)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_quality_rules``: every document, judged by a field trained on a bounded sample of labelled ones."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(*training_lines(documents, table(spark, sf_dir, "labels"))))
