"""Toxicity by a factorization machine over hashed terms.

A text becomes the set of its lower-cased terms (runs of letters and digits) and
their stems (prefixes of ``STEMS`` bytes), hashed into ``2**BITS`` buckets. The machine scores
``w0 + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)`` over the buckets present: linear
weights, plus an inner product for every pair of terms, so that an insult and a
group mention together weigh more than apart. It learns from all terms of at most
``TRAIN_DOCS`` labelled documents of ``TRAIN_BYTES`` together (see :mod:`training`). Every
bucket that ``MIN_DF`` of them hold and whose share of toxic ones differs from the rest
(chi-square above ``CHI``) has weights; the others' would stay at zero. Scoring reads
whole texts in one pass and ships only the model.

Edge cases: null and empty texts have no terms and score by ``w0`` alone; without
labelled rows of both kinds every score is the share of toxic ones (0 without
any); a document labelled twice counts as toxic if either row says so; repeated
documents score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .textkernel import LOWER, Texts, mix64, slices
from .training import labelled

BITS = 20
STEMS = (5, 6, 7, 8)
RANK = 6
MIN_DF = 5
CHI = 10.83  # one bucket in a thousand passes by chance
TRAIN_DOCS = 16000
TRAIN_BYTES = 64 << 20
THRESHOLD = 0.7

TERM = np.zeros(256, bool)
TERM[ord("0") : ord("9") + 1] = TERM[ord("A") : ord("Z") + 1] = TERM[ord("a") : ord("z") + 1] = TERM[0x80:] = True


@dataclass
class Machine:
    """``slot[bucket]``: the feature of a bucket, or -1; ``v``: features x rank."""

    bits: int
    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` texts from distinct (text, feature) pairs."""
        out = self.w0 + np.bincount(doc, weights=self.w[feature], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[feature, k]
            s = np.bincount(doc, weights=x, minlength=n)
            out += 0.5 * (s * s - np.bincount(doc, weights=x * x, minlength=n))
        return out


def buckets(t: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every term and stem of the texts."""
    starts, ends = t.spans(TERM[t.buf])
    lower = LOWER[t.buf]
    prefix = t.prefix_hash(lower)
    doc = t.doc_of(starts)
    docs, keys = [doc], [t.span_hash(prefix, starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        docs.append(doc[long])
        keys.append(mix64(t.span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc * width + item)
    return pair // width, pair % width


def sample(documents: DataFrame, labels: DataFrame, keep: Column, docs: int = TRAIN_DOCS, budget: int = TRAIN_BYTES, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """All term buckets and the labels of a bounded number of labelled documents for which ``keep`` (over ``doc_id``) holds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                doc, item = _distinct(*buckets(t, bits), 1 << bits)
                cut = np.searchsorted(doc, np.arange(t.n + 1))
                sets = [item[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), pa.array(sets, pa.binary())], ["y", "x"])

    got = labelled(documents, labels, "toxic", docs, budget, keep=keep).mapInArrow(extract, "y long, x binary").toArrow()
    return [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("x")], got.column("y").to_numpy().astype(np.float64)


def fit(sets: list[np.ndarray], y: np.ndarray, bits: int = BITS, rank: int = RANK, min_df: int = MIN_DF, chi_least: float = CHI, steps: int = 250, rate: float = 0.05, l2_w: float = 2e-4, l2_v: float = 1e-3) -> Machine:
    """Full-batch Adam on the logistic loss, over the buckets that pass a chi-square test, as sparse rows."""
    n, slot = len(y), np.full(1 << bits, -1, np.int32)
    share = float(y.mean()) if n else 0.0
    flat = Machine(bits, slot, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0), np.zeros((0, rank)))
    if not n or share in (0.0, 1.0):
        return flat
    df, pos = np.zeros(1 << bits), np.zeros(1 << bits)
    chunks = range(0, n, 512)  # a few documents at a time keep the driver small
    for a in chunks:
        item = np.concatenate(sets[a : a + 512])
        weight = np.repeat(y[a : a + 512], [len(s) for s in sets[a : a + 512]])
        df += np.bincount(item, minlength=1 << bits)
        pos += np.bincount(item, weights=weight, minlength=1 << bits)
    gap = pos - df * share
    chi = gap**2 / np.maximum(df * share * (1 - share) * (1 - df / n), 1e-9)
    best = np.flatnonzero((df >= min_df) & (df < n) & (chi > chi_least))
    if not len(best):
        return flat
    slot[best] = np.arange(len(best))
    known = [f[f >= 0] for f in (slot[items] for items in sets)]
    size = np.array([len(f) for f in known], np.int64)
    feature, doc = np.concatenate(known), np.repeat(np.arange(n), size)
    rng = np.random.default_rng(7)
    w0 = np.array([np.log(share / (1 - share))])
    w, v = np.zeros(len(best)), rng.normal(0, 0.05, (len(best), rank))
    params = [w0, w, v]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        z = w0 + np.bincount(doc, weights=(w - 0.5 * (v**2).sum(1))[feature], minlength=n)
        sums = np.empty((n, rank))
        for k in range(rank):
            sums[:, k] = np.bincount(doc, weights=v[feature, k], minlength=n)
        z += 0.5 * (sums**2).sum(1)
        e = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - y) / n
        each = np.bincount(feature, weights=e[doc], minlength=len(best))
        back = np.stack([np.bincount(feature, weights=(sums[:, k] * e)[doc], minlength=len(best)) for k in range(rank)], 1)
        grads = [np.array([e.sum()]), each + l2_w * w, back - v * each[:, None] + l2_v * v]
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-9)
    return Machine(bits, slot, float(w0[0]), w, v)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, machine: Machine, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                doc, bucket = buckets(t, machine.bits)
                feature = machine.slot[bucket]
                known = feature >= 0
                p = 1 / (1 + np.exp(-machine.logits(*_distinct(doc[known], feature[known].astype(np.int64), max(1, len(machine.w))), t.n)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def fold(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % divisor


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_toxicity``: every document, by a machine that never saw the rows with crc32(doc_id) mod 3 = 1."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(*sample(documents, table(spark, sf_dir, "labels"), fold(3) != 1)), fold(3) == 1)
