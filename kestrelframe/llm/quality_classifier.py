"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its
byte histogram and a few repetition rates by a learned layer; gated attention
(tanh times sigmoid) weighs the passages, and a logistic unit scores the weighted
passage representation. Only the document's label is known; which passages carry
it is what the attention learns. Encoder, attention and score are trained together
by Adam on a bounded sample: at most ``TRAIN_DOCS`` labelled documents of ``TRAIN_BYTES``
together, every passage of each (see :mod:`training`). Scoring encodes every passage
of every whole text in one pass; only the model (some 8,000 numbers) is shipped.

Edge cases: a null or empty text is one passage of zeros; without labelled rows of
both kinds every score is the share of good ones (0.5 without any); a document
labelled twice counts as good if either row says so; repeated documents score
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .textkernel import Texts, mix64, repeated, slices
from .toxicity import fold
from .training import labelled

PASSAGE = 64
HIDDEN = 24
GATE = 12
TRAIN_DOCS = 4000
TRAIN_BYTES = 24 << 20
THRESHOLD = 0.3
WIDTH = 256 + 5


def passages(t: Texts, words: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Text and raw features of every passage; a text without words has one of zeros."""
    starts, ends = t.words()
    doc = t.doc_of(starts)
    n_words = np.bincount(doc, minlength=t.n)
    first_word = np.cumsum(n_words) - n_words
    size = np.maximum(1, -(-n_words // words))
    first = np.cumsum(size) - size
    total = int(size.sum())
    pid = first[doc] + (np.arange(len(starts)) - first_word[doc]) // words
    word = t.span_hash(t.prefix_hash(), starts, ends)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    again = repeated(mix64(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    length = (ends - starts).astype(float)
    count = np.maximum(np.bincount(pid, minlength=total), 1)
    x = np.zeros((total, WIDTH), np.float32)
    if len(starts):
        inside = np.repeat(pid, ends - starts)
        at = np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(len(inside))
        hist = np.bincount(inside * 256 + t.buf[at], minlength=total * 256).reshape(total, 256)
        x[:, :256] = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
        for k, v in enumerate((same, again, length / 10, length == 1)):
            x[:, 256 + k] = np.bincount(pid, weights=v, minlength=total) / count
        x[:, 260] = np.minimum(count / words, 1) * (np.bincount(pid, minlength=total) > 0)
    return np.repeat(np.arange(t.n), size), x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Standardisation, encoder, gated attention, and the logistic unit."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Scores of ``n`` bags; rows of ``x`` are sorted by ``bag`` and no bag is empty."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        cut = np.searchsorted(bag, np.arange(n))
        weight = np.exp(e - np.maximum.reduceat(e, cut)[bag])
        weight = weight / np.add.reduceat(weight, cut)[bag]
        z = np.add.reduceat(weight[:, None] * h, cut, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "cut": cut, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return self.forward(((x - self.mean) / self.scale).astype(np.float32), bag, n)["y"]


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.01, l2: float = 1e-4, hidden: int = HIDDEN, gate: int = GATE) -> Model:
    """Full-batch Adam on the logistic loss; rows of ``x`` sorted by ``bag``, bags 0 to len(y) - 1."""
    n = len(y)
    rng = np.random.default_rng(11)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "c0": np.array(np.log(share / (1 - share)))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if not n or y.all() or not y.any():
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), p)
    mean = x.mean(0)
    scale = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean**2, 0)).astype(np.float32) + np.float32(1e-2)
    model, x = Model(mean, scale, p), (x - mean) / scale
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        f = model.forward(x, bag, n)
        d = ((f["y"] - y) / n).astype(np.float32)
        dz = d[:, None] * p["c"]
        dzb = dz[bag]
        dh = f["weight"][:, None] * dzb
        dw = (dzb * f["h"]).sum(1)
        de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, f["cut"])[bag])
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        grads = {"c": f["z"].T @ d, "c0": d.sum(), "a": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": x.T @ du, "b": du.sum(0)}
        for k, v in p.items():
            g = grads[k] + l2 * v * (v.ndim > 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = (v - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def sample(documents: DataFrame, labels: DataFrame, keep: Column, docs: int = TRAIN_DOCS, budget: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All passages, their bags, and the labels of a bounded number of labelled documents for which ``keep`` (over ``doc_id``) holds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                bag, x = passages(t)
                cut = np.searchsorted(bag, np.arange(t.n + 1))
                bags = [x[i:j].astype(np.float16).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, b - a), pa.array(bags, pa.binary())], ["y", "x"])

    got = labelled(documents, labels, "quality", docs, budget, keep=keep).mapInArrow(extract, "y long, x binary").toArrow()
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, WIDTH) for b in got.column("x")]
    size = np.array([len(b) for b in bags], np.int64)
    x = np.empty((int(size.sum()), WIDTH), np.float32)
    for at, b in zip(np.cumsum(size) - size, bags, strict=True):
        x[at : at + len(b)] = b
    return x, np.repeat(np.arange(len(bags)), size), got.column("y").to_numpy().astype(np.float64)


def score(documents: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                y = model.score(*passages(t)[::-1], t.n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")] + [pa.array(y), pa.array((y >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns, that score ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in slices(batch.column("text")):
                y = model.score(*passages(t)[::-1], t.n)
                yield batch.slice(a, b - a).filter(pa.array(y >= threshold))

    return documents.mapInArrow(run, documents.schema)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """The production model: learns from rows with crc32(doc_id) mod 5 other than 0."""
    return fit(*sample(documents, labels, fold(5) != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_quality_classifier``: every document, by a model that never saw the held-out rows."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")), fold(5) == 0)

