"""Delta-maintained token counts.

A ledger keeps additive totals ``(documents, tokens)`` by source, language and
tokenizer version. Changes are signed: an insert adds a document's count, a delete
subtracts it, a revision subtracts the old count and adds the new one. A batch of
changes is summed per key (map-side first, so a hot source arrives as one row per
task) and committed once under its batch id: an attempt writes its sums to a folder of
its own, then creates the batch's marker file, which names that folder. Creating a file
that must not exist is atomic, so of two writers with one id one wins and the other's
sums are removed; an attempt that dies leaves no marker and counts for nothing.

``compact`` folds the committed batches into the totals, and ``totals`` adds only what
was committed since: the work of a reader follows the new batches, not the history. A
fold becomes visible by its own marker, and takes up exactly the batches whose ids it
records: they are listed once. What a fold replaced (batches and the fold before) is
removed by the next one, so a reader that began before a fold still finds its files.
A batch id that a fold has counts for nothing when a late writer marks it again.

Edge cases: null sources, languages and versions are keys of their own; null counts
add nothing to tokens; repeated changes count repeatedly (one batch is a bag of
changes, only batch ids are unique); keys that fall to zero documents and tokens
leave the totals; an empty batch commits and changes nothing; extra columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import default_tokenizer
from .storage import create_text, exists, names, read_text, remove, scratch, table
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer_version")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents ``(source, lang, tokenizer_version, n_tokens)``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents away again."""
    return inserts(counts).select(*KEYS, (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens"))


def revisions(counts: DataFrame, new: str = "new_tokens") -> DataFrame:
    """Changes of documents whose count was ``n_tokens`` and is now ``new`` (same key)."""
    moved = F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col("n_tokens"), F.lit(0))
    return counts.select(*KEYS, F.lit(0).cast("long").alias("d_docs"), moved.cast("long").alias("d_tokens"))


class Ledger:
    """Committed batches and folds below ``path`` (a file system with atomic file creation that Spark reaches)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, _ and - only")
        return f"{self.path}/commits/{batch_id}"

    def _fold(self) -> tuple[int, str | None]:
        """Number and folder of the latest fold."""
        found = [int(n) for n in names(self.spark, f"{self.path}/folds")]
        return (max(found), read_text(self.spark, f"{self.path}/folds/{max(found)}")) if found else (0, None)

    def _folded(self, fold: str | None) -> DataFrame:
        """``(id)`` of the batches in a fold."""
        return self.spark.read.schema("id string").parquet(f"{self.path}/data/{fold}/ids") if fold else self.spark.createDataFrame([], "id string")

    def committed(self, batch_id: str) -> bool:
        marker = self._marker(batch_id)
        return exists(self.spark, marker) or not self._folded(self._fold()[1]).where(F.col("id") == batch_id).isEmpty()

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Sum and write a batch; False if it was committed before."""
        if self.committed(batch_id):
            return False
        sums = reduce(DataFrame.unionByName, changes).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/data/{attempt}")
        won = create_text(self.spark, self._marker(batch_id), attempt)
        if won and self._among(self._fold()[1], [batch_id]):  # folded, and its marker removed, since the look above
            remove(self.spark, self._marker(batch_id))
            won = False
        if not won:
            remove(self.spark, f"{self.path}/data/{attempt}")
        return won

    def _among(self, fold: str | None, ids: list[str]) -> set[str]:
        """Which of the ids a fold has: one job."""
        if not fold or not ids:
            return set()
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return {r["id"] for r in asked.join(self._folded(fold), "id", "left_semi").collect()}

    def _since(self, fold: str | None) -> dict[str, str]:
        """Folder of each batch that was committed and is not in ``fold``."""
        ids = names(self.spark, f"{self.path}/commits")
        have = self._among(fold, ids)
        return {i: read_text(self.spark, f"{self.path}/commits/{i}") for i in ids if i not in have}

    def batches(self) -> list[str]:
        """Ids of the committed batches that no fold has yet."""
        return sorted(self._since(self._fold()[1]))

    def totals(self) -> DataFrame:
        """Documents and tokens by key: the latest fold, and the batches since."""
        _, fold = self._fold()
        return self._sums(fold, self._since(fold))

    def _sums(self, fold: str | None, since: dict[str, str]) -> DataFrame:
        folders = [f"{self.path}/data/{fold}/totals"] * bool(fold) + [f"{self.path}/data/{at}" for at in since.values()]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        sums = self.spark.read.schema(_SCHEMA).parquet(*folders).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> bool:
        """Fold all batches so far into the totals; False if another writer did so meanwhile."""
        number, fold = self._fold()
        since, name = self._since(fold), f"fold-{uuid.uuid4().hex}"
        self._sums(fold, since).write.parquet(f"{self.path}/data/{name}/totals")
        new = self.spark.createDataFrame([(i,) for i in since], "id string")
        self._folded(fold).unionByName(new).write.parquet(f"{self.path}/data/{name}/ids")
        if not create_text(self.spark, f"{self.path}/folds/{number + 1}", name):
            remove(self.spark, f"{self.path}/data/{name}")
            return False
        for i in self._among(fold, names(self.spark, f"{self.path}/commits")):  # what the fold before took up
            remove(self.spark, f"{self.path}/data/{read_text(self.spark, self._marker(i))}")
            remove(self.spark, self._marker(i))
        for n in names(self.spark, f"{self.path}/folds"):  # and the folds before that one
            if int(n) < number:
                remove(self.spark, f"{self.path}/data/{read_text(self.spark, f'{self.path}/folds/{n}')}")
                remove(self.spark, f"{self.path}/folds/{n}")
        return True

    def drop(self) -> None:
        remove(self.spark, self.path)


def count_tokens(documents: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Tokens of every whole text, with its words: ``(doc_id, source, lang, tokenizer_version, n_tokens, n_words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            n = np.fromiter((len(code.encode(t)) // 4 for t in texts), np.int64, len(texts))
            w = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(texts), pa.string()), pa.array(n), pa.array(w)], ["doc_id", "source", "lang", "tokenizer_version", "n_tokens", "n_words"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_words long")


VERSION = "byte_bpe_50k"
WORDS = "words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_token_counts``: totals of all documents after four commits to a ledger and a fold between them.

    ``load`` inserts every document under two tokenizer versions, ``load`` again (a
    replay, which must change nothing), ``end-ids`` revises every BPE count to include
    an end-of-text id, ``retire`` deletes the documents without words.
    """
    counts = count_tokens(table(spark, sf_dir, "documents"), default_tokenizer(), VERSION)
    path = scratch(spark, "counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    words = counts.withColumns({"tokenizer_version": F.lit(WORDS), "n_tokens": F.col("n_words")})
    ledger = Ledger(spark, scratch(spark, "ledger"))
    for _ in range(2):
        ledger.commit("load", inserts(counts), inserts(words))
    ledger.compact()
    longer = counts.withColumn("new_tokens", F.col("n_tokens") + 1)
    ledger.commit("end-ids", revisions(longer))
    empty = F.col("n_words") == 0
    ledger.commit("retire", deletes(longer.where(empty).withColumn("n_tokens", F.col("new_tokens"))), deletes(words.where(empty)))
    return ledger.totals()
