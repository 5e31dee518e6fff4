"""Bounded samples of labelled documents.

A model here is fitted on at most ``docs`` labelled documents, in the order of a hash
of their ids, as long as they fit into ``budget`` (bytes or lines, by ``size``). A
document comes whole or not at all; one that does not fit is passed over, so that a
giant text costs the sample one row and not its bound. These two numbers are all that
is ever bounded: scoring reads every row whole.

Edge cases: null ids and null labels are left out; a document labelled twice has the
larger label; rows that share an id count together and come together; without labels
the sample is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(documents: DataFrame, labels: DataFrame, label: str, docs: int, budget: int, size: Column | None = None, keep: Column | None = None) -> DataFrame:
    """``(text, y)`` of the sample; ``keep`` is a condition over ``doc_id``, ``size`` a measure of ``text`` (its bytes)."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    chosen = rows.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(label).cast("long").alias("y")).orderBy(F.xxhash64("k"), "k").limit(docs)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measure = F.coalesce(size if size is not None else F.octet_length("text"), F.lit(0)).cast("long")
    sized = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).groupBy("k", "y").agg(F.sum(measure).alias("size"))
    taken, left = [], budget
    for r in sized.orderBy(F.xxhash64("k"), "k").collect():  # `docs` rows of three numbers at most
        if r["size"] <= left:
            taken.append((r["k"], r["y"]))
            left -= r["size"]
    few = documents.sparkSession.createDataFrame(taken, "k long, y long")
    return texts.join(F.broadcast(few), F.col("doc_id") == F.col("k")).select("text", "y")
