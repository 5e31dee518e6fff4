"""Best-fit packing by large-item matching.

Documents become token ids plus an end id; longer ones than a sequence are cut so
that only the first piece is short. Pieces above a third of the capacity can meet
at most once more in a bin: the largest is matched greedily with the largest that
still fits. Smaller pieces then go, largest first, to the bin with the smallest
gap that holds them.

Only lengths matter for where pieces go, and there are at most ``capacity``
different ones, so the plan is made on the driver from the histogram of lengths
(``capacity`` numbers at any input size). A plan entry sends a range of ranks of
one length to a range of bins. Ranks come from counts per input split and length,
so a length that a third of all pieces share is ranked split by split, never in
one task; the plan is broadcast, bounded by the squared capacity.

Edge cases: a null or empty text is the end id alone; rows with equal or null ids
are packed one by one; ties in rank are ordered by doc_id, piece and content; an
empty table packs to no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialise, table
from .tokens import encoder

CAPACITY = 1024
END_ID = 2


class Entry(NamedTuple):
    """Ranks ``[lo, hi)`` of pieces of ``length``: ``per`` to a bin, from ``bin`` on, the first at ``at``."""

    length: int
    lo: int
    hi: int
    per: int
    bin: int
    at: int


def plan(histogram: dict[int, int], capacity: int) -> list[Entry]:
    """Where the pieces go; ``histogram``: pieces by length, 1 to ``capacity``."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    used = [0] * (capacity + 1)
    out: list[Entry] = []
    bins = 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs (first bin, count)

    def put(length: int, n: int, per: int, first: int, at: int) -> None:
        out.append(Entry(length, used[length], used[length] + n, per, first, at))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for big in range(capacity, third, -1):
        mate = min(big, capacity - big)
        while left[big]:
            while mate > third and not (left[mate] >= (2 if mate == big else 1)):
                mate -= 1
            if mate <= third:
                n = left[big]
                put(big, n, 1, bins, 0)
                gaps[capacity - big].append((bins, n))
            elif mate == big:
                n = left[big] // 2
                put(big, 2 * n, 2, bins, 0)
                gaps[capacity - 2 * big].append((bins, n))
            else:
                n = min(left[big], left[mate])
                put(big, n, 1, bins, 0)
                put(mate, n, 1, bins, big)
                gaps[capacity - big - mate].append((bins, n))
            bins += n
    for small in range(third, 0, -1):
        gap = small
        while left[small]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            per = min(gap, capacity) // small
            if gap > capacity:  # open bins
                n = -(-left[small] // per)
                gaps[capacity].append((bins, n))
                bins += n
                gap = capacity
            first, n = gaps[gap].pop()
            whole = min(n, left[small] // per)
            if whole:
                put(small, whole * per, per, first, capacity - gap)
                gaps[gap - per * small].append((first, whole))
                if n > whole:
                    gaps[gap].append((first + whole, n - whole))
            else:
                rest = left[small]
                put(small, rest, rest, first, capacity - gap)
                gaps[gap - rest * small].append((first, 1))
                if n > 1:
                    gaps[gap].append((first + 1, n - 1))
    return out



PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text. ``ids``: little-endian unsigned 32-bit, null unless ``keep_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, size = encoder(tokenizer), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = code.encode(text.as_py() or "") + end
                cut = len(ids) % size or size
                a = 0
                for k, b in enumerate(range(cut, len(ids) + 1, size)):
                    part = ids[a:b]
                    rows.append((doc_id, k, a // 4, (b - a) // 4, zlib.crc32(part), part if keep_ids else None))
                    a = b
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    cut = materialise(pieces(documents, tokenizer, capacity, end_id, keep_ids).withColumn("split", F.spark_partition_id()), "pieces")
    spark = cut.sparkSession
    per_split = cut.groupBy("split", "length").count()
    histogram = {r["length"]: r["n"] for r in per_split.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("p_length", "lo", "hi", "per", "bin", "at")])
    entries = F.broadcast(spark.createDataFrame(plan(histogram, capacity), schema))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = per_split.select(F.col("split").alias("s"), F.col("length").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("split", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(base, (F.col("split") == F.col("s")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("base"))
    k = F.col("rank") - F.col("lo")
    return ranked.join(entries, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("bin") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + (k % F.col("per")) * F.col("length")).alias("offset")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_best_fit_packing``: all documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
