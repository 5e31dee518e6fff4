"""Product-quantised vector codes, trained over distinct parts.

Components become integers (``floor(256 x)``), a vector is cut into ``PARTS`` equal
parts, and equal parts at one position become one weighted row. Lloyd rounds read
that table: each task holds the codebooks (``ENTRIES`` rows of one vector's width,
whatever the input), assigns its rows and sends back one weighted sum for each entry.
Codes and errors are joined back to the vectors by position and part.

Copies of a vector cost one row in every round. In the join back a hot part is a
plain equi-join of two written tables, which adaptive execution can split; sums and
counts are partial before they are shuffled. A vector is named by the number it got
when the integer table was written, so lost executors cannot change names.

Edge cases: vectors that are null, or hold null or non-finite components, are
dropped. So are vectors whose length differs from that of the smallest kept
``vec_id`` or is no positive multiple of ``PARTS``. Rows with equal ids are kept
apart, equal vectors first by their components; null ids come last. With fewer than
``ENTRIES`` vectors the codebooks are as short. An empty table gives no rows. Integer
components saturate at ``limit_of(width)`` (2**27 for 64 components), where every
distance still fits in 64 bits; ``label_error`` saturates at the largest long. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows of one distance matrix, which has ``ENTRIES`` columns.
_ROWS = 8192


def limit_of(width: int) -> int:
    """The largest integer component for which a vector's summed squared distances stay below 2**62."""
    return math.isqrt((1 << 60) // max(1, width))


def _finite(v: Column) -> Column:
    """A vector without null or non-finite components."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame | None:
    """``(vec_id, label, v)`` of the kept vectors, ``v`` being an array of longs; None if there are none."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v")).where(F.col("v").isNotNull()).where(_finite(F.col("v")))
    fits = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = fits.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", F.size("v").alias("width"))).alias("f")).first()["f"]
    if first is None:
        return None
    most = float(limit_of(first["width"]))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-most)), F.lit(most))))
    return rows.where(F.size("v") == first["width"]).select("vec_id", "label", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of ``x``; ties go to the lower index."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), _ROWS):
        d = np.zeros((len(x[a : a + _ROWS]), len(book)), np.int64)
        for k in range(x.shape[1]):
            d += (x[a : a + _ROWS, k, None] - book[None, :, k]) ** 2
        code[a : a + _ROWS] = d.argmin(axis=1)
        far[a : a + _ROWS] = d.min(axis=1)
    return code, far


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """``[part, entry, component]`` from the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # a stated number of rows
    v = np.array([r["v"] for r in rows], np.int64)
    return v.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def distinct_parts(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """``(row, part, x)`` of every part of every vector."""
    d = width // parts
    cut = F.array(*[F.slice("v", k * d + 1, d) for k in range(parts)])
    return vectors.select("row", F.posexplode(cut).alias("part", "x"))


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one weighted round over ``distinct(part, x, weight)``."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, weight, x = batch.column("part").to_numpy(), batch.column("weight").to_numpy(), _matrix(batch.column("x"), d)
            at = []
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                code, _ = nearest(x[mine], books[p])
                for e in np.unique(code):
                    one = mine[code == e]
                    # Python integers: weight times component may pass 2**63
                    w = weight[one].astype(object)
                    at.append((int(p), int(e), int(w.sum()), [str(s) for s in (w[:, None] * x[one]).sum(axis=0)]))
            columns = [pa.array(c, t) for c, t in zip(zip(*at, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)] if at else None
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    sums = distinct.mapInArrow(run, "part int, entry int, n long, sums array<string>")
    total = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(d)]
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # at most one row an entry
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(d)]
    return out


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """``(part, x, code, error)`` of every distinct part."""
    d = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column("part").to_numpy(), _matrix(batch.column("x"), d)
            code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(part):
                mine = part == p
                code[mine], far[mine] = nearest(x[mine], books[p])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("x"), pa.array(code), pa.array(far)], ["part", "x", "code", "error"])

    return distinct.select("part", "x").mapInArrow(run, "part int, x array<long>, code long, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """``(vec_id, label, codes, error)`` of every kept vector and the final codebooks ``[part, entry, component]``.

    ``codes`` is an array of ``parts`` entry numbers. None if no vector is kept.
    """
    kept = integer_vectors(vectors, parts)
    if kept is None:
        return None
    kept = materialise(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    books = first_books(kept, parts, entries)
    cut = distinct_parts(kept, parts * books.shape[2], parts)
    distinct = materialise(cut.groupBy("part", "x").agg(F.count("*").alias("weight")), "distinct_parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    codes = materialise(coded(distinct, books), "part_codes")
    met = cut.join(codes, ["part", "x"]).select("row", "part", "code", "error")
    # one slot of a row each: a sum over slots that are 0 elsewhere needs no list of a vector's parts
    slots = [F.sum(F.when(F.col("part") == p, F.col("code")).otherwise(0)).alias(f"c{p}") for p in range(parts)]
    found = met.groupBy("row").agg(*slots, F.sum("error").alias("error"))
    found = found.select("row", F.array(*[f"c{p}" for p in range(parts)]).alias("codes"), "error")
    return kept.select("row", "vec_id", "label").join(found, "row").drop("row"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_vector_codes``: every kept vector's code and error, its label's error and the codebooks' digest."""
    vectors = table(spark, sf_dir, "embeddings")
    made = compress(vectors)
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if made is None:
        return spark.createDataFrame([], columns)
    found, books = made
    found = materialise(found, "vector_codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    by_label = materialise(by_label.withColumnRenamed("label", "of"), "label_errors")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    met = found.join(by_label, found["label"].eqNullSafe(by_label["of"]))
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """Codebook ``b{k + 1}`` from ``b{k}``."""
    return f"""
, a{k} AS ({_sql_assign(k)})
, m{k} AS (SELECT part, e, list(c ORDER BY k) AS c FROM (
    SELECT part, e, k, CAST(floor(CAST(sum(w * x[k]) AS DOUBLE) / sum(w)) AS BIGINT) AS c FROM a{k}, range(1, len(x) + 1) t(k) GROUP BY part, e, k) GROUP BY part, e)
, b{k + 1} AS (SELECT b{k}.part, b{k}.e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e))"""


def _sql_assign(k: int) -> str:
    far = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    return f"SELECT part, x, w, best.e AS e, best.d AS d FROM (SELECT part, x, w, min({{'d': {far}, 'e': e}}) AS best FROM g JOIN b{k} USING (part) GROUP BY part, x, w)"


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
, p AS (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(part))
, g AS (SELECT part, x, count(*) AS w FROM p GROUP BY part, x)
, b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})
{_sql_round(0)}{_sql_round(1)}
, last AS ({_sql_assign(2)})
, codes AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM p JOIN last USING (part, x) GROUP BY vec_id, label)
, sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, sha
"""
