"""Vector codes against plain Python integers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from kestrelframe.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, row string, x double"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [math.floor(256 * c) for c in v], label) for k, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fits = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    if not fits:
        return []
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    width = len(min(fits, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    kept = sorted((r for r in kept if len(r[1]) == width), key=order)
    d = width // parts
    cut = lambda v: [tuple(v[p * d : p * d + d]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    def assign(p, x):
        return min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[assign(p, cut(v)[p])].append(cut(v)[p])
            for e, xs in groups.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = []
    for k, v, label in kept:
        codes = [assign(p, cut(v)[p]) for p in range(parts)]
        out.append((k, "".join(f"{c:02x}" for c in codes), sum(far(cut(v)[p], books[p][codes[p]]) for p in range(parts)), label))
    by = Counter()
    for *_, e, label in out:
        by[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(k, code, e, by[label], sha) for k, code, e, label in out]


def rows_of(seed, n, width):
    rng = random.Random(seed)
    some = [[rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(width)] for _ in range(n)]
    rows = [(k, some[k if rng.random() < 0.6 else 0], rng.choice([1, 2, None])) for k in range(n)]  # the first vector is very common
    bad = [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [math.nan] * width, 2), (n + 3, [math.inf] * width, 2), (n + 4, [0.5] * (width + 16), 1), (-3, [0.5] * 5, 1), (-2, [], 1), (None, some[1], 7), (3, some[2], 1), (3, some[2], 1)]
    import numpy as np

    return [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for k, v, label in rows + bad]


@pytest.mark.parametrize(("n", "width"), [(300, 32), (40, 16), (90, 64)])
def test_codes_equal_plain_lloyd(spark, tmp_path, n, width):
    rows = rows_of(n, n, width)
    spark.createDataFrame([(*r, "z", 3, "r", 1.5) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.query(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert vector_codes.query(spark, str(tmp_path)).collect() == []


def test_very_large_components_saturate(spark, tmp_path):
    rows = [(k, [(-1) ** k * 3e38] * 16, 1) for k in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.query(spark, str(tmp_path)).collect()
    assert len(got) == 70 and {r.error for r in got} == {0}


def test_hot_part_is_one_weighted_row(spark):
    rows = spark.range(5000).selectExpr("id row", "array_repeat(cast(id % 3 as bigint), 16) v")
    distinct = vector_codes.distinct_parts(rows, 16).groupBy("part", "x").count()
    assert distinct.count() == 48


def test_sql_says_the_same(spark, tmp_path):
    import duckdb

    rows = [(k, v, label) for k, v, label in rows_of(5, 120, 32) if k is not None and (v is None or len(v) == 32)]
    rows = list({r[0]: r for r in rows}.values())  # the SQL takes ids to be unique
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vector_codes.ORACLE_SQL})").fetchall()
    assert Counter(want) == Counter(map(tuple, vector_codes.query(spark, str(tmp_path)).collect()))
