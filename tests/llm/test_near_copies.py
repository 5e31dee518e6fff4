"""The pipeline's near-copy stage against brute-force five-word Jaccard."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from kestrelframe.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    texts = ["a b c d e f", "A  b\nc d e F", "a b c d e g", "b a", "a b", "", None]
    sets = list(near_copies.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 2, 2, 1, 1, 0, 0]
    assert np.array_equal(sets[0], sets[1]) and len(np.intersect1d(sets[0], sets[2])) == 1 and sets[3][0] != sets[4][0]


def brute_force(rows):
    root = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    best = {}
    for (k, _), r in zip(rows, root, strict=True):
        best.setdefault(r, []).append((k is None, k or 0))
    return sorted(min(x) for x in best.values())


def test_stage_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, common = [], [word() for _ in range(30)]
    for _ in range(40):
        base = [word() for _ in range(rng.choice((3, 12, 60, 200)))] + common * rng.randrange(2)
        for _ in range(rng.choice((1, 2, 6))):
            near = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                near[rng.randrange(len(near))] = word()
            rows.append((len(rows), " ".join(near)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1].upper()), (None, "only one"), (None, "only one"), (900, None), (901, ""), (902, " \n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, more int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == brute_force(rows)
