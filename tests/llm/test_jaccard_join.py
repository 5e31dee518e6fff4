"""The Jaccard join against all pairs of word sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelframe.llm import jaccard_join
from kestrelframe.llm.jaccard_join import Side, links, possible, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    at = list(range(len(rows)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    count = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                count[i] += 1
                count[j] += 1
                at[find(i)] = find(j)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(k)
            ids[r] = min(ids.get(r, doc), doc)
    return Counter((doc, len(sets[k]), ids.get(find(k)), count[k]) for k, (doc, _) in enumerate(rows))


def texts(seed, n):
    """Families of near copies with a few words changed, a passage in many unlike texts, copies and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(30)]
    heads = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 40, 90, 160]))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(heads))
        kind = rng.random()
        if kind < 0.2:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
            w[10:10] = passage
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        if kind > 0.97:
            w = w[: rng.randint(0, 3)]
        text = " ".join(w)
        out.append(text.upper() if rng.random() < 0.1 else text)
    return out


@pytest.mark.parametrize(("seed", "rows", "shingles"), [(1, 1024, 1 << 20), (2, 7, 500), (3, 40, 1 << 20)])
def test_join_equals_all_pairs(spark, odd, seed, rows, shingles):
    docs = [(rng_id, t) for rng_id, t in enumerate(texts(seed, 300))] + [(None, texts(seed, 1)[0]), (5, "a b"), (6, "A  b"), (7, "a b c"), (8, None), (9, " \n"), (9, " \n"), (10, "ﬁ É b")]
    docs += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(*d, "x", 3, 4) for d in docs], "doc_id long, text string, set string, n long, unit int").repartition(5)
    got = jaccard_join.join(frame, rows=rows, shingles=shingles)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert Counter(map(tuple, got.collect())) == brute(docs)


def test_no_documents(none):
    assert jaccard_join.join(none).collect() == []


def test_skipping_loses_no_link():
    """Signatures, bounds and answers derived from a pivot give what intersections give."""
    rng = np.random.default_rng(4)
    ranks = np.zeros(jaccard_join.SLOTS, np.uint8)
    base = [np.unique(rng.integers(1 << 62, size=size, dtype=np.uint64)) for size in (30, 200, 210)]
    sets = []
    for k in range(120):
        s = base[k % 3]
        s = s[rng.random(len(s)) > rng.choice([0, 0.01, 0.04, 0.08])]
        sets.append(np.unique(np.concatenate([s, rng.integers(1 << 62, size=rng.integers(0, 12), dtype=np.uint64)])))
    first = int(min(s[0] for s in sets)) - 1  # nothing stands before it
    side = lambda some: Side([{"set": k, "n": len(s), "rest": len(s), "sig": signature(s).tobytes(), "early": [], "list": 0, "hashes": s.tobytes()} for k, s in enumerate(some)])
    for a, b, same in ((sets, sets, True), (sets[:50], sets[50:], False)):
        got = links(side(a), side(b), same, ranks, first)
        want = np.zeros_like(got)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                both = len(np.intersect1d(x, y))
                want[i, j] = (not same or i < j) and 100 * both >= 90 * (len(x) + len(y) - both)
        assert want.sum() > 100 and (got == want).all()
        assert (possible(side(a), side(b), same) >= want).all()


def test_hot_list_is_cut_into_blocks(spark):
    """A list that a third of all sets share is dealt to blocks of a bounded size, and late positions are skipped."""
    lists = spark.range(3000).select(F.lit(0).cast("long").alias("list"), F.lit(5).cast("long").alias("first"), F.lit(0).alias("place"), F.col("id").alias("set"), F.lit(100).cast("long").alias("n"), (100 - F.col("id") % 11).alias("rest"))
    members, units = jaccard_join._blocks(lists, 100, 1 << 20)
    key = ["size", "place", "part"]
    stats = {tuple(r)[:3]: (r["n"], r["rest"]) for r in members.groupBy(*key).agg(F.count("*").alias("n"), F.max("rest").alias("rest")).collect()}
    assert max(n for n, _ in stats.values()) < 200
    pairs = [(tuple(r.a), tuple(r.b)) for r in units.collect()]
    assert pairs and len(set(pairs)) == len(pairs) and all(min(stats[a][1], stats[b][1]) >= 95 for a, b in pairs)
    kept = members.select("set", "rest").collect()
    # whoever can link is dealt to a block, and no one else's block is opened
    assert {r["set"] for r in kept} >= {k for k in range(3000) if 100 - k % 11 >= 95} and len(kept) < 3000
