"""Classifiers, near-duplicates, decontamination, host reputation and the pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kestrelframe.llm import decontamination, host_reputation, quality_classifier, registry, simhash, toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    y = np.asarray(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def held_out(spark, query, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = query(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    return [labels[r.doc_id] for r in rows], rows


def test_quality_classifier_held_out(spark):
    y, rows = held_out(spark, quality_classifier.query, "quality")
    assert auc(y, [r.score for r in rows]) > 0.98
    assert np.mean([r.predicted for r, v in zip(rows, y, strict=True) if v == 1]) > 0.99


def test_toxicity_held_out(spark):
    y, rows = held_out(spark, toxicity.query, "toxic")
    assert auc(y, [r.score for r in rows]) > 0.95
    assert np.mean([r.predicted for r, v in zip(rows, y, strict=True) if v == 0]) < 0.01


@pytest.mark.parametrize("module,divisor,rest", [(quality_classifier, 5, 0), (toxicity, 3, 1)])
def test_folds(spark, module, divisor, rest):
    import zlib

    rows = module.query(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest) for r in rows)


def test_models_on_awkward_texts(spark, odd, none):
    few = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    q = quality_classifier.fit(*quality_classifier.sample(odd, few, F.lit(True)))
    t = toxicity.fit(*toxicity.sample(odd, few, F.lit(True)), min_df=1)
    for rows in (quality_classifier.score(odd, q, F.lit(False)).collect(), toxicity.score(odd, t, F.lit(False)).collect()):
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        twins = [r.score for r in rows if r.doc_id in (7, 8)]
        assert max(twins) - min(twins) < 1e-6
    assert quality_classifier.accepted(odd, q).columns == odd.columns
    for labels in (few.limit(0), few.where("quality = 1")):
        assert quality_classifier.score(odd, quality_classifier.fit(*quality_classifier.sample(odd, labels, F.lit(True))), F.lit(False)).count() == odd.count()
        assert toxicity.score(odd, toxicity.fit(*toxicity.sample(odd, labels, F.lit(True))), F.lit(False)).count() == odd.count()
    assert quality_classifier.score(none, q, F.lit(False)).count() == 0 and toxicity.score(none, t, F.lit(False)).count() == 0


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, y, x = [], [], []
    for b in range(300):
        n = rng.integers(2, 8)
        p = rng.random((n, quality_classifier.WIDTH)).astype(np.float32) * 0.1
        bad = b % 2
        if bad:
            p[rng.integers(n), 5:9] += 1.0
        bags += [b] * n
        y.append(1.0 - bad)
        x.append(p)
    x, bag, y = np.concatenate(x), np.array(bags), np.array(y)
    model = quality_classifier.fit(x, bag, y)
    assert auc(y, model.score(x, bag, 300)) > 0.99
    weight = model.forward(((x - model.mean) / model.scale).astype(np.float32), bag, 300)["weight"]
    marked = x[:, 5] > 0.5
    assert weight[marked].mean() > 2 * weight[~marked & (y[bag] == 0)].mean()


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(1500):  # toxic only if both 1 and 2 stand together
        s = set(rng.integers(10, 60, 6).tolist()) | {k for k in (1, 2) if rng.random() < 0.5}
        sets.append(np.array(sorted(s), np.int32))
        y.append(float({1, 2} <= s))
    m = toxicity.fit(sets, np.array(y), bits=8)
    score = lambda *f: 1 / (1 + np.exp(-m.logits(np.zeros(len(f), int), m.slot[list(f)], 1)[0]))
    assert score(1, 2) > 0.9 and score(1) < 0.1 and score(2) < 0.1
    f = m.slot[[1, 2]]
    pair = m.w0 + m.w[f].sum() + m.v[f[0]] @ m.v[f[1]]
    assert np.isclose(m.logits(np.zeros(2, int), f, 1)[0], pair)


def plain_fingerprint(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_groups(items, radius=4):
    ids = list(range(len(items)))

    def find(a):
        while ids[a] != a:
            a = ids[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            if bin(items[a][1] ^ items[b][1]).count("1") <= radius:
                x, y = find(a), find(b)
                ids[max(x, y)] = min(x, y)
    low = {}
    for a, (k, _) in enumerate(items):
        if k is not None:
            low[find(a)] = min(k, low.get(find(a), k))
    return [low.get(find(a)) for a in range(len(items))]


def test_simhash_awkward(spark, odd, none):
    src = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(k, plain_fingerprint(t)) for k, t in src]
    want = sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(items, plain_groups(items), strict=True))
    rows = simhash.groups(odd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("h"), "component_id").collect()
    assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in rows) == want
    assert simhash.groups(none).count() == 0
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 7, 9, 10]


@pytest.mark.parametrize("leaf,homes,guests", [(16384, 32768, 1 << 18), (16, 8, 32)])
def test_near_links_equal_all_pairs(spark, monkeypatch, leaf, homes, guests):
    monkeypatch.setattr(simhash, "LEAF_TARGET", leaf)
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(simhash, "GUESTS", guests)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(340):  # chains of near copies
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(nodes).collect()]
    groups = plain_groups(list(zip(fps, fps, strict=True)))
    low = dict(zip(fps, fps, strict=True))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    assert [find(f) for f in fps] == groups


def edit_search(p, t):
    row, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(t, 1):
        new = [0]
        for i, q in enumerate(p, 1):
            new.append(min(row[i - 1] + (q != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, (row[-1], j))
    return best


def test_myers():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 90))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 150))))
        assert decontamination.Myers(p).best(t) == edit_search(p, t)


def edited(text, n, rng):
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([[], ["q"], [s[k], "z"]])
    return "".join(s)


def test_matches_equal_brute_force(spark, text_of):
    rng = random.Random(8)
    items = [(k, text_of(1000 + k, rng.randint(2, 25))) for k in range(12)] + [(90, None), (91, " "), (92, "tiny one"), (93, "elevenchars"), (94, "twelve chars"), (95, "thirteen char"), (None, "an item without id"), (0, text_of(1000, 9))]
    docs = []
    for k in range(60):
        own = text_of(k, 60)
        if k % 2:
            item = items[rng.randrange(12)][1]
            own = own[:150] + " " + edited(item, rng.randint(0, decontamination.budget_of(item) + 6), rng) + " " + own[150:]
        docs.append((k, own if k % 7 else own.upper().replace(" ", "\n ")))
    docs += [(100, None), (101, ""), (102, "a tiny one here"), (103, "a tiny oneself"), (104, "xelevenchars, twelve chaos, tirteen char, an itme without id")]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for k, t in docs:
        text = decontamination.normalise(t or "")
        for i, item in items:
            n = decontamination.normalise(item or "")
            if n and (d := edit_search(n, text)[0]) <= len(n) // decontamination.CHARS_PER_EDIT:
                want.add((k, i, d))
    assert got == want and len(want) > 15 and any(d for *_, d in want)


def test_decontamination_blocks_and_edges(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(1, "Ünïcode 😀 猫が座る。"), (2, "nothing like this at all here")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(odd, bench).collect()} == {9}
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    monkeypatch.setattr(decontamination, "BLOCK_PIECES", 1)
    assert len(list(decontamination.blocks(bench, 1))) == 2
    assert decontamination.matches(odd, bench.limit(0)).count() == 0 and decontamination.matches(none, bench).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == odd.count()


def test_host_parts(spark):
    urls = [("https://A.Example.COM/en/7?x#y", "a.example.com", "/en/7"), ("http://u@h.co.uk:8080", "u@h.co.uk:8080", ""), ("no scheme", "", ""), (None, "", ""), ("x://", "", ""), ("a://b?c/d", "b", ""), ("http://x\ny/z", "x\ny", "/z"), ("ftp://É.Net/p://q", "É.net", "/p://q")]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    got = df.select(host_reputation.host_of(F.col("url")).alias("h"), host_reputation.path_of(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [(h, p) for _, h, p in urls]
    lv = {h: d for h, d in (("a.b.example.com", ("example.com", "com")), ("x.h.co.uk", ("h.co.uk", "co.uk")), ("10.0.0.1:80", ("10.0.0.1", "10.0.0.1")), ("localhost", ("localhost", "localhost")), ("", ("", "")))}
    d, s = host_reputation.levels(F.col("h"))
    assert {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in lv], "h string").select("h", d.alias("d"), s.alias("s")).collect()} == lv


def test_host_filter(spark):
    pages = [(k, f"http://bad.spam.info/{k}") for k in range(40)] + [(100 + k, f"http://good.site.info/{k}") for k in range(40)] + [(200, "http://new.spam.info/"), (201, "http://x.example.com/en/7a"), (202, "http://example.com/en/9"), (203, "http://myexample.com/en/7"), (204, None), (None, "http://notcom/en/"), (206, "http://bad.spam.info/0")]
    outcomes = [(k, 0) for k in range(40)] + [(100 + k, 1) for k in range(40)] + [(999, 0), (100, None), (None, 0)]
    p = spark.createDataFrame([(k, u, "x", "block") for k, u in pages], "page_id long, url string, html string, verdict string")
    o = spark.createDataFrame(outcomes, "page_id long, good int")
    got = {r.page_id: (r.rule, r.verdict) for r in host_reputation.filter_pages(p, o).collect()}
    assert got[0] == (None, "block") and got[200] == (None, "block") and got[100] == (None, "allow")
    assert got[201] == ("example.com/en/7", "allow") and got[202] == ("com/en/", "block") and got[203] == ("com/en/", "block") and got[None] == (None, "allow") and got[204][0] is None
    free = host_reputation.filter_pages(p, o.limit(0), rules=())
    assert {r.verdict for r in free.collect()} == {"allow"} and free.count() == len(pages)
    assert host_reputation.filter_pages(p.limit(0), o).count() == 0


def test_host_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(map(str, con.execute(registry.ORACLE_SQL["op9_url_filters"]).fetchall()))
    assert sorted(str(tuple(r)) for r in host_reputation.query(spark, SF).collect()) == want


def test_host_query_blocks_bad_hosts_only(spark):
    rows = [r for r in host_reputation.query(spark, "/root/testdata/sf0.1").collect() if r.rule is None]
    bad = {r.host for r in rows if r.verdict == "block"}
    assert len(bad) >= 4 and all(any(w in h for w in host_reputation.BAD_WORDS) for h in bad)


def test_very_long_urls(spark):
    host, path = "a." * 30_000 + "example.com", "/en/7" + "x" * 100_000
    p = spark.createDataFrame([(1, f"http://{host}{path}?q", None)], "page_id long, url string, html string")
    r = host_reputation.filter_pages(p, spark.createDataFrame([], "page_id long, good int")).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, "example.com/en/7", "allow")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [], [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        names.append(name)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns and docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
            last = docs
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] and len(names) == 5
    texts = last.collect()
    items = [decontamination.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in texts:
        t = decontamination.normalise(r.text)
        assert not any(i in t for i in items) and r.n_chars == len(r.text)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()]
    assert {r.doc_id for r in docs.collect()} == {k for k, _ in prints}
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_survives_awkward_rows(spark, odd, none, monkeypatch):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
