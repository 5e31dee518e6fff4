"""Packing, token counts, quality rules, secrets, repeated strings: against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrelframe.llm import packing, quality_rules, secret_scan, suffix_dedup, token_ledger
from kestrelframe.llm.storage import exists, scratch
from kestrelframe.llm.textkernel import Texts, slices
from kestrelframe.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_encoder_equals_the_library(tokenizer, text_of):
    rng = random.Random(0)
    texts = [text_of(k, 40) for k in range(20)] + ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\u00a0 b", "don't 12ab<|endoftext|>x", "é" * 300, "\t\ta   b\n\n c", "猫 が 座る", "y" * 6000]
    texts += ["".join(rng.choice("ab1 .,'\n\té😀") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    code = encoder(packing.default_tokenizer())
    for t in texts:
        assert np.frombuffer(code.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, docs, tokenizer, capacity=1024):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = Counter()
    for k, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % capacity or capacity
        starts = [0, *range(cut, len(ids), capacity)]
        for p, a in enumerate(starts):
            b = starts[p + 1] if p + 1 < len(starts) else len(ids)
            want[(k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, none, tokenizer):
    rows = packing.pack(odd, packing.default_tokenizer()).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], tokenizer)
    assert n <= 1.05 * sum(r.length for r in rows) / 1024 + 1
    assert packing.pack(none, packing.default_tokenizer()).count() == 0
    with_ids = packing.pack(odd.where("doc_id = 4"), packing.default_tokenizer(), keep_ids=True).first()
    assert zlib.crc32(with_ids.ids) == with_ids.ids_crc32 and with_ids.length == len(with_ids.ids) // 4


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    h = {k: rng.randint(1, 40) for k in rng.sample(range(1, capacity + 1), min(capacity, 25))}
    seen, fill = Counter(), {}
    for e in packing.plan(h, capacity):
        for r in range(e.lo, e.hi):
            seen[(e.length, r)] += 1
            k = r - e.lo
            fill.setdefault(e.bin + k // e.per, []).append((e.at + (k % e.per) * e.length, e.length))
    assert seen == Counter({(length, r): 1 for length, n in h.items() for r in range(n)})
    large = 0
    for places in fill.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
        large = max(large, sum(n > capacity // 3 for _, n in places))
    assert large <= 2
    total = sum(k * n for k, n in h.items())
    big = sum(n for k, n in h.items() if k > capacity // 2)
    assert len(fill) <= max(big, 1.25 * total / capacity + 2)


def test_ledger(spark, odd, none):
    counts = token_ledger.count_tokens(odd, packing.default_tokenizer(), "v1")
    ledger = token_ledger.Ledger(spark, scratch(spark, "t"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", token_ledger.inserts(counts)) and not ledger.commit("a", token_ledger.inserts(counts))
    plain = {r.source: r.n for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert {r.source: r.n_tokens for r in ledger.totals().collect()} == plain
    first = counts.where("source = 'src1'")
    ledger.commit("b", token_ledger.revisions(first.withColumn("new_tokens", F.lit(7))))
    assert {r.source: r.n_tokens for r in ledger.totals().collect()}["src1"] == 7 * first.count()
    ledger.commit("c", token_ledger.deletes(first.withColumn("n_tokens", F.lit(7))))
    assert "src1" not in {r.source for r in ledger.totals().collect()}
    assert ledger.commit("d", token_ledger.inserts(token_ledger.count_tokens(none, packing.default_tokenizer(), "v1")))
    assert sorted(ledger.batches()) == ["a", "b", "c", "d"]
    before = sorted(map(tuple, ledger.totals().collect()))
    spark.createDataFrame([(None, "en", "v1", 1, 5)], token_ledger._SCHEMA).write.parquet(f"{ledger.path}/data/half-0")  # an attempt that died
    assert "half" not in ledger.batches() and ledger.compact() and ledger.batches() == []
    assert sorted(map(tuple, ledger.totals().collect())) == before and not ledger.commit("a", token_ledger.inserts(counts)) and ledger.committed("d")
    assert ledger.commit("e", token_ledger.inserts(first)) and ledger.batches() == ["e"] and ledger.compact()
    assert {r.source: r.n_docs for r in ledger.totals().collect()}["src1"] == first.count() and not ledger.committed("half")
    assert not exists(spark, f"{ledger.path}/commits/a") and ledger.committed("a")
    rival = token_ledger.Ledger(spark, ledger.path)
    rival.committed = lambda _: False  # two writers that both found the id free: the marker decides
    assert ledger.commit("f", token_ledger.inserts(first)) and not rival.commit("f", token_ledger.inserts(first))
    assert {r.source: r.n_docs for r in ledger.totals().collect()}["src1"] == 2 * first.count()
    with pytest.raises(ValueError):
        ledger.commit("../x", token_ledger.inserts(counts))


def test_token_counts_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Counter()
    for d in docs:
        if WORD.search(d.text or ""):
            want[(d.source, d.lang, "byte_bpe_50k", "t")] += len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1
            want[(d.source, d.lang, "words", "t")] += len(WORD.findall(d.text))
            want[(d.source, d.lang, "words", "d")] += 1
            want[(d.source, d.lang, "byte_bpe_50k", "d")] += 1
    got = {}
    for r in token_ledger.query(spark, sf).collect():
        got[(r.source, r.lang, r.tokenizer_version, "t")], got[(r.source, r.lang, r.tokenizer_version, "d")] = r.n_tokens, r.n_docs
    assert got == dict(want)


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_rules_counts(spark, odd, none):
    rows = quality_rules.judge(odd, quality_rules.Field.prior()).collect()
    want = Counter((r.doc_id, *base_rules(r.text)) for r in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert quality_rules.judge(none, quality_rules.Field.prior()).count() == 0


def test_quality_rules_on_random_lines(spark):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice("a bb c# d| é".split()) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(df, quality_rules.Field.prior()).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(texts[r.doc_id])


def test_viterbi_and_likelihood_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    size = [3, 1, 0, 4]
    doc = np.repeat(np.arange(4), size)
    x = rng.normal(size=(8, 2))
    field = quality_rules.Field(rng.normal(size=2), rng.normal(size=2), rng.normal(size=(2, 2)))
    label = quality_rules.viterbi(field, x @ field.emit, doc, 4)
    y = rng.integers(0, 2, 8)

    def score(path, s):
        return sum(field.emit @ x[s + k] * v for k, v in enumerate(path)) + field.start[path[0]] + sum(field.trans[a, b] for a, b in zip(path, path[1:], strict=False))

    total = 0.0
    for d, n in enumerate(size):
        if n:
            s = int(np.sum(size[:d]))
            paths = list(product((0, 1), repeat=n))
            assert tuple(label[s : s + n].astype(int)) == max(paths, key=lambda p, s=s: score(p, s))
            total += score(tuple(y[s : s + n]), s) - np.logaddexp.reduce([score(p, s) for p in paths])
    got, grad = quality_rules.log_likelihood(field, x, y, doc, 4)
    assert np.isclose(got, total)
    for part, g in (("emit", grad.emit), ("start", grad.start), ("trans", grad.trans)):
        p = getattr(field, part)
        for i in np.ndindex(p.shape):
            p[i] += 1e-6
            up = quality_rules.log_likelihood(field, x, y, doc, 4)[0]
            p[i] -= 1e-6
            assert abs((up - got) / 1e-6 - g[i]) < 1e-3


def test_quality_rules_learn(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_rules.query(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in rows]) > 0.97


def test_base_spans():
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "Z9" * 8
    t = f'Password: "abc.12+/", token=short api_key:\'x1x1x1\' {key} AKIA123 {hexes} ABCDEF{hexes[:23]} secret = {hexes}'
    got = {(k, t[a:b]) for a, b, k in secret_scan.base_spans(t)}
    assert got == {("assign", 'Password: "abc.12+/'), ("assign", "api_key:'x1x1x1"), ("access", key), ("hex", hexes), ("assign", f"secret = {hexes}")} | {("hex", hexes)}
    assert [k for _, _, k in secret_scan.base_spans("token=" + hexes)] == ["assign", "hex"]
    assert secret_scan.base_spans("\u017fecret=abcdefg \u212aey") == []  # look-alike letters are no letters of the names


def test_weak_parts_link_only_together():
    weak, ident = "aB3" + "xY9" * 6, "username = maria.k"
    spans = lambda t: [k for _, _, k in secret_scan.linked_spans(t, secret_scan.base_spans(t))]
    assert spans(weak) == [] and spans(ident) == [] and spans("https://db.example.org/x " + ident) == []
    assert sorted(spans(f"{ident} {weak} https://db.example.org/x")) == ["endpoint", "ident", "weak"]
    assert spans(f"{ident}{' .' * 300} {weak}") == []
    assert spans(f"{ident} password=hunter2hunter2") == ["ident"]
    assert spans("AKIA" + "Q" * 16 + " " + weak) == ["weak"]


def test_linking_equals_all_pairs():
    rng = random.Random(2)
    parts = ["username=bob77", "aB3xY9aB3xY9aB3xY9", "https://h.example.org/p", "AKIA" + "A1" * 9, "token=abcdef12", "lorem ipsum " * 8, "."]
    for _ in range(60):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        base = secret_scan.base_spans(t)
        every = secret_scan.linked_spans(t, base)
        near = lambda s, o: o[0] < s[1] + 200 and o[1] > s[0] - 200
        cand = [(m.start(), m.end(), k) for k, p in (("ident", secret_scan._IDENT), ("weak", secret_scan._WEAK), ("endpoint", secret_scan._ENDPOINT)) for m in p.finditer(t)]
        cand = [c for c in cand if not any(b[0] < c[1] and b[1] > c[0] for b in base)]
        ids = [c for c in cand if c[2] == "ident"] + [b for b in base if b[2] == "access"]
        sec = [c for c in cand if c[2] == "weak"] + [b for b in base if b[2] != "access"]
        want = [c for c in cand if (c[2] == "weak" or any(near(c, s) for s in sec)) and (c[2] == "ident" or any(near(c, i) for i in ids))]
        assert sorted(every) == sorted(want), t


def test_parts_link_inside_their_block_only():
    weak, ident, end = "aB3" + "xY9" * 6, "login: root.admin", "postgres://db.internal/x"
    kinds = lambda t: sorted(k for _, _, k in secret_scan.linked_spans(t, secret_scan.base_spans(t)))
    assert kinds(f"{ident}\n{weak}\n{end}") == ["endpoint", "ident", "weak"]
    assert kinds(f"{ident}\n \t\n{weak}") == [] and kinds(f"{ident}\n\n{ident}\n{weak}\n\n{end}") == ["ident", "weak"]
    assert kinds(f"{end}\n{ident}\r\n\r\n{weak}") == []


def test_planted_credentials_through_the_scan(spark, text_of):
    """Planted parts, their places known from the planting alone."""
    rng, rows, want = random.Random(4), [], {}
    for k in range(60):
        here = {"ident": "username=maria77", "weak": "zQ7" + "pL4xR9" * 4, "endpoint": "https://vault.example.org/api"}
        kinds = [n for n in here if rng.random() < 0.6]
        text, spans = text_of(k, 30) + "\n", []
        for n in rng.sample(kinds, len(kinds)):
            spans.append((n, len(text), len(text) + len(here[n])))
            text += here[n] + " \n"
        text += text_of(k + 1, 30)
        linked = {"ident", "weak"} <= set(kinds)
        want[k] = ",".join(f"{n}:{a}:{b}" for n, a, b in spans) if linked else ""
        rows.append((k, text))
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_secret_scan_and_redaction(spark, odd, none):
    extra = odd.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("é password = hunter2hunter2 and " + "ab12" * 8), "n_chars": F.lit(1).cast("long")})
    df = odd.unionByName(extra)
    rows = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assert rows[77].spans == "assign:2:27,hex:32:64" and rows[77].base_sha256 == hashlib.sha256(rows[77].spans.encode()).hexdigest()
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and len(rows) == len({r[0] for r in df.select("doc_id").collect()})
    red = secret_scan.redact(df)
    assert red.columns == df.columns and red.count() == df.count()
    r = red.where("doc_id = 77").first()
    assert r.text == f"é {secret_scan.MASK} and {secret_scan.MASK}" and r.n_chars == len(r.text)
    assert red.where("doc_id = 1").first().text is None and secret_scan.redact(none).count() == 0 and secret_scan.scan(none).count() == 0


def repeats(docs, length=100):
    """By brute force: strings of ``length`` bytes with an earlier start, ids with equal places being no earlier."""
    first = {}
    for k, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w, at = b[p : p + length], ((-(1 << 63) if k is None else k), p)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for k, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < ((-(1 << 63) if k is None else k), p):
                gone[p : p + length] = True
        runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        out.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def test_suffix_dedup_awkward(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = suffix_dedup.deduplicate(odd)
    assert Counter(map(tuple, got.collect())) == repeats(docs)
    assert suffix_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_random(spark, text_of, seed):
    rng = random.Random(seed)
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.4 or not docs:
                parts.append(text_of(rng.random(), rng.randint(5, 60)))
            elif kind < 0.8:
                other = rng.choice(docs)[1]
                a = rng.randint(0, len(other))
                parts.append(other[a : a + rng.randint(60, 400)])
            else:
                parts.append(rng.choice(["ab", "x", "Der ", "é"]) * rng.randint(20, 300))
        docs.append((k, "".join(parts)))
    rng.shuffle(docs)
    got = suffix_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), keep_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == repeats(docs)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_interleave_blocks_are_common_prefixes():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    end, group = np.arange(20, 400), rng.integers(0, 2, 380)
    order, block = suffix_dedup.interleave(buf, end, group, 6)
    found = {}
    for w, b in zip(order, block, strict=True):
        found.setdefault(b, set()).add(int(w))
    want = {}
    for w, (e, g) in enumerate(zip(end, group, strict=True)):
        want.setdefault((g, buf[e - 6 : e].tobytes()), set()).add(w)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_text_slices():
    texts = ["", None, "a b", "ccc", "", "d" * 50]
    for t in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array(texts, pa.large_string()), pa.chunked_array([texts[:3], texts[3:]])):
        got = [t2.buf[i:j].tobytes().decode() for a, b, t2 in slices(t, 8) for i, j in zip(t2.off[:-1], t2.off[1:], strict=True)]
        assert got == [x or "" for x in texts]
    assert list(slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_find_equal_windows(monkeypatch, seed):
    """Many small shards, texts of few symbols (zero bytes too): the blocks are the sets of equal windows."""
    rng = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "SHARD", rng.choice([150, 700, 1 << 18]))
    alphabet = [b"\0a", b"abc", bytes(range(256))][seed % 3]
    bodies: list[bytes] = []
    for _ in range(60):
        body = bytes(rng.choice(alphabet) for _ in range(rng.randint(100, 160)))
        if bodies and rng.random() < 0.7:
            other = rng.choice(bodies)
            a = rng.randint(0, max(0, len(other) - 101))
            body = body[: rng.randint(0, 60)] + other[a:] + body[100 : 100 + rng.randint(0, 60)]
        bodies.append(body if len(body) >= 100 else body.ljust(100, b"a"))
    bodies.append(b"\0" * 400)
    size = np.array([len(b) - 99 for b in bodies])
    body, nth, block = suffix_dedup.repeated_windows(pa.array(bodies, pa.binary()), size)
    got: dict[int, set] = {}
    for b, k, g in zip(body.tolist(), nth.tolist(), block.tolist(), strict=True):
        got.setdefault(g, set()).add((b, k))
    want: dict[bytes, set] = {}
    for b, text in enumerate(bodies):
        for k in range(len(text) - 99):
            want.setdefault(text[k : k + 100], set()).add((b, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_transform_orders_suffixes():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (1, 5, 40, 300, 300)] + [b"ab" * 90, b"ab" * 90]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rank, interval = suffix_dedup.transform(Texts(np.frombuffer(b"".join(texts), np.uint8), off), 100)
    suffixes = [t[k : k + 100] for t in texts for k in range(len(t))]
    by = np.argsort(rank)
    assert sorted(rank.tolist()) == list(range(1, len(suffixes) + 1))
    assert [suffixes[k] for k in by] == sorted(suffixes)
    assert [interval[by[k]] == interval[by[k + 1]] for k in range(len(by) - 1)] == [suffixes[by[k]] == suffixes[by[k + 1]] for k in range(len(by) - 1)]
