"""Nothing of a text is left out: hashes of regular strings, signals at the far end of very long texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kestrelframe.llm import quality_classifier, quality_rules, textkernel, toxicity


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_regular_strings_do_not_collide(spark):
    m = thue_morse(4096)
    other = m.translate(str.maketrans("ab", "ba"))
    rows = [(k, f"{x}\n{y}\n{x}") for k, (x, y) in enumerate((m[:n], other[:n]) for n in (512, 1024, 2048, 4096))]
    rows += [(10, " ".join([f"{m[:1024]} x y {other[:1024]} x y"]))]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), quality_rules.Field.prior()).collect()}
    assert [got[k].n_dup_lines for k in range(4)] == [1] * 4 and got[10].n_repeat_words == 0


def test_hash_is_the_polynomial():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    t = textkernel.Texts(buf, np.array([0, 4000]))
    start = rng.integers(0, 4000, 300)
    end = np.array([rng.integers(s, 4001) for s in start])
    plain = [sum((int(c) + 1) * pow(textkernel._BASE, k, textkernel._PRIME) for k, c in enumerate(buf[a:b])) % textkernel._PRIME for a, b in zip(start, end, strict=True)]
    assert (t.span_hash(t.prefix_hash(), start, end) == textkernel.mix64(np.array(plain, np.uint64))).all()


def test_long_spans_hash_in_steps(monkeypatch):
    t = next(textkernel.slices(pa.array(["ab" * 3000]), 1 << 20))[2]
    a, b = np.array([0, 2, 1]), np.array([5000, 5002, 5001])
    want = t.span_hash(t.prefix_hash(), a, b)
    monkeypatch.setattr(textkernel, "_STEP", 64)
    assert (t.span_hash(t.prefix_hash(), a, b) == want).all() and want[0] == want[1] != want[2]


def far_end(spark, text_of):
    """Long texts, alike but for their last words; the label follows those."""
    rows = [(k, text_of(k, 4000) + "\n" + ("### %%% JUNK ||| " if k % 2 else "A calm close of it all. ") * 300) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")


def test_models_learn_from_the_end_of_long_texts(spark, text_of):
    docs, labels = far_end(spark, text_of)
    first = F.col("doc_id") < 20
    q = quality_classifier.fit(*quality_classifier.sample(docs, labels, first))
    t = toxicity.fit(*toxicity.sample(docs, labels, first))
    good = {r.doc_id: r.score for r in quality_classifier.score(docs, q, F.lit(False)).collect()}
    bad = {r.doc_id: r.score for r in toxicity.score(docs, t, F.lit(False)).collect()}
    assert all((good[k] > 0.5) == (k % 2 == 0) and (bad[k] > 0.5) == (k % 2 == 1) for k in range(20, 40))


def test_every_line_trains(spark, text_of):
    docs, labels = far_end(spark, text_of)
    x, y, of, n = quality_rules.training_lines(docs, labels, sequence=100)
    lines = [sum(1 for v in r.text.split("\n") if v.split()) for r in docs.collect()]
    assert len(x) == sum(lines) == len(y) and n == sum(-(-k // 100) for k in lines) and np.bincount(of).max() == 100


def test_sample_takes_whole_texts_within_its_bounds(spark):
    from kestrelframe.llm.training import labelled

    docs = spark.createDataFrame([(k, "x" * (1000 if k == 3 else 10)) for k in range(10)] + [(None, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    every = labelled(docs, labels, "quality", 100, 10_000).collect()
    assert len(every) == 11 and sum(r.y for r in every) == 6
    some = labelled(docs, labels, "quality", 100, 95).collect()
    assert all(r.text != "x" * 1000 for r in some) and sum(len(r.text or "") for r in some) <= 95 and len([r for r in some if r.text]) == 9
    assert labelled(docs, labels, "quality", 3, 10_000).count() <= 4 and labelled(docs, labels.limit(0), "quality", 3, 9).count() == 0
