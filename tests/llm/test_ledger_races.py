"""Commits that fall between a fold's listing and its writing, on either side."""

from kestrelframe.llm.storage import names, scratch
from kestrelframe.llm.token_ledger import Ledger, inserts


def counted(spark, n):
    return inserts(spark.createDataFrame([("s", "en", "v", n)], "source string, lang string, tokenizer_version string, n_tokens long"))


def sums(ledger):
    return [tuple(r)[-2:] for r in ledger.totals().collect()]


def test_commit_while_folding(spark, monkeypatch):
    ledger = Ledger(spark, scratch(spark, "race"))
    ledger.commit("a", counted(spark, 10))
    listed, written = Ledger._since, Ledger._sums

    def after_listing(self, fold):
        found = listed(self, fold)
        Ledger(spark, ledger.path).commit("b", counted(spark, 5))
        return found

    def before_writing(self, fold, since):
        Ledger(spark, ledger.path).commit("c", counted(spark, 3))
        return written(self, fold, since)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_since", after_listing)
        m.setattr(Ledger, "_sums", before_writing)
        assert ledger.compact()
    assert sums(ledger) == [(3, 18)] and ledger.batches() == ["b", "c"]
    assert ledger.compact() and sums(ledger) == [(3, 18)] and ledger.batches() == []


def test_late_writer_of_a_folded_batch(spark, monkeypatch):
    ledger = Ledger(spark, scratch(spark, "late"))
    ledger.commit("a", counted(spark, 10))
    assert ledger.compact() and ledger.compact()  # the marker is gone
    with monkeypatch.context() as m:
        m.setattr(Ledger, "committed", lambda self, batch_id: False)  # it looked before the first commit
        assert not ledger.commit("a", counted(spark, 10))
    assert sums(ledger) == [(1, 10)]


def test_old_folds_are_removed(spark):
    ledger = Ledger(spark, scratch(spark, "folds"))
    for k in range(4):
        ledger.commit(f"b{k}", counted(spark, 1))
        assert ledger.compact()
    assert names(spark, f"{ledger.path}/folds") == ["3", "4"]
    assert sum(n.startswith("fold-") for n in names(spark, f"{ledger.path}/data")) == 2
    assert sums(ledger) == [(4, 4)] and all(ledger.committed(f"b{k}") for k in range(4))
