"""Weak parts of any length."""

import pytest

from kestrelframe.llm import secret_scan


@pytest.mark.parametrize("n", (16, 128, 129, 500, 100_000))
def test_long_parts_are_reported_whole(n):
    token, name = ("aB3" * n)[:n], "u" * n
    text = f"user = {name} then {token}== end"
    spans = secret_scan.linked_spans(text, secret_scan.base_spans(text))
    assert {(k, text[a:b]) for a, b, k in spans} == {("ident", f"user = {name}"), ("weak", f"{token}==")}
