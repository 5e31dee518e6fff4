"""Byte-level BPE ids for many texts.

A byte-level tokenizer never joins bytes across the gap before a single space
that a non-space follows, so a text is the concatenation of its space-led words
and most words are encoded once per worker: a cache of ids, bounded in bytes, replaces
most of the merging. Texts in which a space meets other white space, or which hold
a special token's string, are encoded whole. Ids equal ``tokenizers``' own.
"""

from __future__ import annotations

import json
import re

import tiktoken
from tokenizers import Tokenizer

CACHE_BYTES = 24 << 20
_ENTRY = 170  # bytes of an entry besides its characters and ids
LONGEST_CACHED = 48
_GAP = re.compile(r" \s")
_encoders: dict[str, Encoder] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 stays, the rest is shifted above 255."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(moved)}


class _Words(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, encode, lead: str) -> None:
        self.encode, self.lead, self.left = encode, lead, CACHE_BYTES

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(word) <= LONGEST_CACHED:
            self.left -= _ENTRY + len(word) + len(ids)
            if self.left < 0:
                self.clear()
                self.left = CACHE_BYTES
            self[word] = ids
        return ids


class Encoder:
    """Ids of a ``tokenizers`` JSON file (byte-level BPE), without special tokens added."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            alphabet = _byte_alphabet()
            ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.specials}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Words(self._whole, ""), _Words(self._whole, " ")

    def _whole(self, text: str) -> bytes:
        # very long unbroken runs merge faster in the library's heap
        if self.fast is None or len(text) > 4096 and " " not in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return b"".join(k.to_bytes(4, "little") for k in ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        if self.fast is None or any(s in text for s in self.specials):
            return b"".join(k.to_bytes(4, "little") for k in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _GAP.search(text):
            return self._whole(text)
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
