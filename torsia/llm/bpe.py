"""Token counts and ids of texts through caches of white-space chunks.

Neither vocabulary merges across the edge between a non-space character and a
space, so a text's tokens are those of its chunks. A worker keeps what it has
worked out for chunks, in dictionaries that start anew when full.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .common import LONG

#: Entries that a worker's dictionary may hold.
CACHE = 400_000
#: Characters on which Python's classes and the vocabulary's pre-tokenizer agree.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[!-~{LATIN}]+")
SPECIAL = "<|"
#: Python splits at these; the vocabularies take them for visible characters.
ODD = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=8)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + rest.index(b)) for b in range(256)]


def as_letters(piece: str) -> str:
    table = byte_letters()
    return "".join([table[b] for b in piece.encode()])


def whole_tokens(path: str) -> frozenset[str]:
    """Lower-case strings proven to encode alone as one token.

    Every vocabulary string that ends a word is decoded and encoded again by the
    library. The set is no larger than the vocabulary.
    """
    t = tokenizer(path)
    back = {c: b for b, c in enumerate(byte_letters())}
    strings = []
    for s in t.get_vocab():
        if s.endswith("</w>") and all(c in back for c in s[:-4]):
            raw = bytes(back[c] for c in s[:-4])
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:
                continue
    codes = t.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, codes) if len(e.ids) == 1 and s == s.lower() and SPECIAL not in s)


def keep(known: dict, chunk: str, value: int | bytes) -> None:
    """Remember a chunk unless it is long; a full dictionary starts anew."""
    if len(chunk) <= LONG:
        if len(known) >= CACHE:
            known.clear()
        known[chunk] = value


class WordCounts(dict):
    """chunk without white space -> tokens, for vocabularies that end words.

    A plain chunk is cut into pre-tokens; those proven whole count one, and only
    the rest are merged. Any other chunk is encoded by the library.
    """

    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.library, self.whole, self.merged = tokenizer(path), whole, {}

    def __missing__(self, chunk: str) -> int:
        if PLAIN.fullmatch(chunk) and SPECIAL not in chunk:
            n = sum(1 if p in self.whole else self.merge(p) for p in self.pieces.findall(chunk.lower()))
        else:
            n = self.by_library(chunk)
        keep(self, chunk, n)
        return n

    def merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            n = len(self.library.model.tokenize(as_letters(piece)))
            keep(self.merged, piece, n)
        return n

    def by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def text(self, text: str) -> int:
        if ODD.search(text):
            return self.by_library(text)
        return sum(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def merger(path: str) -> tiktoken.Encoding | None:
    """The same merges in a leaner form, or None if the vocabulary's numbers aren't in the order of its merges."""
    model = json.loads(Path(path).read_text())["model"]
    back = {c: b for b, c in enumerate(byte_letters())}
    vocab = {s: i for s, i in model["vocab"].items() if all(c in back for c in s)}
    for k, m in enumerate(model["merges"]):
        if vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) != 256 + k:
            return None
    ranks = {bytes(back[c] for c in s): i for s, i in vocab.items() if i < 256 + len(model["merges"])}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class SpacedIds(dict):
    """chunk after one space -> its ids as little-endian 32-bit numbers, for byte-level vocabularies."""

    word = re.compile(f"([{LATIN}]+)([!-&(-/:-@\\[-`{{-~]+)")
    plain = re.compile(f"[\n!-~{LATIN}]+")
    #: A run of white space that holds a space not at its end can be one token.
    inner = re.compile(r"\s \s")

    def __init__(self, path: str):
        super().__init__()
        self.library, self.merges, self.tails = tokenizer(path), merger(path), {}

    def __missing__(self, chunk: str) -> bytes:
        m = self.word.fullmatch(chunk)
        if m is not None and SPECIAL not in chunk:
            # Punctuation after a word stands alone, whatever the word.
            ids = self[m[1]] + self.tail(m[2])
        else:
            ids = self.encoded(" " + chunk)
        keep(self, chunk, ids)
        return ids

    def tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.encoded(marks)
            keep(self.tails, marks, ids)
        return ids

    def encoded(self, text: str) -> bytes:
        if self.merges is not None and SPECIAL not in text and self.plain.fullmatch(text.removeprefix(" ")):
            return array("I", self.merges.encode_ordinary(text)).tobytes()
        return self.by_library(text)

    def by_library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        if ODD.search(text) or SPECIAL in text or self.inner.search(text):
            return self.by_library(text)
        first, *rest = text.split(" ")
        return (self.encoded(first) if first else b"") + b"".join(map(self.__getitem__, rest))
