"""Benchmark items in documents, by SimHash of item-sized windows.

For each length that a benchmark item has, windows of as many words slide over a
document. A window's fingerprint is the SimHash of its shingles, each weighted by
its count: 256 signs of sums, taken from running sums. Windows without any
shingle of the benchmark have similarity 0 and are skipped, which loses nothing.
A multi-index finds all item fingerprints within RADIUS: fingerprints are cut
into 16 blocks of 16 bits, and of two that differ in at most 63 bits some block
differs in at most 3, so each item is entered under all block values that near.
Candidates are then verified by the exact weighted Jaccard similarity of the two
bags of shingles. Two bags of one size with similarity 0.8 differ in 39 bits on
average, with a deviation below 6.

The benchmark is read in parts of at most ITEMS items, each small enough to
broadcast; the documents are scanned once per part, without any shuffle.

Defined results: null text is empty; documents shorter than an item are one
window; items of fewer than five words have no shingle and match nothing; an
item is reported once per document row, with its best window, the first of
equals; repeated items are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import batch_rows, held, id_type, text_rows, texts_of
from .shingles import SHINGLE, U64, mix, overlap, shingles, words

SIMILAR = 0.8
BITS, CELL, RADIUS = 256, 16, 63
ITEMS = 500
NEAR = RADIUS // (BITS // CELL)


def signs(s: np.ndarray) -> np.ndarray:
    """(shingles, BITS) of +1 and -1."""
    salted = np.stack([mix(s + U64(0x5851F42D4C957F2D * k & (1 << 64) - 1)) for k in range(1, BITS // 64 + 1)], 1)
    return np.unpackbits(np.ascontiguousarray(salted).view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(windows, BITS / CELL) block values of sums of signs."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


class Items:
    """Items of one part of the benchmark, by length, with their multi-index."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.shingles, self.bags, self.length, self.at = [], [], [], []
        for at, text in rows:
            w = words(text or "")
            if len(w) >= SHINGLE:
                s = shingles(w)
                self.shingles.append(s)
                self.bags.append(np.unique(s, return_counts=True))
                self.length.append(len(w))
                self.at.append(at)
        self.known = np.unique(np.concatenate([np.zeros(0, U64), *self.shingles]))
        none = np.zeros((0, BITS // CELL), np.int64)
        self.prints = np.concatenate(
            [none, *[fingerprints(signs(s).sum(axis=0, dtype=np.int64)[None]) for s in self.shingles]]
        )
        near = [0] + [
            sum(1 << b for b in bits) for n in range(1, NEAR + 1) for bits in combinations(range(CELL), n)
        ]
        self.ball = np.array(near, dtype=np.int64)
        small = np.uint16 if len(self.length) <= 1 << 16 else np.int32
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in set(self.length):
            of = np.array([k for k, m in enumerate(self.length) if m == n])
            each = len(of) * len(self.ball)
            key = np.empty(each * (BITS // CELL), np.int32)
            item = np.empty(len(key), small)
            for c in range(BITS // CELL):  # keys of a block lie below those of the next
                own = ((self.prints[of, c][:, None] ^ self.ball[None]) + (c << CELL)).astype(np.int32).ravel()
                order = np.argsort(own, kind="stable")
                key[c * each : (c + 1) * each] = own[order]
                item[c * each : (c + 1) * each] = of.astype(small)[order // len(self.ball)]
            self.index[n] = key, item

    def within(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with distance at most RADIUS, among items of n words."""
        key, item = self.index[n]
        asked = (prints + (np.arange(BITS // CELL) << CELL)[None]).astype(np.int32).ravel()
        lo, hi = np.searchsorted(key, asked), np.searchsorted(key, asked, side="right")
        many = hi - lo
        window = np.repeat(np.arange(len(asked)) // (BITS // CELL), many)
        found = item[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())].astype(np.int64)
        pairs = np.unique(window * len(self.length) + found)
        window, found = pairs // max(len(self.length), 1), pairs % max(len(self.length), 1)
        near = distances(prints[window], self.prints[found]) <= RADIUS
        return window[near], found[near]

    def matches(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the items in a text."""
        if not len(self.known):
            return []
        w = words(text)
        if len(w) < SHINGLE:
            return []
        s = shingles(w)
        at = np.searchsorted(self.known, s)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == s)
        if not len(hits):
            return []
        best: dict[int, tuple[float, int, int]] = {}
        far = max(self.length) - SHINGLE
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * far + 1) + 1):
            lo, hi = max(0, part[0] - far), min(len(s), part[-1] + far + 1)
            self._around(s[lo:hi], part - lo, lo, len(w), least, best)
        return [(self.at[k], *v) for k, v in sorted(best.items())]

    def _around(self, s, hits, first, n_words, least, best) -> None:
        # All windows of any item's length that touch a hit lie in ``s``.
        sums = np.zeros((len(s) + 1, BITS), np.int32)
        np.cumsum(signs(s), axis=0, out=sums[1:])
        held = np.zeros(len(s) + 1, np.int64)
        held[1:] = np.cumsum(np.isin(np.arange(len(s)), hits))
        for n in self.index:
            m = min(n, n_words) - SHINGLE + 1
            if m > len(s):
                continue
            starts = np.flatnonzero(held[m:] - held[: len(held) - m])
            window, item = self.within(n, fingerprints(sums[starts + m] - sums[starts]))
            for k, i in zip(starts[window].tolist(), item.tolist()):
                like = overlap(np.unique(s[k : k + m], return_counts=True), self.bags[i])
                if like >= least and (i not in best or like > best[i][0]):
                    best[i] = (like, first + k, m + SHINGLE - 1)


def items_of(key: str, rows: Broadcast) -> Items:
    """The index of a part, built once per worker."""
    return held("words", "items", key, lambda: Items(rows.value))


def parts_of(benchmark: DataFrame, item_col: str, item_text: str, items: int) -> Iterator[tuple[str, Broadcast, list]]:
    """Key, broadcast (number, text) rows and item ids of each part of the benchmark."""
    parts = max(1, -(-benchmark.count() // items))
    dealt = benchmark.select(
        F.col(item_col).alias("item"),
        F.col(item_text).alias("text"),
        F.pmod(F.xxhash64(item_col, item_text), F.lit(parts)).alias("part"),
    )
    for p in range(parts):
        rows = dealt.filter(F.col("part") == p).collect()  # about ``items`` rows
        shared = benchmark.sparkSession.sparkContext.broadcast([(k, r["text"]) for k, r in enumerate(rows)])
        yield uuid4().hex, shared, [r["item"] for r in rows]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    least: float = SIMILAR,
    items: int = ITEMS,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): one row per document row and item in it."""
    batch_rows(docs.sparkSession)
    schema = StructType.fromDDL(
        f"doc_id {id_type(docs, id_col)}, item_id {id_type(benchmark, item_col)}, "
        "similarity double, first_word long, n_words long"
    )
    kind = to_arrow_type(schema["item_id"].dataType)
    texts = text_rows(docs, id_col, text_col)
    out = None
    for key, rows, names in parts_of(benchmark, item_col, item_text, items):

        def scan(batches, key=key, rows=rows, names=names):
            index = items_of(key, rows)
            for b in batches:
                found = [(k, *m) for k, text in enumerate(texts_of(b)) for m in index.matches(text, least)]
                doc, item, like, first, n = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(pa.array(doc, pa.int64())),
                        pa.array([names[i] for i in item], kind),
                        pa.array(like, pa.float64()),
                        pa.array(first, pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    schema.names,
                )

        hits = texts.mapInArrow(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    least: float = SIMILAR,
    items: int = ITEMS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they were; no shuffle."""
    batch_rows(docs.sparkSession)
    for key, rows, _ in parts_of(benchmark, item_col, item_text, items):
        docs = docs.filter(~holds_item(F.col(text_col), key, rows, least))
    return docs


def holds_item(text: Column, key: str, rows: Broadcast, least: float = SIMILAR) -> Column:
    """Whether a text holds an item of one part of the benchmark."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = items_of(key, rows)
        for texts in batches:
            yield pd.Series([bool(index.matches(t, least)) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")(F.coalesce(text, F.lit("")))
