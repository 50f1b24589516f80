"""Order-preserving packing of token streams into windows.

Each partition is one stream of documents in its order. Cuts fall on ends of
documents or sentences (and on a grid inside sentences that are longer than a
window's worth of choice). A dynamic programme picks the cuts of least cost:
padding, plus a penalty for a cut inside a document, plus a small price per
window. Its transitions come from a monotone queue: the cost of a padded window
from j to i is dp[j] + window - (i - j) + penalty(i), so the best j is the least
dp[j] + j among the last ``window`` positions. A window whose length is a power
of two needs no padding; those few lengths are looked up directly.

A stream is handled in blocks. The last cuts of a block are taken back and its
rest is carried on, so memory stays bounded and block ends cost nothing.

Defined results: null text is an empty document, of one end mark; a document
longer than a block goes on in the next one; ids of any type, null or repeated,
are carried along; empty partitions give no rows. Sequence numbers are unique
over the table, not dense.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import SpacedIds, tokenizer
from .common import batch_rows, held, id_type, text_rows, texts_of

WINDOW = 1024
#: Tokens of a block, and how many of them are taken back at its end.
BLOCK, TAKEN_BACK = 1 << 18, 1 << 14
#: Price in padded tokens: of a window, of a cut at a sentence's end, of one inside a sentence.
PER_WINDOW, AT_SENTENCE, INSIDE = 8.0, 1.0, 4.0
#: A sentence longer than this also gets cut points on a grid.
GRID = 24
END_ID = 0
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ids_of(path: str) -> SpacedIds:
    """Kept for the tasks that follow in a worker."""
    return held("tokens", "ids", path, lambda: SpacedIds(path))


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its string ends a sentence."""
    t = tokenizer(path)
    ends = np.zeros(t.get_vocab_size(), dtype=bool)
    for s, i in t.get_vocab().items():
        ends[i] = s[-1] in ".!?Ċ"  # the last is the letter for a line feed
    return ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and what each costs."""
    price = np.full(len(ids) + 1, np.inf)
    price[np.flatnonzero(ends[ids]) + 1] = AT_SENTENCE
    price[doc_ends] = 0.0
    price[0] = price[len(ids)] = 0.0
    at = np.flatnonzero(np.isfinite(price))
    grid = min(GRID, window)
    gaps = np.diff(at)
    for k in np.flatnonzero(gaps > grid):
        inside = np.arange(at[k] + grid, at[k + 1], grid)
        price[inside] = INSIDE
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, window: int = WINDOW, power_free: bool = True) -> np.ndarray:
    """Positions of ``at`` where windows end, from 0 to the last one, at least cost."""
    n = len(at)
    place = np.full(at[-1] + 1, -1, dtype=np.int64)
    place[at] = np.arange(n)
    free: list[list[int]] = [[] for _ in range(n)]
    p = 1
    while power_free and p <= window:
        i = np.flatnonzero(at >= p)
        j = place[at[i] - p]
        for k, m in zip(i[j >= 0].tolist(), j[j >= 0].tolist()):
            free[k].append(m)
        p *= 2
    where, prices = at.tolist(), price.tolist()
    cost, back, value = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque([0])
    for i in range(1, n):
        x = where[i]
        while where[queue[0]] < x - window:
            queue.popleft()
        j = queue[0]
        least = value[j] + window - x
        for m in free[i]:
            if cost[m] < least:
                least, j = cost[m], m
        least += prices[i] + PER_WINDOW
        cost[i], back[i] = least, j
        v = value[i] = least + x
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
    cuts, i = [n - 1], n - 1
    while i:
        i = back[i]
        cuts.append(i)
    return at[np.array(cuts[::-1])]


class Stream:
    """Documents that wait to be packed, and the windows made of them."""

    def __init__(self, ends: np.ndarray, window: int, first: int):
        self.ends, self.window, self.sequence = ends, window, first
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # row in ``ids``, ids taken before, tokens in all
        self.waiting = 0

    def add(self, row: int, raw: bytes) -> None:
        ids = np.frombuffer(raw + END_ID.to_bytes(4, "little"), dtype="<u4")
        self.parts.append(ids)
        self.docs.append((row, 0, len(ids)))
        self.waiting += len(ids)

    def pack(self, last: bool) -> list[np.ndarray]:
        """Columns row, start, length, crc32, doc_tokens, sequence_id, offset of finished pieces."""
        ids = np.concatenate(self.parts)
        rows, before, total = (np.array(x, dtype=np.int64) for x in zip(*self.docs))
        doc_ends = np.cumsum(total - before)
        doc_starts = doc_ends - (total - before)
        at, price = cut_points(ids, doc_ends, self.ends, self.window)
        cuts = best_cuts(at, price, self.window)
        if not last:
            cuts = cuts[cuts <= len(ids) - TAKEN_BACK]
        done = cuts[-1]
        starts = np.unique(np.concatenate([cuts[:-1], doc_starts[doc_starts < done]]))
        stops = np.append(starts[1:], done)
        doc = np.searchsorted(doc_starts, starts, side="right") - 1
        seq = np.searchsorted(cuts, starts, side="right") - 1
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]
        out = [
            rows[doc],
            starts - doc_starts[doc] + before[doc],
            stops - starts,
            np.array(crc, dtype=np.int64),
            total[doc],
            self.sequence + seq,
            starts - cuts[seq],
        ]
        self.sequence += len(cuts) - 1
        keep = doc_ends > done
        gone = np.clip(done - doc_starts[keep], 0, None)
        self.docs = list(zip(rows[keep].tolist(), (before[keep] + gone).tolist(), total[keep].tolist()))
        self.parts = [ids[done:].copy()] if done < len(ids) else []
        self.waiting = len(ids) - int(done)
        return out


def pack(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece."""
    kind = id_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stream = ids_of(path), Stream(sentence_ends(path), window, TaskContext.get().partitionId() << 40)
        known: list[pa.Array] = []  # ids of the documents in the stream

        def pieces(last: bool) -> pa.RecordBatch:
            nonlocal known
            names = pa.concat_arrays(known)
            row, *columns = stream.pack(last)
            found = names.take(pa.array(row))
            waiting = [d[0] for d in stream.docs]
            known = [names.take(pa.array(waiting, pa.int64()))]
            stream.docs = [(k, b, t) for k, (_, b, t) in enumerate(stream.docs)]
            return pa.RecordBatch.from_arrays([found, *[pa.array(c, pa.int64()) for c in columns]], NAMES)

        for b in batches:
            names = b.column("id")
            for k, text in enumerate(texts_of(b)):
                known.append(names.slice(k, 1))
                stream.add(len(stream.docs), of.text(text))
                if stream.waiting >= BLOCK:
                    yield pieces(False)
        if stream.docs:
            yield pieces(True)

    batch_rows(df.sparkSession)
    schema = ", ".join(f"`{n}` {kind if n == 'doc_id' else 'long'}" for n in NAMES)
    return text_rows(df, id_col, text_col).mapInArrow(run, schema)

