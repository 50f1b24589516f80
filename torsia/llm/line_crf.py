"""Document quality from a linear-chain conditional random field over lines.

Every line that isn't blank is described by measures of its characters and words,
each cut into bins. A line's state, good or bad, takes evidence from the bins of
the line itself, of the line before and of the line after, and from the states
next to it. The forward and backward messages give each line's probability of
being good; their mean, weighted by the lines' bytes, is the document's share of
good text, and a logistic function fitted to the labels turns its log-odds into
the score.

Labels mark documents, not lines. The field is first fitted with every line
bearing its document's label. In later rounds, lines of a bad document that look
good by their own evidence count as good, but for its worst line, so that one
ordinary line in junk isn't learnt as junk.

Training takes at most TRAIN documents of each label, those with the least hash
of their id, and of each at most LINES neighbouring lines, whose place is drawn
by a hash; only bins and lengths reach the driver. Scoring reads whole texts in
place, without a shuffle.

Defined results: null, empty and blank texts are one empty line; unlabelled rows
and null labels aren't learnt from; a document labelled twice bears the larger
label, and of rows with one id each counts; without both labels the score is the
share of good rows, or 0.5 if there are no labels. Scoring is a column, so all
columns of a frame stay, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, texts_of

TRAIN, LINES = 3000, 200
#: Weight of the prior on the field's weights, gradient steps a round, rounds.
RIDGE, STEPS, ROUNDS = 2.0, 120, 2
SENTENCE_MARKS = b".,;:!?'\"()-"
WHITE = b" \t\r\v\f\x1c\x1d\x1e\x1f"
LETTER, UPPER, DIGIT, BLANK, MARK, SIGN = range(6)
#: Upper edges of the bins of shares, and of lengths and counts.
SHARE = np.array([0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
SIZE = np.array([1, 4, 8, 16, 32, 64, 128, 256, 512])
WORD = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 15])
BINS = 10
MEASURES = (
    "bytes", "upper", "digits", "blanks", "marks", "signs", "doubled",
    "words", "letters a word", "distinct words", "neighbours alike", "ends as a sentence", "seen above",
)


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    of[33:128] = SIGN
    of[0:33] = SIGN
    for marks, c in ((range(97, 123), LETTER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (WHITE, BLANK), (SENTENCE_MARKS, MARK)):
        of[list(marks)] = c
    return of


CLASS = _classes()


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()] or [""]


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line's measures, bytes of every line, lines of every text)."""
    lines: list[str] = []
    many = np.zeros(len(texts), np.int64)
    words, distinct, alike, seen = [], [], [], []
    for k, t in enumerate(texts):
        own = lines_of(t)
        many[k] = len(own)
        lines += own
        known: set[str] = set()
        for x in own:
            w = x.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            alike.append(sum(map(eq, w, w[1:])))
            seen.append(x in known)
            known.add(x)
    raw = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    stops = np.flatnonzero(raw == 10)
    starts = np.r_[0, stops[:-1] + 1]
    size = stops - starts
    kind = CLASS[raw]
    kind[stops] = 255

    def total(flags: np.ndarray) -> np.ndarray:
        # Every stretch from a start to the next holds at least its line's end.
        return np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    shares = [total(kind == c) for c in (UPPER, DIGIT, BLANK, MARK, SIGN)]
    twice = np.zeros(len(raw), bool)
    twice[1:] = (raw[1:] == raw[:-1]) & (kind[1:] >= MARK) & (kind[1:] < 255)
    shares.append(total(twice))
    least = np.maximum(size, 1)
    n, u, a = np.array(words, float), np.array(distinct, float), np.array(alike, float)
    last = raw[np.maximum(stops - 1, 0)]
    columns = [np.searchsorted(SIZE, size)]
    columns += [np.searchsorted(SHARE, s / least) for s in shares]
    columns += [
        np.searchsorted(SIZE, n),
        np.searchsorted(WORD, (size - shares[2]) / np.maximum(n, 1)),
        np.searchsorted(SHARE, u / np.maximum(n, 1)),
        np.searchsorted(SHARE, a / np.maximum(n, 1)),
        np.isin(last, np.frombuffer(b".!?", np.uint8)),
        np.array(seen, bool),
    ]
    return np.stack(columns, 1).astype(np.uint8), size, many


class Chains:
    """Lines of many documents, to be walked line by line in all documents at once.

    Documents are put in order of falling length, so the k-th lines of all
    documents that have one are a leading stretch.
    """

    def __init__(self, many: np.ndarray):
        self.many = many
        self.first = np.cumsum(many) - many
        self.order = np.argsort(-many, kind="stable")
        falling = many[self.order]
        longest = int(falling[0]) if len(falling) else 0
        self.alive = np.searchsorted(-falling, -np.arange(1, longest + 1), side="right")
        self.starts = self.first[self.order]
        total = int(many.sum())
        self.head = np.zeros(total, bool)
        self.head[self.first] = True
        self.tail = np.zeros(total, bool)
        self.tail[self.first + many - 1] = True

    def messages(self, evidence: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good that come to each line from those before and from those after.

        ``pull[a, b]`` is the weight of a line in state a followed by one in state b.
        """

        def passed(odds: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.logaddexp(odds + w[1, 1], w[0, 1]) - np.logaddexp(odds + w[1, 0], w[0, 0])

        before, after = np.zeros(len(evidence)), np.zeros(len(evidence))
        for k in range(1, len(self.alive)):
            at = self.starts[: self.alive[k]] + k
            before[at] = passed(before[at - 1] + evidence[at - 1], pull)
        for k in range(len(self.alive) - 2, -1, -1):
            at = self.starts[: self.alive[k + 1]] + k
            after[at] = passed(after[at + 1] + evidence[at + 1], pull.T)
        return before, after


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Field:
    """Weights of bins (own line, line before, line after), of neighbouring states, and the logistic fit."""

    weights: np.ndarray  # (3, measures, BINS)
    offset: float
    pull: np.ndarray  # (2, 2)
    slope: float
    shift: float

    def evidence(self, bins: np.ndarray, chains: Chains) -> np.ndarray:
        at = np.arange(len(MEASURES))
        own, before, after = (self.weights[k][at, bins].sum(axis=1) for k in range(3))
        # ``before`` is what a line says of the next one, ``after`` of the one above.
        out = own + self.offset
        out[1:] += np.where(chains.head[1:], 0.0, before[:-1])
        out[:-1] += np.where(chains.tail[:-1], 0.0, after[1:])
        return out

    def marginals(self, bins: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of being good, per line."""
        e = self.evidence(bins, chains)
        before, after = chains.messages(e, self.pull)
        return sigmoid(e + before + after)

    def shares(self, bins: np.ndarray, size: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Share of good text of every document, by bytes."""
        if not len(many):
            return np.zeros(0)
        chains = Chains(many)
        weight = np.maximum(size, 1).astype(float)
        good = np.add.reduceat(self.marginals(bins, chains) * weight, chains.first)
        return good / np.add.reduceat(weight, chains.first)

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * odds(self.shares(*measure(texts))) + self.shift)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def constant(share: float) -> Field:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Field(np.zeros((3, len(MEASURES), BINS)), 0.0, np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))


def gradient(field: Field, bins: np.ndarray, chains: Chains, good: np.ndarray, weight: np.ndarray) -> tuple:
    """Slopes of the weighted log-likelihood of the lines' states: bins, offset, neighbouring states."""
    e = field.evidence(bins, chains)
    before, after = chains.messages(e, field.pull)
    gap = weight * (good - sigmoid(e + before + after))
    slot = bins.astype(np.int64) + BINS * np.arange(len(MEASURES))
    cells = BINS * len(MEASURES)

    def add(at: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.bincount(at.ravel(), np.repeat(by, at.shape[1]), cells).reshape(len(MEASURES), BINS)

    inner = np.flatnonzero(~chains.head)
    d = np.stack([add(slot, gap), add(slot[inner - 1], gap[inner]), add(slot[inner], gap[inner - 1])])
    # Probabilities of the four pairs of states of a line and the one above it.
    up, down = (e + before)[inner - 1], (e + after)[inner]
    logs = np.stack([field.pull[a, b] + a * up + b * down for a in (0, 1) for b in (0, 1)])
    pair = np.exp(logs - logs.max(axis=0))
    pair *= weight[inner] / pair.sum(axis=0)
    seen = np.bincount((2 * good[inner - 1] + good[inner]).astype(np.int64), weight[inner], 4)
    return d, gap.sum(), (seen - pair.sum(axis=1)).reshape(2, 2)


def fit_field(bins: np.ndarray, chains: Chains, good: np.ndarray, weight: np.ndarray, start: Field, steps: int = STEPS) -> Field:
    """Weights by gradient steps of a length of their own each (Adam)."""
    shape = start.weights.shape
    x = np.concatenate([start.weights.ravel(), [start.offset], start.pull.ravel()])
    m, v = np.zeros_like(x), np.zeros_like(x)
    field = start
    for k in range(1, steps + 1):
        d, o, p = gradient(field, bins, chains, good, weight)
        g = np.concatenate([d.ravel(), [o], p.ravel()]) - RIDGE * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * min(1.0, 2.0 * (1 - k / (steps + 1)))
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        n = int(np.prod(shape))
        field = Field(x[:n].reshape(shape), float(x[n]), x[n + 1 :].reshape(2, 2), 0.0, 0.0)
    return field


def fit_logistic(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps; a weak prior keeps them finite."""
    a, b = np.c_[z, np.ones(len(z))], np.zeros(2)
    for _ in range(steps):
        p = sigmoid(a @ b)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, a.T @ (p - y) + 1e-2 * b), -2, 2)
    return float(b[0]), float(b[1])


def train(bins: np.ndarray, size: np.ndarray, many: np.ndarray, good: np.ndarray) -> Field:
    """A field from documents' lines and labels; every document has the same weight in all."""
    good = np.asarray(good, dtype=bool)
    if not good.any() or good.all():
        return constant(float(good.mean()) if len(good) else 0.5)
    chains = Chains(many)
    owner = np.repeat(np.arange(len(many)), many)
    weight = 1.0 / many[owner]
    state = good[owner].astype(float)
    field = constant(0.5)
    for k in range(ROUNDS):
        if k:
            own = field.evidence(bins, chains)
            worst = np.lexsort((own, owner))[chains.first]
            state = np.where(good[owner] | (own > 0), 1.0, 0.0)
            state[worst[~good]] = 0.0
        field = fit_field(bins, chains, state, weight, field)
    fit = fit_logistic(odds(field.shares(bins, size, many)), good.astype(float))
    return Field(field.weights, field.offset, field.pull, *fit)


def labelled_lines(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = TRAIN, lines: int = LINES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, bytes, lines and label of at most ``most`` documents of each label, by least hash of the id."""
    marks = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).alias("label"))
    )
    drawn = None
    for y in (0, 1):
        own = marks.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = own if drawn is None else drawn.unionByName(own)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [str(x) for x in b.column("id").to_pylist()]
            bins, size, many = measure(texts_of(b))
            ends = np.cumsum(many)
            out: list[list] = [[], [], []]
            for name, lo, hi in zip(names, (ends - many).tolist(), ends.tolist()):
                if hi - lo > lines:
                    lo += zlib.crc32(name.encode()) % (hi - lo - lines + 1)
                    hi = lo + lines
                out[0].append(bins[lo:hi].tobytes())
                out[1].append(size[lo:hi].astype("<i8").tobytes())
                out[2].append(hi - lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), *map(pa.array, out[:2], [pa.binary()] * 2), pa.array(out[2], pa.int64())],
                ["id", "label", "bins", "size", "many"],
            )

    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, label {labels.schema[label_col].dataType.simpleString()}"
    rows = (
        texts.join(F.broadcast(drawn), "id")  # at most 2 * ``most`` rows
        .mapInArrow(run, f"{kinds}, bins binary, size binary, many long")
        .orderBy("id", "bins")
        .collect()
    )
    width = len(MEASURES)
    return (
        np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(-1, width),
        np.frombuffer(b"".join(r["size"] for r in rows), "<i8"),
        np.array([r["many"] for r in rows], np.int64),
        np.array([r["label"] == 1 for r in rows], bool),
    )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field from the labelled rows of ``labels``; which may be used is the caller's choice."""
    batch_rows(docs.sparkSession)
    return train(*labelled_lines(docs, labels, id_col, text_col, label_col))


def quality(text: Column, field: Field) -> Column:
    """Score from 0 to 1 of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(field.scores(texts.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))
