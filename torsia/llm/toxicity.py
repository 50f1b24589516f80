"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

The kernel of two words sums, over all sequences of three letters that both
hold, lambda to the lengths of the stretches they span; stretches of up to SPAN
letters count, so gaps and inserted letters lower the value without ending the
match. A mark stands before a word's first letter. Landmarks are beginnings of
words that set toxic sentences apart. A word's similarity to a landmark is their
kernel over the landmark's own, at most 1, so longer forms of a stem match it
whole; similarities up to FLOOR count as none. A word above LONGEST letters counts
by the most similar of overlapping stretches, so every letter is read. A sentence is compared with a
landmark by its most similar word, and the vector of similarities is whitened by
the inverse root of the landmarks' own kernel matrix (Nyström).

A linear support vector machine on these vectors is trained on sentences. As
labels mark documents, a toxic document is represented by its worst sentence
under the current machine, a clean one by its worst sentence too, for a few
rounds. A document's score is the logistic function, fitted to the labels, of
its worst sentence.

Training takes at most TRAIN documents of each label, those with the least hash
of their id. Scoring reads whole texts in place, without a shuffle.

Defined results: null and empty texts have no words and get the score of a
sentence without any similar word; unlabelled rows and null labels are not
learnt from; without both labels the score is the share of toxic rows, or 0.5
if there are no labels; all columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, held

TRAIN = 3000
LANDMARKS = 32
SPAN, LAMBDA = 8, 0.5
FLOOR = 0.45
#: Likelihood-ratio statistic that a landmark must exceed, and lengths of landmarks.
EVIDENCE = 30.0
STEMS = (4, 5, 6, 7, 8, 10, 12)
#: Letters of a word that are compared at once, letters that two stretches of a longer word share, and words that a worker remembers.
LONGEST, OVERLAP, CACHE = 32, 2 * max(STEMS), 400_000
#: Characters of the words that a worker remembers.
LETTERS_KEPT = 16_000_000
#: Letters whose sequences are in memory at once.
AT_ONCE = 200_000
#: Digits and signs that stand for letters.
SHAPES = str.maketrans("013457@$", "oieastas")
SPLIT = re.compile(r"[\W\d_]+")
#: Letters are numbered below 64: the mark before a word, a to z, and 35 numbers for all others.
MARK, LETTERS = "`", 64
#: Stands before a stretch inside a word; no landmark has it.
INSIDE = "_"
#: Letters written apart: three or more in a row, each alone.
APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*]{1,2}[^\W\d_](?![^\W_])){2,}")
STOP = (".", "!", "?")
SENTENCE = re.compile(r"[.!?\n]+\s*")


def pieces(chunk: str) -> list[str]:
    """Words of a chunk without white space, and the letters of several as one word."""
    low = chunk.lower()
    runs = [low] if low.isalpha() else [r for r in SPLIT.split(low.translate(SHAPES)) if r]
    if len(runs) > 1:
        runs.append("".join(runs))
    return [r for r in runs if len(r) >= 3]


def stretches(word: str) -> Iterator[str]:
    """The word in stretches of LONGEST letters, of which the later ones begin inside it."""
    yield word[:LONGEST]
    step = LONGEST - OVERLAP
    for at in range(step, len(word) - OVERLAP, step):
        yield INSIDE + word[at : at + LONGEST]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of every sequence of three letters within SPAN, the mark included."""
    marked = [w if w.startswith(INSIDE) else MARK + w for w in words]
    n = np.array([len(w) for w in marked], dtype=np.int64)
    text = "".join(marked)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letters = np.where(letters < 128, letters - 95, 28 + letters % 35)
    owner = np.repeat(np.arange(len(words)), n)
    padded = np.concatenate([letters, np.zeros(SPAN, np.int64)])
    who = np.concatenate([owner, np.full(SPAN, -1)])
    total = len(letters)
    word, code, weight = [], [], []
    for b in range(2, SPAN):
        same = np.flatnonzero(who[b : b + total] == owner)
        outer = padded[same] * LETTERS**2 + padded[same + b]
        for a in range(1, b):
            word.append(owner[same])
            code.append(outer + padded[same + a] * LETTERS)
            weight.append(np.full(len(same), LAMBDA ** (b + 1), np.float32))
    return np.concatenate(word), np.concatenate(code), np.concatenate(weight)


@lru_cache(maxsize=2)
def landmark_table(landmarks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each triple, -1 for none, and the rows: weights over the landmark's own kernel."""
    word, code, weight = triples(list(landmarks))
    used, at = np.unique(code, return_inverse=True)
    rows = np.zeros((len(used), len(landmarks)))
    np.add.at(rows, (at, word), weight)
    rows /= (rows**2).sum(axis=0)
    place = np.full(LETTERS**3, -1, np.int32)
    place[used] = np.arange(len(used))
    return place, rows.astype(np.float32)


def kernel(words: list[str], landmarks: tuple[str, ...], floor: float = FLOOR) -> np.ndarray:
    """(words, landmarks) similarities above ``floor``, stretched to 0 to 1."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    place, rows = landmark_table(landmarks)
    word, code, weight = triples(words)
    row = place[code]
    # No landmark gets more than this.
    reach = np.bincount(word[row >= 0], (weight * rows.max(axis=1)[row])[row >= 0], len(words))
    on = (row >= 0) & (reach > floor)[word]
    word, row, weight = word[on], row[on], weight[on]
    if not len(word):
        return out
    order = np.argsort(word, kind="stable")
    word = word[order]
    shared = rows[row[order]] * weight[order][:, None]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    like = np.minimum(np.add.reduceat(shared, starts, axis=0), 1.0)
    out[word[starts]] = np.maximum(like - floor, 0.0) / (1.0 - floor)
    return out


def parts_of(chunks: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(chunk, stretch) of all words of the chunks, AT_ONCE letters at a time."""
    who, words, held = [], [], 0
    for k, c in enumerate(chunks):
        for w in pieces(c):
            for s in stretches(w) if len(w) > LONGEST else (w,):
                who.append(k)
                words.append(s)
                held += len(s)
                if held >= AT_ONCE:
                    yield who, words
                    who, words, held = [], [], 0
    if words:
        yield who, words


class Similar(dict):
    """chunk -> 2 * row of ``vectors`` + whether it ends a sentence; row 0 is all zeros."""

    def __init__(self, landmarks: tuple[str, ...]):
        super().__init__()
        self.landmarks = landmarks
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.letters = 0
        self.vectors = [np.zeros(len(self.landmarks), np.float32)]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > CACHE or self.letters + sum(map(len, new)) > LETTERS_KEPT:
            self.reset()
            new = list(chunks)
        self.letters += sum(map(len, new))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            like = np.zeros((len(part), len(self.landmarks)), np.float32)
            for who, words in parts_of(part):
                own = kernel(words, self.landmarks)
                some = np.flatnonzero(own.any(axis=1))
                np.maximum.at(like, np.array(who)[some], own[some])
            code = np.fromiter((c.endswith(STOP) for c in part), np.int64, len(part))
            some = np.flatnonzero(like.any(axis=1))
            code[some] += 2 * (len(self.vectors) + np.arange(len(some)))
            self.vectors.extend(like[some])
            self.update(zip(part, code.tolist()))

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the (sentences, landmarks) similarities of sentences with any."""
        split = []
        for t in texts:
            chunks = t.split()
            if APART.search(t):
                chunks += ["".join(c for c in m if c.isalpha()) for m in APART.findall(t)]
            split.append(chunks)
        out, at = [], 0
        while at < len(split):  # as many texts at once as the dictionary can hold
            stop, unknown, letters = at, set(), 0
            while stop < len(split) and len(unknown) < CACHE // 4 and letters < LETTERS_KEPT // 4:
                unknown.update(split[stop])
                letters += len(texts[stop])
                stop += 1
            self.learn(unknown)
            for chunks in split[at:stop]:
                code = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
                hit = np.flatnonzero(code > 1)
                if not len(hit):
                    out.append(np.zeros((0, len(self.landmarks)), np.float32))
                    continue
                number = (np.cumsum(code & 1) - (code & 1))[hit]
                rows = np.stack([self.vectors[k] for k in code[hit] >> 1])
                starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                out.append(np.maximum.reduceat(rows, starts, axis=0))
            at = stop
        return out


def similar(landmarks: tuple[str, ...]) -> Similar:
    """Kept for the tasks that follow in a worker."""
    return held("toxicity", "similar", landmarks, lambda: Similar(landmarks))


@dataclass(frozen=True)
class Machine:
    """Landmarks, weights on the raw similarities, offset, and the logistic fit."""

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    offset: float
    slope: float
    shift: float

    def decisions(self, texts: list[str]) -> np.ndarray:
        w = np.array(self.weights)
        found = similar(self.landmarks).sentences(texts)
        return np.array([max([0.0, *(s @ w)]) for s in found]) + self.offset

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.shift, -30, 30)))


def choose_landmarks(texts: list[str], toxic: np.ndarray, count: int) -> tuple[str, ...]:
    """Beginnings of words that occur in more sentences of toxic texts than chance would have, clearest first.

    A sentence counts once for each label, so that copies prove nothing. The
    evidence is the likelihood ratio of a stem's share among sentences of toxic
    texts; stems below EVIDENCE are left out, and so is a stem that begins a
    chosen one or begins with it. Of equal evidence the longest is taken.
    """
    sides: list[set[str]] = [set(), set()]
    for t, y in zip(texts, toxic):
        sides[int(y)].update(SENTENCE.split(t))
    counts: list[Counter] = []
    for side in sides:
        of_words = Counter(c for s in side for c in set(s.split()))
        stems: Counter = Counter()
        for chunk, n in of_words.items():
            for w in pieces(chunk):
                for k in {min(k, len(w)) for k in STEMS}:
                    stems[w[:k]] += n
        counts.append(stems)
    clean, bad = max(1, len(sides[0])), max(1, len(sides[1]))
    share = bad / (bad + clean)
    gain = {}
    for w, n in counts[1].items():
        m = counts[0][w]
        own = n / (n + m)
        if n > 2 and own > share:
            g = n * np.log(own / share) + (m * np.log((1 - own) / (1 - share)) if m else 0.0)
            if 2 * g > EVIDENCE:
                gain[w] = round(g, 6)
    chosen: list[str] = []
    for w in sorted(gain, key=lambda w: (-gain[w], -len(w), w)):
        if len(chosen) < count and not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return tuple(chosen)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared hinge loss with classes of equal weight; gradient steps with momentum."""
    sign = np.where(y, 1.0, -1.0)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    z = np.c_[x, np.ones(len(x))]
    rate = 1.0 / (2 * np.linalg.norm((z * share[:, None]).T @ z, 2) + ridge)
    w = v = np.zeros(z.shape[1])
    for k in range(steps):
        look = w + (w - v) * k / (k + 3)
        slack = np.maximum(0.0, 1.0 - sign * (z @ look))
        v, w = w, look - rate * (-2 * z.T @ (share * sign * slack) + ridge * np.r_[look[:-1], 0.0])
    return w[:-1], float(w[-1])


def fit_logistic(d: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps; a weak prior keeps them finite."""
    z, b = np.c_[d, np.ones(len(d))], np.zeros(2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0]), float(b[1])


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """A machine from labelled texts."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        share = min(max(float(toxic.mean()) if len(toxic) else 0.5, 1e-6), 1 - 1e-6)
        return Machine((), (), 0.0, 0.0, float(np.log(share / (1 - share))))
    chosen = choose_landmarks(texts, toxic, landmarks)
    if not chosen:
        share = float(toxic.mean())
        return Machine((), (), 0.0, 0.0, float(np.log(share / (1 - share))))
    own = kernel(list(chosen), chosen).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    found = Similar(chosen).sentences(texts)
    w = np.ones(len(chosen))
    for _ in range(3):
        x = np.stack([s[np.argmax(s @ w)] if len(s) else np.zeros(len(chosen)) for s in found])
        v, offset = fit_svm(x @ white, toxic)
        w = white @ v
    d = np.array([max([0.0, *(s @ w)]) for s in found]) + offset
    return Machine(chosen, tuple(w.tolist()), offset, *fit_logistic(d, toxic.astype(float)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = TRAIN
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` documents of each label, by least hash of the id."""
    marks = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
    )
    drawn = None
    for y in (0, 1):
        own = marks.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        drawn = own if drawn is None else drawn.unionByName(own)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .join(F.broadcast(drawn), "_id")  # at most 2 * ``most`` rows
        .groupBy("_id", "_label")
        .agg(F.max("_text").alias("_text"))
        .orderBy("_id")
        .collect()
    )
    return [r["_text"] for r in rows], np.array([r["_label"] == 1 for r in rows], dtype=bool)


def toxicity(text: Column, machine: Machine) -> Column:
    """Score from 0 to 1 of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(machine.scores(texts.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the labelled rows of ``labels``; which may be used is the caller's choice."""
    batch_rows(docs.sparkSession)
    return train(*labelled_sample(docs, labels, id_col, text_col, label_col))
