"""Log probabilities of texts under a hashed maximum-entropy model.

A word's probability is the probability of its class given the words before it,
times its share of the class. The class part is a maximum-entropy model: a
softmax over CLASSES + TAILS classes whose weights are rows of one table, found
by hashing a bias, the last word, the last two words, and the word before the
last alone (a skip). The TOP most frequent words are put into CLASSES classes by
the frequent words next to them; every other word belongs to one of TAILS classes
by its last two bytes. Shares are counts plus one half; each tail class also has
one half for a word never seen.

Training passes over all training texts once. Each learner, WAVES to a task slot,
reads many partitions and takes AdaGrad steps on minibatches from the same start;
the tables are averaged row by row, weighted by how often a learner met the row,
in a tree of FAN tables to a task. Counts cover all training texts.
The HEAD most frequent words go to the workers with their counts, a table of
fixed size; the rest of a text's words are joined with the counts.

Scoring is done in batches of rows of numpy arrays; the table's rows of a
position are gathered and summed.

Defined results: null text is empty and has one token, the end; tokens are
compared as bytes after A-Z are lower-cased; a word's unknown or rare letters
need no care; without training texts all words are unknown and both scores are
finite; rows that repeat are scored each; only id and text are read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, written

#: Words with their counts on every worker, and those of them with classes of their own.
HEAD, TOP = 200_000, 8192
CLASSES, TAILS, CONTEXTS = 48, 32, 64
#: Rows of the table: the last word, the last two, the word before the last; the bias is the last row.
LAST, PAIR, SKIP = TOP + 1024, 1 << 14, 1 << 12
ROWS = LAST + PAIR + SKIP + 1
MINIBATCH, RATE = 4096, 0.4
END = b" "
#: Distinct words that a partition counts before it hands them on.
COUNTED = 400_000
BLOCK = 2048
#: Learners to a task slot, and tables that one task adds up.
WAVES, FAN = 4, 32


def tokens(text: str) -> list[bytes]:
    """Words, split at ASCII white space, then the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"]
            )

        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
            if len(seen) > COUNTED:
                # Frequent words stay, so that they are handed on once.
                often = Counter({w: n for w, n in seen.items() if n > 8})
                often = often if len(often) < COUNTED // 2 else Counter()
                yield rows(Counter({w: n for w, n in seen.items() if w not in often}))
                seen = often
        if seen:
            yield rows(seen)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head: numbers and counts by frequency; of the first TOP also classes."""

    number: dict[bytes, int]
    counts: np.ndarray
    tail: np.ndarray
    total: int
    types: int
    classes: np.ndarray | None = None
    share: np.ndarray | None = None

    @property
    def base_total(self) -> float:
        return self.total + 0.5 * (self.types + 1)


class Reader:
    """Texts to numbers. Words outside the head get numbers from HEAD on, by tail class."""

    def __init__(self, v: Vocabulary):
        self.v = v
        size = len(v.number)
        # Row of the last word: own for the first TOP, hashed by ending for others.
        ends = TOP + np.arange(1024)
        self.row = np.concatenate([np.minimum(np.arange(size), TOP - 1), ends])
        if size > TOP:
            self.row[TOP:size] = TOP + (v.tail[TOP:] * 32 + np.arange(TOP, size) % 32) % 1024
        self.size = size

    def read(self, text: str) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the tokens and, in order, the words that are not in the head."""
        words = tokens(text)
        get = self.v.number.get
        n = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        far = np.flatnonzero(n < 0)
        rest = [words[k] for k in far]
        n[far] = [self.size + tail_class(w) * 32 + zlib.crc32(w) % 32 for w in rest]
        return n, rest


def features(row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows for last word, last two and skip; ``starts`` marks first tokens of texts."""
    last = np.empty_like(row)
    last[0], last[1:] = 0, row[:-1] + 1
    last[starts] = 0
    skip = np.empty_like(row)
    skip[0], skip[1:] = 0, last[:-1]
    skip[starts] = 0
    pair = (last * 40503 + skip * 9973 + ((last * skip) >> 5)) % PAIR
    return last % LAST, LAST + pair, LAST + PAIR + (skip * 2654435761 >> 7) % SKIP


def logits(table: np.ndarray, f: tuple[np.ndarray, ...]) -> np.ndarray:
    z = np.take(table, f[0], axis=0, mode="clip")
    more = np.take(table, f[1], axis=0, mode="clip")
    z += more
    z += np.take(table, f[2], axis=0, mode="clip", out=more)
    z += table[-1]
    return z


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - shift) in place of ``z``, its sums by row, and the shift: each row's greatest where it is needed."""
    shift: np.ndarray | float = 0.0
    high, low = z.max(), z.min()
    if not (high < 60 and low > -60):  # else no sum can overflow or vanish
        shift = z.max(axis=1, keepdims=True)
        z -= shift
        shift = shift[:, 0]
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z), shift


def softmax(z: np.ndarray) -> np.ndarray:
    z, total, _ = exponentials(z)
    z *= (1.0 / total)[:, None]
    return z


def log_softmax(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the share of ``y`` in each row; ``z`` is used up."""
    picked = z[np.arange(len(z)), y].astype(np.float64)
    _, total, shift = exponentials(z)
    return picked - shift - np.log(total.astype(np.float64))


class Learner:
    """One partition's table and how often it met each row."""

    def __init__(self, table: np.ndarray):
        self.table = table.copy()
        self.met = np.zeros(len(table), np.float32)
        self.square = np.full(len(table), 1e-3, np.float32)

    def step(self, f: tuple[np.ndarray, ...], y: np.ndarray) -> None:
        g = softmax(logits(self.table, f))
        g[np.arange(len(y)), y] -= 1.0
        for rows in f:
            order = np.argsort(rows.astype(np.uint16), kind="stable")  # fewer than 65,536 rows: by radix
            own = rows[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            times = np.diff(np.append(at, len(own)))
            for n in (1, 2, 3):  # most rows: few terms, added side by side
                some = at[times == n]
                total = np.take(g, order[some], axis=0, mode="clip")
                for k in range(1, n):
                    total += np.take(g, order[some + k], axis=0, mode="clip")
                self._move(own[some], total, times[times == n])
            many = times[times > 3]
            if len(many):
                again = order[np.repeat(times > 3, times)]
                self._move(own[at[times > 3]], np.add.reduceat(np.take(g, again, axis=0, mode="clip"), np.cumsum(many) - many, axis=0), many)
        self._move(np.array([len(self.table) - 1]), g.sum(axis=0, keepdims=True), np.array([len(y)]))

    def _move(self, rows: np.ndarray, total: np.ndarray, times: np.ndarray) -> None:
        mean = total / np.sqrt(times)[:, None].astype(np.float32)
        square = self.square[rows] + np.einsum("ij,ij->i", mean, mean)
        self.square[rows] = square
        mean *= (RATE / np.sqrt(square))[:, None]
        self.table[rows] = np.take(self.table, rows, axis=0, mode="clip") - mean
        self.met[rows] += times


def blobs_of(matrix: np.ndarray, sender: int) -> pa.RecordBatch:
    """(block, sender, blob) of the rows of a matrix that are not all zero: their numbers, then their values."""
    blocks, blobs = [], []
    for lo in range(0, len(matrix), BLOCK):
        part = matrix[lo : lo + BLOCK]
        at = np.flatnonzero(part.any(axis=1))
        if len(at):
            blocks.append(lo // BLOCK)
            blobs.append(at.astype("<i4").tobytes() + part[at].astype("<f4").tobytes())
    columns = [pa.array(blocks, pa.int64()), pa.array([sender] * len(blocks), pa.int64()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "sender", "blob"])


def add_blobs(blobs: Iterator[bytes], width: int) -> np.ndarray:
    out = np.zeros((BLOCK, width))
    for x in blobs:
        n = len(x) // (4 + 4 * width)
        out[np.frombuffer(x, "<i4", n)] += np.frombuffer(x, "<f4", n * width, 4 * n).reshape(n, width)
    return out


def few(texts: DataFrame) -> tuple[DataFrame, int]:
    """``texts`` in at most WAVES partitions to a slot, no row moved, and that number."""
    most = WAVES * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(most), most


def summed(blobs: DataFrame, senders: int, rows: int, width: int) -> np.ndarray:
    """(rows, width) sum of the blobs of senders 0, 1, ..., FAN of them to a task until one is left."""

    def run(t: pa.Table) -> pa.Table:
        own = blobs_of(add_blobs((x.as_py() for x in t.column("blob")), width), 0)
        block, sender = (pa.array([t.column(c)[0].as_py()] * own.num_rows, pa.int64()) for c in ("block", "sender"))
        return pa.table({"block": block, "sender": sender, "blob": own.column("blob")})

    while senders > 1:
        blobs = (
            blobs.withColumn("sender", F.floor(F.col("sender") / FAN))
            .groupBy("block", "sender")
            .applyInArrow(run, "block long, sender long, blob binary")
        )
        senders = -(-senders // FAN)
    out = np.zeros((-(-rows // BLOCK) * BLOCK, width), np.float32)
    for r in blobs.collect():  # a table of fixed size
        lo = r["block"] * BLOCK
        out[lo : lo + BLOCK] = add_blobs([bytes(r["blob"])], width)
    return out[:rows]


_SHARED: dict[str, tuple] = {}


def unpacked(shared: Broadcast) -> tuple:
    """The broadcast model, unpacked once per worker."""
    raw = shared.value
    key = raw[:16]
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = pickle.loads(raw[16:])
    return _SHARED[key]


def broadcast(spark, *what) -> Broadcast:
    raw = pickle.dumps(what, protocol=5)
    return spark.sparkContext.broadcast(zlib.adler32(raw).to_bytes(8, "little") + np.random.bytes(8) + raw)


def batches_of(reader: Reader, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, whether a text starts) of many texts at a time."""
    numbers, starts, held = [], [], 0
    for b in batches:
        for t in b.column("text").to_pylist():
            n, _ = reader.read(t)
            s = np.zeros(len(n), bool)
            s[0] = True
            numbers.append(n)
            starts.append(s)
            held += len(n)
            if held >= 16 * MINIBATCH:
                yield np.concatenate(numbers), np.concatenate(starts)
                numbers, starts, held = [], [], 0
    if held:
        yield np.concatenate(numbers), np.concatenate(starts)


def neighbours(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """(TOP, 2 * CONTEXTS) counts of the frequent words before and after each of the first TOP words."""
    shared = broadcast(texts.sparkSession, v)
    size = TOP * 2 * CONTEXTS

    def run(batches):
        (vocabulary,) = unpacked(shared)
        total = np.zeros(size, np.float32)
        for n, start in batches_of(Reader(vocabulary), batches):
            here, before = n[1:], n[:-1]
            inside = ~start[1:]
            on = inside & (here < TOP) & (before < CONTEXTS)
            total += np.bincount(here[on] * 2 * CONTEXTS + before[on], minlength=size)[:size]
            on = inside & (before < TOP) & (here < CONTEXTS)
            total += np.bincount(before[on] * 2 * CONTEXTS + CONTEXTS + here[on], minlength=size)[:size]
        yield blobs_of(total.reshape(TOP, 2 * CONTEXTS), TaskContext.get().partitionId())

    dealt, senders = few(texts)
    return summed(dealt.mapInArrow(run, "block long, sender long, blob binary"), senders, TOP, 2 * CONTEXTS)


def cluster(m: np.ndarray, weight: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Classes of the rows of ``m`` by spherical k-means on square roots of shares."""
    x = np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1.0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[np.unique(np.linspace(0, min(len(x), 1024) - 1, CLASSES).astype(int))]

    def nearest() -> np.ndarray:
        """Own classes; an empty class gets a row that is far from its own."""
        like = x @ centre.T
        own = np.argmax(like, axis=1)
        empty = np.setdiff1d(np.arange(len(centre)), own)
        far = np.where(x.any(axis=1), (1.0 - like.max(axis=1)) * np.sqrt(weight), 0.0)
        worst = np.argsort(-far, kind="stable")[: len(empty)]
        own[worst] = empty
        return own

    for _ in range(rounds):
        own = nearest()
        total = np.zeros_like(centre)
        np.add.at(total, own, x * np.sqrt(weight)[:, None])
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return nearest()


def vocabulary(counts: DataFrame, texts: DataFrame) -> Vocabulary:
    """The head of the counts (word, n), with classes and the log shares of words in them."""
    total, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    head = counts.orderBy(F.col("n").desc(), "word").limit(HEAD).collect()  # of fixed size
    words = [bytes(r["word"]) for r in head]
    n = np.array([r["n"] for r in head], np.float64)
    tail = np.array([tail_class(w) for w in words], np.int64)
    v = Vocabulary({w: k for k, w in enumerate(words)}, n, tail, int(total or 0), int(types))
    top = min(TOP, len(words))
    own = cluster(neighbours(texts, v)[:top], n[:top]) if top > CLASSES else np.arange(top) % CLASSES
    v.classes = np.concatenate([own, CLASSES + tail[top:]]).astype(np.int64)
    mass = np.zeros(CLASSES + TAILS)
    np.add.at(mass, own, n[:top] + 0.5)
    # Tail classes: all words but the first TOP, and one never seen.
    inside = counts.select(
        (F.crc32(F.expr("substring(word, -2, 2)")) % TAILS).alias("tail"), (F.col("n") + 0.5).alias("m")
    )
    for r in inside.groupBy("tail").agg(F.sum("m").alias("m")).collect():  # TAILS rows
        mass[CLASSES + r["tail"]] = r["m"]
    np.add.at(mass, CLASSES + tail[:top], -(n[:top] + 0.5))
    mass[CLASSES:] = np.maximum(mass[CLASSES:], 0.0) + 0.5
    v.share = np.log10(np.maximum(mass, 0.5))
    return v


def first_table(v: Vocabulary) -> np.ndarray:
    """All zero but the bias, which has the classes' own log shares."""
    table = np.zeros((ROWS, CLASSES + TAILS), np.float32)
    table[-1] = v.share * np.log(10.0)
    table[-1] -= table[-1].max()
    return table


def class_of(reader: Reader, n: np.ndarray) -> np.ndarray:
    every = np.concatenate([reader.v.classes, CLASSES + np.arange(1024) // 32])
    return every[n]


def learn(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """The table after one pass of all learners."""
    shared = broadcast(texts.sparkSession, v)

    def run(batches):
        (vocabulary,) = unpacked(shared)
        reader, learner, some = Reader(vocabulary), Learner(first_table(vocabulary)), False
        for n, start in batches_of(reader, batches):
            some = True
            f, y = features(reader.row[n], start), class_of(reader, n)
            for at in range(0, len(n), MINIBATCH):
                learner.step(tuple(x[at : at + MINIBATCH] for x in f), y[at : at + MINIBATCH])
        if not some:
            return
        weighted = np.c_[learner.table * learner.met[:, None], learner.met]
        yield blobs_of(weighted, TaskContext.get().partitionId())

    dealt, senders = few(texts)
    sent = dealt.mapInArrow(run, "block long, sender long, blob binary")
    total = summed(sent, senders, ROWS, CLASSES + TAILS + 1)
    met = total[:, -1:]
    return np.where(met > 0, total[:, :-1] / np.maximum(met, 1.0), first_table(v)).astype(np.float32)


def scored(docs: DataFrame, v: Vocabulary, table: np.ndarray) -> DataFrame:
    """(id, held_out, n_tokens, known, base, score, words, times) of (id, held_out, text).

    ``base`` and ``score`` lack log10(count + 0.5) of ``words``, which are not in the head.
    """
    shared = broadcast(docs.sparkSession, v, table)

    def run(batches):
        vocab, weights = unpacked(shared)
        reader = Reader(vocab)
        log_count = np.concatenate([np.log10(vocab.counts + 0.5), np.zeros(1024)])
        lowest = np.log10(vocab.base_total)
        for whole in batches:
            for b in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                got = [reader.read(t) for t in b.column("text").to_pylist()]
                size = np.array([len(n) for n, _ in got])
                n = np.concatenate([n for n, _ in got])
                first = np.cumsum(size) - size
                start = np.zeros(len(n), bool)
                start[first] = True
                f, y = features(reader.row[n], start), class_of(reader, n)
                log_class = np.empty(len(n))
                for at in range(0, len(n), MINIBATCH):
                    to = slice(at, at + MINIBATCH)
                    log_class[to] = log_softmax(logits(weights, tuple(x[to] for x in f)), y[to]) / np.log(10.0)
                score = np.add.reduceat(log_class + log_count[n] - vocab.share[y], first)
                base = np.add.reduceat(log_count[n] - lowest, first)
                known = np.add.reduceat((n < reader.size).astype(np.int64), first)
                rest = [Counter(w) for _, w in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id"),
                        b.column("held_out"),
                        pa.array(size, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()),
                        pa.array([list(c) for c in rest], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for c in rest], pa.list_(pa.int64())),
                    ],
                    ["id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, "
        "words array<binary>, times array<long>",
    )


def score_texts(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``df``.

    The model learns from rows where ``held_out`` is false.
    """
    spark = df.sparkSession
    batch_rows(spark)
    docs = df.select(
        F.col(id_col).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    train = docs.filter(~F.col("held_out")).select("text")
    counts = written(word_counts(train), "counts")
    v = vocabulary(counts, train)
    table = learn(train, v)
    rows = written(scored(docs, v, table).withColumn("row", F.monotonically_increasing_id()), "scored")
    far = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    log_count = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rest = (
        far.join(counts, F.col("words") == F.col("word"), "left")
        .groupBy("row")
        .agg(F.sum(log_count).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("met"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("words", "times").join(rest, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )

