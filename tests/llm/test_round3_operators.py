"""Line field, clustering by approximations and conversation trie against brute force and on odd inputs."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from torsia.llm import line_crf, prefix_trie, va_clusters

SF = "/root/testdata/sf0.01"
GOOD = "The hills lie quiet in the evening, and nobody walks there.\nLater the rain came back."
JUNK = "buy buy buy buy buy buy buy buy\n%%% &&& ### *** $$$ %%%\nBUY!! NOW!! BUY!! NOW!!"


def plain_marginals(field, bins):
    """By listing all states of one document's lines."""
    n = len(bins)
    e = []
    for k in range(n):
        x = field.offset + sum(field.weights[0, m, b] for m, b in enumerate(bins[k]))
        if k:
            x += sum(field.weights[1, m, b] for m, b in enumerate(bins[k - 1]))
        if k + 1 < n:
            x += sum(field.weights[2, m, b] for m, b in enumerate(bins[k + 1]))
        e.append(x)
    weights = {}
    for y in itertools.product((0, 1), repeat=n):
        weights[y] = math.exp(sum(s * x for s, x in zip(y, e)) + sum(field.pull[a, b] for a, b in zip(y, y[1:])))
    total = sum(weights.values())
    return [sum(w for y, w in weights.items() if y[k]) / total for k in range(n)], weights, total


def random_field(seed=3):
    rng = np.random.default_rng(seed)
    shape = (3, len(line_crf.MEASURES), line_crf.BINS)
    return line_crf.Field(rng.normal(0, 0.3, shape), 0.2, rng.normal(0, 1, (2, 2)), 1.0, 0.0)


def test_marginals_equal_all_states_listed():
    texts = [GOOD, JUNK, "", "one\n\ntwo\nthree\nfour five\nsix", "x"]
    field = random_field()
    bins, size, many = line_crf.measure(texts)
    got = field.marginals(bins, line_crf.Chains(many))
    at = 0
    shares = []
    for n in many:
        want = plain_marginals(field, bins[at : at + n])[0]
        assert np.allclose(got[at : at + n], want)
        w = np.maximum(size[at : at + n], 1)
        shares.append((want * w).sum() / w.sum())
        at += n
    assert np.allclose(field.shares(bins, size, many), shares)


def test_gradient_is_the_slope_of_the_likelihood():
    bins, _, many = line_crf.measure([GOOD + "\n" + JUNK, "a\nb\nc"])
    good = np.array([1, 1, 0, 1, 0, 0, 1, 0], float)
    weight = np.repeat([0.5, 2.0], many)

    def likelihood(field):
        total, at = 0.0, 0
        for k, n in enumerate(many):
            _, weights, z = plain_marginals(field, bins[at : at + n])
            total += (0.5, 2.0)[k] * math.log(weights[tuple(good[at : at + n].astype(int))] / z)
            at += n
        return total

    field = random_field(5)
    d, o, p = line_crf.gradient(field, bins, line_crf.Chains(many), good, weight)
    h = 1e-5
    for name, slope, places in (("weights", d, [(0, 1, bins[2, 1]), (1, 7, bins[0, 7]), (2, 4, bins[3, 4])]), ("pull", p, [(0, 1), (1, 1)])):
        for place in places:
            moved = getattr(field, name).copy()
            moved[place] += h
            up = likelihood(line_crf.Field(**{**vars(field), name: moved}))
            assert abs((up - likelihood(field)) / h - slope[place]) < 1e-3
    up = likelihood(line_crf.Field(**{**vars(field), "offset": field.offset + h}))
    assert abs((up - likelihood(field)) / h - o) < 1e-3


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    field = line_crf.learn(docs, labels.filter(part != 0))
    rows = docs.join(labels.filter(part == 0), "doc_id").select("quality", line_crf.quality(F.col("text"), field).alias("s")).collect()
    right = sum((r["s"] >= 0.3) == (r["quality"] == 1) for r in rows)
    assert right > 0.97 * len(rows)


def test_quality_of_odd_rows(spark):
    rows = [(k, GOOD.replace("hills", f"hills {k}"), 1) for k in range(8)] + [(k, JUNK + f"\n### {k}", 0) for k in range(8, 16)]
    rows += [(None, GOOD, 0), (16, None, None), (17, "", None), (18, "word " * 60000, None), (19, "a\n" * 20000, None), (19, "a\n" * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs = df.drop("quality")
    for c in ("id", "label", "bins", "size", "many", "score"):
        docs = docs.withColumn(c, F.lit("x"))
    field = line_crf.learn(docs, df.select("doc_id", "quality", F.lit("y").alias("id")))
    out = docs.withColumn("mark", line_crf.quality(F.col("text"), field))
    assert out.columns == docs.columns + ["mark"]
    got = {r["doc_id"]: r["mark"] for r in out.collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert min(got[k] for k in range(8)) > max(got[k] for k in range(8, 16))
    assert got[16] == got[17]
    assert line_crf.learn(docs.limit(0), df).scores(["", GOOD]).tolist() == [0.5, 0.5]
    assert out.limit(0).count() == 0
    all_good = line_crf.learn(docs, df.filter("quality = 1"))
    assert all_good.scores([JUNK])[0] > 0.99


def plain_clusters(rows, dims, count, rounds):
    kept = [
        (i, [max(-va_clusters.LIMIT, min(va_clusters.LIMIT, math.floor(256 * x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)
        ]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = [sum(d for _, c, d in out if c == k) for k in range(len(centroids))]
    total = sum(d for *_, d in out)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, own[c], total, names[c]) for i, c, d in out], key=str)


@pytest.mark.parametrize("bits,spread", [(2, 0.02), (7, 0.3)])
def test_clusters(spark, bits, spread):
    rng = random.Random(bits)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for k in range(300)]
    rows += [(k, list(rows[0][1])) for k in range(300, 400)]  # one very common vector
    rows += [(7, rows[7][1]), (None, [0.0] * 6), (500, [1.0] * 5), (501, None), (502, [None] + [0.0] * 5)]
    rows += [(503, [math.nan] + [0.0] * 5), (504, [math.inf] + [0.0] * 5), (505, [1e300] + [0.0] * 5), (506, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for c in ("id", "v", "row", "cells", "cluster", "many"):
        df = df.withColumn(c, F.lit("x"))
    got = va_clusters.clusters(df, dims=6, count=12, rounds=4, bits=bits)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_clusters(rows, 6, 12, 4)
    assert va_clusters.clusters(df.limit(0), dims=6).count() == 0
    few = va_clusters.clusters(df.filter("vec_id < 3"), dims=6, count=12, rounds=2)
    assert sorted([tuple(r) for r in few.collect()], key=str) == plain_clusters(rows[:3], 6, 12, 2)


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (200, 8))
    cells = va_clusters.Cells(np.tile(np.array([-20, -3, -3, 4, 30]), (8, 1)), v.min(0), v.max(0))
    c = rng.integers(-60, 60, (9, 8))
    near, far = va_clusters.intervals(cells.approximate(v), cells.tables(c))
    d = ((v[:, None] - c[None]) ** 2).sum(-1)
    assert (near <= d).all() and (d <= far).all()


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in nodes)]
        kids = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ended = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("c", "b", "h", "at", "path", "depth", "k1", "n_convs", "saved"):
        df = df.withColumn(c, F.lit("x"))
    return prefix_trie.prefix_trie(df)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(230, 260)]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé😀", "", None, "a:b"])))
    rows += [(c, t, "user", "same") for c in range(300, 360) for t in range(7)]  # one very common conversation
    rows += [(400, t, "user", "deep") for t in range(30)] + [(401, 0, "user", "lone")]
    rows += [(5, None, "user", "first"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "bot", "tie"), (None, 1, "user", "lost")]
    got = trie_rows(spark, rows)
    assert [k for _, k in got.dtypes[:7]] == ["bigint"] * 7
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_trie(rows)


def test_prefix_trie_of_odd_tables(spark):
    assert trie_rows(spark, []).count() == 0
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "bot", "gone too")]  # turnless: its span's first is absent
    got = [tuple(r) for r in trie_rows(spark, rows).collect()]
    assert got == plain_trie(rows) and got[0][:3] == (lone, 0, None)
    long = [(100, 0, "user", "x" * 300000)] + [(100, t, "bot", "y" * t) for t in range(1, 7)]
    assert sorted([tuple(r) for r in trie_rows(spark, long).collect()], key=str) == plain_trie(long)
