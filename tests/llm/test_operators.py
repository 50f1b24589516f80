"""The operators against brute force and on odd inputs: nulls, empty tables, repeats, clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from torsia.llm import (
    bpe,
    chat_format,
    components,
    decontaminate,
    exact_dedup,
    lm_score,
    near_dedup,
    packing,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from torsia.llm.queries import BYTE_BPE, WORD_BPE
from torsia.llm.shingles import bag, overlap
from torsia.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 3000
ODD = [
    (1, "Hello  World\n\n  don't  stop"),
    (2, None),
    (3, ""),
    (4, LONG),
    (4, LONG),
    (None, "HELLO  WORLD\n\n  DON'T  STOP"),
    (5, "<|endoftext|> a\x1cb ÀÉ ß Σς 漢字 e\u0301 \t\n x² ½ 123"),
    (6, "   "),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("id", "row", "digest", "part", "node", "n", "key"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none(df):
    return df.limit(0)


def test_exact_dedup(odd):
    rows = exact_dedup.decide(odd, "doc_id", "text", slots=2).collect()
    assert len(rows) == len(ODD)
    groups = Counter((r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert groups[(4, 2, True)] == groups[(4, 2, False)] == 1  # a repeated row stays once
    assert groups[(3, 2, True)] == groups[(3, 2, False)] == 1  # null counts as empty
    assert groups[(1, 2, True)] == groups[(1, 2, False)] == 1  # a null id is the smallest
    kept = exact_dedup.drop_copies(odd, "doc_id", "text")
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert exact_dedup.decide(none(odd), "doc_id", "text").count() == 0


def test_misra_gries_keeps_frequent():
    c = exact_dedup.shrink(Counter({"a": 10, "b": 4, "c": 2}), 2)
    assert c == {"a": 8, "b": 2}


def test_token_counts(odd):
    library = Tokenizer.from_file(WORD_BPE)
    got = token_counts.count_tokens(odd, WORD_BPE, out="tokens").select("text", "tokens").collect()
    for r in got:
        assert r["tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(none(odd), WORD_BPE).count() == 0


def test_cached_ids_and_counts_equal_the_library():
    rng = random.Random(7)
    letters = "aZ é'.,|<>1 2\n\t \u00a0\x1c\x1fßÀ漢e\u0301"
    words, ids = bpe.WordCounts(WORD_BPE, bpe.whole_tokens(WORD_BPE)), bpe.SpacedIds(BYTE_BPE)
    by_word, by_byte = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["it's we'll I'D\u0130", "a   b", "a\n \nb", " x ", "don't.Stop", "ends <|endoftext|>here"]
    for t in texts:
        assert words.text(t) == len(by_word.encode(t, add_special_tokens=False).ids), repr(t)
        want = by_byte.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.text(t), "<u4").tolist() == want, repr(t)


def test_packing(odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(odd, BYTE_BPE).collect()
    whole = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == whole
    windows = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == windows.get(r["sequence_id"], 0)
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(windows.values()) <= 1024
    assert sum(windows.values()) == sum(n * k for (_, n), k in whole.items())
    ids = library.encode(LONG, add_special_tokens=False).ids + [0]
    for r in rows:
        if r["doc_id"] == 4:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert packing.pack(none(odd), BYTE_BPE).count() == 0


def test_best_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        at = np.array(sorted({0, *(rng.randrange(1, 60) for _ in range(25)), 60}))
        if np.diff(at).max() > 16:
            continue
        price = np.array([rng.choice([0.0, 1.0, 6.0]) for _ in at])

        def pad(n):
            return 0 if n & (n - 1) == 0 else 16 - n

        cost = [0.0] + [math.inf] * (len(at) - 1)
        for i in range(1, len(at)):
            for j in range(i):
                n = int(at[i] - at[j])
                if n <= 16:
                    cost[i] = min(cost[i], cost[j] + pad(n) + price[i] + packing.PER_WINDOW)
        cuts = packing.best_cuts(at, price, 16)
        own = dict(zip(at.tolist(), price))
        got = sum(pad(int(b - a)) + own[int(b)] + packing.PER_WINDOW for a, b in zip(cuts, cuts[1:]))
        assert got == pytest.approx(cost[-1])


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def cut_by_hand(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            if i is not None:
                first[b[a : a + 50]] = min(i, first.get(b[a : a + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - 49):
            if i is not None and first[b[a : a + 50]] < i:
                gone[a : a + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_suffix_dedup(spark, hot):
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcd é") for _ in range(n)) for n in (60, 90, 300, 49, 50)]
    texts = [
        "".join(rng.choice(base)[rng.randrange(20) :] for _ in range(rng.randrange(1, 5))) + "x" * rng.randrange(70)
        for _ in range(60)
    ]
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)] + [(99, None), (98, ""), (97, "\0" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    got = suffix_dedup.remove_repeats(df.repartition(3), hot=hot, chunk=2000)
    cols = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == cut_by_hand(rows)
    assert suffix_dedup.remove_repeats(none(df)).count() == 0


def test_windows_around_repeated_anchors():
    """Short character runs and repeated words at the edges of shared passages: an anchor's bytes occur several times in a piece."""
    rng = random.Random(5)
    words = [chr(c) * 20 for c in range(33, 127)] + ["".join(rng.choice("abcdefgh ") for _ in range(16)) for _ in range(900)]
    least = lambda w: suffix_dedup.gram_hashes(np.frombuffer(w.encode(), np.uint8)).min()
    runs = sorted(words[:94], key=least)[:3] + sorted(words[94:], key=least)[:3]  # likely to be anchors
    several = 0
    for _ in range(300):
        noise = lambda n: "".join(rng.choice("abcdefgh -") for _ in range(n))
        shared = "".join(x for _ in range(3) for x in (noise(rng.randrange(20)), rng.choice(runs)))
        texts = [(noise(rng.randrange(25)) + shared[rng.randrange(15) :] + rng.choice([noise(rng.randrange(25)), *runs])).encode() for _ in range(4)]
        groups: dict[int, dict[bytes, int]] = {}
        for i, t in enumerate(texts):
            for start, size, anchor in suffix_dedup.anchors(np.frombuffer(t, np.uint8), np.array([len(t)])):
                for a, w, g in zip(start.tolist(), size.tolist(), anchor.tolist()):
                    groups.setdefault(g, {}).setdefault(t[a : a + w + 49], i)
        for group in groups.values():
            pieces = sorted(group)
            several += len(pieces) > 1 and any(len(at) > 1 for at in suffix_dedup.anchor_places(pieces))
            first: dict[bytes, int] = {}
            for p in pieces:
                for x in range(len(p) - 49):
                    first[p[x : x + 50]] = min(group[p], first.get(p[x : x + 50], group[p]))
            told = suffix_dedup.least_ids(pieces, [group[p] for p in pieces])
            assert told == [[first[p[x : x + 50]] for x in range(len(p) - 49)] for p in pieces]
    assert several > 100


def test_chat_format(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"),
        (1, 1, "a", "> Hello there.\n> How are you?\nFine."),
        (1, 2, "u", "> > Hello there.\n> fine.\nGood"),
        (1, 3, "u", "> How are  you?\nme too"),
        (1, 4, "u", ">nothing known\nx"),
        (1, 4, "u", ">nothing known\nx"),
        (2, 0, "u", None),
        (None, 1, "u", "> Hello there."),
        (2, 1, "a", "a > b is plain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("unit", F.lit(1))
    got = chat_format.format_conversations(df).collect()
    told = [(r["conv_id"], r["turn"], r["text"], r["parent_turn"], r["root_turn"], r["depth"]) for r in got]
    assert told == [
        (None, 1, "", None, 1, 0),
        (1, 0, "Hello there.\nHow are you?", None, 0, 0),
        (1, 1, "Fine.", 0, 0, 1),
        (1, 3, "me too", 0, 0, 1),
        (1, 2, "Good", 1, 0, 2),
        (1, 4, "x", None, 4, 0),
        (1, 4, "x", None, 4, 0),
        (2, 0, "", None, 0, 0),
        (2, 1, "a > b is plain", None, 1, 0),
    ]
    assert chat_format.format_conversations(none(df)).count() == 0


def test_chat_format_links_deeper_quotes(spark):
    rows = [
        (1, 0, "u", "First words.\n\nMore of it."),
        (1, 1, "a", "Second words."),
        (1, 2, "u", "digest\n>> First words.\n>>\n>> More of it.\nThird words."),
        (1, 3, "u", "> Second words.\n>> First words.\n> > > unknown\nyes"),
        (1, 4, "u", "> unknown\n>>> Second words.\n>> First words.\n>> Second words.\n>> and more\nno"),
        (1, 5, "a", "> First words.\n>> First words.\nboth"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["parent_turn"], r["root_turn"], r["depth"], r["n_linked"]) for r in chat_format.format_conversations(df).collect()}
    assert got == {
        0: (None, 0, 0, 0),
        1: (None, 1, 0, 0),
        2: (0, 0, 1, 3),  # whole, and two paragraphs that are lines too
        3: (1, 1, 1, 2),  # the first level decides
        4: (1, 1, 1, 2),  # of level 2 the longer unit
        5: (0, 0, 1, 1),
    }


def test_bag_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a = items[:200], rng.integers(1, 7, 200)
    b = items[100:], rng.integers(1, 7, 200)
    b[1][:100] = np.maximum(1, a[1][100:] - 1)
    order = [np.argsort(x[0]) for x in (a, b)]
    a, b = (a[0][order[0]], a[1][order[0]]), (b[0][order[1]], b[1][order[1]])
    sig = near_dedup.signatures([a, b], 8192)
    assert np.isfinite(sig).all()
    assert (sig[0] == sig[1]).mean() == pytest.approx(overlap(a, b), abs=0.03)


def classes_by_hand(rows):
    bags = [bag(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if overlap(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_near_dedup(spark):
    rng = random.Random(11)
    words = ["w%d" % k for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(50):  # near copies of one text, some of which are links only to others
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t)))
    rows += [(50 + k, " ".join(rng.choice(words) for _ in range(80))) for k in range(10)]
    rows += [(70, None), (71, ""), (72, "!?"), (73, "one two"), (73, "One, two!"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x"))
    got = near_dedup.classes(df.coalesce(1)).collect()
    by_hand = classes_by_hand(rows)
    least = {}
    for (i, _), r in zip(rows, by_hand):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter((r["id"], r["class_id"]) for r in got) == Counter((i, least[r]) for (i, _), r in zip(rows, by_hand))
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(by_hand))
    assert near_dedup.classes(none(df)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_decontamination(spark):
    rng = random.Random(4)
    words = ["w%d" % k for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(20 + 3 * (k % 5)))) for k in range(12)]
    items += [(20, None), (21, "too short"), (22, items[0][1])]
    rows = []
    for k in range(40):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        if k % 3 == 0:
            own = items[k % 12][1].split()
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = "changed"
            t[len(t) // 2 : len(t) // 2] = own
        rows.append((k, " ".join(t)))
    rows += [(50, None), (51, ""), (None, items[3][1].upper() + "!"), (52, " ".join(items[1][1].split()[1:]))]
    want = set()
    for i, t in rows:
        w = (t or "").split()
        for j, x in items:
            n = len((x or "").split())
            if n < 5 or len(w) < 5:
                continue
            m = min(n, len(w))
            if max(overlap(bag(" ".join(w[a : a + m])), bag(x)) for a in range(len(w) - m + 1)) >= 0.8:
                want.add((i, j))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (500, 4):
        got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, items=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = decontaminate.drop_contaminated(df, bench, items=4)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(none(df), bench).count() == 0
    assert decontaminate.contaminated(df, none(bench)).count() == 0


def test_near_fingerprints_are_all_found():
    rng = np.random.default_rng(9)
    items = decontaminate.Items([(k, " ".join("v%d" % x for x in rng.integers(0, 900, 30))) for k in range(60)])
    asked = items.prints.copy()
    for k in range(len(asked)):  # flip up to RADIUS bits anywhere
        for bit in rng.choice(decontaminate.BITS, k + 4, replace=False):
            asked[k, bit // 16] ^= 1 << (bit % 16)
    window, item = items.within(30, asked)
    near = {
        (a, b)
        for a in range(60)
        for b in range(60)
        if decontaminate.distances(asked[a : a + 1], items.prints[b : b + 1])[0] <= decontaminate.RADIUS
    }
    assert set(zip(window.tolist(), item.tolist())) == near and len(near) >= 60


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.learn(docs, labels.filter("doc_id % 3 <> 0"))
    got = docs.join(labels.filter("doc_id % 3 = 0"), "doc_id").withColumn("score", toxicity.toxicity(F.col("text"), machine)).collect()
    bad = [r["score"] for r in got if r["toxic"] == 1]
    clean = [r["score"] for r in got if r["toxic"] == 0]
    assert np.mean([x >= 0.5 for x in clean]) < 0.05
    assert np.mean([a > b for a in bad for b in clean]) > 0.7


def test_toxicity_tolerates_gaps(spark, odd):
    texts = ["you are an idiot today"] * 40 + ["you are an early bird today"] * 60
    texts = [t + " %s%d" % (chr(97 + k % 26) * 3, k) for k, t in enumerate(texts)]
    machine = toxicity.train(texts, np.arange(100) < 40)
    score = lambda t: machine.scores([t])[0]
    assert min(score("an idiot."), score("an i.d.i.o.t!"), score("i d i o t"), score("idi*ot"), score("idioot")) > 0.5
    assert max(score("a fine day"), score("")) < 0.5
    rows = odd.withColumn("score", toxicity.toxicity(F.col("text"), machine)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.train([], np.zeros(0)).scores(["a"])[0] == 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < toxicity.learn(odd, empty).scores([""])[0] < 1


def test_toxicity_reads_every_letter(monkeypatch):
    texts = ["you are an idiot today"] * 40 + ["you are an early bird today"] * 60
    texts = [t + " %s%d" % (chr(97 + k % 26) * 3, k) for k, t in enumerate(texts)]
    machine = toxicity.train(texts, np.arange(100) < 40)
    rng = random.Random(4)
    for n in [*range(28, 60), 500, 5000]:
        before = "".join(rng.choice("bcfghjklm") for _ in range(n))
        glued = [before + "idiotidiot" + "xyz" * (n % 5), "漢字" * n + "idiot", f"{before}-i-d-i-o-t", f"{before[:30]}.{before}.idi.ot"]
        plain = [before + "early" + "xyz" * (n % 5), "漢字" * n + "early", f"{before}-e-a-r-l-y"]
        assert min(machine.scores(glued)) > max(machine.scores([*plain, "a fine day"]))
    word = "".join(rng.choice("abcdefgh") for _ in range(1000))
    parts = list(toxicity.stretches(word))
    assert max(map(len, parts)) <= toxicity.LONGEST + 1
    for at in range(len(word) - toxicity.OVERLAP + 1):
        assert any(word[at : at + toxicity.OVERLAP] in p for p in parts)
    long = [word + "idiot", "a", "", word[:50], "idiot"]
    whole = toxicity.Similar(machine.landmarks).sentences(long)
    monkeypatch.setattr(toxicity, "AT_ONCE", 40)
    assert all((a == b).all() for a, b in zip(whole, toxicity.Similar(machine.landmarks).sentences(long)))


def test_lm_scores(spark, docs):
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string"))
    df = df.withColumn("row", F.lit("x")).withColumn("word", F.lit("y"))
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(True))
    rows = df.select("doc_id", "text", held.alias("h")).collect()
    counts = Counter()
    for r in rows:
        if not r["h"]:
            counts.update(lm_score.tokens(r["text"] or ""))
    total = sum(counts.values())
    size = total + 0.5 * (len(counts) + 1)
    want = Counter()
    for r in rows:
        w = lm_score.tokens(r["text"] or "")
        base = sum(math.log10((counts[x] + 0.5) / size) for x in w)
        want[(r["doc_id"], r["h"], len(w), sum(x in counts for x in w), total, round(base, 6))] += 1
    got = lm_score.score_texts(df, held).collect()
    cols = ("id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*(r[c] for c in cols), round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm_score.score_texts(none(df), held).count() == 0
    assert lm_score.score_texts(df.limit(5), F.lit(True)).count() == 5


def test_lm_scores_by_plain_loop(spark, docs):
    """Each token's log probability, worked out alone from the table; the classes' shares sum to 1."""
    texts = docs.select("text").limit(60)
    v = lm_score.vocabulary(lm_score.word_counts(texts), texts)
    weights = lm_score.learn(texts, v)
    rows = docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("held_out"), "text").limit(20)
    got = {r["id"]: r["score"] for r in lm_score.scored(rows, v, weights).collect()}
    reader = lm_score.Reader(v)
    for r in rows.collect():
        numbers, want, before, two = reader.read(r["text"])[0], 0.0, 0, 0
        for k in numbers.tolist():
            pair = (before * 40503 + two * 9973 + ((before * two) >> 5)) % lm_score.PAIR
            skip = (two * 2654435761 >> 7) % lm_score.SKIP
            at = [before % lm_score.LAST, lm_score.LAST + pair, lm_score.LAST + lm_score.PAIR + skip, -1]
            z = [sum(float(weights[i][c]) for i in at) for c in range(weights.shape[1])]
            own = int(lm_score.class_of(reader, np.array([k]))[0])
            want += (z[own] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))) / math.log(10)
            if k < reader.size:  # others' counts are joined later
                want += math.log10(v.counts[k] + 0.5)
            want -= v.share[own]
            before, two = int(reader.row[k]) + 1, before
        assert abs(got[r["id"]] - want) < 1e-4 * max(1, len(numbers) / 10)
    known = np.zeros(len(v.share))
    np.add.at(known, v.classes, v.counts + 0.5)
    assert len(v.number) == v.types and (known[: lm_score.CLASSES] > 0).all()
    assert np.allclose(known[: lm_score.CLASSES], 10 ** v.share[: lm_score.CLASSES])
    # Each tail class keeps one half for a word never seen.
    assert np.allclose(known[lm_score.CLASSES :] + 0.5, 10 ** v.share[lm_score.CLASSES :])


def test_lm_step_by_plain_loop():
    rng = np.random.default_rng(5)
    table = rng.normal(size=(40, 6)).astype(np.float32)
    learner = lm_score.Learner(table)
    f = (rng.integers(0, 4, 50), rng.integers(4, 30, 50), rng.integers(30, 39, 50))
    y = rng.integers(0, 6, 50)
    z = table[f[0]] + table[f[1]] + table[f[2]] + table[-1]
    g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    g[np.arange(50), y] -= 1
    want = table.astype(np.float64)
    for rows in (*f, np.full(50, 39)):
        for r in np.unique(rows):
            mean = g[rows == r].sum(axis=0) / math.sqrt((rows == r).sum())
            want[r] -= lm_score.RATE / math.sqrt(1e-3 + (mean**2).sum()) * mean
    learner.step(f, y)
    assert np.allclose(learner.table, want, atol=1e-4) and learner.met.sum() == 200


def test_lm_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN", 2)
    one = np.arange(2 * 3, dtype=np.float64).reshape(2, 3)
    rows = [tuple(c[0].as_py() for c in lm_score.blobs_of(one * k, k).columns) for k in range(1, 8)]
    blobs = spark.createDataFrame(rows, "block long, sender long, blob binary")
    assert np.allclose(lm_score.summed(blobs, 8, 2, 3), one * 28)


def test_lm_classes_tell_contexts_apart():
    """Words with 48 different surroundings get more than 24 classes, each surrounding one."""
    kinds = np.eye(48, 2 * lm_score.CONTEXTS)[np.arange(960) % 48] * 100
    own = lm_score.cluster(np.vstack([kinds, kinds[:100]]), np.ones(1060))
    assert len(np.unique(own)) > 24 and (own[:48] == own[48:96]).all()


def test_url_filter(spark):
    urls = [
        "http://Example.ORG/es/1?x",
        "https://a.example.org/en/12",
        "https://a.example.org/en/2#t",
        "http://org",
        "http://notexample.org/es/",
        "b.com/de/",
        None,
        "",
        "x://com/de/" + "y" * 5000,
        "http://a.com/de/",
        "http://a.com/de/",
        "http://.com/fr/?/de/",
        "ftp://u@b.com:80/de/",
    ]
    rules = [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("EXAMPLE.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"),
    ]

    def by_hand(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, path = rest.split("/", 1)[0].lower(), rest[len(rest.split("/", 1)[0]) :]
        fits = [
            (len(h) + len(p), len(h), v, h.lower() + p)
            for h, p, v in rules
            if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, "allow", None))
        return host, path, best[3], best[2]

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.filter_urls(df, table, partitions=3)
    names = ("_host", "_path", "_rule", "_verdict")
    assert {r["page_id"]: tuple(r[c] for c in names) for r in got.collect()} == {k: by_hand(u) for k, u in enumerate(urls)}
    assert got.columns[:3] == df.columns
    assert url_filter.filter_urls(none(df), table).count() == 0
    assert url_filter.filter_urls(df, none(table)).filter("_verdict = 'allow'").count() == len(urls)


def test_clashing_names(spark):
    """Columns named like the operators' own keep their values, whatever their case."""
    extra = ["_host", "_PATH", "_rule", "verdict", "_h", "_p", "_url", "_bare", "_id", "_digest", "_own", "_label", "_row"]
    extra += ["_text", "n_tokens", "row", "id"]
    df = spark.createDataFrame(
        [(1, "one two three four five six seven", "http://a.org/x"), (2, "ONE two three four five six seven", None),
         (2, "ONE two three four five six seven", None), (None, None, "http://b.com/de/")],
        "doc_id long, text string, url string",
    )
    for k, c in enumerate(extra):
        df = df.withColumn(c, F.lit(k))

    def same(out, rows):
        assert out.columns[: len(df.columns)] == df.columns
        got = out.select(*df.columns).collect()
        assert len(got) == rows and all([r[c] for c in extra] == list(range(len(extra))) for r in got)

    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    judged = url_filter.filter_urls(df, rules)
    same(judged, 4)
    assert judged.columns[len(df.columns) :] == ["__host", "__path", "__rule", "_verdict"]
    assert {(r["__host"], r["__path"], r["__rule"], r["_verdict"]) for r in judged.collect()} == {
        ("a.org", "/x", "org/", "block"), ("", "", None, "allow"), ("b.com", "/de/", None, "allow"),
    }
    same(exact_dedup.drop_copies(df, "doc_id", "text"), 2)
    same(near_dedup.drop_near_copies(df), 2)
    counted = token_counts.count_tokens(df, WORD_BPE)
    same(counted, 4)
    assert counted.columns[-1] == "_n_tokens" and counted.filter("_n_tokens = 0").count() == 1
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    texts, marks = toxicity.labelled_sample(df, labels, "doc_id", "text", "toxic")
    assert len(texts) == 2 and marks.tolist() == [True, False]
