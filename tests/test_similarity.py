"""Similarity joins and screens against brute force."""

import random
from collections import Counter

import pytest

from torsia.operators import overlaps as O
from torsia.operators import similarity as S


def score(a, b, k):
    ca, cb = (Counter(s[i:i + k] for i in range(len(s) - k + 1)) for s in (a, b))
    low = sum((ca & cb).values())
    high = sum((ca | cb).values())
    return low / high if high else 0.0


def make(n, seed, letters="ACDE"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 80))) for _ in range(n)]
    for i in range(0, n, 3):
        s = list(base[(i + 1) % n])
        for _ in range(2):
            s[rng.randrange(len(s))] = rng.choice(letters)
        base[i] = "".join(s)
    return list(enumerate(base))


@pytest.mark.parametrize("cutoff", [0.1, 0.35, 0.8, 1.0])
def test_similar_pairs_is_exact(spark, cutoff):
    rows = make(40, 3)
    df = spark.createDataFrame(rows, "id bigint, sequence string")
    got = {(r.id_a, r.id_b): r.score for r in S.similar_pairs(df, df, 3, cutoff, self_join=True, strict=False).collect()}
    want = {(i, j): score(a, b, 3) for i, a in rows for j, b in rows if i < j and score(a, b, 3) >= cutoff}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_kmer_modes(spark):
    df = spark.createDataFrame([(1, "ACXDA"), (2, "AC"), (3, "")], "id bigint, sequence string")
    skip = {(r.id, r.kmer): r.n for r in S.kmer_counts(df, 2, "skip").collect()}
    clean = {(r.id, r.kmer): r.n for r in S.kmer_counts(df, 2, "clean").collect()}
    assert skip == {(1, "AC"): 1, (1, "DA"): 1, (2, "AC"): 1}
    assert clean == {(1, "AC"): 1, (1, "CD"): 1, (1, "DA"): 1, (2, "AC"): 1}


def test_dedup_keeps_first(spark):
    rows = [(1, "a", "ac-d"), (2, "b", "ACD"), (3, "c", "AXD"), (4, "d", "AC")]
    got = S.dedup_exact(spark.createDataFrame(rows, "seq_no bigint, name string, sequence string")).collect()
    assert sorted((r.seq_no, r.name, r.copies) for r in got) == [(1, "a", 2), (4, "d", 1)]


def test_non_redundant_is_the_ordered_walk(spark):
    rng = random.Random(11)
    n = 60
    group = [rng.choice(["p", "q", None, f"s{i}"]) for i in range(n)]
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}
    given = {3, 9}
    taken, seen = [], set()
    for i in range(n):
        if i in given or any((j, i) in edges for j in taken) or (group[i] is not None and group[i] in seen):
            continue
        taken.append(i)
        seen.add(group[i])
    entries = spark.createDataFrame([(i, group[i]) for i in range(n)], "seq_no bigint, pdb string")
    pairs = spark.createDataFrame([(b, a) for a, b in edges], "id_a bigint, id_b bigint")
    out = S.non_redundant(entries, pairs, spark.createDataFrame([(g,) for g in given], "id bigint"), structure="pdb")
    assert sorted(r.seq_no for r in out.collect()) == taken


def test_homologs_rules(spark):
    base = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQ"
    entries = [
        (1, "1abc_A mol:protein", "1abc", base), (2, "1abc_B mol:protein", "1abc", base),
        (3, "2abc_A MUTANT", "2abc", base), (4, "3abc_A", "3abc", base[:10]), (5, "4abc_A", "4abc", base[:-2] + "AA"),
    ]
    df = spark.createDataFrame(entries, "seq_no bigint, name string, pdb string, sequence string")
    q = spark.createDataFrame([(7, base), (8, base)], "query_no bigint, sequence string")
    got = {r.pdb: (r.seq_no, r.query_no) for r in S.best_homologs(df, q).collect()}
    assert got == {"1abc": (1, 7), "4abc": (5, 7)}


@pytest.mark.parametrize("cutoff,strict", [(0.2, True), (0.5, False), (1.0, True), (1.0, False)])
def test_copies_and_links(spark, cutoff, strict):
    rows = make(30, 8)
    rows += [(100 + i, s) for i, s in rows[:12]] + [(200, "AC"), (201, "AC"), (202, ""), (203, None), (204, None)]
    df = spark.createDataFrame(rows, "id bigint, sequence string")
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b:
                x = score(a, b, 3)
                if x > cutoff or not strict and x >= cutoff:
                    want[i, j] = x
    got = {(r.id_a, r.id_b): r.score for r in S.similar_pairs(df, df, 3, cutoff, self_join=True, strict=strict).collect()}
    assert got == pytest.approx(want)
    links = {r.id: (r.rep, r.copies, r.links) for r in S.similar_links(df, 3, cutoff, strict=strict).collect()}
    for i, s in rows:
        same = [j for j, t in rows if t == s and s is not None] or [i]
        assert links[i] == (min(same), len(same), sum(i in pair for pair in want))


@pytest.mark.parametrize("ratio", [None, 0.8])
def test_two_sides_with_copies(spark, ratio):
    a = make(30, 4)
    b = [(i, s) for i, s in make(20, 4)] + [(50 + i, s) for i, s in a[:5]]
    da, db = (spark.createDataFrame(x + x[:0], "id bigint, sequence string") for x in (a + [(60 + i, s) for i, s in a[:7]], b))
    got = {(r.id_a, r.id_b): r.score for r in S.similar_pairs(da, db, 3, 0.25, ratio).collect()}
    want = {}
    for i, s in a + [(60 + i, s) for i, s in a[:7]]:
        for j, t in b:
            if score(s, t, 3) > 0.25 and (ratio is None or ratio <= len(s) / len(t) <= 1 / ratio):
                want[i, j] = score(s, t, 3)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("cutoff,letters", [(0.15, "ACDE"), (0.4, "AC"), (0.6, "ACDEFGHIKLMNPQRSTVWY")])
def test_blocks_tiles_and_folds_lose_no_pair(spark, monkeypatch, cutoff, letters):
    # Cells of a few rows, tiles of three, no exact tile, words that share columns.
    for name, value in (("BLOCK_ROWS", 7), ("TILE", 3), ("EXACT", 4), ("FOLD", 16), ("STRIP", 5)):
        monkeypatch.setattr(O, name, value)
    rows = make(45, 21, letters) + [(90, "A" * 60), (91, "A" * 50 + "C"), (92, "AC\u00df" + "ACDE" * 5)]
    df = spark.createDataFrame(rows, "id bigint, sequence string")
    want = {(i, j): score(a, b, 3) for i, a in rows for j, b in rows if i < j and "\u00df" not in a + b and score(a, b, 3) > cutoff}
    # Built in this process, as the workers read the module's own limits.
    got = {}
    vectors = [r.asDict() for r in O.word_vectors(df, 3).collect()]
    import pyarrow as pa
    table = pa.table({c: [v[c] for v in vectors] for c in ("id", "total", "low", "high", "lens")})
    side = O._Side(table)
    for i, j, x in O._found(side, side, True, cutoff, None, True):
        for p, q, r in zip(i, j, x):
            pair = tuple(sorted((side.ids[int(p)].as_py(), side.ids[int(q)].as_py())))
            assert pair not in got
            got[pair] = r
    assert {p: s for p, s in got.items() if 92 not in p} == pytest.approx(want)
    spread = {(r.id_a, r.id_b): r.score for r in S.similar_pairs(df, df, 3, cutoff, self_join=True).collect()}
    assert spread == pytest.approx(got)


def test_texts_alike_in_most_windows_store_no_rows_per_window_or_pair(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACDEF") for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, sequence string")
    stored = []

    def counted(d, cut=S.cut):
        out = cut(d)
        stored.append(out.count())
        return out

    for module in (S, O):
        monkeypatch.setattr(module, "cut", counted)
    links = {r.id: r.links for r in S.similar_links(df, 3, 0.3).collect()}
    assert links == {i: sum(i != j and score(a, b, 3) > 0.3 for j, b in rows) for i, a in rows}
    assert stored and max(stored) <= len(rows)


def test_packed_windows_come_back():
    import numpy as np
    rows = [([5], [1]), ([0, 255, 256, 7999], [1, 255, 256, 70000]), ([1 << 30], [3]), ([2, 3, 4], [1, 2, 3])]
    packed = [O._planes(np.array(c), np.array(n)) for c, n in rows]
    ends, codes, counts = O._unplaned([x for x, _ in packed], [x for _, x in packed])
    assert ends.tolist() == [0, 1, 5, 6, 9]
    assert codes.tolist() == [x for c, _ in rows for x in c] and counts.tolist() == [x for _, n in rows for x in n]
