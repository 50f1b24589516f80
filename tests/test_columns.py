"""Column operators and subsets on small alignments."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from torsia.operators import columns as C

SCHEMA = "family string, protein string, seq_no bigint, col bigint, aa string"


def cells(spark, proteins, family="f"):
    rows = [(family, n, i, c, a) for i, (n, s) in enumerate(proteins) for c, a in enumerate(s, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_gap_columns_and_trim(spark):
    df = cells(spark, [("a", "--AC-D-"), ("b", "X-A--D-")])
    kept = C.drop_gap_columns(df)
    assert kept.agg(F.max("col")).head()[0] == 4
    trimmed = sorted((r.protein, r.col, r.aa) for r in C.trim_family(df).collect())
    assert [a for p, _, a in trimmed if p == "a"] == list("AC-D") and trimmed[0][1] == 1


def test_project_then_degap_is_identity(spark):
    df = cells(spark, [("a", "-A-CD")])
    values = spark.createDataFrame([("f", "a", i, float(i)) for i in (1, 2, 3)], "family string, protein string, pos bigint, value double")
    got = [r.value for r in C.project_to_alignment(values, df).orderBy("col").collect()]
    assert got == [None, 1.0, None, 2.0, 3.0]


def test_patterns(spark):
    got = {r.col: (r.first_col, r.weight) for r in C.column_patterns(cells(spark, [("a", "AACA"), ("b", "DDED")])).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 4: (1, 3), 3: (3, 1)}


def test_fisher_against_sums(spark):
    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (0, 0, 2, 3), (120, 80, 60, 140)]
    df = spark.createDataFrame(tables, "n11 bigint, n12 bigint, n21 bigint, n22 bigint")
    for r in C.fisher_exact(df).collect():
        n = r.n11 + r.n12 + r.n21 + r.n22
        row, col = r.n11 + r.n12, r.n11 + r.n21
        p = [math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row) if 0 <= row - k <= n - col else 0.0 for k in range(min(row, col) + 1)]
        want = min(1.0, 2 * min(sum(p[: r.n11 + 1]), sum(p[r.n11:])))
        assert abs(r.p_value - want) < 1e-9


def test_fisher_sums_every_term(spark):
    """Tables far out: the logs agree with exact integers, where a cut of the support gave zero."""
    for cells_ in [(100, 900, 900, 998_100), (9000, 1000, 1000, 9000)]:
        df = spark.createDataFrame([cells_, cells_, (None, 1, 2, 3)], "n11 bigint, n12 bigint, n21 bigint, n22 bigint")
        got = C.fisher_exact(df, "upper").collect()
        n11, n12, n21, n22 = cells_
        row, col, n = n11 + n12, n11 + n21, sum(cells_)
        logs = [
            math.lgamma(row + 1) + math.lgamma(n - row + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1) - math.lgamma(n + 1)
            - math.lgamma(k + 1) - math.lgamma(row - k + 1) - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1)
            for k in range(n11, min(row, col) + 1)
        ]
        want = max(logs) + math.log(math.fsum(math.exp(x - max(logs)) for x in logs))
        assert len(got) == 3 and sum(r.p_value is None for r in got) == 1
        assert all(abs(r.log_p_value / want - 1) < 1e-8 for r in got if r.p_value is not None)


def test_large_subsets_are_not_measured(spark):
    df = cells(spark, [(n, "ACDA") for n in "abcd"])
    rows = [("f", 1, n, True, 4) for n in "abcd"]
    members = spark.createDataFrame(rows, "family string, subset int, protein string, good_structure boolean, candidates int")
    few = C.subset_score(df, members, most=3).head()
    all_ = C.subset_score(df, members, most_identity=1.0, most=4).head()
    assert (few.least_aligned, few.least_identity, few.most_identity, few.valid) == (None, None, None, False) and few.score == -5
    assert (all_.least_aligned, all_.least_identity, all_.most_identity, all_.valid) == (1.0, 1.0, 1.0, True)


def test_fingerprint_counts_repeats(spark):
    one, two = (spark.createDataFrame([(x,) for x in xs], "a int") for xs in ([1, 1, 2], [3, 3, 2]))
    assert C.fingerprint(one).head() != C.fingerprint(two).head()
    assert C.fingerprint(one).head() == C.fingerprint(one.orderBy(F.desc("a"))).head()


def test_association_signs(spark):
    df = cells(spark, [("a_D_", "AC"), ("b_D_", "AC"), ("c_S_", "CC"), ("d_S_", "C-")])
    classes = spark.createDataFrame([("a_D_", 1), ("b_D_", 1), ("c_S_", 2), ("d_S_", 2)], "protein string, class int")
    got = {(r.col, r.aa): r.chi2 for r in C.column_association(df, classes).collect()}
    assert got[(1, "A")] == 4.0 and got[(1, "C")] == -4.0 and got[(2, "C")] == 0.0 and got[(2, "W")] == 0.0


def brute_subset(rows, order, aligned, low, high, most):
    def measure(a, b):
        shown = [(x, y) for x, y in zip(a, b) if x != "-" or y != "-"]
        both = [(x, y) for x, y in shown if x in C.LETTER_LIST and y in C.LETTER_LIST]
        share = sum("-" not in p for p in shown) / len(shown)
        same = sum(x == y for x, y in both) / len(both) if both else 0.0
        return share >= aligned and low <= same <= high
    out = []
    for n in order:
        if len(out) < most and all(measure(rows[n], rows[m]) for m in out):
            out.append(n)
    return out


@pytest.mark.parametrize("most", [3, 30])
def test_constrained_subset_is_the_greedy_walk(spark, most):
    rng = random.Random(2)
    rows = {f"p{i:02d}": "".join(rng.choice("ACD-") for _ in range(12)) for i in range(25)}
    order = sorted(rows)
    members = spark.createDataFrame([("f", n, i) for i, n in enumerate(order)], "family string, protein string, rank bigint")
    got = C.constrained_subset(cells(spark, list(rows.items())), members, 0.5, 0.1, 0.6, most)
    assert sorted(r.protein for r in got.collect()) == brute_subset(rows, order, 0.5, 0.1, 0.6, most)


def test_hash_sample_ignores_partitioning(spark):
    from torsia.operators.filters import hash_sample

    df = spark.range(5000)
    a = {r.id for r in hash_sample(df, ["id"], 125, (1, 2)).collect()}
    b = {r.id for r in hash_sample(df.repartition(17), ["id"], 125, (1, 2)).collect()}
    assert a == b and 30 < len(a) < 140


def test_rename_and_mask(spark):
    from torsia.operators.filters import rename_and_mask

    df = spark.createDataFrame([(1, "x", "A-C"), (2, "y", "DE")], "seq_no bigint, name string, sequence string")
    got = {r.name: r.sequence for r in rename_and_mask(df, df.filter("name = 'x'")).collect()}
    assert got == {"seq1": "X-X", "seq1_1": "X-X", "seq1_2": "X-X", "seq2": "DE"}


def exact_tails(a, b, c, d):
    r, k, t = a + b, a + c, a + b + c + d
    lo, hi = max(0, r + k - t), min(r, k)
    weight = {x: math.comb(r, x) * math.comb(t - r, k - x) for x in range(lo, hi + 1)}
    whole = math.comb(t, k)
    return Fraction(sum(w for x, w in weight.items() if x <= a), whole), Fraction(sum(w for x, w in weight.items() if x >= a), whole)


def test_exact_test_against_whole_numbers(spark):
    rng = random.Random(5)
    tables = [tuple(rng.randint(0, m) for _ in range(4)) for m in (2, 5, 20, 300) for _ in range(12)]
    tables += [(0, 0, 0, 0), (7, 0, 0, 0), (0, 0, 5, 9), (3, 900, 900, 3), (900, 2, 3, 4000), (420, 418, 390, 391)]
    df = spark.createDataFrame(sorted(set(tables)), "n11 bigint, n12 bigint, n21 bigint, n22 bigint")
    for side, i in (("lower", 0), ("upper", 1)):
        for x in C.fisher_exact(df, side).collect():
            want = exact_tails(x.n11, x.n12, x.n21, x.n22)[i]
            log = math.log(want.numerator) - math.log(want.denominator)
            assert x.log_p_value == pytest.approx(log, rel=1e-9, abs=1e-9)


def test_exact_test_of_large_counts(spark):
    n = 2_500_000
    df = spark.createDataFrame([(n, n, n, n)], "n11 bigint, n12 bigint, n21 bigint, n22 bigint")
    # A symmetric table: half of all and half of the middle term, 1 / (sd sqrt(2 pi)) with sd^2 = 4 n / 16.
    middle = 1.0 / math.sqrt(2.0 * math.pi * n / 4.0)
    assert C.fisher_exact(df, "lower").head().p_value == pytest.approx(0.5 + middle / 2.0, abs=1e-7)


def test_association_by_family(spark):
    sites = spark.createDataFrame(
        [(f, f"{f}{i}", 1, "A" if i % 2 else "C") for f in "xy" for i in range(6 if f == "x" else 4)], "family string, protein string, col bigint, aa string"
    )
    classes = sites.select("protein", (F.substring("protein", 2, 1).cast("int") % 2 + 1).alias("class"))
    got = {(r.family, r.aa): (r.n11, r.n12, r.n21, r.n22) for r in C.column_association(sites, classes, ["family"]).collect()}
    assert got["x", "A"] == (3, 0, 0, 3) and got["x", "C"] == (0, 3, 3, 0)
    assert got["y", "A"] == (2, 0, 0, 2) and got["y", "D"] == (2, 2, 0, 0)


def test_constrained_subset_reads_sites_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    made = cells(spark, [("a", "ACDE"), ("b", "ACDF"), ("c", "AWWW"), ("d", "ACYE")])
    sites = made.coalesce(1).mapInArrow(counted, made.schema)
    members = made.select("family", "protein").distinct().withColumn("rank", F.ascii("protein"))
    got = C.constrained_subset(sites, members, 0.5, 0.3, 0.9, 4)
    assert sorted(r["protein"] for r in got.collect()) == ["a", "b", "d"]
    assert seen.value == 16
