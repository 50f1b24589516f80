"""Chain and tree scores against plain numpy."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from torsia.catalog.scoring import MODEL
from torsia.operators import scoring as S
from torsia.operators import trees as T

TR = np.array([[0.9, 0.1], [0.3, 0.7]])
START = np.array([0.75, 0.25])


@pytest.fixture(scope="module")
def e(spark):
    rng = random.Random(1)
    rows = [
        ("f", p, c, [rng.uniform(-900, 0), rng.uniform(-900, 0)]) for p, n in (("long", 23), ("short", 2), ("one", 1)) for c in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, "family string, protein string, col bigint, e array<double>").cache()


def table(e):
    out = {}
    for r in e.orderBy("col").collect():
        out.setdefault(r.protein, []).append(np.array(r.e))
    return out


def lse(x):
    m = x.max(axis=0)
    return m + np.log(np.exp(x - m).sum(axis=0))


def forward(rows):
    f = [np.log(START) + rows[0]]
    for r in rows[1:]:
        f.append(lse(f[-1][:, None] + np.log(TR)) + r)
    return f


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_loglik(e, width):
    got = {r.protein: r.loglik for r in S.hmm_loglik(e, TR.tolist(), START.tolist(), width).collect()}
    for p, rows in table(e).items():
        assert abs(got[p] - lse(forward(rows)[-1])) < 1e-6


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_posterior(e, width):
    got = {(r.protein, r.col): r.posterior for r in S.hmm_posterior(e, TR.tolist(), START.tolist(), width).collect()}
    for p, rows in table(e).items():
        f = forward(rows)
        b = [np.zeros(2)]
        for r in reversed(rows[1:]):
            b.insert(0, lse((np.log(TR) + (r + b[0])[None, :]).T))
        for c, (x, y) in enumerate(zip(f, b), 1):
            want = np.exp(x + y - lse(x + y))
            assert np.allclose(got[(p, c)], want, atol=1e-9)


def test_a_chain_of_many_rows_in_few_rounds(e, monkeypatch):
    want = {(r.protein, r.col): r.posterior for r in S.hmm_posterior(e, TR.tolist(), START.tolist()).collect()}
    rounds = []
    monkeypatch.setattr(S, "cut", lambda df, cut=S.cut: rounds.append(1) or cut(df))
    # 23 columns, two to a block and three blocks to a row: 4 rows, 2 rows, 1 row.
    got = {(r.protein, r.col): r.posterior for r in S.hmm_posterior(e, TR.tolist(), START.tolist(), 2, fan=3).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert len(rounds) <= 7
    # Chains of one row meet no join and store nothing.
    rounds.clear()
    assert S.hmm_posterior(e, TR.tolist(), START.tolist(), 3).count() == 26 and not rounds


def test_a_missing_score_leaves_its_chain_without_answer(spark):
    rows = [("f", p, c, [-1.0, None if (p, c) == ("x", 5) else -2.0]) for p in "xy" for c in range(1, 8)]
    df = spark.createDataFrame(rows, "family string, protein string, col bigint, e array<double>")
    for width in (2, 3, 100):
        got = {r.protein: r.loglik for r in S.hmm_loglik(df, TR.tolist(), START.tolist(), width).collect()}
        assert got["x"] is None and got["y"] is not None
    for fan in (2, 64):
        shares = S.hmm_posterior(df, TR.tolist(), START.tolist(), 2, fan).collect()
        assert len(shares) == 14
        assert all((r.posterior is None or None in r.posterior) == (r.protein == "x") for r in shares)


def test_emissions_with_missing_parts(spark):
    rows = [("f", "p", 1, "A", 0.3, 0.4), ("f", "p", 2, "A", 0.3, None), ("f", "p", 3, "X", 0.3, 0.4), ("f", "p", 4, "-", None, None), ("f", "p", 5, "C", None, 1.0)]
    sites = spark.createDataFrame(rows, "family string, protein string, col bigint, aa string, phi double, psi double")
    got = {r.col: r.e for r in S.emissions(sites, spark.createDataFrame(MODEL, S.PARAMS)).collect()}
    model = {(r[0], r[1]): r for r in MODEL}

    def joint(r, phi, psi):
        a, b = phi - r[3], psi - r[4]
        return r[5] * math.cos(a) + r[6] * math.cos(b) - r[7] * math.cos(a - b) - r[8]

    for s in (0, 1):
        a, c = model[(s, "A")], model[(s, "C")]
        assert abs(got[1][s] - (joint(a, 0.3, 0.4) + math.log(a[2]))) < 1e-9
        assert abs(got[2][s] - (a[5] * math.cos(0.3 - a[3]) - a[9] + math.log(a[2]))) < 1e-9
        mixed = math.log(sum(r[2] * math.exp(joint(r, 0.3, 0.4)) for (t, _), r in model.items() if t == s))
        assert abs(got[3][s] - mixed) < 1e-9
        assert got[4][s] == 0.0
        assert abs(got[5][s] - (c[6] * math.cos(1.0 - c[4]) - c[10] + math.log(c[2]))) < 1e-9


def test_viterbi_is_the_best_string(spark):
    rng = random.Random(4)
    draws = ["".join(rng.choice("ACD") for _ in range(6)) for _ in range(15)]
    rows = [("p", i, c, a) for i, s in enumerate(draws) for c, a in enumerate(s, 1)]
    got = S.chain_viterbi(spark.createDataFrame(rows, "protein string, iter bigint, col bigint, aa string")).head().sequence

    def prob(s):
        p = sum(d[0] == s[0] for d in draws) / len(draws)
        for c in range(5):
            n = Counter(d[c] for d in draws)[s[c]]
            p *= (sum(d[c:c + 2] == s[c:c + 2] for d in draws) / n) if n else 0.0
        return p

    best = max(prob(s) for s in itertools.product("ACD", repeat=6) if True for s in ["".join(s)])
    assert len(got) == 6 and abs(prob(got) - best) < 1e-12


def test_viterbi_across_gaps(spark):
    def best(draws):
        rows = [(k, i, c, a) for k, own in draws.items() for i, d in enumerate(own) for c, a in enumerate(d, 3) if a != " "]
        got = S.chain_viterbi(spark.createDataFrame(rows, "protein string, iter bigint, col bigint, aa string").repartition(3))
        return {r.protein: r.sequence for r in got.collect()}

    draws = {
        "gap": ["A-DE"] * 3 + ["ACDE"], "one": ["C"], "tie": ["CA", "AC"], "odd": ["AX?", "AX?"],
        "missing": ["AC D", "AC D", "ACDD"], "long": ["ACDEFGHIKLMNP" * 5] * 2 + ["-" * 65],
    }
    assert best(draws) == {
        "gap": "A-DE", "one": "C", "tie": "CA", "odd": "A--", "missing": "AC-D", "long": "ACDEFGHIKLMNP" * 5,
    }


def test_tree_score_against_sum_over_states(spark):
    nodes = T.newick_nodes(spark.createDataFrame([("t", "((a:0.1,b:0.4):0.3,c:0.7);")], "tree string, newick string"))
    anc = T.ancestors(nodes)
    ids = {r.name: r.node for r in nodes.collect() if r.name}
    freqs = np.array([0.1, 0.2, 0.3, 0.4])
    rates = np.array([[0, 1, 2, 1], [1, 0, 1, 3], [2, 1, 0, 1], [1, 3, 1, 0]], float)
    left, values, right = S.rate_eigen(rates, freqs)

    def p(t):
        return (left * np.exp(values * t)) @ right

    assert np.allclose(p(0.0), np.eye(4)) and np.allclose(p(1e4)[0], freqs)
    letters = {1: {"a": "A", "b": "C", "c": "A"}, 2: {"a": "D", "b": "?", "c": "E"}}
    cells = spark.createDataFrame([("t", ids[n], c, a) for c, d in letters.items() for n, a in d.items()], "tree string, node bigint, col bigint, aa string")
    got = {r.col: r.loglik for r in S.tree_site_loglik(nodes, cells, "ACDE", (left, values, right), freqs, (0.5, 2.0)).collect()}
    for c, d in letters.items():
        tip = {n: np.ones(4) if a == "?" else np.eye(4)["ACDE".index(a)] for n, a in d.items()}
        classes = []
        for r in (0.5, 2.0):
            inner = (p(0.1 * r) @ tip["a"]) * (p(0.4 * r) @ tip["b"])
            classes.append(freqs @ ((p(0.3 * r) @ inner) * (p(0.7 * r) @ tip["c"])))
        assert abs(got[c] - math.log(np.mean(classes))) < 1e-9


def test_log_sum_exp(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("a", None), ("b", float("-inf")), ("c", -2.0)], "k string, x double")
    got = {r.k: r.lse for r in S.log_sum_exp(df, ["k"], "x").collect()}
    assert abs(got["a"] - 1000 - math.log(2)) < 1e-9 and got["b"] == float("-inf") and abs(got["c"] + 2.0) < 1e-12


def test_patterns_give_the_same_total(spark):
    scores = spark.createDataFrame([("t", 1, -2.0), ("t", 3, -1.0)], "tree string, col bigint, loglik double")
    weights = spark.createDataFrame([("t", 1, 3), ("t", 3, 1)], "tree string, col bigint, weight bigint")
    assert S.weighted_loglik(scores, weights).head().loglik == -7.0


def test_states_keep_their_ids(spark):
    """Of states 5 and 9, the latter knows no C: a C has one row, of state 5."""
    params = [S.parameter_row(k, aa, 0.5, 0.0, 0.0, 1.0, 1.0, 0.0) for k, aa in ((9, "A"), (5, "A"), (5, "C"))]
    sites = [("f", "p", 1, "A", 0.1, 0.2), ("f", "p", 2, "C", 0.1, 0.2)]
    got = S.score_sites(
        spark.createDataFrame(sites, "family string, protein string, col bigint, aa string, phi double, psi double"),
        spark.createDataFrame(params, S.PARAMS),
    )
    assert sorted((r.col, r.state) for r in got.collect()) == [(1, 5), (1, 9), (2, 5)]
