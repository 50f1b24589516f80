"""Densities, chain scores and tree scores with given parameters."""

import math

import numpy as np
from pyspark.sql import functions as F

from torsia.functions import densities as den
from torsia.functions.letters import RESIDUES
from torsia.operators import scoring as ops
from torsia.operators.columns import LETTER_LIST, transitions
from torsia.session import cut

from . import query
from .columns import _GRID, _ROLES
from .tables import SITES, r6, sites, sql_nodes, table, tree_nodes

# A small fixed model of two states.
T2 = ((0.9, 0.1), (0.3, 0.7))
START = (0.75, 0.25)


def _model_rows():
    out = []
    for state in (0, 1):
        raw = [1 + (i * (state + 1)) % 5 for i in range(20)]
        for i, aa in enumerate(LETTER_LIST):
            out.append(ops.parameter_row(
                state, aa, raw[i] / sum(raw), -1.1 + state + 0.01 * i, -0.8 + 2.0 * state, 1.5 + state, 1.0 + 0.5 * state, 0.2 * state
            ))
    return out


MODEL = _model_rows()
_NAMES = "state, aa, p_aa, mu_phi, mu_psi, k1, k2, k3, log_norm, norm_phi, norm_psi"
_PAR = f"par({_NAMES}) AS (VALUES " + ", ".join(
    "(" + ", ".join([str(r[0]), f"'{r[1]}'"] + [f"{x!r}::DOUBLE" for x in r[2:]]) + ")" for r in MODEL
) + ")"
_DENSITY = "k1 * cos(phi - mu_phi) + k2 * cos(psi - mu_psi) - k3 * cos(phi - mu_phi - psi + mu_psi) - log_norm"
_E = f"""{_PAR}, em AS (SELECT s.family, s.protein, s.col, p.state, {_DENSITY} AS d, ln(p_aa) AS lp FROM sites s JOIN par p ON p.aa = s.aa
  UNION ALL SELECT family, protein, col, unnest([0, 1]), 0.0, 0.0 FROM sites WHERE aa IN ('-', 'X'))"""


def _params(spark):
    return spark.createDataFrame(MODEL, ops.PARAMS)


@query(
    "density_functions",
    f"""WITH {SITES}, a AS (SELECT *, (phi + 2*pi()) % (2*pi()) AS x, (psi + 2*pi()) % (2*pi()) AS y FROM sites WHERE phi IS NOT NULL),
      m AS (SELECT *, unnest([-1, 0, 1]) AS m FROM a), st AS (SELECT protein, col, m, x, y, (x - 1.0 + m*2*pi()) AS o,
        -0.5 * (x - 1.0 + m*2*pi())**2 / 0.32 - 0.5*ln(0.32) - 0.5*ln(2*pi()) AS w FROM m),
      tr AS (SELECT *, 1.0 + o * exp(-0.5) AS mu, 0.32 * (1 - exp(-1.0)) AS v FROM st),
      k AS (SELECT protein, col, m, w, ln(sum(exp(-0.5 * (y - mu + j*2*pi())**2 / v))) - 0.5*ln(v) - 0.5*ln(2*pi()) AS t FROM (SELECT *, unnest([-1, 0, 1]) AS j FROM tr) GROUP BY protein, col, m, w, v),
      r AS (SELECT protein, col, ln(sum(exp(w))) AS stat, ln(sum(exp(w + t))) AS joint FROM k GROUP BY ALL)
    SELECT r.protein, r.col, round(2.0 * cos(phi - 0.5) - {den.von_mises_log_norm(2.0)!r}, 5) + 0.0 AS von_mises,
      round(1.5 * cos(phi - 0.5) + 1.0 * cos(psi + 0.5) - 0.3 * cos(phi - psi - 1.0) - {den.bivariate_log_norm(1.5, 1.0, 0.3)!r}, 5) + 0.0 AS bivariate,
      round(stat, 5) + 0.0 AS stat, round(joint - stat, 5) + 0.0 AS step, round(joint, 5) + 0.0 AS joint
    FROM r JOIN a ON a.protein = r.protein AND a.col = r.col""",
)
def _(spark, sf):
    phi, psi = F.col("phi"), F.col("psi")
    one, half, sigma = F.lit(1.0), F.lit(0.5), F.lit(math.sqrt(2 * 0.5 * 0.32))
    step = den.wrapped_transition_logpdf(phi, psi, one, one, half, sigma)
    stat = den.wrapped_normal_logpdf(phi, one, F.lit(math.sqrt(0.32)))
    return sites(spark, sf).filter(phi.isNotNull()).select(
        "protein", "col",
        r6(den.von_mises_logpdf(phi, half, F.lit(2.0), F.lit(den.von_mises_log_norm(2.0))), 5).alias("von_mises"),
        r6(den.bivariate_logpdf(phi, psi, half, F.lit(-0.5), F.lit(1.5), one, F.lit(0.3), F.lit(den.bivariate_log_norm(1.5, 1.0, 0.3))), 5).alias("bivariate"),
        r6(stat, 5).alias("stat"), r6(step, 5).alias("step"),
        r6(den.wrapped_joint_logpdf(phi, psi, one, one, half, sigma), 5).alias("joint"),
    )


@query(
    "score_sites",
    f"WITH {SITES}, {_E} SELECT family, protein, col, CAST(state AS BIGINT) AS state, round(d, 6) + 0.0 AS loglik FROM em",
)
def _(spark, sf):
    return ops.score_sites(sites(spark, sf), _params(spark)).withColumn("loglik", r6(F.col("loglik")))


@query(
    "family_loglik",
    f"""WITH {SITES}, {_E}, f AS (SELECT family, sum(d) FILTER (state = 0) AS a, sum(d) FILTER (state = 1) AS b FROM em GROUP BY family)
    SELECT family, round(sum(a), 3) AS path, round(sum(b), 3) AS observation, round(sum(a) + sum(b), 3) AS total FROM f GROUP BY ROLLUP (family)""",
)
def _(spark, sf):
    scored = ops.score_sites(sites(spark, sf), _params(spark))
    wide = scored.select(
        "family", F.when(F.col("state") == 0, F.col("loglik")).alias("path"), F.when(F.col("state") == 1, F.col("loglik")).alias("observation")
    )
    out = ops.family_loglik(wide)
    return out.select("family", *[F.round(c, 3).alias(c) for c in ("path", "observation", "total")])


@query(
    "log_sum_exp",
    """WITH m AS (SELECT l_suppkey, max(l_extendedprice / 1000) AS m FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(any_value(m) + ln(sum(exp(l_extendedprice / 1000 - m))), 6) + 0.0 AS lse FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("x"))
    return ops.log_sum_exp(rows, ["l_suppkey"], "x").withColumn("lse", r6(F.col("lse")))


_ORDERED = f"""{SITES}, {_E}, w AS (SELECT family, protein, col, max(d + lp) FILTER (state = 0) AS e0, max(d + lp) FILTER (state = 1) AS e1 FROM em GROUP BY ALL),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY col) AS i, count(*) OVER (PARTITION BY protein) AS n FROM w)"""


@query(
    "hmm_loglik",
    f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT family, protein, i, n, {START[0]} * exp(e0) AS a0, {START[1]} * exp(e1) AS a1 FROM o WHERE i = 1
      UNION ALL SELECT f.family, f.protein, o.i, o.n, (a0 * {T2[0][0]} + a1 * {T2[1][0]}) * exp(e0), (a0 * {T2[0][1]} + a1 * {T2[1][1]}) * exp(e1)
      FROM f JOIN o ON o.protein = f.protein AND o.i = f.i + 1)
    SELECT family, protein, round(ln(a0 + a1), 6) + 0.0 AS loglik FROM f WHERE i = n""",
)
def _(spark, sf):
    e = ops.emissions(sites(spark, sf), _params(spark))
    # Three columns to a block: longer proteins go through the block product.
    return ops.hmm_loglik(e, T2, START, width=3).withColumn("loglik", r6(F.col("loglik")))


@query(
    "hmm_posterior",
    f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT family, protein, col, i, n, {START[0]} * exp(e0) AS a0, {START[1]} * exp(e1) AS a1 FROM o WHERE i = 1
      UNION ALL SELECT f.family, f.protein, o.col, o.i, o.n, (a0 * {T2[0][0]} + a1 * {T2[1][0]}) * exp(e0), (a0 * {T2[0][1]} + a1 * {T2[1][1]}) * exp(e1)
      FROM f JOIN o ON o.protein = f.protein AND o.i = f.i + 1),
    b AS (SELECT protein, i, e0, e1, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM o WHERE i = n
      UNION ALL SELECT o.protein, o.i, o.e0, o.e1, {T2[0][0]} * exp(b.e0) * b0 + {T2[0][1]} * exp(b.e1) * b1, {T2[1][0]} * exp(b.e0) * b0 + {T2[1][1]} * exp(b.e1) * b1
      FROM b JOIN o ON o.protein = b.protein AND o.i = b.i - 1)
    SELECT f.family, f.protein, f.col, round(a0 * b0 / (a0 * b0 + a1 * b1), 6) + 0.0 AS p0 FROM f JOIN b ON b.protein = f.protein AND b.i = f.i""",
)
def _(spark, sf):
    e = ops.emissions(sites(spark, sf), _params(spark))
    out = ops.hmm_posterior(e, T2, START, width=3)
    return out.select("family", "protein", "col", r6(F.col("posterior")[0]).alias("p0"))


@query(
    "chain_viterbi",
    f"""WITH RECURSIVE {SITES}, s AS (SELECT family, protein, col, CASE WHEN instr('{RESIDUES}', aa) > 0 THEN instr('{RESIDUES}', aa) - 1 ELSE 20 END AS s FROM sites),
      span AS (SELECT family, min(col) AS lo, max(col) AS hi FROM s GROUP BY family),
      g AS MATERIALIZED (SELECT family, protein, col, coalesce(s, 20) AS s FROM (SELECT family, protein, unnest(range(lo, hi + 1)) AS col
        FROM (SELECT DISTINCT family, protein FROM s) JOIN span USING (family)) LEFT JOIN s USING (family, protein, col)),
      c AS (SELECT family, b.col, coalesce(a.s, 21) AS f, b.s AS t, count(*) AS n FROM g b LEFT JOIN g a USING (family, protein)
        WHERE a.col = b.col - 1 GROUP BY ALL
        UNION ALL SELECT family, col, 21, s, count(*) FROM g JOIN span USING (family) WHERE col = lo GROUP BY ALL),
      m AS MATERIALIZED (SELECT family, col, f, t, CAST(round(ln(n / sum(n) OVER (PARTITION BY family, col, f)) * {ops.SCORE_UNIT}) AS BIGINT) AS lp FROM c),
      v AS (SELECT family, col, t, {{'s': lp, 'b': -21}} AS w FROM m WHERE f = 21
        UNION ALL SELECT family, m.col, m.t, max({{'s': v.w.s + lp, 'b': -m.f}}) FROM v JOIN m USING (family) WHERE m.col = v.col + 1 AND m.f = v.t GROUP BY family, m.col, m.t),
      e AS (SELECT family, col, -(max({{'s': w.s, 'b': -t}})).b AS t FROM v JOIN span USING (family) WHERE col = hi GROUP BY family, col),
      p AS (SELECT family, col, t FROM e UNION ALL SELECT p.family, v.col - 1, -v.w.b FROM p JOIN v ON v.family = p.family AND v.col = p.col AND v.t = p.t WHERE v.w.b > -21)
    SELECT family, string_agg(substr('{RESIDUES}-', CAST(t + 1 AS INT), 1), '' ORDER BY col) AS sequence FROM p GROUP BY family""",
)
def _(spark, sf):
    draws = sites(spark, sf).select("family", F.col("protein").alias("iter"), "col", "aa")
    return ops.chain_viterbi(draws, ["family"])


_SQ = ", ".join(
    f"m{i} AS MATERIALIZED (SELECT a.f, b.t, sum(a.p * b.p) AS p FROM m{i - 1} a JOIN m{i - 1} b ON a.t = b.f GROUP BY a.f, b.t)" for i in range(1, 8)
)


@query(
    "stationary",
    f"""WITH {_GRID}, s AS (SELECT role AS f, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
      c AS (SELECT f, t, count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY ALL),
      g AS (SELECT a.r AS f, b.r AS t, coalesce(n, 0) + 0.1::DOUBLE AS n FROM roles a CROSS JOIN roles b LEFT JOIN c ON c.f = a.r AND c.t = b.r),
      m0 AS (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS p FROM g), {_SQ}
    SELECT t AS state, round(p, 6) + 0.0 AS share FROM m7 WHERE f = 'assistant'""",
)
def _(spark, sf):
    steps = transitions(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", _ROLES)
    return ops.stationary(steps, 7).withColumn("share", r6(F.col("share")))


_RATES = (0.5, 1.5)


def _up(level: str, name: str) -> str:
    """One level up: messages of the children added per parent, column and rate class."""
    return f"""{name} AS (SELECT n.parent AS node, col, r, sum(greatest(la, lc) + ln((0.5 + 0.5 * exp(-2 * n.branch_length * r)) * exp(la - greatest(la, lc)) + (0.5 - 0.5 * exp(-2 * n.branch_length * r)) * exp(lc - greatest(la, lc)))) AS la,
      sum(greatest(la, lc) + ln((0.5 - 0.5 * exp(-2 * n.branch_length * r)) * exp(la - greatest(la, lc)) + (0.5 + 0.5 * exp(-2 * n.branch_length * r)) * exp(lc - greatest(la, lc)))) AS lc
      FROM {level} x JOIN nodes n ON n.node = x.node GROUP BY n.parent, col, r)"""


@query(
    "tree_site_loglik",
    f"""WITH {SITES}, {sql_nodes(True)}, l0 AS (SELECT protein + 1000000000 AS node, col, unnest([0.5, 1.5]) AS r,
        CASE WHEN aa > 'L' AND aa <> 'X' THEN -1e9 ELSE 0.0 END AS la, CASE WHEN aa BETWEEN 'A' AND 'L' THEN -1e9 ELSE 0.0 END AS lc FROM sites),
      {_up('l0', 'l1')}, {_up('l1', 'l2')}, {_up('l2', 'l3')}, {_up('l3', 'l4')},
      t AS (SELECT col, greatest(la, lc) + ln(0.5 * exp(la - greatest(la, lc)) + 0.5 * exp(lc - greatest(la, lc))) AS x FROM l4)
    SELECT col, round(max(x) + ln((exp(max(x) - max(x)) + exp(min(x) - max(x))) / 2), 4) AS loglik FROM t GROUP BY col""",
)
def _(spark, sf):
    nodes = cut(tree_nodes(spark, sf))
    letter = F.when(F.col("aa").isin("-", "X"), "?").when(F.col("aa") <= "L", "A").otherwise("C")
    cells = sites(spark, sf).select(F.lit("t").alias("tree"), (F.col("protein") + 1000000000).alias("node"), "col", letter.alias("aa"))
    freqs = np.array([0.5, 0.5])
    eigen = ops.rate_eigen(np.ones((2, 2)), freqs)
    out = ops.tree_site_loglik(nodes, cells, "AC", eigen, freqs, _RATES)
    return out.select("col", F.round("loglik", 4).alias("loglik"))
