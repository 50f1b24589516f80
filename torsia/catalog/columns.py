"""Alignment columns, letters, pairs of proteins and letter-class association."""

from pyspark.sql import functions as F

from torsia.operators import columns as ops

from . import query
from .tables import SITES, documents, r6, sites, sql_number, table

_L = "('" + "'),('".join(ops.LETTER_LIST) + "')"
LETTERS20 = f"letters(aa) AS (VALUES {_L})"
RES = "aa NOT IN ('-', 'X')"


@query(
    "category_freqs",
    f"""WITH {SITES}, {LETTERS20}, c AS (SELECT col, aa, count(*) AS n FROM sites WHERE {RES} GROUP BY ALL),
      t AS (SELECT col, sum(n) AS t FROM c GROUP BY col)
    SELECT t.col, l.aa, coalesce(n, 0) AS n, round((coalesce(n, 0) + 0.1) / (t + 2.0), 6) + 0.0 AS share
    FROM t CROSS JOIN letters l LEFT JOIN c ON c.col = t.col AND c.aa = l.aa""",
)
def _(spark, sf):
    return ops.category_freqs(sites(spark, sf), ["col"], "aa").select("col", "aa", "n", r6(F.col("share")).alias("share"))


@query(
    "column_consensus",
    f"""WITH {SITES}, c AS (SELECT family, col, aa, count(*) AS n FROM sites WHERE {RES} GROUP BY ALL),
      b AS (SELECT family, col, first(aa ORDER BY n DESC, aa) AS aa FROM c GROUP BY ALL)
    SELECT family, string_agg(aa, '' ORDER BY col) AS consensus FROM b GROUP BY family""",
)
def _(spark, sf):
    return ops.column_consensus(sites(spark, sf), ["family"])


@query(
    "drop_gap_columns",
    f"""WITH {SITES}, f AS (SELECT *, protein AS fam FROM sites),
      k AS (SELECT family, col, row_number() OVER (PARTITION BY family ORDER BY col) AS new FROM
        (SELECT protein AS family, col FROM sites GROUP BY ALL HAVING max(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) = 1))
    SELECT sites.protein, new AS col, aa FROM sites JOIN k ON k.family = sites.protein AND k.col = sites.col""",
)
def _(spark, sf):
    # Each order is a family of its own here, so that columns of gaps only do occur.
    rows = sites(spark, sf).withColumn("family", F.col("protein"))
    return ops.drop_gap_columns(rows, rows_per_block=5).select("protein", "col", "aa")


@query(
    "trim_family",
    f"""WITH {SITES}, s AS (SELECT protein AS family, min(col) FILTER ({RES}) AS lo, max(col) FILTER ({RES}) AS hi FROM sites GROUP BY 1)
    SELECT protein, col - lo + 1 AS col, aa FROM sites JOIN s ON s.family = protein WHERE col BETWEEN lo AND hi""",
)
def _(spark, sf):
    rows = sites(spark, sf).withColumn("family", F.col("protein"))
    return ops.trim_family(rows).select("protein", "col", "aa")


@query(
    "position_map",
    f"""WITH {SITES} SELECT protein, col, CASE WHEN aa = '-' THEN 0 ELSE
      CAST(sum(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY protein ORDER BY col) AS BIGINT) END AS pos FROM sites""",
)
def _(spark, sf):
    return ops.position_map(sites(spark, sf), rows_per_block=5).select("protein", "col", "pos")


@query(
    "project_to_alignment",
    f"""WITH {SITES}, p AS (SELECT protein, col, aa, CASE WHEN aa = '-' THEN 0 ELSE
        sum(CASE WHEN aa <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY protein ORDER BY col) END AS pos FROM sites),
      v AS (SELECT o_orderkey AS protein, unnest(generate_series(1, 7)) AS pos, o_totalprice FROM orders)
    SELECT p.protein, p.col, p.aa, round(o_totalprice + p.pos, 2) AS value FROM p LEFT JOIN v ON v.protein = p.protein AND v.pos = p.pos""",
)
def _(spark, sf):
    values = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("family"),
        F.col("o_orderkey").alias("protein"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("pos"),
        "o_totalprice",
    )
    values = values.withColumn("value", F.round(F.col("o_totalprice") + F.col("pos"), 2)).drop("o_totalprice")
    return ops.project_to_alignment(values, sites(spark, sf), rows_per_block=5).select("protein", "col", "aa", "value")


@query(
    "site_context",
    f"""WITH {SITES} SELECT protein, col, aa, lead(aa) OVER w AS next_aa, lag(aa) OVER w AS prev_aa
    FROM sites WINDOW w AS (PARTITION BY protein ORDER BY col)""",
)
def _(spark, sf):
    rows = ops.context(sites(spark, sf).select("family", "protein", "col", "aa"), 1, "next_aa", 4)
    return ops.context(rows, -1, "prev_aa", 4).select("protein", "col", "aa", "next_aa", "prev_aa")


@query(
    "column_patterns",
    f"""WITH {SITES}, c AS (SELECT protein AS family, col, string_agg(aa, '' ORDER BY protein) AS pat FROM sites GROUP BY 1, 2),
      g AS (SELECT family, col, min(col) OVER w AS first_col, count(*) OVER w AS weight FROM c WINDOW w AS (PARTITION BY family, pat))
    SELECT * FROM g""",
)
def _(spark, sf):
    return ops.column_patterns(sites(spark, sf).withColumn("family", F.col("protein")))


@query(
    "family_column_patterns",
    f"""WITH {SITES}, c AS (SELECT family, col, string_agg(protein || aa, ',' ORDER BY protein) AS pat FROM sites GROUP BY 1, 2)
    SELECT family, col, min(col) OVER w AS first_col, count(*) OVER w AS weight FROM c WINDOW w AS (PARTITION BY family, pat)""",
)
def _(spark, sf):
    return ops.column_patterns(sites(spark, sf))


@query(
    "leaf_letter_counts",
    f"WITH {SITES} SELECT family, col, aa, count(*) AS n FROM sites WHERE {RES} GROUP BY ALL",
)
def _(spark, sf):
    return ops.leaf_letter_counts(sites(spark, sf))


@query(
    "family_composition",
    f"""WITH {SITES}, p AS (SELECT o_custkey * 8 + o_orderkey % 8 AS family, count(*) AS s, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS t FROM orders GROUP BY 1),
      c AS (SELECT family * 8 + protein % 8 AS family, sum(CASE WHEN {RES} THEN 1 ELSE 0 END) AS r, sum(CASE WHEN phi IS NOT NULL OR psi IS NOT NULL THEN 1 ELSE 0 END) AS a FROM sites GROUP BY 1),
      f AS (SELECT p.family, s, t, coalesce(r, 0) AS r, coalesce(a, 0) AS a, CASE WHEN s = 1 AND t = 0 THEN 'one sequence' WHEN s = 2 AND t = 0 THEN 'two sequences'
        WHEN t = 0 THEN 'three or more sequences' WHEN s = 1 AND t = 1 THEN 'one sequence and structure' WHEN t = 1 THEN 'one structure'
        WHEN t = 2 THEN 'two structures' ELSE 'three or more structures' END AS class FROM p LEFT JOIN c USING (family))
    SELECT coalesce(class, 'total') AS class, count(*) AS families, CAST(sum(s) AS BIGINT) AS sequences, CAST(sum(t) AS BIGINT) AS structures,
      CAST(sum(r) AS BIGINT) AS residues, CAST(sum(a) AS BIGINT) AS angles, round(sum(r) / sum(s), 6) AS residues_per_sequence,
      round(CASE WHEN sum(t) > 0 THEN sum(a) / sum(t) END, 6) AS angles_per_structure
    FROM f GROUP BY ROLLUP (class)""",
)
def _(spark, sf):
    proteins = table(spark, sf, "orders").select(
        (F.col("o_custkey") * 8 + F.col("o_orderkey") % 8).alias("family"), F.col("o_orderkey").alias("protein"),
        (F.col("o_orderstatus") == "F").alias("has_structure"),
    )
    rows = sites(spark, sf).withColumn("family", F.col("family") * 8 + F.col("protein") % 8)
    _, classes = ops.family_composition(proteins, rows)
    return classes.withColumns(
        {c: F.round(c, 6) for c in ("residues_per_sequence", "angles_per_structure")}
    )


@query(
    "fingerprint",
    f"""SELECT count(*) AS rows, bit_xor(x) AS hash, CAST(sum(x) AS VARCHAR) AS total FROM (
      SELECT {sql_number('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority')} AS x FROM orders)""",
)
def _(spark, sf):
    return ops.fingerprint(table(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "aligned_pairs",
    f"""WITH {SITES}, p AS (SELECT o_custkey AS family, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
    SELECT p.family, p.a, p.b, x.col, x.aa AS aa_a, y.aa AS aa_b FROM p
    JOIN sites x ON x.protein = p.a JOIN sites y ON y.protein = p.b AND y.col = x.col""",
)
def _(spark, sf):
    return ops.aligned_pairs(
        sites(spark, sf).select("family", "protein", "col", "aa"), _chain_pairs(spark, sf)
    )


def _chain_pairs(spark, sf):
    """Each order with the next one of the customer: pairs grow with the table, not with its square."""
    from torsia.operators.ordered import neighbour

    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("a"))
    return neighbour(orders, ["family"], "a", {"b": "a"}).filter("b is not null")


@query(
    "column_pair_counts",
    f"""WITH {SITES} SELECT x.col, least(x.aa, y.aa) AS aa_a, greatest(x.aa, y.aa) AS aa_b, count(*) AS pairs
    FROM sites x JOIN sites y ON x.family = y.family AND x.col = y.col AND x.protein < y.protein GROUP BY ALL""",
)
def _(spark, sf):
    out = ops.column_pair_counts(sites(spark, sf))
    return out.groupBy("col", "aa_a", "aa_b").agg(F.sum("pairs").alias("pairs"))


_PAIRS_MEASURE = """m AS (SELECT family, a, b,
      sum(CASE WHEN aa_a <> '-' OR aa_b <> '-' THEN 1 ELSE 0 END) AS shown,
      sum(CASE WHEN (aa_a = '-') <> (aa_b = '-') THEN 1 ELSE 0 END) AS gaps,
      sum(CASE WHEN aa_a NOT IN ('-','X') AND aa_b NOT IN ('-','X') THEN 1 ELSE 0 END) AS both_seen,
      sum(CASE WHEN aa_a NOT IN ('-','X') AND aa_a = aa_b THEN 1 ELSE 0 END) AS same
    FROM (SELECT x.family, x.protein AS a, y.protein AS b, x.aa AS aa_a, y.aa AS aa_b FROM sites x JOIN sites y
      ON x.family = y.family AND x.col = y.col AND x.protein < y.protein) GROUP BY ALL),
    pm AS (SELECT family, a, b, CASE WHEN shown > 0 THEN (shown - gaps) / shown END AS aligned,
      CASE WHEN both_seen > 0 THEN same / both_seen ELSE 0.0 END AS ident FROM m)"""


@query(
    "subset_score",
    f"""WITH {SITES}, {_PAIRS_MEASURE}, r AS (SELECT family, min(aligned) AS la, min(ident) AS li, max(ident) AS mi FROM pm GROUP BY family),
      t AS (SELECT o_custkey AS family, count(*) AS size, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS st FROM orders GROUP BY 1),
      u AS (SELECT family, size, st, size - st AS sq, CASE WHEN size <= 12 THEN coalesce(la, 1.0) END AS la,
        CASE WHEN size <= 12 THEN coalesce(li, 1.0) END AS li, CASE WHEN size <= 12 THEN coalesce(mi, 0.0) END AS mi
        FROM t LEFT JOIN r USING (family))
    SELECT family, size, round(la, 6) + 0.0 AS least_aligned, round(li, 6) + 0.0 AS least_identity, round(mi, 6) + 0.0 AS most_identity,
      (la >= 0.5 AND li >= 0 AND mi <= 0.5 AND size <= 12) AS valid,
      CAST(CASE WHEN la >= 0.5 AND li >= 0 AND mi <= 0.5 AND size <= 12 THEN st * size + sq ELSE -size - 1 END AS BIGINT) AS score
    FROM u""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("candidates"))
    members = orders.join(sizes, "o_custkey").select(
        F.col("o_custkey").alias("family"), F.lit(1).alias("subset"), F.col("o_orderkey").alias("protein"),
        (F.col("o_orderstatus") == "F").alias("good_structure"), "candidates",
    )
    out = ops.subset_score(sites(spark, sf), members, 0.5, 0.0, 0.5, 12)
    return out.select(
        "family", "size", *[r6(F.col(c)).alias(c) for c in ("least_aligned", "least_identity", "most_identity")], "valid", "score"
    )


@query(
    "subset_score_by_rule",
    f"""WITH {SITES}, t AS (SELECT o_custkey AS family, o_orderstatus AS subset, count(*) AS size, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS st FROM orders GROUP BY ALL),
      ss AS (SELECT s.*, o_orderstatus AS subset FROM sites s JOIN orders ON o_orderkey = s.protein),
      m AS (SELECT x.family, x.subset, x.protein AS a, y.protein AS b, sum(CASE WHEN x.aa <> '-' OR y.aa <> '-' THEN 1 ELSE 0 END) AS shown,
        sum(CASE WHEN (x.aa = '-') <> (y.aa = '-') THEN 1 ELSE 0 END) AS gaps FROM ss x JOIN ss y
        ON x.family = y.family AND x.subset = y.subset AND x.col = y.col AND x.protein < y.protein GROUP BY ALL),
      r AS (SELECT family, subset, min(CASE WHEN shown > 0 THEN (shown - gaps) / shown END) AS la FROM m GROUP BY ALL)
    SELECT t.family, t.subset, size, round(CASE WHEN size <= 30 THEN coalesce(la, 1.0) END * size + st, 6) + 0.0 AS score
    FROM t LEFT JOIN r ON r.family = t.family AND r.subset = t.subset""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    members = orders.select(
        F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("subset"), F.col("o_orderkey").alias("protein"),
        (F.col("o_orderpriority") == "1-URGENT").alias("good_structure"), F.lit(10).cast("bigint").alias("candidates"),
    )
    out = ops.subset_score(
        sites(spark, sf), members, 0.5, 0.0, 0.5, 30, rule=lambda c: c["least_aligned"] * c["size"] + c["structures"]
    )
    return out.select("family", "subset", "size", r6(F.col("score")).alias("score"))


@query("constrained_subset")
def _(spark, sf):
    members = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("protein"),
        ((F.col("o_orderstatus") != "F").cast("bigint") * 10**12 + F.col("o_orderkey")).alias("rank"),
    )
    return ops.constrained_subset(sites(spark, sf), members, 0.5, 0.0, 0.5, 30)


@query(
    "mapped_pairs",
    """WITH l AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS pos, min(l_quantity) AS value FROM lineitem GROUP BY ALL),
      m AS (SELECT o_orderkey AS id, unnest(generate_series(1, 7)) AS pos_a FROM orders)
    SELECT m.id, m.pos_a, a.value AS value_a, b.value AS value_b FROM m JOIN l a ON a.id = m.id AND a.pos = m.pos_a
    JOIN l b ON b.id = m.id AND b.pos = 8 - m.pos_a WHERE m.pos_a <> 4""",
)
def _(spark, sf):
    values = (
        table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("value"))
        .select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("pos"), "value")
    )
    mapping = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("pos_a")
    ).withColumn("pos_b", F.when(F.col("pos_a") != 4, 8 - F.col("pos_a")))
    return ops.mapped_pairs(values, values, mapping).select("id", "pos_a", "value_a", "value_b")


@query(
    "sequence_identity",
    f"""WITH {SITES}, c AS (SELECT family, col, aa, count(*) AS n FROM sites WHERE {RES} GROUP BY ALL),
      b AS (SELECT family, col, first(aa ORDER BY n DESC, aa) AS aa FROM c GROUP BY ALL),
      d AS (SELECT s.family, s.protein, avg(CASE WHEN s.aa = b.aa THEN 1.0 ELSE 0.0 END) AS m FROM sites s JOIN b ON b.family = s.family AND b.col = s.col GROUP BY 1, 2)
    SELECT family, count(*) AS draws, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m), 6) + 0.0 AS sd FROM d GROUP BY family""",
)
def _(spark, sf):
    rows = sites(spark, sf)
    counts = ops.leaf_letter_counts(rows)
    real = counts.groupBy("family", "col").agg(F.min_by("aa", F.struct((-F.col("n")).alias("m"), "aa")).alias("letter"))
    pred = rows.select("family", F.col("protein").alias("draw"), F.col("col").alias("pos"), F.col("aa").alias("letter"))
    out = ops.identity(pred, real.withColumnRenamed("col", "pos"), ["family"])
    return out.select("family", "draws", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query(
    "column_association",
    f"""WITH {SITES}, {LETTERS20}, k AS (SELECT col, aa, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS class FROM sites JOIN orders ON o_orderkey = protein
        WHERE aa <> '-' AND o_orderstatus <> 'P'),
      c AS (SELECT col, aa, count(*) FILTER (class = 1) AS n21, count(*) FILTER (class = 2) AS n22 FROM k GROUP BY ALL),
      t AS (SELECT col, sum(n21) AS c1, sum(n22) AS c2 FROM c GROUP BY col),
      f AS (SELECT t.col, l.aa, CAST(c1 - coalesce(n21, 0) AS BIGINT) AS n11, CAST(c2 - coalesce(n22, 0) AS BIGINT) AS n12, coalesce(n21, 0) AS n21, coalesce(n22, 0) AS n22
        FROM t CROSS JOIN letters l LEFT JOIN c ON c.col = t.col AND c.aa = l.aa),
      e AS (SELECT *, CAST(n11 + n12 AS DOUBLE) * (n11 + n21) / (n11 + n12 + n21 + n22) AS e11, CAST(n11 + n12 AS DOUBLE) * (n12 + n22) / (n11 + n12 + n21 + n22) AS e12,
        CAST(n21 + n22 AS DOUBLE) * (n11 + n21) / (n11 + n12 + n21 + n22) AS e21, CAST(n21 + n22 AS DOUBLE) * (n12 + n22) / (n11 + n12 + n21 + n22) AS e22 FROM f),
      x AS (SELECT *, CASE WHEN e11 > 0 AND e12 > 0 AND e21 > 0 AND e22 > 0 THEN (n11-e11)**2/e11 + (n12-e12)**2/e12 + (n21-e21)**2/e21 + (n22-e22)**2/e22 ELSE 0.0 END AS chi FROM e)
    SELECT col, aa, n11, n12, n21, n22, round(e22, 6) + 0.0 AS e22, round(CASE WHEN n22 > e22 THEN -chi ELSE chi END, 6) + 0.0 AS chi2 FROM x""",
)
def _(spark, sf):
    return _association(spark, sf).select("col", "aa", "n11", "n12", "n21", "n22", r6(F.col("e22")).alias("e22"), r6(F.col("chi2")).alias("chi2"))


def _association(spark, sf):
    classes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("protein"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("class")
    )
    return ops.column_association(sites(spark, sf), classes)


@query(
    "fisher_exact",
    f"""WITH {SITES}, {LETTERS20}, k AS (SELECT col, aa, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS class FROM sites JOIN orders ON o_orderkey = protein
        WHERE aa <> '-' AND o_orderstatus <> 'P'),
      c AS (SELECT col, aa, count(*) FILTER (class = 1) AS n21, count(*) FILTER (class = 2) AS n22 FROM k WHERE aa <> 'X' GROUP BY ALL),
      t AS (SELECT col, count(*) FILTER (class = 1) AS c1, count(*) FILTER (class = 2) AS c2 FROM k GROUP BY col),
      f AS (SELECT c.col, c.aa, c1 - n21 AS x, c1 - n21 + c2 - n22 AS r, c1 AS c, c1 + c2 AS t FROM c JOIN t ON c.col = t.col),
      s AS (SELECT *, unnest(generate_series(greatest(0, r + c - t), least(r, c))) AS j FROM f),
      p AS (SELECT col, aa, x, j, exp(lgamma(r+1) + lgamma(t-r+1) + lgamma(c+1) + lgamma(t-c+1) - lgamma(t+1)
          - lgamma(j+1) - lgamma(r-j+1) - lgamma(c-j+1) - lgamma(t-r-c+j+1)) AS p FROM s)
    SELECT col, aa, round(least(1.0, 2 * least(sum(p) FILTER (j <= x), sum(p) FILTER (j >= x))), 6) + 0.0 AS p_value FROM p GROUP BY col, aa""",
)
def _(spark, sf):
    tested = _association(spark, sf).filter("n21 + n22 > 0")
    return ops.fisher_exact(tested).select("col", "aa", r6(F.col("p_value")).alias("p_value"))


def _chi(prefix: str) -> str:
    o = {f"{i}{j}": f"{prefix}{i}{j}" for i in (1, 2) for j in (1, 2)}
    t = " + ".join(o.values())
    e = {f"{i}{j}": f"(({o[f'{i}1']} + {o[f'{i}2']}) * ({o[f'1{j}']} + {o[f'2{j}']}) / ({t}))" for i in (1, 2) for j in (1, 2)}
    ok = " AND ".join(f"{v} > 0" for v in e.values())
    stat = " + ".join(f"({o[k]} - {e[k]})**2 / {e[k]}" for k in o)
    return f"CASE WHEN ({t}) = 0 THEN 0.0 WHEN {ok} THEN CASE WHEN {o['22']} > {e['22']} THEN 1 ELSE -1 END * ({stat}) ELSE 0.0 END AS {prefix}"


@query(
    "trait_transition_chi2",
    f"""WITH {SITES}, up AS (SELECT col, family, min(aa) AS aa FROM sites GROUP BY ALL),
      r AS (SELECT s.col AS draw, s.aa IN ('A') AS now, up.aa IN ('A') AS was, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS tr
        FROM sites s JOIN up ON up.col = s.col AND up.family = s.family JOIN orders ON o_orderkey = s.protein WHERE o_orderstatus <> 'P'),
      d AS (SELECT draw, {', '.join(f"CAST(count(*) FILTER ({c} AND tr = {t}) AS DOUBLE) AS {n}{i}{t}" for n, cs in
        (('lost', ('was AND NOT now', 'was AND now')), ('gained', ('NOT was AND NOT now', 'NOT was AND now')), ('held', ('NOT now', 'now')))
        for i, c in enumerate(cs, 1) for t in (1, 2))} FROM r GROUP BY draw),
      x AS (SELECT draw, {_chi('lost')}, {_chi('gained')}, {_chi('held')} FROM d)
    SELECT {', '.join(f"round(quantile_cont({n}, {q}), 6) + 0.0 AS {n}_{l}" for n in ('lost', 'gained', 'held') for q, l in ((0.5, 'median'), (0.05, 'p05'), (0.95, 'p95')))} FROM x""",
)
def _(spark, sf):
    s = sites(spark, sf)
    up = s.groupBy(F.col("col").alias("draw"), (F.col("family") + 10**12).alias("node")).agg(F.min("aa").alias("aa"))
    draws = s.select(F.col("col").alias("draw"), F.col("protein").alias("node"), "aa").unionByName(up)
    orders = table(spark, sf, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") + 10**12).alias("parent"))
    traits = orders.select(
        F.col("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("trait")
    )
    out = ops.trait_transition_chi2(draws, nodes, traits, "A")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


_ROLES = ("assistant", "system", "user")
_GRID = "roles(r) AS (VALUES ('assistant'), ('system'), ('user'))"


def _transition_sql(share: str) -> str:
    return f"""WITH {_GRID}, s AS (SELECT role AS f, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations),
      c AS (SELECT f, t, count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY ALL),
      g AS (SELECT a.r AS f, b.r AS t, coalesce(n, 0) + 0.1::DOUBLE AS n FROM roles a CROSS JOIN roles b LEFT JOIN c ON c.f = a.r AND c.t = b.r)
    SELECT f AS from_state, t AS to_state, round(n, 6) AS n, round({share}, 6) + 0.0 AS share,
      round((SELECT sum(n) FROM g h WHERE h.t = g.f) / sum(n) OVER (), 6) + 0.0 AS start FROM g"""


def _transitions(spark, sf, mixture):
    out = ops.transitions(
        table(spark, sf, "conversations"), ["conv_id"], "turn", "role", _ROLES, mixture=mixture, rows_per_block=3
    )
    return out.select("from_state", "to_state", *[r6(F.col(c)).alias(c) for c in ("n", "share", "start")])


@query("transitions", _transition_sql("n / sum(n) OVER (PARTITION BY f)"))
def _(spark, sf):
    return _transitions(spark, sf, False)


@query("transitions_mixture", _transition_sql("sum(n) OVER (PARTITION BY t) / sum(n) OVER ()"))
def _(spark, sf):
    return _transitions(spark, sf, True)
