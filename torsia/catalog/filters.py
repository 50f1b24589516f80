"""Projections, filters, scalar functions and set operations."""

from pyspark.sql import functions as F

from torsia.functions import angles, letters, numeric
from torsia.operators import filters as ops

from . import query
from .tables import LETTERS, SITES, documents, r6, sites, sql_drop, sql_number, table

ALPHA = "ACDEFGHIKLMNPQRSTVWY"


@query(
    "canonical_sequences",
    f"""SELECT doc_id, md5(regexp_replace(upper(text), '[^{ALPHA}]', '', 'g')) AS dropped,
      CAST(length(regexp_replace(upper(text), '[^{ALPHA}]', '', 'g')) AS BIGINT) AS n_dropped,
      CAST(length(regexp_replace(upper(replace(text, '-', '')), '[^{ALPHA}]', 'X', 'g')) AS BIGINT) AS n_masked,
      CAST(length(replace(text, '-', '')) AS BIGINT) AS n_degapped,
      CAST(length(regexp_replace(upper(replace(trim(text), '-', '')), '[^T]', '', 'g'))
         + length(regexp_replace(upper(replace(trim(text), '-', '')), '[^U]', '', 'g')) AS BIGINT) AS n_t_or_u
    FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    masked = letters.canonical(text, "mask")
    rna = letters.canonical(text, "rna")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(letters.canonical(text, "drop")).alias("dropped"),
        F.length(letters.canonical(text, "drop")).cast("bigint").alias("n_dropped"),
        F.length(masked).cast("bigint").alias("n_masked"),
        F.length(letters.canonical(text, "degap")).cast("bigint").alias("n_degapped"),
        F.length(F.regexp_replace(rna, "[^T]", "")).cast("bigint").alias("n_t_or_u"),
    )


@query(
    "exclude_keywords",
    """SELECT doc_id, lang FROM documents
       WHERE NOT regexp_matches(lower(text), 'the|mutant|recombinant|synthetic|humanized|humanised')""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return ops.exclude_keywords(docs, "text", ("the", *letters.UNNATURAL_WORDS)).select("doc_id", "lang")


@query(
    "quality_pass",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_tax,
         l_tax > 0 AS strict FROM lineitem
       WHERE l_discount * 4 > 0 AND l_discount * 4 < 0.25 AND l_tax * 4 < 0.25""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns(
        {"rvalue": F.col("l_discount") * 4, "freervalue": F.col("l_tax") * 4}
    )
    return ops.quality_pass(rows, strict=False).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_discount", "l_tax", (F.col("l_tax") > 0).alias("strict"),
    )


@query(
    "quality_pass_strict",
    """SELECT l_returnflag, count(*) AS n FROM lineitem
       WHERE l_discount * 4 > 0 AND l_discount * 4 < 0.25 AND l_tax * 4 > 0 AND l_tax * 4 < 0.25 GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns(
        {"rvalue": F.col("l_discount") * 4, "freervalue": F.col("l_tax") * 4}
    )
    return ops.quality_pass(rows).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "candidate_entries",
    f"""SELECT doc_id FROM documents WHERE contains(text, 'ion') AND length({sql_drop('text')}) >= 100""",
)
def _(spark, sf):
    docs = documents(spark, sf).withColumn("description", F.col("text"))
    return ops.candidate_entries(docs, 100, marker="ion").select(F.col("id").alias("doc_id"))


@query(
    "split_entry_name",
    """SELECT c_custkey, 'k' || c_custkey AS pdb, c_mktsegment AS chain,
         CASE WHEN c_custkey % 2 = 0 THEN substr(c_name, 15, 4) ELSE '' END AS pdb4,
         CASE WHEN c_custkey % 2 = 0 THEN substr(c_mktsegment, 1, 1) ELSE '' END AS chain1
       FROM customer""",
)
def _(spark, sf):
    key, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    rows = table(spark, sf, "customer").withColumns(
        {
            "name": F.concat(F.lit("k"), key, F.lit("_"), seg, F.lit(" mol:protein length:9")),
            "sname": F.concat(
                F.when(F.col("c_custkey") % 2 == 0, "pdb").otherwise("seq"), F.substring("c_name", 15, 4), F.lit("_"), seg
            ),
        }
    )
    plain = ops.split_entry_name(rows)
    pdb4, chain1 = letters.structure_name(F.col("sname"))
    return plain.select("c_custkey", "pdb", "chain", pdb4.alias("pdb4"), chain1.alias("chain1"))


@query(
    "sentinel_values",
    """SELECT c_custkey, CASE WHEN c_acctbal > -100 THEN c_acctbal END AS known,
         CASE WHEN c_acctbal > -100 THEN c_acctbal ELSE -1000.0 END AS written FROM customer""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").withColumn("known", F.col("c_acctbal"))
    rows = ops.sentinel_to_null(rows, "known").withColumn("written", F.col("known"))
    return ops.null_to_sentinel(rows, "written").select("c_custkey", "known", "written")


@query(
    "blind_sites",
    f"""WITH {SITES}, p AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
      s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')
    SELECT family, protein, col,
      CASE WHEN protein IN (FROM p) AND aa <> '-' THEN 'X' ELSE aa END AS aa,
      CASE WHEN protein NOT IN (FROM p) AND protein NOT IN (FROM s) THEN round(phi, 6) + 0.0 END AS phi
    FROM sites""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("protein"), "o_orderpriority")
    out = ops.blind(
        sites(spark, sf),
        orders.filter("o_orderpriority = '1-URGENT'"),
        orders.filter("o_orderpriority = '2-HIGH'"),
    )
    return out.select("family", "protein", "col", "aa", r6(F.col("phi")).alias("phi"))


@query(
    "hash_sample",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {sql_number('o_orderkey')} % 125 IN (1, 16, 32, 48, 65, 72, 98, 114)",
)
def _(spark, sf):
    rows = table(spark, sf, "orders")
    return ops.hash_sample(rows, ["o_orderkey"], 125, (1, 16, 32, 48, 65, 72, 98, 114)).select("o_orderkey", "o_custkey")


@query(
    "class_from_name",
    """SELECT o_orderkey, CAST(CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1
         WHEN contains(o_orderpriority, 'LOW') THEN 2 ELSE 0 END AS BIGINT) AS class FROM orders""",
)
def _(spark, sf):
    rows = ops.class_from_name(table(spark, sf, "orders"), "o_orderpriority", (("URGENT", 1), ("LOW", 2)))
    return rows.select("o_orderkey", "class")


_THREE = "".join(f" WHEN '{k}' THEN '{v}'" for k, v in letters.THREE_LETTER.items())


@query(
    "residue_code",
    f"""WITH {SITES} SELECT aa, CASE aa{_THREE} ELSE 'XXX' END AS three,
      CASE WHEN aa IN ('-', 'X') THEN 'X' ELSE aa END AS back, count(*) AS n FROM sites GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    three = letters.residue_code(F.col("aa"), "three")
    rows = sites(spark, sf).withColumn("three", three)
    return (
        rows.withColumn("back", letters.residue_code(F.col("three")))
        .groupBy("aa", "three", "back")
        .agg(F.count("*").alias("n"))
    )


# The residues and weights of the receptor-binding motif score.
MOTIF = (("T", 21.2103485709695), ("N", 5.619267763), ("I", 9.235710963), ("I", 6.755671367), ("N", 2.581189838))
_WEIGHTS = ", ".join(f"({i}, '{a}', {w}::DOUBLE)" for i, (a, w) in enumerate(MOTIF, 1))


@query(
    "motif_score",
    f"""WITH {SITES}, w(pos, letter, weight) AS (VALUES {_WEIGHTS})
    SELECT protein AS id, round(sum(CASE WHEN letter = aa THEN weight ELSE 0 END) / (SELECT sum(weight) FROM w), 6) + 0.0 AS score
    FROM sites LEFT JOIN w ON pos = col GROUP BY protein""",
)
def _(spark, sf):
    weights = spark.createDataFrame(
        [(i, a, w) for i, (a, w) in enumerate(MOTIF, 1)], "pos bigint, letter string, weight double"
    )
    cells = sites(spark, sf).select(F.col("protein").alias("id"), F.col("col").alias("pos"), F.col("aa").alias("letter"))
    return ops.motif_score(cells, weights).select("id", r6(F.col("score")).alias("score"))


@query(
    "check_alignment",
    """SELECT doc_id, CAST(length(replace(text, ' ', '')) AS BIGINT) AS aligned_length, n_chars AS sequence_length
       FROM documents WHERE upper(replace(text, ' ', '')) <> upper(text)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.translate(F.regexp_replace("text", "-", "~"), " ", "-").alias("aligned_sequence"),
        F.regexp_replace("text", "-", "~").alias("sequence"),
    )
    out = ops.check_alignment(rows)
    return out.select(
        "doc_id", F.col("aligned_length").cast("bigint").alias("aligned_length"),
        F.col("sequence_length").cast("bigint").alias("sequence_length"),
    )


@query(
    "rename_and_mask",
    """WITH r AS (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) AS no FROM documents),
      c AS (SELECT *, unnest(CASE WHEN lang = 'de' THEN [0, 1, 2] ELSE [0] END) AS copy FROM r)
    SELECT 'doc' || doc_id AS old_name, 'seq' || no || CASE WHEN copy > 0 THEN '_' || copy ELSE '' END AS name,
      CASE WHEN lang = 'de' THEN md5(regexp_replace(regexp_replace(upper(text), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'), '.', 'X', 'g'))
        ELSE md5(regexp_replace(upper(text), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) END AS digest FROM c""",
)
def _(spark, sf):
    docs = documents(spark, sf)
    out = ops.rename_and_mask(
        docs.select("seq_no", "name", "sequence"), docs.filter("lang = 'de'"), rows_per_block=100
    )
    return out.select("old_name", "name", F.md5("sequence").alias("digest"))


@query(
    "union_sources",
    """SELECT event_id, user_id, value, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS BIGINT) AS source_no,
      CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS event_type FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    return ops.union_sources(
        [
            ev.filter("event_type = 'click'").drop("event_type"),
            ev.filter("event_type = 'view'").drop("event_type"),
            ev.filter("event_type not in ('click', 'view')"),
        ]
    )


@query(
    "blind_lists",
    """SELECT 'every' AS mode, n_name AS protein, 'all' AS scope FROM nation
       UNION ALL SELECT 'structures', n_name, 'structure' FROM nation
       UNION ALL SELECT 'except', n_name, 'all' FROM nation WHERE n_regionkey <> 1
       UNION ALL SELECT 'given', n_name, 'all' FROM nation WHERE n_regionkey = 1""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("protein"), "n_regionkey")
    given = nation.filter("n_regionkey = 1")
    out = None
    for mode in ("every", "structures", "except", "given"):
        part = ops.blind_lists(nation, mode, given).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("first_families", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def _(spark, sf):
    return ops.first_n(table(spark, sf, "orders"), 100, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "angle_functions",
    f"""WITH {SITES}, s AS (SELECT *, psi + 7.0 AS w FROM sites WHERE phi IS NOT NULL),
      m AS (SELECT *, w % (2*pi()) AS m FROM s)
    SELECT protein, col, round(m, 6) + 0.0 AS mod2pi, round(CASE WHEN m > pi() THEN m - 2*pi() ELSE m END, 6) + 0.0 AS pimod,
      CAST(floor(((phi + 2*pi()) % (2*pi())) / (2*pi() / 13)) + 1 AS BIGINT) AS cell,
      round((floor(((phi + 2*pi()) % (2*pi())) / (2*pi() / 13)) + 1) * 2*pi() / 13 - pi() / 13, 6) + 0.0 AS cell_mid,
      round(least(abs(phi - psi), 2*pi() - abs(phi - psi)), 6) + 0.0 AS circle,
      round(sqrt((cos(psi) - cos(phi))**2 + (sin(psi) - sin(phi))**2), 6) + 0.0 AS chord,
      round(sqrt(2.0 * (2.0 - cos(phi - psi) - cos(phi + psi))), 6) + 0.0 AS torus,
      round(acos((4.0 - (col / 4.0)**2) / 4.0), 6) + 0.0 AS radius_angle
    FROM m""",
)
def _(spark, sf):
    phi, psi = F.col("phi"), F.col("psi")
    w = psi + 7.0
    cell = angles.angle_to_index(phi, 13)
    return sites(spark, sf).filter(phi.isNotNull()).select(
        "protein",
        "col",
        r6(angles.mod2pi(w)).alias("mod2pi"),
        r6(angles.pimod(w)).alias("pimod"),
        cell.alias("cell"),
        r6(angles.index_to_angle(cell, 13)).alias("cell_mid"),
        r6(angles.circle_distance(phi, psi)).alias("circle"),
        r6(angles.chord_distance(phi, psi)).alias("chord"),
        r6(angles.torus_distance(phi, phi, psi, -psi)).alias("torus"),
        r6(angles.radius_angle(F.col("col") / 4.0)).alias("radius_angle"),
    )


@query(
    "letter_functions",
    f"""WITH {SITES}, s AS (SELECT protein, string_agg(aa, '' ORDER BY col) AS word FROM sites GROUP BY protein),
      w AS (SELECT protein, word, unnest(generate_series(1, length(word))) AS pos FROM s),
      i AS (SELECT protein, pos, length(word) - pos + 1 AS rest, strpos('{ALPHA}', substr(word, pos, 1)) AS a,
        strpos('{ALPHA}', substr(word, pos + 1, 1)) AS b, strpos('{ALPHA}', substr(word, pos + 2, 1)) AS c FROM w)
    SELECT protein, pos, CAST(a AS BIGINT) AS letter, CASE WHEN rest < 3 THEN NULL WHEN a = 0 OR b = 0 OR c = 0 THEN -1
        ELSE CAST((a - 1) * 400 + (b - 1) * 20 + c - 1 AS BIGINT) END AS kmer3 FROM i""",
)
def _(spark, sf):
    # The letters of one protein of this table: at most seven.
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "aa"))), lambda x: x["aa"]), "")
    rows = sites(spark, sf).groupBy("protein").agg(word.alias("word"))
    windows = rows.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("word"))))
    at = F.expr("substring(word, pos, 3)")
    return windows.select(
        "protein",
        F.col("pos").cast("bigint").alias("pos"),
        letters.letter_index(F.substring(at, 1, 1)).alias("letter"),
        F.when(F.length(at) == 3, letters.kmer_index(at)).alias("kmer3"),
    )


@query(
    "numeric_functions",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_tax <= 0 THEN -1e9 ELSE round(ln(l_tax), 6) END AS safe_log,
      CASE WHEN -l_quantity < -40 THEN 0.0 ELSE round(exp(-l_quantity) * 1e6, 6) END AS quick_exp,
      greatest(l_discount, 1e-50) AS clamped,
      least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi,
      round(ln(exp(l_discount) + exp(l_tax)), 6) + 0.0 AS lse
    FROM lineitem""",
)
def _(spark, sf):
    lo, hi = numeric.ordered_pair(F.col("l_discount"), F.col("l_tax"))
    log = numeric.safe_log(F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        F.when(log == float("-inf"), -1e9).otherwise(F.round(log, 6)).alias("safe_log"),
        F.round(numeric.quick_exp(-F.col("l_quantity")) * 1e6, 6).alias("quick_exp"),
        numeric.clamp(F.col("l_discount")).alias("clamped"),
        lo.alias("lo"),
        hi.alias("hi"),
        r6(numeric.logsumexp2(F.col("l_discount"), F.col("l_tax"))).alias("lse"),
    )


@query(
    "vector_functions",
    """WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
      c AS (SELECT label, min(vec_id) AS first_id FROM e GROUP BY label),
      j AS (SELECT e.vec_id, e.v AS a, f.v AS b FROM e JOIN c USING (label) JOIN e f ON f.vec_id = c.first_id)
    SELECT vec_id, round(sqrt(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(a, b)]) / 64), 6) + 0.0 AS rmsd,
      round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine FROM j""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    # Ten labels in the table's definition, so ten reference vectors; the join is by label.
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return e.join(ref, "label").select(
        "vec_id",
        r6(numeric.vector_rmsd(F.col("embedding"), F.col("ref"))).alias("rmsd"),
        r6(numeric.cosine_similarity(F.col("embedding"), F.col("ref"))).alias("cosine"),
    )
