"""The operators as queries on the given tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    exact_dedup,
    line_crf,
    lm_score,
    near_dedup,
    packing,
    prefix_trie,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    va_clusters,
)
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: (host, path, verdict) of the rules that the URL query applies.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").filter(fold("doc_id") != 0)
    score = toxicity.toxicity(F.col("text"), toxicity.learn(docs, labels))
    return docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


@query("op2_decontamination")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_BPE).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_exact_dedup",
    f"""WITH d AS (SELECT doc_id, {SQL_LOWER} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY norm)""",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    told = exact_dedup.decide(table(spark, sf, "documents"), "doc_id", "text")
    return told.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    told = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return told.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op6_chat_format")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf, "conversations"))


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), BYTE_BPE)


@query("op8_near_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    told = near_dedup.classes(table(spark, sf, "documents"))
    return told.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query("op9_lm_scores")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf, "documents"), fold("doc_id") == 1).withColumnRenamed("id", "doc_id")


SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op10_url_filter",
    f"""WITH rules(rh, rp, rv) AS (VALUES {SQL_RULES}),
    cut AS (SELECT page_id, CASE WHEN contains(url, '://')
        THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS bare FROM pages),
    parts AS (SELECT page_id, translate(split_part(bare, '/', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM cut)
    SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM (
      SELECT page_id, host, path, rh || rp AS rule, rv,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, rv DESC) AS k
      FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    WHERE k = 1""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )


@query("op11_quality")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").filter(fold("doc_id") != 0)
    score = line_crf.quality(F.col("text"), line_crf.learn(docs, labels))
    return docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


SQL_APART = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sql_clusters(count: int = 40, rounds: int = 5) -> str:
    """Every round as two named tables: nearest centroids, then their means."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS w FROM (
          SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {count}))""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM (SELECT vec_id, v, cluster, {SQL_APART} AS distance,
              row_number() OVER (PARTITION BY vec_id ORDER BY {SQL_APART}, cluster) AS k FROM kept, c{k}) WHERE k = 1)"""
        )
        steps.append(
            f"""m{k} AS (SELECT cluster, d, (sum(v[d]) - (((sum(v[d]) % count(*)) + count(*)) % count(*))) // count(*) AS x
              FROM a{k}, range(1, 65) t(d) GROUP BY cluster, d)"""
        )
        steps.append(
            f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.w, c.w) AS w FROM c{k} c
              LEFT JOIN (SELECT cluster, list(x::BIGINT ORDER BY d) AS w FROM m{k} GROUP BY cluster) n USING (cluster))"""
        )
    return f"""WITH {", ".join(steps[:-2])}
    SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance,
      (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query("op12_clusters", sql_clusters())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return va_clusters.clusters(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


#: crc32 of decimal digits, from the table of its 256 byte steps.
SQL_CRC = """(SELECT list(list_reduce(list_concat([i], range(8)),
  lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"""


@query(
    "op13_prefix_trie",
    f"""WITH crc AS MATERIALIZED {SQL_CRC},
    turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS spot
      FROM conversations WHERE conv_id IS NOT NULL),
    heads AS MATERIALIZED (SELECT c, c - c % 100 AS b, xor(list_reduce(list_concat([4294967295],
        list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM turns), crc),
    whole AS (SELECT c, spot, role, text FROM turns JOIN heads USING (c) WHERE spot > h
      UNION ALL SELECT heads.c, spot, role, text FROM heads JOIN turns ON turns.c = heads.b WHERE spot <= h),
    spots AS MATERIALIZED (SELECT c, row_number() OVER w AS depth, list([role, text]) OVER w AS path, length(text) AS n
      FROM whole WINDOW w AS (PARTITION BY c ORDER BY spot)
      UNION ALL SELECT c, 0, [], 0 FROM heads),
    longest AS (SELECT c, max(depth) AS depth FROM spots GROUP BY c),
    nodes AS MATERIALIZED (SELECT s.depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
        coalesce(string_agg(c, ',' ORDER BY c) FILTER (l.depth = s.depth), '') AS ends
      FROM spots s JOIN longest l USING (c) GROUP BY s.depth, path),
    lines AS MATERIALIZED (SELECT s.depth, min(s.c) OVER (PARTITION BY s.depth, s.path) AS conv_id, s.c AS rep FROM spots s),
    kids AS (SELECT u.conv_id, u.depth, count(*) AS n_children FROM nodes n
      JOIN lines u ON u.rep = n.conv_id AND u.depth = n.depth - 1 GROUP BY ALL),
    parents AS (SELECT n.depth, n.conv_id, u.conv_id AS parent_conv_id FROM nodes n
      JOIN lines u ON u.rep = n.conv_id AND u.depth = n.depth - 1),
    below AS (SELECT u.depth, u.conv_id, sum((n.n_convs - 1) * n.n) AS saved_tokens,
        count(*) FILTER (k.n_children IS NULL) AS n_leaves
      FROM nodes n JOIN lines u ON u.rep = n.conv_id AND u.depth <= n.depth
      LEFT JOIN kids k ON k.depth = n.depth AND k.conv_id = n.conv_id GROUP BY ALL)
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
      n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
    FROM nodes LEFT JOIN kids USING (depth, conv_id) LEFT JOIN parents USING (depth, conv_id) JOIN below USING (depth, conv_id)""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))
