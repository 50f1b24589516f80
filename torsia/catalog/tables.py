"""The given tables dressed as the engine's inputs, in Spark and in SQL.

Sites come from lineitem and orders (customer = family, order = protein, line
number = column), entries from documents, jumps and traces from events, trees
from region > nation > customer > orders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torsia.functions.angles import pimod
from torsia.functions.letters import canonical
from torsia.session import dealt, spread

TWO_PI = 2.0 * math.pi
LETTERS = "ACDEFGHIKLMNPQRSTVWY-X"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


def sql_number(*columns: str) -> str:
    """The number that ``md5_number`` gives."""
    told = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"CAST('0x' || md5({told})[1:15] AS BIGINT)"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """(family, protein, seq_no, col, aa, phi, psi), angles null at gaps and X.

    Lines are dealt out by order once: the grouping, the join and later steps per protein need no other deal.
    """
    lines = (
        dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"), ["l_orderkey"])
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("pk"),
            F.min("l_shipdate").alias("ship"),
            F.min("l_extendedprice").alias("price"),
        )
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    aa = F.substring(F.lit(LETTERS), (F.col("pk") % 22 + 1).cast("int"), F.lit(1))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).withColumn("aa", aa)
    seen = ~F.col("aa").isin("-", "X")
    cents = F.round(F.col("price") * 100).cast("bigint")
    return joined.select(
        F.col("o_custkey").alias("family"),
        F.col("l_orderkey").alias("protein"),
        F.col("l_orderkey").alias("seq_no"),
        F.col("l_linenumber").cast("bigint").alias("col"),
        "aa",
        F.when(seen, pimod(F.dayofyear("ship") * F.lit(TWO_PI) / 366.0)).alias("phi"),
        F.when(seen, F.lit(math.pi) - (cents % 1000) * F.lit(TWO_PI) / 1000.0).alias("psi"),
    )


SITES = f"""sites AS (
  SELECT family, protein, protein AS seq_no, col, aa,
    CASE WHEN aa NOT IN ('-', 'X') THEN
      CASE WHEN a > pi() THEN a - 2*pi() ELSE a END END AS phi,
    CASE WHEN aa NOT IN ('-', 'X') THEN pi() - (cents % 1000) * 2*pi() / 1000.0 END AS psi
  FROM (
    SELECT o_custkey AS family, l_orderkey AS protein, CAST(l_linenumber AS BIGINT) AS col,
      substr('{LETTERS}', CAST(min(l_partkey) % 22 + 1 AS INTEGER), 1) AS aa,
      (dayofyear(min(l_shipdate)) * 2*pi() / 366.0) % (2*pi()) AS a,
      CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_custkey, l_orderkey, l_linenumber))"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as entries: id, seq_no, name, cleaned sequence."""
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("seq_no"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        "text",
        "lang",
        "source",
        canonical(F.col("text"), "drop").alias("sequence"),
    )


def sql_drop(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


def sql_kmers(k: int, source: str, id_col: str = "id", seq: str = "sequence") -> str:
    """SELECT of (id, kmer, n) from a relation with cleaned sequences."""
    return f"""SELECT {id_col} AS id, substr({seq}, p, {k}) AS kmer, count(*) AS n
      FROM (SELECT {id_col}, {seq}, unnest(generate_series(1, length({seq}) - {k - 1})) AS p FROM {source})
      GROUP BY ALL"""


DOCS = f"""docs AS (SELECT doc_id AS id, doc_id AS seq_no, 'doc' || doc_id AS name, text, lang, source,
  {sql_drop('text')} AS sequence FROM documents)"""
ITEMS = f"""items AS (SELECT item_id AS id, {sql_drop('text')} AS sequence FROM benchmark)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), canonical(F.col("text"), "drop").alias("sequence")
    )


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(node, t_us, t, state, value, hour, minute, theta): events as timed states of a user."""
    us = micros("ts")
    return (
        table(spark, sf, "events")
        .withColumn("t_us", us)
        .select(
            F.col("user_id").alias("node"),
            "event_id",
            "t_us",
            (F.col("t_us") / F.lit(31.0 * 86400e6)).alias("t"),
            F.col("event_type").alias("state"),
            "value",
            (F.floor((F.col("t_us") % 86400000000) / 3600000000)).cast("bigint").alias("hour"),
            (F.floor((F.col("t_us") % 3600000000) / 60000000)).cast("bigint").alias("minute"),
            pimod((F.col("t_us") % 86400000000) * F.lit(TWO_PI) / 86400e6).alias("phi"),
            pimod((F.col("t_us") % 3600000000) * F.lit(TWO_PI) / 3600e6).alias("psi"),
        )
    )


EVENTS = """ev AS (
  SELECT user_id AS node, event_id, t_us, t_us / (31.0 * 86400e6) AS t, event_type AS state, value,
    CAST((t_us % 86400000000) // 3600000000 AS BIGINT) AS hour,
    CAST((t_us % 3600000000) // 60000000 AS BIGINT) AS minute,
    CASE WHEN a > pi() THEN a - 2*pi() ELSE a END AS phi,
    CASE WHEN b > pi() THEN b - 2*pi() ELSE b END AS psi
  FROM (SELECT *, (t_us % 86400000000) * 2*pi() / 86400e6 AS a, (t_us % 3600000000) * 2*pi() / 3600e6 AS b
        FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS t_us FROM events)))"""


def tree_nodes(spark: SparkSession, sf: str, orders: bool = True) -> DataFrame:
    """(node, parent, branch_length, name, child_no) of the test tree."""
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    top = spark.range(1).select(
        F.lit(0).cast("bigint").alias("node"),
        F.lit(None).cast("bigint").alias("parent"),
        F.lit(0.0).alias("branch_length"),
        F.lit("root").alias("name"),
    )
    parts = [
        region.select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("node"),
            F.lit(0).cast("bigint").alias("parent"),
            F.lit(1.0).alias("branch_length"),
            F.col("r_name").alias("name"),
        ),
        nation.select(
            (F.col("n_nationkey") + 100).cast("bigint").alias("node"),
            (F.col("n_regionkey") + 1).cast("bigint").alias("parent"),
            ((F.col("n_nationkey") + 1) / 50.0).alias("branch_length"),
            F.col("n_name").alias("name"),
        ),
        customer.select(
            (F.col("c_custkey") + 1000).alias("node"),
            (F.col("c_nationkey") + 100).cast("bigint").alias("parent"),
            ((F.col("c_acctbal") + 1000) / 10000.0).alias("branch_length"),
            F.col("c_name").alias("name"),
        ),
    ]
    if orders:
        parts.append(
            table(spark, sf, "orders").select(
                (F.col("o_orderkey") + 1000000000).alias("node"),
                (F.col("o_custkey") + 1000).alias("parent"),
                (F.col("o_totalprice") / 1e6).alias("branch_length"),
                F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"),
            )
        )
    for p in parts:
        top = top.unionByName(p)
    return top.withColumn("tree", F.lit("t"))


def sql_nodes(orders: bool = True) -> str:
    last = (
        """ UNION ALL SELECT o_orderkey + 1000000000, o_custkey + 1000, o_totalprice / 1e6, 'order' || o_orderkey FROM orders"""
        if orders
        else ""
    )
    return f"""nodes AS (
  SELECT CAST(0 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(0 AS DOUBLE) AS branch_length, 'root' AS name
  UNION ALL SELECT r_regionkey + 1, 0, 1.0, r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, (n_nationkey + 1) / 50.0, n_name FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, (c_acctbal + 1000) / 10000.0, c_name FROM customer{last})"""
