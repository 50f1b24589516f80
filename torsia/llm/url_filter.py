"""URL rules as a sort-merge range join.

A rule is a host and a path prefix. Its key is the host with its labels
reversed, a slash, and the path; all keys that start with it form one interval
of the sorted keys, and intervals are nested or apart. A URL gives one point per
suffix of its host, so that a rule fits subdomains. Rules and points are sorted
together and swept once: at a rule the sweep pushes it on the stack of rules
that enclose it, and a point pops those whose interval has ended. The sweep runs
in range partitions; the stack at the start of each is carried over.

Defined results: a null url or one without ``://`` has empty host and path; a
url that no rule fits has a null rule and the default verdict; among rules of
one length the longer host wins, then ``block``; rules with a null part are left
out; empty tables give empty results. Repeated urls are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, lower_ascii, written

ALLOW, BLOCK = "allow", "block"


def parts_of(url: Column) -> Column:
    """(host, path) of a url, the host with A-Z lower-cased."""
    given = F.coalesce(url, F.lit(""))
    at = F.instr(given, "://")
    rest = F.when(at > 0, F.substring(given, at + 3, F.length(given))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.substring_index(bare, "/", 1)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.struct(lower_ascii(host).alias("host"), path.alias("path"))


def key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def nested(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with all rules that enclose it, itself last.

    Enclosing rules have the same host and a path that is a prefix. Prefixes are
    cut only at lengths that the host's rules have, then joined on equality.
    """
    named = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("host", lower_ascii(F.col("host")))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of two verdicts block is the greater
    )
    lengths = named.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = named.join(lengths, "host").select(
        "host", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    ).withColumn("up", F.expr("substr(path, 1, n)"))
    above = named.select(
        F.col("host").alias("h"), F.col("path").alias("up_path"), F.col("verdict").alias("up_verdict")
    )
    full = key(F.split("host", r"\."), F.col("up_path"))
    entry = F.struct(
        F.length(full).alias("n"),
        full.alias("key"),
        F.concat("host", "up_path").alias("rule"),
        F.length("host").alias("host_n"),
        F.col("up_verdict").alias("verdict"),
    )
    return (
        prefixes.join(above, (F.col("host") == F.col("h")) & (F.col("up") == F.col("up_path")))
        .groupBy("host", "path")
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
        .select(key(F.split("host", r"\."), F.col("path")).alias("key"), "stack")
    )


def judged(urls: DataFrame, rules: DataFrame, partitions: int | None = None) -> DataFrame:
    """(_host, _path, rule, verdict) of distinct hosts and paths; only those that a rule fits."""
    spark = urls.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = nested(rules)
    # Longer suffixes than any rule's host can match nothing.
    deepest = rules.select(F.max(F.size(F.split("host", r"\."))).alias("deepest"))
    labels = F.split("_host", r"\.")
    points = (
        urls.crossJoin(F.broadcast(deepest))  # one row
        .withColumn("labels", labels)
        .withColumn("m", F.explode(F.expr("sequence(1, least(size(labels), coalesce(deepest, 1)))")))
        .select(
            key(F.expr("slice(labels, size(labels) - m + 1, m)"), F.col("_path")).alias("key"),
            F.lit(1).alias("kind"),
            "_host",
            "_path",
        )
    )
    rows = stacks.select("key", F.lit(0).alias("kind"), "stack").unionByName(points, allowMissingColumns=True)
    dealt = written(
        rows.repartitionByRange(parts, "key", "kind", "_host").withColumn("part", F.spark_partition_id()), "sweep"
    )
    within = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        dealt.groupBy("part")  # one row per range partition
        .agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("top"))
        .select("part", F.last("top", ignorenulls=True).over(before).alias("carried"))
    )
    swept = (
        dealt.withColumn("own", F.last("stack", ignorenulls=True).over(within))
        .filter(F.col("kind") == 1)
        .join(F.broadcast(carry), "part")
        .withColumn("open", F.filter(F.coalesce("own", "carried"), lambda r: F.startswith(F.col("key"), r["key"])))
        .filter(F.size("open") > 0)
        .withColumn("hit", F.element_at("open", -1))
    )
    best = F.struct(F.length("hit.rule").alias("n"), F.col("hit.host_n"), F.col("hit.verdict"), F.col("hit.rule"))
    return (
        swept.groupBy("_host", "_path")
        .agg(F.max(best).alias("best"))
        .select("_host", "_path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW, partitions: int | None = None
) -> DataFrame:
    """All rows of ``pages`` with ``_host``, ``_path``, ``_rule`` and ``_verdict``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). All columns of
    ``pages`` stay; where one is named like a result, the result's name gets
    underscores in front.
    """
    names = free(pages, "_host", "_path", "_rule", "_verdict")
    host, path, rule, verdict = names
    told = pages.select("*", parts_of(F.col(url_col)).alias(host)).select(
        *pages.columns, F.col(host)["host"].alias(host), F.col(host)["path"].alias(path)
    )
    urls = told.select(F.col(host).alias("_host"), F.col(path).alias("_path")).distinct()
    found = judged(urls, rules, partitions)
    found = found.select(*[F.col(c).alias(n) for c, n in zip(found.columns, names)])
    return told.join(found, [host, path], "left").select(
        *pages.columns, host, path, rule, F.coalesce(verdict, F.lit(default)).alias(verdict)
    )
