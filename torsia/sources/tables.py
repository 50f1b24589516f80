"""Trace logs, reports and rate matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ordered_text

# Fixed value: order of the rows in published rate files.
RATE_ORDER = "ARNDCQEGHILKMFPSTWYV"


def read_trace(spark: SparkSession, path: str | Sequence[str], run: str | None = "run", index: str = "iter") -> DataFrame:
    """Wide trace files to (run, iter, param, value); absent values are dropped.

    The first line of each file that is neither blank nor a comment (``#``) names its
    columns, so files may differ in columns and order. Columns are set apart by tabs
    if that line has one, else by blanks. Without ``run`` the file's name without its
    ending is the run.
    """
    lines = ordered_text(spark, path).filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    heads = lines.groupBy("source").agg(F.min_by("line", "no").alias("_head"), F.min("no").alias("_at"))
    blanks = F.when(F.col("_head").contains("\t"), "\t").otherwise(r"\s+")

    def cells(c: str) -> Column:
        return F.split(F.when(F.col("_head").contains("\t"), F.col(c)).otherwise(F.trim(c)), blanks)

    rows = lines.join(heads, "source").filter(F.col("no") > F.col("_at")).select("source", cells("_head").alias("names"), cells("line").alias("cells"))
    name = F.lit(run) if run is not None else F.regexp_extract("source", r"([^/]+?)(\.[^./]*)?$", 1)
    at = F.get("cells", (F.array_position("names", index) - 1).cast("int"))
    long = rows.select(
        name.alias("run"), F.trim(at).try_cast("bigint").alias("iter"), F.explode(F.arrays_zip("names", "cells")).alias("_c")
    )
    value = F.trim(F.col("_c")["cells"]).try_cast("double")
    return long.select("run", "iter", F.col("_c")["names"].alias("param"), value.alias("value")).filter(
        (F.col("param") != index) & F.col("value").isNotNull()
    )


def trace_wide(long: DataFrame, params: Sequence[str] | None = None) -> DataFrame:
    """One row per iteration, one column per parameter. Naming ``params`` saves a pass."""
    grouped = long.groupBy("iter")
    pivot = grouped.pivot("param", list(params)) if params else grouped.pivot("param")
    return pivot.agg(F.first("value"))


def write_trace(wide: DataFrame, path: str) -> None:
    wide.write.option("sep", "\t").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_rates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symmetric (from_aa, to_aa, rate) and (aa, freq) from a lower triangle and a line of 20.

    A triangle line with i numbers is row i + 1, so no line order is needed.
    Letters are the keys, not positions.
    """
    values = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = spark.read.text(path).select(values.alias("v")).filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def letter(i):
        return F.substring(F.lit(RATE_ORDER), i.cast("int"), F.lit(1))

    cells = rows.select(F.size("v").alias("n"), F.posexplode("v").alias("j", "x"))
    lower = cells.filter("n < 20").select(letter(F.col("n") + 1).alias("from_aa"), letter(F.col("j") + 1).alias("to_aa"), F.col("x").alias("rate"))
    rates = lower.unionByName(lower.select(F.col("to_aa").alias("from_aa"), F.col("from_aa").alias("to_aa"), "rate"))
    freqs = cells.filter("n = 20").select(letter(F.col("j") + 1).alias("aa"), F.col("x").alias("freq"))
    return rates, freqs
