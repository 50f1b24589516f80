"""Sequence collections: ``>name`` lines followed by residues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torsia.operators.ordered import ROWS_PER_BLOCK, running

from .text import ordered_text


def read_fasta(
    spark: SparkSession, path: str | Sequence[str], lines: bool = False, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(source, seq_no, name, sequence).

    A record may run over several lines. With ``lines`` every line that is no
    header is one whole sequence under the last header, as in databases of
    two-line records.
    """
    if lines:
        text = ordered_text(spark, path)
        header = F.when(F.col("line").startswith(">"), F.expr("trim(substring(line, 2))"))
        held = running(text, ["source"], "no", {"name": ("last", header)}, rows_per_block)
        return held.filter(~F.col("line").startswith(">") & (F.trim("line") != "")).select(
            "source", F.col("no").alias("seq_no"), "name", F.trim("line").alias("sequence")
        )
    record = F.regexp_replace("line", "^>", "")
    parts = ordered_text(spark, path, sep="\n>").withColumn("_r", record).filter(F.trim("_r") != "")
    at = F.instr("_r", "\n")
    head = F.when(at > 0, F.expr("substring(_r, 1, instr(_r, '\n') - 1)")).otherwise(F.col("_r"))
    body = F.when(at > 0, F.expr("substring(_r, instr(_r, '\n') + 1)")).otherwise("")
    return parts.select(
        "source", F.col("no").alias("seq_no"), F.trim(F.regexp_replace(head, "\r", "")).alias("name"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
    )


def write_fasta(df: DataFrame, path: str) -> None:
    """Name and sequence of each row as a record, one file per partition; a null sequence is empty."""
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("value")).write.text(path)
