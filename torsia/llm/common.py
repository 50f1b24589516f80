"""What several operators share: tables written once, letter case, folds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torsia.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, stored once in the shared folder and read again.

    Cuts lineage: a lost executor costs no recomputation, and columns that a
    later step does not use are not read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matched(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: met by an exchange, at any size.

    The files of a table of numbers take a tenth of its rows, and the optimiser doesn't count the rows
    that an ``explode`` adds, so what it takes for small enough to send whole may fill the driver.
    """
    return df.hint("merge")


#: Chunks of text above so many characters aren't remembered by workers.
LONG = 64
_HELD: dict[tuple[str, str], tuple[Any, Any]] = {}


def held(group: str, name: str, key: Any, make: Callable[[], Any]) -> Any:
    """What a worker keeps for the tasks that follow: one thing a name, and the things of one group at a time.

    Workers live on from stage to stage; what the last operator kept goes when the next one asks.
    """
    at = (group, name)
    if at not in _HELD or _HELD[at][0] != key:
        for k in [k for k in _HELD if k[0] != group or k == at]:
            del _HELD[k]
        _HELD[at] = (key, make())
    return _HELD[at][1]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(id_col: str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def batch_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Limit the rows and bytes of an Arrow batch, as rows hold whole texts; the session keeps both."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), under names that clash with nothing; null text is empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()
