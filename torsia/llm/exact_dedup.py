"""Exact de-duplication with a heavy-hitter split.

Texts are compared by the SHA-256 of their normalised form. A Misra-Gries
summary finds the digests that own a large share of the rows. Exact counts
verify them, and their few winners are broadcast, so that the rows of the
largest groups are decided where they are and never meet in one task. All other
digests go through an ordinary aggregate and join.

Defined results: null text counts as empty text; a null id is smaller than any
other; of rows that repeat both id and text one stays; an empty table gives an
empty result. Only the id and the text are read, so further columns may have
any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, lower_ascii, written

#: Counters of a summary. A digest with 2/(SLOTS+1) of all rows is always split off.
SLOTS = 1000


def digest(text_col: str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))


def shrink(counters: Counter, slots: int) -> Counter:
    """Misra-Gries step: take the (slots+1)-th largest count from all, keep what is positive."""
    if len(counters) <= slots:
        return counters
    less = sorted(counters.values(), reverse=True)[slots]
    return Counter({k: v - less for k, v in counters.items() if v > less})


def summaries(digests: DataFrame, slots: int) -> DataFrame:
    """(digest, estimate) of each partition, at most ``slots`` rows per partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: Counter = Counter()
        for b in batches:
            for x in b.column(0).value_counts():
                counters[x["values"].as_py()] += x["counts"].as_py()
            counters = shrink(counters, slots)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())],
            ["digest", "estimate"],
        )

    return digests.select("digest").mapInArrow(scan, "digest binary, estimate long")


def heavy_digests(digests: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Digests whose summed estimate reaches rows/(slots+1).

    A partition of n rows underestimates a count by at most n/(slots+1), so the
    sum is at most rows/(slots+1) too low and never too high: every digest with
    twice that many rows is found, and no more than slots+1 are returned.
    """
    least = digests.count() / (slots + 1)
    return (
        summaries(digests, slots)
        .groupBy("digest")
        .agg(F.sum("estimate").alias("estimate"))
        .filter(F.col("estimate") >= max(least, 1.0))
        .select("digest")
    )


def decide(df: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(id, digest, keep_id, group_size, kept): one row per row of ``df``."""
    rows = written(
        df.select(
            F.col(id_col).alias("id"),
            digest(text_col).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    winner = F.max(F.struct("id", "row")).alias("winner")
    size = F.count(F.lit(1)).alias("group_size")
    heavy = written(heavy_digests(rows, slots), "heavy")  # at most slots + 1 rows
    winners = written(
        rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(winner, size), "winners"
    )
    of_heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    of_rest = rest.join(rest.groupBy("digest").agg(winner, size), "digest")
    return of_heavy.unionByName(of_rest).select(
        "id",
        "digest",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
    )


def drop_copies(df: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` that stay, with their columns as they were."""
    told = written(decide(df, id_col, text_col, slots).filter(~F.col("kept")), "dropped")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    own, key, its = free(df, "_own", "_id", "_digest")
    away = told.filter(~same).select(F.col("id").alias(key), F.col("digest").alias(its))
    # Rows that repeat id and text: the winner is among them, so one stays.
    again = told.filter(same).select(F.col("id").alias(key), F.col("digest").alias(its)).distinct()
    named = df.withColumn(own, digest(text_col))
    match = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(its))
    left = named.join(away, match, "left_anti")
    if again.isEmpty():
        return left.drop(own)
    once = left.join(again, match, "left_semi").dropDuplicates([id_col, own])
    return left.join(again, match, "left_anti").unionByName(once).drop(own)
