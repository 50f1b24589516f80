"""Exact percentiles that hold no group in memory.

The built-in exact percentile keeps every distinct value of a group in one
task. Here equal values are counted, the counts are summed along the values (in
blocks for a hot group), and the one or two rows that cover the wanted rank are
picked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torsia.session import cut

from .ordered import ROWS_PER_BLOCK, running


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(keys, one column per wanted share of 0 to 1), with linear interpolation; nulls do not count."""
    keys = list(keys)
    # Written once: the size check, the scan and the totals all read it.
    counts = cut(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running(counts, keys, "_v", {"_upto": ("sum", F.col("_n"))}, rows_per_block)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    rows = placed.join(totals, keys)
    first = F.col("_upto") - F.col("_n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col("_v")))

    aggs = []
    for name, p in wanted.items():
        # A product like 0.9 * 10 may come out a hair off a whole rank.
        place = F.round(F.lit(p) * (F.col("_all") - 1), 9)
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    picked = rows.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in wanted],
    )


def nan_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], fill: float = 0.0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The same after NaN has become ``fill``."""
    clean = df.withColumn(value, F.nanvl(F.col(value), F.lit(fill)))
    return exact_percentiles(clean, keys, value, wanted, rows_per_block)
