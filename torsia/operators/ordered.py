"""Ordered scans that do not need a whole group in one task.

A window over ``partitionBy(key)`` puts a key's rows in one task. Where a key has
more than ``rows_per_block`` rows, the table is range-partitioned on keys and order
columns, so blocks are cut by rank: a far value, an infinity, nulls (first) and NaN
(last) take the place that the plain window gives them. Each block is scanned on its
own, one summary row per key and block is scanned over the key, and the carry is
joined back. Only keys that reach over a block's edge have a carry, so there are
fewer carries than blocks. Rows that tie in the order columns are told apart by a
hash of the row; only rows that are alike in every column stay together.
Tables without such a key get the plain window, dealt out in parts of bounded size. So do those whose largest key is no
larger than a block would be, with the same order of ties: there a block spares no
task anything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torsia.session import cut, parts_for, split

ROWS_PER_BLOCK = 1_000_000
# Range bounds come from a sample, so aim below the limit.
FINER = 2
# More blocks per task slot than this give no more parallel work.
BLOCKS_PER_SLOT = 4
BLOCK = "_block"
TIE = "_tie"


def block_count(df: DataFrame, keys: Sequence[str], rows_per_block: int) -> int:
    """Blocks to cut the table into: 0 when no key has more than ``rows_per_block`` rows, 1 when none has more than an even block."""
    return _blocks_and_rows(df, keys, rows_per_block)[0]


def _blocks_and_rows(df: DataFrame, keys: Sequence[str], rows_per_block: int) -> tuple[int, int]:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = sizes.agg(F.max("_n"), F.sum("_n")).head()
    if most is None or most <= rows_per_block:
        return 0, rows or 0
    spark = df.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = max(2, min(math.ceil(FINER * rows / rows_per_block), BLOCKS_PER_SLOT * slots))
    return (blocks if most > rows / blocks else 1), rows


def with_ties(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows dealt out by key, with the hash that orders ties, which is worked out after the shuffle."""
    out = split(df, rows, keys) if parts_for(df, rows) else df.repartition(*keys)
    return out.withColumn(TIE, F.xxhash64(*df.columns))


def with_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int) -> DataFrame:
    """Add ``_block``, which grows along keys and order, and ``_tie``.

    Written once, so that every later step sees the same blocks.
    """
    ranged = df.withColumn(TIE, F.xxhash64(*df.columns)).repartitionByRange(blocks, *keys, *order, TIE)
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _with_carry(blocked: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the carry per key and block."""
    small = carry.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        F.col(BLOCK).alias("_s_block"),
        *[c for c in carry.columns if c not in (*keys, BLOCK)],
    )
    cond = F.col(BLOCK) == F.col("_s_block")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return blocked.join(small, cond, "left").drop("_s_block", *[f"_s_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    out: dict[str, tuple[str, Column]],
    rows_per_block: int = ROWS_PER_BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``count``, ``min``, ``max`` or ``last`` (of non-nulls) per key.

    ``out`` maps a new column to (function, input column). Null order values come
    first. Rows that tie in all order columns may come in any order.
    """
    order = [order] if isinstance(order, str) else list(order)
    end = 0 if inclusive else -1
    agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}

    def scan(fn: str, x: Column, window) -> Column:
        return F.last(x, ignorenulls=True).over(window) if fn == "last" else agg[fn](x).over(window)

    blocks, rows = _blocks_and_rows(df, keys, rows_per_block)
    if not blocks:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return split(df, rows, keys).select("*", *[scan(fn, c, whole).alias(n) for n, (fn, c) in out.items()])
    inputs = df.select("*", *[c.alias(f"_in_{n}") for n, (_, c) in out.items()])
    if blocks == 1:
        told = Window.partitionBy(*keys).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, end)
        return with_ties(inputs, keys, rows).select(*df.columns, *[scan(fn, F.col(f"_in_{n}"), told).alias(n) for n, (fn, _) in out.items()])
    blocked = with_blocks(inputs, keys, order, blocks)
    here = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order, TIE)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    parts, carries = [F.count(F.lit(1)).alias("_rows")], [F.count("_rows").over(before).alias("_blocks_before")]
    rank = F.struct(*[F.col(o) for o in (*order, TIE)])
    for n, (fn, _) in out.items():
        x = F.col(f"_in_{n}")
        if fn == "last":
            parts.append(F.max_by(x, F.when(x.isNotNull(), rank)).alias(f"_sum_{n}"))
            carries.append(F.last(f"_sum_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}"))
        else:
            parts.append(agg[fn](x).alias(f"_sum_{n}"))
            fold = F.sum if fn == "count" else agg[fn]
            carries.append(fold(f"_sum_{n}").over(before).alias(f"_carry_{n}"))
    carry = (
        blocked.groupBy(*keys, BLOCK).agg(*parts).select(*keys, BLOCK, *carries)
        .filter("_blocks_before > 0").drop("_blocks_before")
    )
    within = blocked.select(
        "*",
        *[
            scan(fn, F.col(f"_in_{n}"), here).alias(f"_own_{n}")
            for n, (fn, _) in out.items()
        ],
    )
    joined = _with_carry(within, carry, keys)
    result = []
    for n, (fn, _) in out.items():
        own, carried = F.col(f"_own_{n}"), F.col(f"_carry_{n}")
        if fn == "count":
            value = F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        elif fn == "sum":
            value = F.when(own.isNull(), carried).when(carried.isNull(), own).otherwise(own + carried)
        elif fn == "min":
            value = F.least(own, carried)
        elif fn == "max":
            value = F.greatest(own, carried)
        else:
            value = F.coalesce(own, carried)
        result.append(value.alias(n))
    return joined.select(*df.columns, *result)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    name: str = "rank",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Row number from 1 within a key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, rows_per_block)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    out: dict[str, str],
    step: int = 1,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Columns of the next (``step=1``) or previous (``step=-1``) row of the key.

    ``out`` maps a new column to the source column. Order and ties as in ``running``.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    order = [order] if isinstance(order, str) else list(order)
    row = F.struct(*[F.col(s).alias(n) for n, s in out.items()])
    shift = F.lead if step == 1 else F.lag
    blocks, rows = _blocks_and_rows(df, keys, rows_per_block)
    if not blocks:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return split(df, rows, keys).select("*", *[shift(s).over(whole).alias(n) for n, s in out.items()])
    if blocks == 1:
        told = Window.partitionBy(*keys).orderBy(*order, TIE)
        return with_ties(df, keys, rows).select(*df.columns, *[shift(s).over(told).alias(n) for n, s in out.items()])
    blocked = with_blocks(df, keys, order, blocks)
    here = Window.partitionBy(*keys, BLOCK).orderBy(*order, TIE)
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    rank = F.struct(*[F.col(o) for o in (*order, TIE)])
    edge = F.min_by if step == 1 else F.max_by
    carry = (
        blocked.groupBy(*keys, BLOCK)
        .agg(edge(row, rank).alias("_edge"))
        .select(*keys, BLOCK, shift("_edge").over(along).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    within = blocked.withColumn("_own", shift(row).over(here))
    joined = _with_carry(within, carry, keys).withColumn("_pick", F.coalesce("_own", "_carry"))
    return joined.select(*df.columns, *[F.col("_pick")[n].alias(n) for n in out])
