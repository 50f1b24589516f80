"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("torsia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    The cluster sets ``spark.checkpoint.dir``. Only a local session without it
    gets a folder of its own.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="torsia-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, stored once in the shared folder and read again: they survive the loss of an executor.

    Packed columns, of which a later step reads those it uses; a checkpoint of rows
    takes several times the disk. Written without dictionaries, so that the size of
    the files tells the optimiser about the size of the rows.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a deal should have, where there are enough partitions to choose.
ROWS_PER_PART = 500_000


def dealt(table: DataFrame, keys: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """A stored table's rows dealt out by key, in as many parts as its size asks for.

    What one task holds then stays the same however large the table is. A small
    table gets the session's number of partitions, which adaptive execution may
    lower. The rows are counted, which reads no column.
    """
    rows = table.count()
    if parts_for(table, rows, rows_per_part):
        return split(table, rows, keys, rows_per_part)
    return table.repartition(*keys)


def parts_for(df: DataFrame, rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """Parts for so many rows, 0 where the session's number of partitions is enough."""
    parts = math.ceil(rows / rows_per_part)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def split(df: DataFrame, rows: int, keys: Sequence[str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rows dealt out by key before a join or grouping on it, where there are more of them than the session's partitions should hold.

    Keys should not be hot: adaptive execution leaves such a deal as it is.
    """
    parts = parts_for(df, rows, rows_per_part)
    return df.repartition(parts, *keys) if parts else df


def spread(df: DataFrame) -> DataFrame:
    """Give a small input as many partitions as there are cores.

    A file of one row group is read by one task. Large inputs have more splits
    than cores already and are left as they are, with no extra shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
