"""Traces followed while they grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torsia.schemas import TRACE
from torsia.session import scratch_path


def write_trace_parts(trace: DataFrame) -> str:
    """Long trace as tab-separated part files in a new shared folder."""
    path = scratch_path(trace.sparkSession, "trace")
    trace.select("run", "iter", "param", "value").write.option("sep", "\t").csv(path)
    return path


def running_statistics(stream: DataFrame) -> DataFrame:
    """Count, mean, least and most per run and parameter.

    The state is one row of four numbers per (run, parameter), so it does not
    grow with the length of a trace. Partial aggregation comes before the shuffle.
    """
    return stream.groupBy("run", "param").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def read_trace_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(TRACE)
        .option("sep", "\t")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )


STATISTICS = "run string, param string, n bigint, mean double, least double, most double"


def newest_statistics(spark: SparkSession, out: str) -> DataFrame:
    """The last row stored of each (run, param)."""
    values = ("n", "mean", "least", "most")
    stored = spark.read.schema(f"{STATISTICS}, batch bigint").parquet(out)
    last = stored.groupBy("run", "param").agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select("run", "param", *[F.col("_v")[c].alias(c) for c in values])


def follow_traces(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 4) -> None:
    """Take in all files there now; a later call with the same folders goes on where this one ended.

    The stream keeps a row of state per (run, param) and gives changed rows
    only, so what a batch writes follows the keys it touched. A batch that is
    repeated after a failure replaces its own folder of ``out``.
    """
    # So that the table can be read before the first file comes.
    spark.createDataFrame([], STATISTICS).write.mode("ignore").parquet(f"{out}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        running_statistics(read_trace_stream(spark, folder, files_per_trigger))
        .writeStream.outputMode("update")
        .queryName(f"trace_{uuid.uuid4().hex}")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()


def trace_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """Statistics over all files there now, as the stream leaves them in a new table of the shared folder."""
    out, checkpoint = scratch_path(spark, "trace-stats"), scratch_path(spark, "trace-stream")
    follow_traces(spark, folder, out, checkpoint, files_per_trigger)
    return newest_statistics(spark, out)
