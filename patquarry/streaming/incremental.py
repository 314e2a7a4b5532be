"""Incremental forms of batch steps as Structured Streaming: an extension for tables that keep growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet folder as a stream of the rows that new files bring."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def assign_new(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "patent_id") -> StreamingQuery:
    """Transform what arrives and append rows whose key the target lacks; a batch that is run again adds nothing.

    ``transform`` is, for instance, a fitted model's. Keys within a batch are taken once."""

    def put(batch: DataFrame, _: int) -> None:
        rows = transform(batch.dropDuplicates([key]))
        try:
            there = batch.sparkSession.read.parquet(path).select(key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            rows.write.mode("append").parquet(path)
            return
        rows.join(there, key, "left_anti").write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by tumbling window and kind; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
