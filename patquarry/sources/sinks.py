"""Writing derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table by its new contents in one commit."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Append the rows, one a key, whose keys a table lacks, parted as the table is. One writer at a time: Parquet folders do not isolate two."""
    there = df.sparkSession.read.parquet(path).select(*keys)
    writer = df.dropDuplicates(keys).join(there, keys, "left_anti").write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as canonical JSON, columns in order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
