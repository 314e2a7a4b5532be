"""Topic models that learn from rows as they come: an extension of the incremental assignment to a stream.

A model is a folder of versions. Version 0 is a fit; each batch of a stream writes a version of ``assignments`` (its rows that no earlier version
has) and then of ``centers``, which completes it. What a batch writes follows from the version before and its own rows alone, and it
writes over what an earlier try of the same batch left: a batch that is run again changes nothing, and old versions stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from patquarry.operators import online

KEY = "patent_id"
ASSIGNMENTS = f"{KEY} long, topic int, distance double"


def _path(path: str, what: str, version: int) -> str:
    return f"{path.rstrip('/')}/{what}/version={version}"


def found(spark: SparkSession, path: str, fit: online.Fit, rows: DataFrame, vector: str = "vector") -> None:
    """Version 0: the centers of a fit and the assignments of its rows."""
    centers = online.as_table(spark, fit)
    near = online.nearest(rows, centers, vector).select(F.col(KEY).cast("long"), "topic", "distance")
    near.write.mode("overwrite").parquet(_path(path, "assignments", 0))
    centers.write.mode("overwrite").parquet(_path(path, "centers", 0))


def centers(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(online.CENTERS).parquet(_path(path, "centers", version))


def assignments(spark: SparkSession, path: str, to: int | None = None) -> DataFrame:
    """``patent_id, topic, distance, version`` of all versions, or of those up to one."""
    rows = spark.read.schema(f"{ASSIGNMENTS}, version int").parquet(f"{path.rstrip('/')}/assignments")
    return rows if to is None else rows.where(F.col("version") <= to)


def learn(batch: DataFrame, version: int, path: str, vector: str = "vector") -> None:
    """Make ``version`` from the one before and a batch ``patent_id, vector``.

    Rows that have an assignment, have no vector or repeat another's id and vector are left out; of different vectors of one id the smallest
    counts. A batch without new rows gives a version with the centers as they were."""
    spark = batch.sparkSession
    before = centers(spark, path, version - 1)
    once = batch.where(F.col(KEY).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(KEY).cast("long").alias(KEY)).agg(F.min(vector).alias(vector))
    new = once.join(assignments(spark, path, version - 1).select(KEY), KEY, "left_anti")
    near = online.nearest(new, before, vector)
    near.select(KEY, "topic", "distance").write.mode("overwrite").parquet(_path(path, "assignments", version))
    online.partial_fit(before, new, vector).coalesce(1).write.mode("overwrite").parquet(_path(path, "centers", version))


def grow(stream: DataFrame, path: str, checkpoint: str, vector: str = "vector") -> StreamingQuery:
    """Learn from a stream, a version a batch; one stream a model."""
    return stream.writeStream.foreachBatch(lambda batch, k: learn(batch, k + 1, path, vector)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
