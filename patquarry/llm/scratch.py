"""Tables written to the folder that all executors share, to cut lineage.

The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process (tests, a
laptop) is a folder under the system's temporary folder used; with other masters its lack is an error, as
executors do not see each other's disks. Files are read and written by Spark alone, so any file
system that Spark knows will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Bytes of a batch of rows that a Python worker gets; texts are long, and Spark's own bound lets a batch have 10,000 of them.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the batches that Python workers of this session get by ``BATCH_BYTES``, unless its bound is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def base(spark: SparkSession) -> str:
    """The shared folder of this application."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own.setdefault(app, tempfile.mkdtemp(prefix="patquarry-"))
    return f"{shared.rstrip('/')}/patquarry-{app}"


def folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder name for one result."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in the shared folder and read back with the same schema, and where."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back with the same schema."""
    return stored(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this application wrote; results not yet stored elsewhere become unreadable."""
    delete(spark, base(spark))
