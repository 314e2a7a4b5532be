"""Derived tables that many queries read, built once and stored.

A table is stored as Parquet in the folder that ``spark.checkpoint.dir`` names, once for an application and state of its source files, so
later queries read only the columns they use. Only where Spark runs in one process and no folder is set is one under the
system's temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_stored: dict[tuple, tuple[str, object]] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder for derived tables."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own.setdefault(app, tempfile.mkdtemp(prefix="patquarry-"))
    return f"{shared.rstrip('/')}/derived-{app}"


def state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Names, sizes and times of all files below the given paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def derived(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, stored under ``name`` while the source files stay as they are."""
    key = (spark.sparkContext.applicationId, name, state(spark, sources))
    if key not in _stored:
        df, path = build(), f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _stored[key] = path, df.schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once to this application's folder and read back with the same schema, and where; ``delete`` it after use."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a stored folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this application has stored here; frames that read it become unreadable."""
    app = spark.sparkContext.applicationId
    delete(spark, folder(spark))
    for key in [k for k in _stored if k[0] == app]:
        del _stored[key]
