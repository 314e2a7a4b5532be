"""Shared handling of embedding columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has only finite components and is not zero throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepare(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id``, ``v``, the vector as doubles, and ``ok``: whether it can be compared and has an id."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.withColumn("ok", usable(F.col("v")) & F.col("vec_id").isNotNull())


def stored_kind(df: DataFrame, vector: str) -> str:
    """How components are kept: as four bytes where the column has no more, else as eight; either way exactly."""
    t = df.schema[vector].dataType
    return "<f4" if isinstance(t, ArrayType) and isinstance(t.elementType, FloatType) else "<f8"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def raw(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one width as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def digests(v: np.ndarray) -> pa.Array:
    """A 128-bit key of each row; equal vectors (0 and -0 being equal) have one key."""
    return pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in v + 0.0], pa.binary())


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component is divided out first, so no square leaves the range of doubles."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def dimension(df: DataFrame, column: str = "v") -> tuple[int, int]:
    """The number of vectors and their one length; raises if there are several lengths."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components cannot be compared")
    return n, low or 0


def keyed(rows: DataFrame, kind: str) -> DataFrame:
    """``vec_id``, ``key`` and ``v``, the components' bytes, of the rows of ``prepare`` that are ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), digests(v), binary(v.astype(kind))], names=["vec_id", "key", "v"])

    return rows.where("ok").select("vec_id", "v").mapInArrow(run, "vec_id long, key binary, v binary")
