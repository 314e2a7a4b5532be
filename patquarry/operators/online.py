"""Topic models that grow: principal components from mergeable moments, k-means of many starts at once, and centers with counts.

All three keep a state of bounded size (moments of d x d numbers, centers of a few topics), made by tasks and merged by tree; new rows are
added to it without the old ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from patquarry.operators.sets import mean_vector
from patquarry.sources import derived

#: Partial states that meet in one task of the first merge.
FAN = 32


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1 if len(column) else 0)


def _merged(a: tuple[int, np.ndarray, np.ndarray] | None, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Two parts' rows, mean and scatter around it as those of both."""
    if a is None or not a[0]:
        return n, mean, scatter
    if not n:
        return a
    both, off = a[0] + n, mean - a[1]
    return both, a[1] + off * (n / both), a[2] + scatter + np.outer(off, off) * (a[0] * n / both)


_STATE = "bucket int, n long, mean binary, scatter binary"


def _state(bucket: int, state: tuple[int, np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([state[0]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in state[1:])], names=["bucket", "n", "mean", "scatter"])


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    state = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            mean = x.mean(0)
            state = _merged(state, len(x), mean, (x - mean).T @ (x - mean))
    yield from _state(TaskContext.get().partitionId() % FAN, state)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        for n, mean, scatter in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            mean = np.frombuffer(mean)
            state = _merged(state, n, mean, np.frombuffer(scatter).reshape(len(mean), -1))
    yield from _state(0, state)


def moments(df: DataFrame, vector: str, more: DataFrame | None = None) -> DataFrame:
    """One row: the number of vectors, their mean and the scatter around it; with ``more``, such a row, the moments of both.

    Null vectors are left out; no vectors give no row. A task sends one state of d x d numbers, ``FAN`` tasks merge them, one merges theirs.
    """
    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_part, _STATE)
    fewer = parts.repartition("bucket").mapInArrow(_merge, _STATE)
    return (fewer if more is None else fewer.unionByName(more)).repartition(1).mapInArrow(_merge, _STATE)


@dataclass(frozen=True)
class Components:
    """Principal components as rows, the vectors' mean, and the share of the variance that each explains."""

    mean: np.ndarray
    rows: np.ndarray
    explained: np.ndarray

    def project(self, df: DataFrame, vector: str, out: str = "reduced") -> DataFrame:
        """``df`` with each vector's coordinates, null where the vector is."""
        mean, rows = self.mean, self.rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(vector)
                there = column.is_valid()
                x = _matrix(column.filter(there))
                flat = ((x - mean) @ rows.T).reshape(-1) if len(x) else np.empty(0)
                offsets = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False).astype(np.int32) * len(rows)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~there.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

        from pyspark.sql.types import ArrayType, DoubleType, StructType

        return df.mapInArrow(run, StructType([*df.schema.fields, *StructType().add(out, ArrayType(DoubleType())).fields]))


def components(state: DataFrame, most: int = 100) -> Components:
    """The first ``min(most, vectors, dimensions)`` components of moments; of each the largest coordinate is positive.

    The driver gets the one row of d x d numbers."""
    row = state.first()
    if row is None:
        raise ValueError("no vectors")
    mean = np.frombuffer(row["mean"])
    values, vectors = np.linalg.eigh(np.frombuffer(row["scatter"]).reshape(len(mean), -1))
    k = min(most, row["n"], len(mean))
    values, rows = np.maximum(values[::-1], 0.0), vectors.T[::-1][:k]
    rows = rows * np.sign(rows[np.arange(k), np.abs(rows).argmax(1)])[:, None]
    return Components(mean, rows, values[:k] / (values.sum() or 1.0))


# k-means


@dataclass(frozen=True)
class Fit:
    """The best of several starts: centers, their sizes, and the sum of squared distances to them."""

    k: int
    centers: np.ndarray
    sizes: np.ndarray
    inertia: float


def _seeded(sample: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """``k`` of the sampled vectors, each drawn by its squared distance to those before."""
    chosen = [sample[r.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = far.sum()
        chosen.append(sample[r.choice(len(sample), p=far / total) if total > 0 else r.integers(len(sample))])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest center, the first on a tie, and the squared distance."""
    far = ((x * x).sum(1)[:, None] - 2 * x @ centers.T) + (centers * centers).sum(1)
    at = far.argmin(1)
    return at, ((x - centers[at]) ** 2).sum(1)


def _sums(models: list[np.ndarray]):
    """For every model the sums and numbers of the rows nearest to each center and the models' sums of squares, a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [np.zeros((len(c), c.shape[1] + 1)) for c in models]
        squares, seen = np.zeros(len(models)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            x, seen = _matrix(batch.column(0)), True
            ones = np.column_stack([x, np.ones(len(x))])
            for i, centers in enumerate(models):
                at, far = _nearest(x, centers)
                total[i] += (at[:, None] == np.arange(len(centers))).astype(float).T @ ones
                squares[i] += far.sum()
        if seen:
            flat = np.concatenate([squares, *(t.reshape(-1) for t in total)])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["bucket", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            total = np.frombuffer(raw) if total is None else total + np.frombuffer(raw)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "sums"])


def kmeans(df: DataFrame, vector: str, ks: Sequence[int], starts: int = 10, rounds: int = 30, tolerance: float = 1e-4, seed: int = 42, sample: int = 4096) -> tuple[list[Fit], int]:
    """For each number in ``ks`` the best of ``starts`` fits by Lloyd's rounds, and the passes over the data that all of them took.

    All numbers and starts are fitted together: each round is one pass that sends the stacked centers to the tasks and adds up their sums by
    tree; the vectors alone are stored for that. Starts are drawn from a sample of about ``sample`` vectors, which is also the most that the driver sees of the data; fits see all rows. A
    center that no row is nearest to stays. Rounds end when no center moves by more than ``tolerance`` times the spread of the sample.
    """
    rows, path = derived.stored(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")), "vectors")
    n = rows.count()
    if not n:
        raise ValueError("no vectors")
    drawn = rows if n <= sample else rows.where(F.rand(seed) < sample / n)
    x = np.array([r.v for r in drawn.limit(4 * sample).collect()])
    x = x[np.lexsort(x.T[::-1])]  # the same starts whatever the order of rows
    models = [_seeded(x, k, np.random.default_rng((seed, k, s))) for k in ks for s in range(starts)]
    spread, passes, width = float(x.std()) or 1.0, 0, x.shape[1]

    def one_pass(centers: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = rows.mapInArrow(_sums(centers), "bucket int, sums binary").repartition("bucket").mapInArrow(_added, "bucket int, sums binary")
        flat = np.frombuffer(parts.repartition(1).mapInArrow(_added, "bucket int, sums binary").first()["sums"])
        ends = np.cumsum([len(centers), *(len(c) * (width + 1) for c in centers)])
        return flat[: ends[0]], [flat[a:b].reshape(-1, width + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    while True:
        squares, sums = one_pass(models)
        passes += 1
        moved = [np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), c) for s, c in zip(sums, models, strict=True)]
        if passes > rounds or max(float(np.abs(a - b).max()) for a, b in zip(moved, models, strict=True)) <= tolerance * spread:
            break  # the sums of squares belong to the centers that were sent
        models = moved
    derived.delete(df.sparkSession, path)
    best = []
    for i, k in enumerate(ks):
        at = min(range(i * starts, (i + 1) * starts), key=lambda m: (squares[m], m))
        best.append(Fit(k, models[at], sums[at][:, -1].astype(int), float(squares[at])))
    return best, passes


def assigned(df: DataFrame, vector: str, fits: Sequence[Fit]) -> DataFrame:
    """``df`` with ``topics`` and ``distances``, of each fit the number of the nearest center from 0 and how far it is, in the order of ``fits``."""
    models = [f.centers for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = [_nearest(_matrix(batch.column(vector)), c) for c in models]
                lists = [pa.array(list(np.column_stack([x[k] for x in near])), t) for k, t in ((0, pa.list_(pa.int32())),)]
                lists.append(pa.array(list(np.sqrt(np.column_stack([x[1] for x in near]))), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "topics", "distances"])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType().add("topics", ArrayType(IntegerType())).add("distances", ArrayType(DoubleType())).fields]))


# centers that go on learning


CENTERS = "topic int, center array<double>, n double"


def as_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """A fit's centers as ``topic, center, n``: a row a topic."""
    return spark.createDataFrame([(i, c.tolist(), float(n)) for i, (c, n) in enumerate(zip(fit.centers, fit.sizes, strict=True))], CENTERS)


def nearest(rows: DataFrame, centers: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows`` with ``topic`` and ``distance`` of the nearest center, the smaller number on a tie. Centers are few and travel as one row."""
    one = centers.agg(F.collect_list(F.struct("topic", "center")).alias("_centers"))
    far = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(far(c["center"]).alias("distance"), c["topic"].alias("topic"))))
    return rows.where(F.col(vector).isNotNull()).join(F.broadcast(one)).withColumn("_b", best).withColumns({"topic": F.col("_b.topic"), "distance": F.col("_b.distance")}).drop("_b", "_centers")


def partial_fit(centers: DataFrame, rows: DataFrame, vector: str = "vector") -> DataFrame:
    """The centers after a batch: each moves to the mean of the rows it has had, of which it keeps the number, and the new ones nearest to it."""
    new = nearest(rows, centers, vector).groupBy("topic").agg(mean_vector(F.col(vector)).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_n"))
    n = F.coalesce("_n", F.lit(0.0))
    moved = F.zip_with("center", "_mean", lambda c, m: (c * F.col("n") + m * n) / (F.col("n") + n))
    return centers.join(new, "topic", "left").select("topic", F.when(n > 0, moved).otherwise(F.col("center")).alias("center"), (F.col("n") + n).alias("n"))
