"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors form a class, so copies are compared once. The signs of a class's products with a table's random
hyperplanes are its key there; classes of one key are a bucket. Two passes over the buckets keep vectors out of the
shuffle until they are needed:

1. Buckets get the classes' packed signs alone. The share of signs in which two classes differ estimates their angle, and pairs
   whose angle is clearly too wide are dropped. A pair counts in its first shared table only.
2. Only classes with a pair left get their vectors, in the buckets where it counts, and all pairs there
   are compared exactly, by blocks of a matrix product. A bucket gives each class's number of links and a
   spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patquarry.llm import scratch
from patquarry.llm.components import Forest, connected, with_classes
from patquarry.llm.runs import grouped
from patquarry.llm.vectors import binary, digests, dimension, matrix, prepare, raw, stored_kind, units

#: The chance that a pair at the threshold shares no table, that of dropping it by its signs, the classes wanted in a bucket, and
#: those of a block. Signs kept of a class at the least, so that they tell angles well. A larger bucket is dealt out in pairs of blocks, and its classes are spread over so many salts.
MISS, SIGN_MISS, WANTED, BLOCK, SIGNS, SALTS = 1e-4, 1e-7, 1024, 1024, 256, 64


def layout(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors: keys grow with log n, tables make up for it."""
    bits = max(6, min(40, ceil(log2(max(n, 1) / WANTED + 1))))
    alike = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(miss) / log(1 - alike)))


def most_different(signs: int, threshold: float, miss: float = SIGN_MISS) -> int:
    """The fewest differing signs that a pair at the threshold exceeds with a chance below ``miss``."""
    p, left = acos(threshold) / pi, 1.0
    for k in range(signs + 1):
        left -= comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if left < miss:
            return k
    return signs


def _signed(planes: np.ndarray, kind: str):
    """The packed signs and the key of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), digests(v), binary(np.packbits(units(v) @ planes > 0, axis=1)), binary(v.astype(kind))], names=["vec_id", "key", "signs", "v"]
                )

    return run


def _unpacked(packed: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs as rows of 0 and 1, and each table's key."""
    signs = np.unpackbits(packed, axis=1, count=max(SIGNS, bits * tables))
    return signs, signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _placed(bits: int, tables: int):
    """A row for each class and table: the bucket, which has the table's number above the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, keys = _unpacked(raw(batch.column(1), "u1"), bits, tables)
                bucket = keys + (np.arange(tables, dtype=np.int64) << bits)
                of = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), batch.column(0).take(of), batch.column(1).take(of)], names=["bucket", "key", "signs"])

    return run


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a run's two blocks, and whether they are one block."""
    pair, block = group.column(1)[0].as_py(), group.column(2).to_numpy()
    same = pair >> 31 == pair & 0x7FFFFFFF
    left = np.nonzero(block == pair >> 31)[0]
    return left, left if same else np.nonzero(block == pair & 0x7FFFFFFF)[0], same


def _first(keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose first shared table is this one."""
    if not len(i):
        return i, j
    keep = np.concatenate([np.argmax(keys[i[s : s + 65_536]] == keys[j[s : s + 65_536]], 1) for s in range(0, len(i), 65_536)]) == table
    return i[keep], j[keep]


def _candidates(bits: int, tables: int, most: int):
    """The rows of each run that have a pair whose signs differ in ``most`` places or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            if group.num_rows < 2:
                continue
            left, right, same = _sides(group)
            if not len(left) or not len(right):
                continue
            signs, keys = _unpacked(raw(group.column(4), "u1"), bits, tables)
            s = signs.astype(np.float32) * 2 - 1
            i, j = np.nonzero(s[left] @ s[right].T >= s.shape[1] - 2 * most - 0.5)
            i, j = left[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            i, j = _first(keys, i, j, group.column(0)[0].as_py() >> bits)
            if len(i):
                yield group.take(pa.array(np.union1d(i, j)))

    return run


def _compare(bits: int, tables: int, threshold: float, kind: str):
    """Counts (a, null, n) and forest links (a, b, 0) of sorted runs of (bucket, pair of blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            left, right, same = _sides(group)
            if not len(left) or not len(right):
                continue
            _, keys = _unpacked(raw(group.column(4), "u1"), bits, tables)
            rep, copies = group.column(5).to_numpy(), group.column(6).to_numpy()
            unit = units(raw(group.column(7), kind).astype(np.float64))
            i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
            i, j = left[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            i, j = _first(keys, i, j, group.column(0)[0].as_py() >> bits)
            if not len(i):
                continue
            n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
            some = np.nonzero(n)[0]
            forest = Forest()
            tree = [(a, b) for a, b in zip(rep[i].tolist(), rep[j].tolist(), strict=True) if forest.join(a, b)]
            a = [*group.column(3).take(pa.array(some)).to_pylist(), *[None] * len(tree)]
            x = [*[None] * len(some), *(x for x, _ in tree)]
            y = [*[None] * len(some), *(y for _, y in tree)]
            count = [*n[some].astype(np.int64).tolist(), *[0] * len(tree)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(count, pa.int64())], names=["key", "a", "b", "n"])

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", seed: int = 20240602) -> DataFrame:
    """Link vectors whose cosine, in double precision, is ``threshold`` or more.

    Returns ``vec_id, n_links, component_id, kept`` for each row: how many other rows' vectors it is linked with, the
    smallest id that links reach, and whether that is its own.

    Vectors that are null, empty or zero, or have null or non-finite components, link with nothing: 0, their own id,
    kept. A null id has a null component and is kept; its vector takes no part. Rows that repeat an id are one node of
    the graph, each returned. Other columns are not read; an empty table gives an empty result. Vectors of different
    lengths raise. No link below the threshold is ever given; a link at the threshold is missed with a chance of 1e-4.
    Classes are told apart by a hash of 128 bits.
    """
    rows, kind = prepare(df, key, vector), stored_kind(df, vector)
    n, width = dimension(rows.where("ok"))
    bits, tables = layout(n, threshold)
    signs = max(SIGNS, bits * tables)
    planes = np.random.default_rng(seed).standard_normal((width, signs))
    signed = rows.where("ok").select("vec_id", "v").mapInArrow(_signed(planes, kind), "vec_id long, key binary, signs binary, v binary")
    signed = scratch.table(signed, "vector-signs")
    classes = scratch.table(signed.groupBy("key", "signs").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    member = classes.select("key", "signs").mapInArrow(_placed(bits, tables), "bucket long, key binary, signs binary")
    hot = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = scratch.table(hot, "vector-hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    member = member.withColumn("hash", F.xxhash64("key")).withColumn("salt", F.pmod(F.shiftright("hash", 32), F.lit(SALTS)).cast("int"))
    member = member.join(hot, ["bucket", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod("hash", "blocks"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.shiftleft(F.least("block", "other"), 31).bitwiseOR(F.greatest("block", "other"))
    dealt = member.select("bucket", pair.alias("pair"), "block", "key", "signs").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    close = dealt.mapInArrow(_candidates(bits, tables, most_different(signs, threshold)), "bucket long, pair long, block long, key binary, signs binary")
    close = scratch.table(close, "vector-candidates")
    wanted = close.select("key").distinct()
    vectors = signed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    both = close.join(vectors.join(wanted, "key", "left_semi"), "key").select("bucket", "pair", "block", "key", "signs", "rep", "copies", "v")
    both = both.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    found = scratch.table(both.mapInArrow(_compare(bits, tables, threshold, kind), "key binary, a long, b long, n long"), "vector-links")
    counts = found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    components = connected(found.where("b is not null").select("a", "b"))
    of = classes.join(counts, "key", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    linked = with_classes(signed.select("vec_id", "key"), scratch.table(of, "vector-components")).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same rows by comparing all pairs; for small tables.
ORACLE = """
with recursive g as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
), ok as (
  select vec_id, v, sqrt(list_dot_product(v, v)) as norm from g
  where v is not null and len(v) > 0 and not list_bool_or(list_transform(v, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(v, lambda x: x != 0))
), links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id != b.vec_id and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(node, other) as (
  select vec_id, vec_id from embeddings union select r.node, l.b from reach r join links l on r.other = l.a
), comp as (select node, min(other) as component_id from reach group by node)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on c.node = e.vec_id
"""
