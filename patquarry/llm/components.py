"""Connected components of a graph given as a table of links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patquarry.llm import scratch


#: A class of more copies than this is hot: there is at most one for so many rows, so those few are broadcast.
HOT = 10_000


def with_classes(rows: DataFrame, of: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with the columns of their class; ``of`` has a row a class, with ``copies``, its number of rows. Rows of no class get nulls.

    The copies of one text or vector may be a third of all rows, as may rows without a key: neither meets in one task."""
    hot = F.broadcast(of.where(F.col("copies") > HOT))
    named = rows.where(F.col(key).isNotNull())
    parts = (named.join(hot, key), named.join(hot.select(key), key, "left_anti").join(of.where(F.col("copies") <= HOT), key))
    none = rows.where(F.col(key).isNull())
    return parts[0].unionByName(parts[1]).unionByName(none, allowMissingColumns=True)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while x != r:
            parent[x], x = r, parent.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as stars around the smallest member; memory is bounded by a batch."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        nodes = np.fromiter(forest.parent, np.int64, len(forest.parent))
        roots = np.fromiter(map(forest.root, forest.parent), np.int64, len(nodes))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node that a link joins to another: the smallest node that can be reached.

    Links may repeat, run either way, join a node to itself or have nulls (these are left out). Each turn makes the
    larger neighbors of every node point to its smallest one, then the smaller ones, until nothing changes; a hub's
    minimum is pre-aggregated, and no task holds a component. Turns are tables in the shared folder.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    edges, path = scratch.stored(pairs.mapInArrow(_contract, "u long, v long").distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        edges, path = scratch.stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.delete(links.sparkSession, before)  # the new turn is stored whole
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
