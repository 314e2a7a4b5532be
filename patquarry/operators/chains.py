"""Pointers followed to their ends by doubling, with a stored frontier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from patquarry.sources import derived

#: A rank that nothing has.
NONE = 9


def follow(links: DataFrame, keys: Sequence[str], node: str, to: str, rank: str | None = None) -> DataFrame:
    """``keys, node, at, up, low, ended, missing`` and, if given, ``rank``: where the pointers from each node lead.

    ``links`` has a row a node: ``to`` names the next node of the same keys, null at an end; ``rank`` is a small number. ``ended``: the chain comes
    to an end; then ``at`` is that last node. Else it runs into a cycle, of which ``low`` is the smallest node, or to a node that is not there, ``at``.
    ``up``: the least rank of the nodes after this one.

    A round doubles how far every open chain has been followed, so a chain of n takes about log2(n) rounds; chains that have ended stay
    as they were stored. Rounds end when none ends any more and no cycle's smallest node changes. Each round's plan is one join."""
    spark, keys = links.sparkSession, list(keys)
    row = links.select(*keys, node, F.col(to).alias("at"), (F.col(rank) if rank else F.lit(NONE)).cast("int").alias("rank"))
    # last: the last node seen; low: the smallest node from this one to before at
    row = row.withColumns({"up": F.lit(NONE), "low": F.col(node), "last": F.col(node), "missing": F.lit(False)})
    open_, path = derived.stored(row, "chains-0")
    done, paths, before = [open_.where("at is null")], [path], None
    open_ = open_.where("at is not null")
    for turn in range(1, 200):
        ahead = reduce(DataFrame.unionByName, [*done, open_])
        ahead = ahead.select(*keys, F.col(node).alias("at"), F.col("at").alias("_at"), F.least("rank", "up").alias("_up"), F.col("low").alias("_low"), F.col("last").alias("_last"), F.col("missing").alias("_missing"), F.lit(True).alias("_there"))
        met = open_.where("not missing").join(ahead, [*keys, "at"], "left")
        there = F.col("_there").isNotNull()
        step = met.select(
            *keys, node, F.when(there, F.col("_at")).otherwise(F.col("at")).alias("at"), "rank", F.least("up", F.coalesce("_up", F.lit(NONE))).alias("up"), F.least("low", F.coalesce("_low", "low")).alias("low"),
            F.coalesce("_last", "last").alias("last"), (~there | F.coalesce("_missing", F.lit(False))).alias("missing"),
        )
        step, path = derived.stored(step, f"chains-{turn}")
        paths.append(path)
        done.append(step.where("at is null or missing"))
        open_ = step.where("at is not null and not missing")
        state = tuple(open_.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(low, at is null))"), F.expr(f"bit_xor(xxhash64({', '.join([*keys, node])}, low))")).first())
        if not state[0] or state == before:
            break
        before = state
    # what is left runs into cycles: the smallest node of the cycle is that of the node reached on it
    reached = open_.select(*keys, F.col(node).alias("at"), F.col("low").alias("_low"))
    cyclic = open_.join(reached, [*keys, "at"], "left").withColumn("low", F.coalesce("_low", "low")).drop("_low")
    out = reduce(DataFrame.unionByName, [*done, cyclic])
    ended = F.col("at").isNull()
    out, _ = derived.stored(out.select(*keys, node, F.when(ended, F.col("last")).otherwise(F.col("at")).alias("at"), "up", "low", ended.alias("ended"), "missing", *([F.col("rank").alias(rank)] if rank else [])), "chains")
    for p in paths:
        derived.delete(spark, p)
    return out
