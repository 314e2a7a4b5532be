"""A hierarchy of topics from what they say, and the pairs in it that are worth merging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from patquarry.sources import derived


def distances(weights: DataFrame, topic: str = "topic") -> DataFrame:
    """``a, b, distance`` with a < b: one less the cosine of two topics' term weights (``topic, term, weight``); 1 where they share no term."""
    return between(weights.groupBy("term").agg(F.collect_list(F.struct(topic, "weight")).alias("w")), topic)


def between(lists: DataFrame, topic: str = "topic") -> DataFrame:
    """``distances`` of terms that come once each, ``term, w``, with an array of ``topic, weight``.

    Topics are few, so a term has a few of them; one pass sums products by pair before the shuffle, a topic's own among them."""
    rows = lists.select(F.filter("w", lambda x: x["weight"] != 0).alias("w"))
    pairs = rows.select(F.explode("w").alias("x"), "w").select("x", F.explode("w").alias("y")).where(F.col(f"x.{topic}") <= F.col(f"y.{topic}"))
    dots = pairs.groupBy(F.col(f"x.{topic}").alias("a"), F.col(f"y.{topic}").alias("b")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("dot"))
    dots, _ = derived.stored(dots, "dots")  # a row a pair of topics
    side = lambda c: dots.where("a = b").select(F.col("a").alias(c), F.sqrt("dot").alias(f"n{c}"))
    every = side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b"))  # a row a pair of topics
    cosine = F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))
    return every.join(dots, ["a", "b"], "left").select("a", "b", F.greatest(F.lit(0.0), 1 - cosine).alias("distance"))


@dataclass(frozen=True)
class Node:
    """A merge: the topics below it, and the distance of the two parts."""

    topics: tuple
    distance: float


def linkage(names: Sequence, far: np.ndarray) -> list[Node]:
    """Ward's agglomerative linkage of a symmetric matrix of distances, by chains of nearest neighbors; nodes by distance.

    A chain goes from a cluster to its nearest one (the previous of the chain on a tie, else the one with the smallest first name) until two
    are nearest to each other; these merge and the chain goes on before them. Takes n ** 2 steps."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    far = np.array(far, float)[np.ix_(order, order)]
    below = {i: (names[o],) for i, o in enumerate(order)}
    np.fill_diagonal(far, np.inf)
    chain: list[int] = []
    out = []
    while len(below) > 1:
        if not chain:
            chain = [min(below)]
        at = chain[-1]
        others = [i for i in below if i != at]
        near = min(others, key=lambda i: (far[at, i], len(chain) < 2 or i != chain[-2], i))
        if len(chain) > 1 and near == chain[-2]:
            a, b = sorted((at, near))
            na, nb, d = len(below[a]), len(below[b]), far[a, b]
            out.append(Node(tuple(sorted(below[a] + below[b])), float(d)))
            for k in below:
                if k not in (a, b):
                    nk = len(below[k])
                    far[a, k] = far[k, a] = np.sqrt(max(0.0, ((na + nk) * far[a, k] ** 2 + (nb + nk) * far[b, k] ** 2 - nk * d**2) / (na + nb + nk)))
            below[a] += below.pop(b)
            chain = chain[:-2]
        else:
            chain.append(near)
    return sorted(out, key=lambda x: (x.distance, x.topics))


def hierarchy(weights: DataFrame, topic: str = "topic") -> list[Node]:
    """The merges of all topics that have terms; the driver gets a row a pair of topics. ``weights``: as ``distances`` or ``between`` take them."""
    rows = (between if "w" in weights.columns else distances)(weights, topic).collect()
    names = sorted({x for r in rows for x in (r.a, r.b)})
    at, far = {x: i for i, x in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        far[at[r.a], at[r.b]] = far[at[r.b], at[r.a]] = r.distance
    return linkage(names, far)


NODES = "node int, topics array<int>, distance double"


def as_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    """``node`` (from 1, by distance), ``topics`` below it, ``distance``: a row less than there are topics."""
    return spark.createDataFrame([(i, [int(t) for t in n.topics], n.distance) for i, n in enumerate(nodes, 1)], NODES)


def merge_suggestions(nodes: DataFrame, active: DataFrame, most: int = 8) -> DataFrame:
    """``rank, topic_codes, labels, distance``: the ``most`` nearest nodes whose topics are exactly two of the active ones.

    ``active``: topic, topic_code, label; a topic of the model that was merged into another has that one's code. Topics that are no
    longer active do not count. A missing label is the code."""
    rows = nodes.select("node", "distance", F.explode("topics").alias("topic")).join(F.broadcast(active.select("topic", "topic_code", F.coalesce("label", "topic_code").alias("label"))), "topic")
    codes = rows.groupBy("node", "distance").agg(F.array_sort(F.collect_set(F.struct("topic_code", "label"))).alias("two")).where(F.size("two") == 2)
    rank = F.row_number().over(Window.orderBy("distance", "node"))  # a row a node
    return codes.withColumn("rank", rank).where(F.col("rank") <= most).select("rank", F.col("two.topic_code").alias("topic_codes"), F.col("two.label").alias("labels"), "distance")
