"""A Merkle manifest of a table: a tree of digests for each language, and one over the languages' roots.

Digests are lowercase hex of SHA-256, hashed as text. The leaves of a tree stand in the order of their ids. Spark cuts them into aligned
blocks of ``FANOUT ** LEVELS`` leaves; a task holds a block as one contiguous numpy matrix of 64 bytes a digest, reshapes it by the
fanout and hashes its rows level by level, and finds every sibling by index arithmetic in the levels' matrices. The blocks' tops are
the leaves of the next round, until a tree has one node. Then the paths above come down again, a row a block.
Whatever the size of a tree, no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.llm import scratch

FANOUT, LEVELS, WIDTH = 8, 3, 64
BLOCK = FANOUT**LEVELS
#: What ``leaf`` hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 bytes' number, a colon and the value, or a dash for a null."""
    return F.sha2(F.concat(*map(_part, fields)).cast("binary"), 256)


def _hex(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, WIDTH)


def levels(leaves: np.ndarray, deep: int) -> list[np.ndarray]:
    """The leaves and ``deep`` levels above them; the last run of a level may be short, even of one node."""
    out = [leaves]
    for _ in range(deep):
        m = np.ascontiguousarray(out[-1])
        full = len(m) // FANOUT * FANOUT
        digests = [sha256(row).hexdigest() for row in m[:full].reshape(-1, FANOUT * WIDTH)]
        if full < len(m):
            digests.append(sha256(m[full:].reshape(-1)).hexdigest())
        out.append(_hex(digests))
    return out


def depth(n: int) -> int:
    """Levels of one block of a tree of ``n`` nodes: all where the tree goes on above it, else until one node is left."""
    if n > BLOCK:
        return LEVELS
    deep, width = 0, 1
    while width < n:
        deep, width = deep + 1, width * FANOUT
    return deep


def siblings(tree: list[np.ndarray], i: int) -> list[str]:
    """The siblings of leaf ``i`` in a block, level by level: those to the left as one text, then those to the right."""
    out = []
    for m in tree[:-1]:
        first = i // FANOUT * FANOUT
        out += [m[first:i].tobytes().decode(), m[i + 1 : first + FANOUT].tobytes().decode()]
        i //= FANOUT
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def proof(path: list[str]) -> str:
    """The digest of all siblings on a path."""
    return sha256("".join(path).encode()).hexdigest()


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the tree from 0, and ``n``, the tree's number of rows.

    One range partitioning by tree and order, so a large tree is dealt over many tasks; places before a partition come from counts.
    """
    by = [tree, *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.table(sorted_.withColumn("_part", F.shiftright("_at", 33)), name)
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select(tree, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    return sorted_.join(parts, [tree, "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _blocks(nodes: DataFrame, more: list[str], name: str) -> DataFrame:
    """A row for each block: ``tree, n, block`` and ``nodes``, its nodes in order with the columns ``more``; stored."""
    row = F.struct("pos", "digest", *more)
    cut = nodes.groupBy("tree", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("nodes"))
    return scratch.table(cut, name)


def _matrix(column: pa.Array, i: int) -> np.ndarray:
    """The digests of block ``i`` of a column of nodes."""
    return _hex(column[i].values.field("digest").to_pylist())


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes = batch.column(3), batch.column(1).to_pylist()
        tops = [levels(_matrix(nodes, i), depth(n))[-1][0].tobytes().decode() for i, n in enumerate(sizes)]
        up = pa.array([-(-n // BLOCK) for n in sizes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), up, batch.column(2), pa.array(tops, pa.string())], names=["tree", "n", "pos", "digest"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, (tree, n, block, above) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
            made = levels(_matrix(batch.column(3), i), depth(n))
            count = len(made[0])
            paths = [siblings(made, k) + above for k in range(count)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * count, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + count), pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=["tree", "pos", "above"])


NODES, PATHS = "tree string, n long, pos long, digest string", "tree string, pos long, above array<string>"


def _keyed(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path above their top."""
    return blocks.join(paths.select("tree", F.col("pos").alias("block"), "above"), ["tree", "block"]).select("tree", "n", "block", "nodes", "above")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, from ``tree, n, pos, digest`` rows, and a row for each tree with its root as ``digest``."""
    rounds = []
    while True:
        most = nodes.agg(F.max("n")).first()[0] or 0  # one number
        if most <= 1:
            return rounds, nodes
        rounds.append(_blocks(nodes, [], f"blocks-{len(rounds)}"))
        nodes = scratch.table(rounds[-1].mapInArrow(_tops, NODES), f"tops-{len(rounds)}")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, pos, above`` of the nodes that ``climb`` was given, from the paths above each tree's root (``pos`` 0)."""
    for blocks in reversed(rounds):
        above = _keyed(blocks, above).mapInArrow(_down, PATHS)
    return above


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a leaf, from blocks with the path above them and the roots."""
    for batch in batches:
        sizes, above, subroots, roots = (batch.column(k).to_pylist() for k in (1, 4, 5, 6))
        for i, n in enumerate(sizes):
            nodes = batch.column(3)[i].values
            made = levels(_matrix(batch.column(3), i), depth(n))
            ids, leaves, now = (nodes.field(x) for x in ("doc_id", "digest", "now"))
            paths = [siblings(made, k) + above[i] for k in range(len(ids))]
            folded = [fold(d, p) for d, p in zip(now.to_pylist(), paths, strict=True)]
            same = [len(ids) * [x] for x in (subroots[i], roots[i])]
            yield pa.RecordBatch.from_arrays(
                [ids, leaves, *(pa.array(x, pa.string()) for x in same), pa.array(map(proof, paths), pa.string()), pa.array(folded, pa.string()), pa.array([x == roots[i] for x in folded], pa.bool_())], names=[c.split()[0] for c in OUT.split(", ")]
            )


def manifest(df: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """A proof for every row of a table of documents, checked against a digest that the row has now.

    ``now`` is the ``digest`` column's table: as ``df``, but with ``now``, the digest to verify; without it rows are verified as they are.
    Returns ``doc_id, leaf, subroot`` (of the row's language), ``root, proof_sha256`` (of the siblings up to the root), ``folded_root`` (from
    the digest ``now`` and the siblings) and ``verified``.

    Leaves of a language stand by ``doc_id``, null ids first, and rows that repeat an id by their digest, so equal rows may change places
    and nothing else. Null fields are dashes; rows without a language are a tree of their own, before the others. An empty table gives
    an empty result; other columns are not read. Texts are hashed where they are read: shuffles carry ids and digests.
    """
    rows = df if now is None else now
    fields = [F.col(c) for c in FIELDS]
    digest = leaf(fields)
    rows = rows.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        digest.alias("digest"), (digest if now is None else F.col("now")).alias("now"),
    )
    leaves = ranked(rows, "tree", ["doc_id", "digest", "now"], "leaves")
    first = _blocks(leaves, ["doc_id", "now"], "leaf-blocks")
    rounds, subroots = climb(scratch.table(first.mapInArrow(_tops, NODES), "tops"))
    subroots = scratch.table(subroots.select("tree", F.col("digest").alias("subroot")), "subroots")
    # the languages' roots are the leaves of a last tree
    trees = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("digest")), "tree", ["of"], "trees")
    trees = scratch.table(trees, "ranked-trees")
    last, root = climb(trees.select("tree", "n", "pos", "digest"))
    over = descend(last, root.select("tree", "pos", F.array().cast("array<string>").alias("above")))
    over = trees.join(over, ["tree", "pos"]).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "above")
    paths = descend(rounds, over)
    tops = subroots.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    return _keyed(first, paths).join(tops, "tree").select("tree", "n", "block", "nodes", "above", "subroot", "root").mapInArrow(_proved, OUT)


def tampered(df: DataFrame) -> DataFrame:
    """``df`` with ``now``: the digest after the texts of the rows whose id's checksum 3 divides have lost their capitals A-Z.

    A row without an id, whose checksum is that of nothing, is among them; a null text stays null.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    changed = [F.when(hit, lowered).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    return df.withColumn("now", leaf(changed))


#: The same rows from SQL: whole levels as lists; siblings by slices.
ORACLE = r"""
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from (select unnest(range(256)) as i)
  )
), docs as (
  select row_number() over () as r, doc_id, lang, text, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda s: ascii(s)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as h
  from documents, crc
), changed as (
  select *, case when h % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as text_now from docs
), leaves as (
  select r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(text_now) || ':' || text_now, '-')) as now from changed
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, now) - 1 as pos from leaves
), up(lang, level, nodes) as (
  select lang, 0, list(leaf order by pos) from placed group by lang
  union all
  select lang, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], ''))) from up where len(nodes) > 1
), subroots as (
  select lang, nodes[1] as subroot, row_number() over (order by encode(lang) nulls first) - 1 as tree from up where len(nodes) = 1
), top(level, nodes) as (
  select 0, list(subroot order by tree) from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], ''))) from top where len(nodes) > 1
), root as (
  select nodes[1] as root from top where len(nodes) = 1
), sides as (
  select r, level, nodes, (pos // (8 ** level)::bigint)::bigint as i, pos as p from placed join up on placed.lang is not distinct from up.lang where len(nodes) > 1
  union all
  select r, 1000 + level, nodes, (tree // (8 ** level)::bigint)::bigint, tree from placed join subroots on placed.lang is not distinct from subroots.lang, top where len(nodes) > 1
), paths as (
  select r, list(struct_pack(a := array_to_string(nodes[i // 8 * 8 + 1:i], ''), b := array_to_string(nodes[i + 2:i // 8 * 8 + 8], '')) order by level) as path from sides group by r
), folds(r, k, digest) as (
  select r, 0, now from leaves
  union all
  select f.r, k + 1, sha256(path[k + 1].a || digest || path[k + 1].b) from folds f join paths p on f.r = p.r where k < len(path)
), ends as (
  select r, last(digest order by k) as folded_root from folds group by r
)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) as proof_sha256, folded_root, folded_root = root as verified
from placed join subroots on placed.lang is not distinct from subroots.lang join ends using (r) left join paths using (r), root
"""
