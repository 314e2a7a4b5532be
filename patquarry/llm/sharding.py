"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A stable key and the number of shards alone decide the shard. Adding a shard moves about one key in
``shards + 1``, and only into the new shard. No ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.llm import scratch

#: The multiplier of the published algorithm's 64-bit generator, as two halves of 32 bits (a fixed value).
_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF
_M16, _M32 = 0xFFFF, 0xFFFFFFFF
#: A key jumps about ln(shards) times; the chance of more jumps than this is below 1e-60 for 1e9 shards.
MAX_JUMPS = 160


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator modulo 2**64 on halves, so that no product passes 2**63 (ANSI arithmetic)."""
    p0 = low.bitwiseAND(F.lit(_M16)) * F.lit(_LOW)
    t = F.shiftright(low, 16) * F.lit(_LOW) + F.shiftright(p0, 16)
    new_low = F.shiftleft(t.bitwiseAND(F.lit(_M16)), 16) + p0.bitwiseAND(F.lit(_M16)) + F.lit(1)
    carry = F.shiftright(t, 16) + F.shiftright(new_low, 32)
    by_low = F.shiftleft((F.shiftright(high, 16) * F.lit(_LOW)).bitwiseAND(F.lit(_M16)), 16) + high.bitwiseAND(F.lit(_M16)) * F.lit(_LOW)
    by_high = F.shiftleft((F.shiftright(low, 16) * F.lit(_HIGH)).bitwiseAND(F.lit(_M16)), 16) + low.bitwiseAND(F.lit(_M16)) * F.lit(_HIGH)
    return (carry + by_low + by_high).bitwiseAND(F.lit(_M32)), new_low.bitwiseAND(F.lit(_M32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards`` - 1, of a 64-bit integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_M32)).alias("low"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        # the top 31 bits of the generator's state
        j = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    return F.aggregate(steps, start, jump, lambda s: s["b"]).cast("int")


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard and give it a place there.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``size`` is the text's UTF-8 bytes
    plus 16, ``slot`` counts from 0 without gaps in each shard in the order of the key (nulls first, then by
    checksum and size), ``grown_shard`` is the shard among ``shards`` + 1.

    A null text counts as empty; a null key hashes as 0; rows that repeat a key share its shard, each with a
    slot of its own; other columns are not read. An empty table gives an empty result. Places come from one range
    partitioning by shard and key, which also spreads the rows of one hot key, and from counts for each
    partition, never from one task for a shard.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"), jump_hash(F.col(key), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"),
    )
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(placed.withColumn("_part", F.shiftright("_at", 33)), "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(first.select("shard", "_part", "_first", "_before"), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("slot"), "grown_shard"
    )


#: The same rows from SQL, checksum and generator included; ``n`` is the number of shards.
ORACLE = """
with recursive docs as (
  select doc_id, coalesce(text, '') as text, row_number() over () as r from documents
), jumps(r, n, k, b, j) as (
  select r, n, coalesce(doc_id, 0)::hugeint, -1::bigint, 0::bigint from docs, (values (%(n)d), (%(n)d + 1)) as s(n)
  union all
  select r, n, k2, j, floor((j + 1) * (2147483648.0::double / ((k2 >> 33) + 1)::double))::bigint
  from (select r, n, j, (k * 2862933555777941757 + 1) %% 18446744073709551616::hugeint as k2 from jumps where j < n)
), ends as (
  select r, n, b from jumps where j >= n
), rows as (
  select d.r, d.doc_id, (octet_length(encode(d.text)) + 16)::bigint as size, a.b::int as shard, g.b::int as grown_shard
  from docs d join ends a on a.r = d.r and a.n = %(n)d join ends g on g.r = d.r and g.n = %(n)d + 1
), crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from (select unnest(range(256)) as i)
  )
), bytes as (
  select r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: (instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1) as b from docs
), sums as (
  select r, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as text_crc32 from bytes, crc
)
select doc_id, size, text_crc32, shard, grown_shard, 'key' as law, row_number() over (partition by shard order by doc_id) - 1 as slot from rows join sums using (r)
"""
