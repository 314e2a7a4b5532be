"""A sieve of bounded size for keys: which rows certainly have none of a set of keys, so that only the others are shuffled.

The keys' hashes set bits of a table of ``BITS`` bits, whatever their number. A row whose bit is not set has none of the keys; of the others an exact
join decides. With more keys than bits the sieve lets all rows through, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patquarry.llm import scratch

#: Bits of the table: 4 MB, or a row for each of at most 524,288 words that have a bit, which are broadcast.
BITS = 1 << 25


def _bit(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def table(keys: DataFrame, name: str) -> DataFrame:
    """``word, bits`` of the rows of ``keys``, all of whose columns are the key; stored. At most ``BITS`` / 64 rows."""
    bit = _bit([F.col(c) for c in keys.columns])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("bit"), F.lit(64)).cast("int"))
    return scratch.table(keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")), name)


def sifted(rows: DataFrame, sieve: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of the sieve's keys, and those that have none; null keys are compared like others."""
    bit = _bit([F.col(k) for k in keys])
    words = F.broadcast(sieve.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    marked = rows.withColumn("_bit", bit).join(words, F.shiftright("_bit", 6) == F.col("_word"), "left")
    may = F.coalesce(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1L") == 1, F.lit(False))
    return tuple(marked.where(may if some else ~may).select(rows.columns) for some in (True, False))
