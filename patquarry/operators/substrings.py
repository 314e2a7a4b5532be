"""An index of trigrams for keywords that may stand anywhere in a search term."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patquarry.sources import derived

#: A keyword meets the postings of so many of its trigrams, the rarest.
RAREST = 3
#: Rows of an index that a task groups, whatever the size of the index.
ROWS_A_TASK = 1_000_000
#: Keywords whose bits a number holds.
BITS = 62


def pattern(keyword: str) -> str:
    """The pattern of a keyword: lower case, single spaces; % and _ stay wildcards."""
    return f"%{' '.join(keyword.lower().split())}%"


def grams(keyword: str) -> list[str]:
    """The trigrams that every term with the keyword has: those of its parts between wildcards and escapes."""
    parts = re.split(r"[%_\\]", pattern(keyword))
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


@dataclass(frozen=True)
class Index:
    """Stored tables: ``lookups`` (id, lookup), ``postings`` (gram, id) in the order of grams, ``frequencies`` (gram, n), ``terms`` (id, patent_id).

    Postings and terms may have a row twice."""

    lookups: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    terms: DataFrame


def build(terms: DataFrame, path: str) -> None:
    """Write the index of search terms (``patent_id, lookup``, also several times) to a folder.

    A lookup text is indexed once, however many patents have it; ids are 64-bit hashes, so texts that share one are both looked at, and found by
    their text. Tables are in the order of what they are looked up by, so a reader skips the row groups of other grams and ids. The terms are
    computed once and stored; every table is made from stored rows."""
    spark = terms.sparkSession
    rows, temporary = derived.stored(terms.where("lookup is not null").select("patent_id", "lookup", F.xxhash64("lookup").alias("id")), "search-terms")
    rows.select("id", "lookup").distinct().repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/lookups")
    rows.select("id", "patent_id").repartitionByRange("id", "patent_id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/terms")
    derived.delete(spark, temporary)
    letters = F.transform(F.sequence(F.lit(1), F.length("lookup") - 2), lambda i: F.substring("lookup", i, F.lit(3)))
    posted = spark.read.parquet(f"{path}/lookups").where(F.length("lookup") >= 3).select(F.explode(F.array_distinct(letters)).alias("gram"), "id")
    posted.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/frequencies")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("lookups", "postings", "frequencies", "terms")))


def chosen(index: Index, keywords: Sequence[str], rarest: int = RAREST) -> dict[str, list[str] | None]:
    """Of each keyword the rarest trigrams, by one lookup of all keywords' frequencies; none if a trigram stands nowhere, None if it has none."""
    every = sorted({g for k in keywords for g in grams(k)})
    n = {r.gram: r.n for r in index.frequencies.where(F.col("gram").isin(every)).collect()} if every else {}  # a row a gram of the keywords
    out: dict[str, list[str] | None] = {}
    for k in keywords:
        own = grams(k)
        out[k] = None if not own else sorted(own, key=lambda g: (n.get(g, 0), g))[:rarest] if all(g in n for g in own) else []
    return out


def _parts(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` dealt out by a key to as many tasks as ``rows`` ask for: a number that grows with the index, so a task's memory does not."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), key)


def _bits(places: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Keywords with their bits, as many as a number holds in a list."""
    pairs = list(places.items())
    return [[(k, 1 << (i % BITS)) for k, i in pairs[at : at + BITS]] for at in range(0, len(pairs), BITS)]


def _masks(index: Index, keywords: Sequence[str], rarest: int) -> DataFrame:
    """``id, m0, m1, ..``: the lookups that have the rarest trigrams of a keyword, a row each, with the bits of those keywords.

    A lookup's trigrams are gathered as bits too: those of all keywords' rarest trigrams that it has."""
    spark, picked = index.lookups.sparkSession, chosen(index, keywords, rarest)
    asked = {g: i for i, g in enumerate(sorted({g for gs in picked.values() for g in gs or ()}))}
    words = _bits({k: i for i, k in enumerate(picked)})
    grams_ = [F.bit_or(F.when(F.col("part") == at, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"g{at}") for at in range(-(-len(asked) // BITS))]
    if grams_:
        table = F.broadcast(spark.createDataFrame([(g, i // BITS, 1 << (i % BITS)) for g, i in asked.items()], "gram string, part int, bit long"))  # a few rows a keyword
        met = index.postings.where(F.col("gram").isin(list(asked))).join(table, "gram")
        n = sum(r.n for r in index.frequencies.where(F.col("gram").isin(list(asked))).collect())  # a row a gram of the keywords
        met = _parts(met, n, "id").groupBy("id").agg(*grams_)
    else:
        met = spark.createDataFrame([], "id long")

    def needs(k: str) -> Column:
        gs = picked[k]
        if not gs:
            return F.lit(gs is None)
        bits: dict[int, int] = {}
        for g in gs:
            bits[asked[g] // BITS] = bits.get(asked[g] // BITS, 0) | 1 << (asked[g] % BITS)
        return reduce(Column.__and__, [F.col(f"g{at}").bitwiseAND(F.lit(b).cast("long")) == b for at, b in bits.items()])

    def masks(test: Callable[[str], Column]) -> list[Column]:
        none = F.lit(0).cast("long")
        return [reduce(Column.bitwiseOR, [F.when(test(k), F.lit(b).cast("long")).otherwise(none) for k, b in part]).alias(f"m{at}") for at, part in enumerate(words)]

    some = [F.col(f"m{at}") != 0 for at in range(len(words))]
    if any(gs is None for gs in picked.values()):  # all lookups are looked at
        met = index.lookups.select("id").join(met, "id", "left").na.fill(0)
    return met.select("id", *masks(needs)).where(reduce(Column.__or__, some)) if some else met.select("id")


def candidates(index: Index, keywords: Sequence[str], rarest: int = RAREST) -> DataFrame:
    """``keyword, id``: the lookups that have a keyword's rarest trigrams; for a keyword without a trigram all of them."""
    return _named(_masks(index, keywords, rarest), keywords, "id")


def _named(masked: DataFrame, keywords: Sequence[str], column: str) -> DataFrame:
    """``keyword, column``: a row a bit."""
    words = _bits({k: i for i, k in enumerate(dict.fromkeys(keywords))})
    found = [F.when(F.col(f"m{at}").bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(k)) for at, part in enumerate(words) for k, b in part]
    return masked.select(F.explode(F.array(*found)).alias("keyword"), column).where("keyword is not null") if found else masked.select(F.lit("").alias("keyword"), column).where("false")


def matches(index: Index, keywords: Sequence[str], rarest: int = RAREST) -> DataFrame:
    """``keyword, patent_id``, each once: the patents that have a term with a keyword, as a full scan by ``like`` finds them.

    ``keywords`` is a list that a user gives; a keyword that ``like`` refuses (an escape before another letter) raises. A blank one finds all that
    have a term. Only texts that have the rarest trigrams are compared; a keyword of less than three letters between wildcards scans them all.
    Keywords are bits of numbers up to the end, so a lookup and a patent are a row each, not one a keyword."""
    words = _bits({k: i for i, k in enumerate(dict.fromkeys(keywords))})
    if not words:
        return index.terms.select(F.lit("").alias("keyword"), "patent_id").where("false")
    rows = _masks(index, [k for part in words for k, _ in part], rarest).join(index.lookups, "id")
    none = F.lit(0).cast("long")
    liked = [reduce(Column.bitwiseOR, [F.when((F.col(f"m{at}").bitwiseAND(F.lit(b).cast("long")) != 0) & F.col("lookup").like(pattern(k)), F.lit(b).cast("long")).otherwise(none) for k, b in part]).alias(f"m{at}") for at, part in enumerate(words)]
    rows = rows.select("id", *liked).where(reduce(Column.__or__, [F.col(f"m{at}") != 0 for at in range(len(words))]))
    n = index.terms.count()
    every = [F.bit_or(f"m{at}").alias(f"m{at}") for at in range(len(words))]
    found = _parts(index.terms.join(rows, "id").drop("id"), n, "patent_id").groupBy("patent_id").agg(*every)
    return _named(found, [k for part in words for k, _ in part], "patent_id")


def scanned(index: Index, keywords: Sequence[str], rarest: int = RAREST) -> DataFrame:
    """``keyword, scanned, share``: how many lookups are compared for each keyword, and of all what share."""
    whole = index.lookups.agg(F.count(F.lit(1)).alias("_all"))
    asked = index.lookups.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keywords)], "keyword string")
    n = candidates(index, list(dict.fromkeys(keywords)), rarest).groupBy("keyword").agg(F.count(F.lit(1)).alias("scanned"))
    return asked.join(n, "keyword", "left").join(F.broadcast(whole)).select("keyword", F.coalesce("scanned", F.lit(0)).alias("scanned"), (F.coalesce("scanned", F.lit(0)) / F.col("_all")).alias("share"))
