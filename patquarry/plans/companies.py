"""Convergence of company names through codes and confirmed aliases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions.text import blank_to_null, first_part, lookup_key, split_multi_value


def mode_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest on a tie, counted before it is ranked so that a hot key stays small."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def code_names(aliases: DataFrame) -> DataFrame:
    """``code, code_name``: the greatest Chinese name, else the most frequent normalised one, of confirmed rows."""
    rows = aliases.where("review_status = 'confirmed'").select("code", blank_to_null(F.col("name_zh")).alias("zh"), blank_to_null(F.col("name_norm")).alias("norm")).where("zh is not null or norm is not null")
    zh = rows.groupBy("code").agg(F.max("zh").alias("zh"))
    return zh.join(mode_by(rows, "code", "norm", "norm"), "code", "left").select("code", F.coalesce("zh", "norm").alias("code_name"))


def alias_names(aliases: DataFrame) -> DataFrame:
    """``alias_key, alias_name``: of the confirmed aliases of one key the best, with a Chinese name first, then the lowest id."""
    rows = aliases.where("review_status = 'confirmed'").select("alias_id", lookup_key(F.col("alias")).alias("alias_key"), blank_to_null(F.col("name_zh")).alias("zh"), blank_to_null(F.col("name_norm")).alias("norm"))
    rows = rows.where("alias_key is not null and (zh is not null or norm is not null)")
    best = F.min(F.struct(F.col("zh").isNull().alias("no_zh"), "alias_id", F.coalesce("zh", "norm").alias("name")))
    return rows.groupBy("alias_key").agg(best["name"].alias("alias_name"))


def lowest_alias_names(aliases: DataFrame) -> DataFrame:
    """``alias_key, alias_name`` by the lowest id alone."""
    rows = aliases.where("review_status = 'confirmed'").select("alias_id", lookup_key(F.col("alias")).alias("alias_key"), F.coalesce(blank_to_null(F.col("name_zh")), blank_to_null(F.col("name_norm"))).alias("name")).where("alias_key is not null and name is not null")
    return rows.groupBy("alias_key").agg(F.min(F.struct("alias_id", "name"))["name"].alias("alias_name"))


@dataclass(frozen=True)
class Names:
    """What confirmed aliases say, made once for all columns that converge: ``alias_key, alias_name`` by the best and by the lowest row, ``code, code_name``."""

    by_alias: DataFrame
    by_lowest_alias: DataFrame
    by_code: DataFrame

    @classmethod
    def of(cls, aliases: DataFrame) -> Names:
        return cls(alias_names(aliases), lowest_alias_names(aliases), code_names(aliases))


def corpus_names(patents: DataFrame, code: str, std: str, raw: str) -> DataFrame:
    """``code, corpus_name``: the most frequent standardised, else raw, primary name that patents give a code, in one pass over them."""
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), first_part(F.col(std)).alias("name")), F.struct(F.lit(1).alias("kind"), first_part(F.col(raw)).alias("name"))))
    rows = patents.select(blank_to_null(F.col(code)).alias("code"), kinds.alias("k")).select("code", "k.*").where("code is not null and name is not null")
    counts = rows.groupBy("code", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("code").agg(F.min(F.struct("kind", (-F.col("n")).alias("n"), "name"))["name"].alias("corpus_name"))


def converge(patents: DataFrame, names: Names, std: str, raw: str, code: str | None, out: str, corpus: DataFrame | None = None) -> DataFrame:
    """``patents`` with the display name ``out``: by code, by alias of the standardised or raw name, by the corpus, as it stands. ``corpus``: the patents that name codes, by default these."""
    df = patents.withColumn("_std", first_part(F.col(std))).withColumn("_raw", first_part(F.col(raw)))
    for key in ("_std", "_raw") if std != raw else ("_raw",):
        df = df.withColumn("alias_key", lookup_key(F.col(key))).join(names.by_alias.withColumnRenamed("alias_name", f"_by{key}"), "alias_key", "left").drop("alias_key")
    ways = [*(("_by_std",) if std != raw else ()), "_by_raw", "_std", "_raw"]
    if code:
        df = df.withColumn("code", blank_to_null(F.col(code))).join(names.by_code, "code", "left").join(corpus_names(patents if corpus is None else corpus, code, std, raw), "code", "left").drop("code")
        ways = ["code_name", *ways[:-2], "corpus_name", "_std", "_raw"]
    return df.withColumn(out, F.coalesce(*ways)).drop("_std", "_raw", "_by_std", "_by_raw", "code_name", "corpus_name")


def converged(patents: DataFrame, names: Names, std: str, raw: str, code: str | None, out: str) -> DataFrame:
    """``patent_id`` and the display name ``out`` of every patent: each distinct spelling converges once, so only these are joined with names and codes."""
    columns = list(dict.fromkeys(c for c in (std, raw, code) if c))
    spelled = converge(patents.select(*columns).distinct(), names, std, raw, code, out, patents)
    spelled = spelled.select(*[F.col(c).alias(f"_{c}") for c in columns], out)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return patents.select("patent_id", *columns).join(spelled, same, "left").select("patent_id", out)


def applicants(patents: DataFrame, names: Names, raw: str = "applicant_raw") -> DataFrame:
    """``patent_id, applicant_name, applicant_no, is_primary, applicant_display_name``: what ``expand_applicants`` adds, without the other columns."""
    return expand_applicants(patents.select("patent_id", raw), names, raw).drop(raw)


def expand_applicants(patents: DataFrame, names: Names, raw: str = "applicant_raw") -> DataFrame:
    """A row for each applicant of each patent: ``applicant_no`` from 1, ``is_primary`` and ``applicant_display_name``."""
    rows = patents.select("*", F.posexplode(split_multi_value(F.col(raw))).alias("_at", "applicant_name"))
    rows = rows.withColumn("alias_key", lookup_key(F.col("applicant_name"))).join(names.by_lowest_alias, "alias_key", "left")
    return rows.withColumn("applicant_no", F.col("_at") + 1).withColumn("is_primary", F.col("_at") == 0).withColumn("applicant_display_name", F.coalesce("alias_name", "applicant_name")).drop("_at", "alias_key", "alias_name")


def group_names(df: DataFrame, groups: DataFrame, company: str, out: str) -> DataFrame:
    """``df`` with the confirmed group of a company, else the company itself."""
    one = groups.where("review_status = 'confirmed'").select(lookup_key(F.col("company")).alias("_key"), "group_name").groupBy("_key").agg(F.min("group_name").alias("_group"))
    return df.withColumn("_key", lookup_key(F.col(company))).join(one, "_key", "left").withColumn(out, F.coalesce("_group", company)).drop("_key", "_group")


def pending_names(patents: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """Names that no confirmed alias has: ``lookup, name, fields, patents``, over the given columns, split at bars."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    rows = patents.select("patent_id", pairs.alias("p")).select("patent_id", "p.field", F.explode(split_multi_value(F.col("p.value"))).alias("name"))
    rows = rows.withColumn("lookup", lookup_key(F.col("name")))
    known = aliases.where("review_status = 'confirmed'").select(lookup_key(F.col("alias")).alias("lookup")).where("lookup is not null").distinct()
    return rows.join(known, "lookup", "left_anti").groupBy("lookup").agg(F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.count_distinct("patent_id").alias("patents"))
