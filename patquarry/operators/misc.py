"""Smaller queries of the application: queues, summaries, lookups and validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions.text import blank_to_null, is_filled, lookup_key, loose_key, split_multi_value


def snapshot(base: DataFrame, condition: Column) -> DataFrame:
    """The patents that a filter picks, in order; stored as a table, so of any size."""
    return base.where(condition).select("patent_id").distinct().orderBy("patent_id")


def claim_source(df: DataFrame) -> DataFrame:
    """The text that comparisons read and which column it is from; neither has an error instead."""
    all_, own = blank_to_null(F.col("all_claims")), blank_to_null(F.col("independent_claims"))
    kind = F.when(all_.isNotNull(), "all_claims").when(own.isNotNull(), "independent_claims").otherwise("missing")
    return df.select("patent_id", F.coalesce(all_, own).alias("claims"), kind.alias("claim_source"))


def note_source(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first filled of several texts and its column."""
    texts = [F.when(is_filled(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text"))) for c in columns]
    return df.select("patent_id", F.coalesce(*texts).alias("s")).select("patent_id", "s.field", "s.text").where("text is not null")


def flags(df: DataFrame, **columns: str) -> DataFrame:
    """Whether each named column is filled."""
    return df.select("patent_id", *[is_filled(F.col(c)).alias(k) for k, c in columns.items()])


def normalization_queue(names: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """Names without a confirmed alias that have patents beyond those counted when last asked; never asked ones first.

    ``names``: patent_id, field, name. ``asked``: lookup, patents."""
    known = aliases.where("review_status = 'confirmed'").select(lookup_key(F.col("alias")).alias("lookup")).where("lookup is not null").distinct()
    rows = names.withColumn("lookup", lookup_key(F.col("name"))).where("lookup is not null").join(known, "lookup", "left_anti")
    counted = rows.groupBy("lookup").agg(F.min("name").alias("name"), F.count_distinct("patent_id").alias("patents"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    out = counted.join(asked.select("lookup", F.col("patents").alias("asked")), "lookup", "left").where("asked is null or patents > asked")
    return out.orderBy(F.col("asked").asc_nulls_first(), F.col("patents").desc(), "lookup")


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("remaining"), F.count_if(F.col("asked").isNull()).alias("never_asked"))


def targets(aliases: DataFrame) -> DataFrame:
    """Codes with any name: the greatest of each kind."""
    zh, norm = blank_to_null(F.col("name_zh")), blank_to_null(F.col("name_norm"))
    return aliases.where("review_status = 'confirmed'").groupBy("code").agg(F.max(zh).alias("name_zh"), F.max(norm).alias("name_norm")).where("name_zh is not null or name_norm is not null")


def grouped_aliases(aliases: DataFrame) -> DataFrame:
    """Confirmed aliases and those to review in the order of codes, each with how many of its code are confirmed. Rows, not
    lists: no code's aliases have to stand in one place."""
    rows = aliases.where(F.col("review_status").isin("confirmed", "review_required")).select("code", "alias_id", "alias", "review_status")
    counts = rows.groupBy(F.col("code").alias("_code")).agg(F.count_if(F.col("review_status") == "confirmed").alias("confirmed"))
    return rows.join(counts, F.col("code").eqNullSafe(F.col("_code"))).drop("_code").orderBy("code", "alias_id")


def codes_without(aliases: DataFrame, done: DataFrame) -> DataFrame:
    """Confirmed codes that have no Chinese name and were neither reviewed nor drafted, with their most frequent name."""
    from patquarry.plans.companies import mode_by

    rows = aliases.where("review_status = 'confirmed'").select("code", blank_to_null(F.col("name_norm")).alias("norm"), blank_to_null(F.col("name_zh")).alias("zh"))
    has = rows.where("zh is not null").select("code").distinct()
    return mode_by(rows, "code", "norm", "name").join(has, "code", "left_anti").join(done.select("code").distinct(), "code", "left_anti")


def groups_with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Each group with its members in order; none gives an empty list."""
    listed = members.groupBy("group_name").agg(F.array_join(F.array_sort(F.collect_set("company")), ",").alias("members"), F.count_distinct("company").alias("n"))
    return groups.select("group_name").distinct().join(listed, "group_name", "left").select("group_name", F.coalesce("members", F.lit("")).alias("members"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def top_applicants(rows: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """The applicants with most patents of each workspace."""
    counts = members.join(rows.select("patent_id", "applicant_display_name").distinct(), "patent_id").groupBy("workspace_id", "applicant_display_name").agg(F.count_distinct("patent_id").alias("patents"))
    rank = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("patents").desc(), "applicant_display_name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def population_note(rows: DataFrame, total: DataFrame, reason: str) -> DataFrame:
    """One row: what a report covers, and why the rest is missing or counted more than once."""
    df = rows.agg(F.coalesce(F.sum("patent_count"), F.lit(0).cast("long")).alias("covered")).join(total.agg(F.count(F.lit(1)).alias("total")))
    text = F.when(F.col("covered") < F.col("total"), F.concat(F.lit("covers "), F.col("covered").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(": "), F.lit(reason))).when(F.col("covered") > F.col("total"), "joint applicants count more than once").otherwise("")
    return df.withColumn("note", text)


def representatives(rows: DataFrame, ranked: DataFrame, number: str) -> DataFrame:
    """Of each topic's leading applicants the newest patent's number, year missing last, smallest id; hyphens do not break.

    ``rows``: topic_code, applicant, patent_id, application_year, number. ``ranked``: topic_code, applicant, k."""
    best = F.min(F.struct((-F.coalesce("application_year", F.lit(-1))).alias("y"), "patent_id", F.regexp_replace(number, "-", chr(0x2011)).alias("n")))
    one = rows.join(ranked, ["topic_code", "applicant"]).groupBy("topic_code", "k").agg(best["n"].alias("n"))
    return one.groupBy("topic_code").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"])), "、").alias("representative"))


def latest_batch(suggestions: DataFrame, assigned: DataFrame) -> DataFrame:
    """The suggestions of the newest batch whose patents have no assignment yet."""
    newest = suggestions.agg(F.max("exported_at").alias("exported_at"))
    return suggestions.join(F.broadcast(newest), "exported_at", "left_semi").join(assigned.select("patent_id"), "patent_id", "left_anti")


def backfill_candidates(patents: DataFrame, members: DataFrame, assigned: DataFrame, text: str, design: Column) -> DataFrame:
    """Members without text, not designs and without an assignment."""
    return patents.where(~is_filled(F.col(text)) & ~design).join(members.select("patent_id"), "patent_id", "left_semi").join(assigned.select("patent_id"), "patent_id", "left_anti")


def name_pairs(patents: DataFrame, pairs: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Distinct code and name of each people column; the nth code belongs to the nth name."""
    one = lambda name, code: patents.select(F.explode(F.arrays_zip(split_multi_value(F.col(name)).alias("name"), (split_multi_value(F.col(code)) if code else F.array().cast("array<string>")).alias("code"))).alias("p")).select("p.code", "p.name").where("name is not null")
    return reduce(DataFrame.unionByName, [one(*p) for p in pairs]).distinct()


def govern(pairs: DataFrame, aliases: DataFrame, standard: DataFrame | None = None) -> DataFrame:
    """What to do with each (code, name) of a batch, and the rows to write: ``code, name, action, target_code, name_zh, name_norm, review_status``.

    * ``known``: the code has the alias, or, without a code, some code has it; nothing is written.
    * ``add alias``: the code has one pair of names, which the new alias takes; without a code one whose alias or name is the same.
    * ``new group``: an unknown code gets a row to be reviewed, with its standard name (``standard``: code, name) or this one;
      further names of the code in the batch are added to it.
    * ``conflict``: the code has several pairs of names. ``suspected``: without a code, a likeness only. ``unmatched``: neither.

    Of names of one code that differ in spelling only the smallest is written. Of several codes for a name the smallest counts."""
    rows = aliases.where("code is not null").select("code", lookup_key(F.col("alias")).alias("lookup"), F.coalesce(blank_to_null(F.col("name_zh")), F.lit("")).alias("zh"), F.coalesce(blank_to_null(F.col("name_norm")), F.lit("")).alias("norm"))
    named = F.when((F.col("zh") != "") | (F.col("norm") != ""), F.struct("zh", "norm"))
    groups = rows.groupBy("code").agg(F.count_distinct(named).alias("names"), F.min(named).alias("own"))
    has = rows.where("lookup is not null").select("code", "lookup").distinct().withColumn("has", F.lit(True))
    exact = rows.select("code", F.explode(F.array("lookup", lookup_key(F.col("zh")), lookup_key(F.col("norm")))).alias("lookup")).where("lookup is not null").distinct()
    loose = exact.withColumn("loose", loose_key(F.col("lookup"))).where("loose is not null").groupBy("loose").agg(F.min("code").alias("like"))
    by_name = exact.groupBy("lookup").agg(F.min("code").alias("same"))
    df = pairs.select("code", "name").withColumn("lookup", lookup_key(F.col("name"))).withColumn("loose", loose_key(F.col("name"))).where("lookup is not null")
    df = df.join(by_name, "lookup", "left").join(loose, "loose", "left").withColumn("target_code", F.coalesce("code", "same"))
    df = df.join(groups.withColumnRenamed("code", "target_code"), "target_code", "left").join(has.withColumnRenamed("code", "target_code"), ["target_code", "lookup"], "left")
    if standard is not None:
        df = df.join(standard.select(F.col("code").alias("target_code"), F.col("name").alias("standard")).groupBy("target_code").agg(F.min("standard").alias("standard")), "target_code", "left")
    else:
        df = df.withColumn("standard", F.lit(None).cast("string"))
    first, nth = F.min("name").over(Window.partitionBy("target_code", "lookup")), F.row_number().over(Window.partitionBy("target_code").orderBy("name", F.col("code").asc_nulls_last()))
    df = df.withColumn("first", F.col("name") == first).withColumn("nth", F.when(F.col("target_code").isNotNull() & F.col("names").isNull(), nth))
    act = (
        F.when(F.col("target_code").isNull(), F.when(F.col("like").isNotNull(), "suspected").otherwise("unmatched"))
        .when(F.col("has"), "known").when(F.col("names").isNull() & (F.col("nth") == 1), "new group")
        .when((F.col("names") > 1) & F.col("code").isNotNull(), "conflict").when(F.col("first"), "add alias").otherwise("known")
    )
    df = df.withColumn("action", act).withColumn("fresh", F.min(F.when(F.col("action") == "new group", F.coalesce("standard", "name"))).over(Window.partitionBy("target_code")))
    writes = F.col("action").isin("add alias", "new group")
    only = F.when(F.col("names") == 1, F.col("own"))
    return df.select(
        "code", "name", "action", F.when(F.col("action") == "suspected", F.col("like")).otherwise(F.col("target_code")).alias("target_code"),
        F.when(writes, F.nullif(only["zh"], F.lit(""))).alias("name_zh"), F.when(writes, F.coalesce(F.nullif(only["norm"], F.lit("")), F.when(F.col("names").isNull(), F.col("fresh")))).alias("name_norm"),
        F.when(F.col("action") == "new group", "review_required").when(F.col("action") == "add alias", F.when(F.col("names").isNull(), "review_required").otherwise("confirmed")).alias("review_status"),
    )


def validate_corpus(corpus: DataFrame, width: int) -> DataFrame:
    """One row: texts whose hash is not the stored one, vectors of another width, and how many models there are."""
    return corpus.agg(F.count_if(F.sha2("text", 256) != F.col("hash")).alias("stale"), F.count_if(F.size("vector") != width).alias("odd_vectors"), F.count_distinct("model").alias("models"))


def require_valid(corpus: DataFrame, width: int, model: Sequence[str] = ("model",)) -> DataFrame:
    """``corpus`` as it is, if topics can be found in it; else an error that names what is wrong and the smallest id of which.

    A corpus (``patent_id, text, hash, vector`` and the columns of ``model``) needs rows, hashes of the texts as they are now, vectors of one width and one
    model. A null hash or vector is wrong too. One row comes to the driver."""
    stale = ~F.sha2("text", 256).eqNullSafe(F.col("hash"))
    odd = ~F.size("vector").eqNullSafe(F.lit(width))
    first = lambda c: F.min(F.when(c, F.col("patent_id")))
    kinds = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in model])
    row = corpus.agg(F.count(F.lit(1)).alias("n"), first(stale).alias("stale"), first(odd).alias("odd"), F.min(kinds).alias("low"), F.max(kinds).alias("high")).first()
    if not row.n:
        raise ValueError("no patents with vectors in this scope")
    if row.stale is not None:
        raise ValueError(f"the vector of patent {row.stale} is of an earlier text")
    if row.odd is not None:
        raise ValueError(f"patent {row.odd} has no vector of {width} numbers")
    if row.low != row.high:
        raise ValueError(f"vectors of several models: {tuple(row.low)} and {tuple(row.high)}")
    return corpus


def skeleton(claims: DataFrame) -> DataFrame:
    """Numbers of each type of claim, as lists."""
    of = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("number")))), ",").alias(kind)
    return claims.groupBy("patent_id").agg(of("independent"), of("dependent"), of("unknown"))
