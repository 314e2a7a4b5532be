"""Profiles of applicants from rows of one applicant and patent each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patquarry.functions import status
from patquarry.functions.text import blank_to_null, surrogate_family

#: Names of the positions (this engine's own), in the order in which they are tried.
PRIOR_ART, FULL, SINGLE, NICHE = "prior art", "wide and broad", "wide", "niche"
LIMIT, DESIGN_LIMIT, TRAJECTORY_YEARS = 10, 20, 3


def one_per_patent(rows: DataFrame) -> DataFrame:
    """Each applicant's patents once."""
    return rows.where(blank_to_null(F.col("applicant_display_name")).isNotNull()).dropDuplicates(["applicant_display_name", "patent_id"])


def strength(rows: DataFrame, topics: DataFrame | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Patents, families, countries, statuses, kinds, topics and classes of the leading applicants."""
    df = one_per_patent(rows)
    df = df.join(topics.groupBy("patent_id").agg(F.min("topic_code").alias("topic_code")), "patent_id", "left") if topics is not None else df.withColumn("topic_code", F.lit(None).cast("string"))
    kind = status.patent_kind(F.col("document_kind"), F.col("patent_type"))
    state = status.normalize(F.col("legal_status"))
    out = df.groupBy(F.col("applicant_display_name").alias("applicant")).agg(
        F.count(F.lit(1)).alias("patent_count"), F.count_distinct(surrogate_family(F.col("family_id_raw"), F.col("patent_id"))).alias("family_count"), F.count_distinct(blank_to_null(F.col("country_code"))).alias("country_count"),
        *[F.count_if(state == s).alias(n) for s, n in ((status.ALIVE, "granted_count"), (status.PENDING, "pending_count"), (status.DEAD, "dead_count"), (status.UNKNOWN, "unknown_count"))],
        *[F.count_if(kind == k).alias(n) for k, n in ((status.DESIGN, "design_count"), (status.UTILITY, "utility_count"), (status.INVENTION, "invention_count"), (status.UNMARKED, "unmarked_count"))],
        F.count_distinct("topic_code").alias("topic_count"), F.count_distinct(F.substring(blank_to_null(F.col("ipc_main")), 1, 4)).alias("ipc_subclass_count"),
    )
    out = out.orderBy(F.col("patent_count").desc(), "applicant")
    return out.limit(limit) if limit else out


def position(country_median: Column, topic_median: Column) -> Column:
    """The competitive position from counts; an applicant without grants but with lapsed rights is prior art first."""
    wide, broad = F.col("country_count") >= country_median, F.col("topic_count") >= topic_median
    return F.when((F.col("granted_count") == 0) & (F.col("dead_count") > 0), PRIOR_ART).when(wide & broad, FULL).when(wide, SINGLE).otherwise(NICHE)


def key_players(rows: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """Years, trajectory, joint and solo patents of the leading applicants."""
    df = one_per_patent(rows).select(F.col("applicant_display_name").alias("applicant"), "patent_id", "application_year")
    holders = df.groupBy("patent_id").agg(F.count(F.lit(1)).alias("holders"))
    out = df.join(holders, "patent_id").groupBy("applicant").agg(
        F.count(F.lit(1)).alias("patent_count"), F.array_join(F.array_sort(F.collect_set(F.col("application_year").cast("string"))), ",").alias("years"),
        (F.count_distinct("application_year") >= TRAJECTORY_YEARS).alias("has_trajectory"), F.count_if(F.col("holders") > 1).alias("joint_count"), F.count_if(F.col("holders") == 1).alias("solo_count"),
    )
    out = out.orderBy(F.col("patent_count").desc(), "applicant")
    return out.limit(limit) if limit else out


def key_player_groups(rows: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """The leading applicants in two parts: those with a trajectory over the years, and the rest."""
    return key_players(rows, limit).withColumn("part", F.when(F.col("has_trajectory"), "trajectory").otherwise("technical"))


def partners(rows: DataFrame) -> DataFrame:
    """How many patents two applicants share: ``applicant, partner, patents``."""
    df = one_per_patent(rows).select("patent_id", F.col("applicant_display_name").alias("applicant"))
    return df.join(df.withColumnRenamed("applicant", "partner"), "patent_id").where("applicant != partner").groupBy("applicant", "partner").agg(F.count(F.lit(1)).alias("patents"))


def designs(rows: DataFrame, limit: int | None = DESIGN_LIMIT) -> DataFrame:
    """Applicants with designs: how many, beside technical patents, when, and the earliest one."""
    df = one_per_patent(rows).withColumn("design", status.is_design(F.col("document_kind")))
    tech_year = F.when(~F.col("design"), F.col("application_year"))
    first = F.min(F.when(F.col("design"), F.struct(F.coalesce("application_year", F.lit(9999)).alias("y"), "patent_id")))["patent_id"]
    year = F.when(F.col("design"), F.col("application_year"))
    out = df.groupBy(F.col("applicant_display_name").alias("applicant")).agg(
        F.count_if(F.col("design")).alias("design_count"), F.count_if(~F.col("design")).alias("tech_count"), F.min(year).alias("first_design_year"), F.max(year).alias("latest_design_year"),
        F.min(tech_year).alias("first_tech_year"), first.alias("representative_design_patent_id"),
    ).where("design_count > 0")
    out = out.withColumn("strategy_type", F.when(F.col("tech_count") > 0, "技術+設計").otherwise("只走設計")).withColumn("filing_order", filing_order(F.col("first_design_year"), F.col("first_tech_year")))
    out = out.orderBy(F.col("design_count").desc(), F.col("tech_count").desc(), "applicant")
    return out.limit(limit) if limit else out


def filing_order(design: Column, tech: Column) -> Column:
    """Which first year comes first, as text; empty where either is missing."""
    text = F.when(design < tech, F.concat(F.lit("設計先行 "), (tech - design).cast("string"), F.lit(" 年"))).when(tech < design, F.concat(F.lit("技術先行 "), (design - tech).cast("string"), F.lit(" 年")))
    return F.when(design.isNull() | tech.isNull(), "").otherwise(F.coalesce(text, F.lit("同年同步")))
