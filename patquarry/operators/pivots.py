"""Cross tables and other shapes of report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions import status


def by_year(rows: DataFrame, entity: str, years: list[int], value: str = "patent_count") -> DataFrame:
    """A row an entity with a column a year, null without patents, and its total, largest first."""
    out = rows.groupBy(entity).pivot("application_year", years).sum(value)
    return out.join(rows.groupBy(entity).agg(F.sum(value).alias("total")), entity).orderBy(F.col("total").desc(), entity)


def by_entity(rows: DataFrame, entity: str, names: list[str], value: str = "patent_count") -> DataFrame:
    """A row a year with a column an entity, and the row of totals at the end."""
    cells = rows.groupBy(F.col("application_year").cast("string").alias("application_year")).pivot(entity, names).sum(value)
    total = rows.groupBy(F.lit("總件數").alias("application_year")).pivot(entity, names).sum(value)
    return cells.unionByName(total)


def by_status(rows: DataFrame) -> DataFrame:
    """A row a country with a column a report bucket."""
    bucket = status.bucket(F.col("legal_status"))
    columns = {"granted": "已授權", "pending": "審查中", "dead": "已失效", "unknown": "未知"}
    return rows.groupBy("country_code").agg(*[F.sum(F.when(bucket == v, F.col("patent_count")).otherwise(0)).alias(k) for k, v in columns.items()], F.sum("patent_count").alias("total"))


def collapse(rows: DataFrame, key: Column, value: str = "patent_count") -> DataFrame:
    """Counts by a coarser key, largest first."""
    return rows.groupBy(key.alias("key")).agg(F.sum(value).alias(value)).orderBy(F.col(value).desc(), "key")


def year_summary(rows: DataFrame) -> DataFrame:
    """Patents, years and range of each applicant."""
    return rows.groupBy("applicant_display_name").agg(
        F.sum("patent_count").alias("patents"), F.min("application_year").alias("first_year"), F.max("application_year").alias("last_year"), (F.max("application_year") - F.min("application_year") + 1).alias("span"), F.count_distinct("application_year").alias("active_years")
    )


def segments(ranking: DataFrame) -> DataFrame:
    """Solo and joint parts of a ranking, each with what has been transferred, clamped to the part."""
    solo = F.greatest(F.col("patent_count") - F.col("joint_count"), F.lit(0))
    return ranking.select(
        "applicant_display_name", solo.alias("solo_count"), "joint_count", F.least(F.col("solo_transferred_count"), solo).alias("solo_transferred"), F.least("joint_transferred_count", "joint_count").alias("joint_transferred")
    )


def truncated(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows, each with how many there were: tasks keep their own first ones and counts."""
    return rows.orderBy(*order).limit(most).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("rows_total"))))


def newest_years(rows: DataFrame, most: int = 25) -> DataFrame:
    """Rows of the newest years; the years, not the rows, are ranked."""
    years = rows.select("application_year").where("application_year is not null").distinct().orderBy(F.col("application_year").desc()).limit(most)
    return rows.join(F.broadcast(years), "application_year", "left_semi")


def full_years(left: DataFrame, right: DataFrame) -> DataFrame:
    """Applications and grants of every year that either has."""
    a = left.select(F.col("application_year").alias("year"), F.col("patent_count").alias("applications"))
    b = right.select(F.col("grant_year").alias("year"), F.col("patent_count").alias("grants"))
    return a.join(b, "year", "full").select("year", F.coalesce("applications", F.lit(0).cast("long")).alias("applications"), F.coalesce("grants", F.lit(0).cast("long")).alias("grants"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: a digest of the rows that does not depend on their order."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    return rows.select(digest.alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.conv(F.substring("d", 1, 15), 16, 10).cast("long")).alias("fingerprint"))
