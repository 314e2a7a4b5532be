"""The reporting tables: a row a patent, and a row a patent and applicant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patquarry.functions.text import leading_year
from patquarry.plans.companies import Names, applicants, converged, group_names


#: Display names and the columns that they converge: standardised, raw, code.
COLUMNS = {
    "applicant_display_name": ("applicant_std", "applicant_raw", "applicant_code"),
    "current_assignee_display_name": ("owner_std", "owner_raw", "owner_code"),
    "recent_assignee_display_name": ("assignee_raw", "assignee_raw", None),
}


def plain_base(patents: DataFrame) -> DataFrame:
    """Patents with the year of grant."""
    return patents.withColumn("grant_year", leading_year(F.col("grant_date_text")))


def patent_base(patents: DataFrame, names: Names) -> DataFrame:
    """Patents with the year of grant and the display names; their other columns are shuffled once, by patent."""
    df = patents
    for name, columns in COLUMNS.items():
        df = df.join(converged(patents, names, *columns, name), "patent_id", "left")
    return plain_base(df).select(*patents.columns, *COLUMNS, "grant_year")


def applicant_expanded(patents: DataFrame, names: Names, people: DataFrame | None = None) -> DataFrame:
    """The base by applicant, with the converged name of the recent assignee; ``people``: ``applicants`` of the patents, if at hand."""
    recent = "recent_assignee_display_name"
    people = applicants(patents, names) if people is None else people
    df = patents.join(converged(patents, names, *COLUMNS[recent], recent), "patent_id", "left").join(people, "patent_id")
    return df.select(*patents.columns, recent, *[c for c in people.columns if c != "patent_id"])


def with_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Company names replaced by those of their groups."""
    for c in COLUMNS:
        if c in df.columns:
            df = group_names(df, groups, c, f"{c}_group").drop(c).withColumnRenamed(f"{c}_group", c)
    return df
