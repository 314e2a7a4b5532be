"""Queries over files that are written from the tables and read back by the readers of vendor files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patquarry.plans import tables as t
from patquarry.plans.catalog import query
from patquarry.sources import delimited, derived, readers, sinks
from patquarry.sources.projection import with_tables


def _folder(s, name):  # noqa: ANN001, ANN202
    return f"{derived.folder(s)}/{name}-{uuid.uuid4().hex}"


_NOTE = "concat('said \"', title, '\",', {line}, main_claim)"


def _delimited(s, d):  # noqa: ANN001, ANN202
    """Quotes, delimiters, line ends, blanks and nulls in cells."""
    path = _folder(s, "delimited")
    rows = t.patents(s, d).selectExpr("patent_id", "title", f"{_NOTE.format(line='chr(10)')} as note", "family_id_raw", "applicant_code")
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    found = delimited.read(s, path, rows.columns, columns=["patent_id", "note", "family_id_raw", "applicant_code"])
    return found.select(F.col("patent_id").cast("long").alias("patent_id"), "note", "family_id_raw", "applicant_code")


query("SRC3_delimited_parts", with_tables(f" select patent_id, {_NOTE.format(line='chr(10)')} as note, family_id_raw, applicant_code from patents", "patents"))(_delimited)


def _xml(s, d):  # noqa: ANN001, ANN202
    """Rows as elements, of which some have no year and some fields are attributes."""
    path = _folder(s, "xml")
    text = "concat('<patent id=\"', patent_id, '\"><title>', title, '</title>', coalesce(concat('<dates><year>', application_year, '</year></dates>'), ''), '<field name=\"number\">', application_no, '</field></patent>')"
    t.patents(s, d).selectExpr(f"{text} as value").write.text(path)
    found = readers.read_xml(s, path, "patent")
    return found.select(F.col("id").cast("long").alias("patent_id"), "title", F.col("year").cast("int").alias("application_year"), F.col("number").alias("application_no"))


query("SRC4_xml", with_tables(" select patent_id, title, application_year, application_no from patents", "patents"))(_xml)


def _rebuilt(s, d):  # noqa: ANN001, ANN202
    """A table that is replaced by one commit: nothing of what it was stays."""
    path = _folder(s, "rebuilt")
    rows = t.patents(s, d).select("patent_id", "title", "patent_type")
    sinks.rebuild(rows.where("patent_id % 2 = 0").withColumn("title", F.lit("old")), path, ["patent_type"])
    sinks.rebuild(rows.where("patent_id % 3 = 0"), path, ["patent_type"])
    sinks.append_new(rows.where("patent_id % 9 = 0 or patent_id % 5 = 0").select("patent_id", F.lit("late").alias("title"), "patent_type"), path, ["patent_id"], ["patent_type"])
    return s.read.schema("patent_id long, title string").parquet(path).select("patent_id", "title")


query("SNK1_rebuilt", with_tables(" select patent_id, case when patent_id % 3 = 0 then title else 'late' end as title from patents where patent_id % 3 = 0 or patent_id % 5 = 0", "patents"))(_rebuilt)
