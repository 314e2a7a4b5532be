"""Families by country: protection counts and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patquarry.functions import status
from patquarry.functions.text import NON_COUNTRY, blank_to_null, split_codes, split_multi_value, surrogate_family

#: Offices whose stated and found counts are compared, and designated states that mean "not yet chosen" (fixed values).
COUNTED, TRANSITION = ("US", "EP", "JP", "KR", "CN"), 30


def ep_contribution(valid: Column, invalid: Column) -> Column:
    """Of a living European patent: missing, in_transition or countries."""
    n, none = F.size(split_codes(valid)), F.size(split_codes(invalid)) == 0
    return F.when((n == 0) & none, F.lit("missing")).when(none & (n >= TRANSITION), F.lit("in_transition")).otherwise(F.lit("countries"))


def family_counts(c: Column) -> Column:
    """Tokens like ``US-2`` as structs of bucket and n; others have no bucket."""
    token = lambda x: F.struct(
        F.nullif(F.regexp_extract(x, r"^([A-Za-z]+)\s*-\s*(\d+)$", 1), F.lit("")).alias("bucket"), F.regexp_extract(x, r"^([A-Za-z]+)\s*-\s*(\d+)$", 2).try_cast("int").alias("n"), x.alias("token")
    )
    return F.transform(split_multi_value(c), token)


def bad_tokens(c: Column) -> Column:
    return F.transform(F.filter(family_counts(c), lambda x: x["bucket"].isNull()), lambda x: x["token"])


def _rows(patents: DataFrame, expand_ep: bool) -> DataFrame:
    """One row for each contribution: family, country, state, and what it counts as."""
    df = patents.select(
        "patent_id", surrogate_family(F.col("family_id_raw"), F.col("patent_id")).alias("family_id"), blank_to_null(F.col("family_id_raw")).isNull().alias("is_surrogate"),
        F.coalesce(blank_to_null(F.upper("country_code")), F.lit("")).alias("country_code"), status.normalize(F.col("legal_status")).alias("state"), blank_to_null(F.col("family_counts_raw")).alias("counts_raw"),
        *([F.col("epc_valid"), F.col("epc_invalid")] if expand_ep else []),
    )
    alive_ep = (F.col("state") == status.ALIVE) & (F.col("country_code") == "EP")
    ep = ep_contribution(F.col("epc_valid"), F.col("epc_invalid")) if expand_ep else F.lit("direct")
    use = (
        F.when(F.col("state") == status.UNKNOWN, F.lit("unknown")).when(F.col("state") == status.PENDING, F.lit("pending")).when(F.col("state") == status.DEAD, F.lit("dead"))
        .when(alive_ep, ep).when((F.col("country_code") == "") | F.col("country_code").isin(*NON_COUNTRY), F.lit("non_country")).otherwise(F.lit("direct"))
    )
    return df.withColumn("use", use)


def quality(patents: DataFrame, expand_ep: bool = False) -> DataFrame:
    """A row a family: members, uncounted rows by reason, and the offices whose stated count differs from the rows found.

    The stated counts are those of the family's smallest patent id that has any."""
    rows = _rows(patents, expand_ep)
    n = lambda x: F.count_if(F.col("use") == x)
    one = rows.groupBy("family_id", "is_surrogate").agg(
        F.count(F.lit(1)).alias("member_rows"), n("unknown").alias("unknown_status_count"), n("pending").alias("pending_status_count"), n("non_country").alias("non_country_row_count"),
        n("in_transition").alias("ep_in_transition_count"), n("missing").alias("ep_missing_epc_count"),
        F.min(F.when(F.col("counts_raw").isNotNull(), F.struct("patent_id", "counts_raw")))["counts_raw"].alias("expected_counts_raw"),
        *[F.count_if(F.col("country_code") == c).alias(f"_{c}") for c in COUNTED],
    )
    stated = lambda c: F.aggregate(F.filter("_stated", lambda x: F.upper(x["bucket"]) == c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    one = one.withColumn("_stated", family_counts(F.col("expected_counts_raw")))
    detail = F.array_compact(F.array(*[F.when(stated(c) != F.col(f"_{c}"), F.concat(F.lit(f"{c}:"), stated(c).cast("string"), F.lit("/"), F.col(f"_{c}").cast("string"))) for c in COUNTED]))
    detail = F.when(F.col("expected_counts_raw").isNull(), F.lit("")).otherwise(F.array_join(detail, ","))
    return one.withColumn("incomplete_detail", detail).withColumn("family_incomplete", F.col("incomplete_detail") != "").drop("_stated", *[f"_{c}" for c in COUNTED])


def by_country(patents: DataFrame, expand_ep: bool = False) -> DataFrame:
    """A row a family and country: direct, via EP, unknown and pending counts. The dead do not count."""
    rows = _rows(patents, expand_ep).where(F.col("use").isin("direct", "unknown", "pending", "countries"))
    if expand_ep:
        rows = rows.withColumn("country_code", F.explode(F.when(F.col("use") == "countries", split_codes(F.col("epc_valid"))).otherwise(F.array("country_code"))))
    n = lambda x: F.count_if(F.col("use") == x)
    out = rows.where("country_code != ''").groupBy("family_id", "country_code").agg(n("direct").alias("direct_patent_count"), n("countries").alias("via_ep_count"), n("unknown").alias("unknown_status_count"), n("pending").alias("pending_status_count"))
    return out.join(quality(patents, expand_ep).select("family_id", "family_incomplete", F.col("is_surrogate").alias("is_surrogate_family")), "family_id")


def summary(patents: DataFrame) -> DataFrame:
    """One row of totals over all families."""
    q = quality(patents).agg(
        F.count(F.lit(1)).alias("family_count"), F.count_if("is_surrogate").alias("surrogate_family_count"), F.count_if("family_incomplete").alias("incomplete_family_count"),
        F.sum("unknown_status_count").alias("unknown_status_count"), F.sum("pending_status_count").alias("pending_status_count"), F.sum("non_country_row_count").alias("non_country_row_count"),
    )
    c = by_country(patents).agg(F.count(F.lit(1)).alias("family_country_rows"), F.count_distinct("country_code").alias("protected_country_count"))
    return q.join(c)  # one row each
