"""The report catalog: declarative specifications compiled to one aggregation each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from patquarry.functions.text import blank_to_null, is_filled, split_multi_value, surrogate_family
from patquarry.plans.companies import lookup_key, lowest_alias_names

#: Classification codes of sections A to H and Y; others, such as design classes, are left out.
CODE_PATTERN = r"^[A-HY]"
SCOPES = ("company", "group")


@dataclass(frozen=True)
class ReportSpec:
    """``aggregates`` are (function, column, output[, extra column]); a spec without a source is made elsewhere."""

    label: str
    source: str  # "base", "expanded", "family_country" or "cluster"
    columns: tuple[str, ...] = ()
    kind: str = "aggregate"
    aggregates: tuple[tuple[str, ...], ...] = ()
    order: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    filled: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()
    count: str = "patent_id"
    filters: tuple[str, ...] = ("patent_id", "application_year", "country_code", "ipc_main", "cpc_main", "applicant_display_name", "current_assignee_display_name")
    by_patent: bool = True


def _counted(label: str, source: str, *columns: str, **more: Any) -> ReportSpec:
    order = (("patent_count", "desc"), *((c, "asc") for c in columns if c != "legal_status"))
    return ReportSpec(label, source, columns, filled=more.pop("filled", columns), order=more.pop("order", order), **more)


REPORTS: dict[str, ReportSpec] = {
    "application_trend": _counted("Patent applications by year", "base", "application_year", order=(("application_year", "asc"),), aggregates=(("count_distinct_family", "family_id_raw", "family_count"),)),
    "publication_trend": _counted("Grants by year", "base", "grant_year", order=(("grant_year", "asc"),)),
    "country_distribution": _counted("Patents by office and status", "base", "country_code", "legal_status", filled=("country_code",)),
    "applicant_country_distribution": _counted("Applicants by office", "expanded", "applicant_display_name", "country_code"),
    "ipc_main_distribution": _counted("Main IPC classes", "base", "ipc_main", patterns=(("ipc_main", CODE_PATTERN),)),
    "cpc_main_distribution": _counted("Main CPC classes", "base", "cpc_main", patterns=(("cpc_main", CODE_PATTERN),)),
    "applicant_ranking": _counted(
        "Applicants by patents", "expanded", "applicant_display_name", limit=100,
        aggregates=(
            ("count_nonblank_excl_group", "recent_assignee_display_name", "recent_assignee_count"),
            ("string_agg_distinct_nonblank_excl_group", "recent_assignee_display_name", "recent_assignee_display_names"),
            ("count_as_value_of", "recent_assignee_display_name", "acquired_count"),
            ("count_multivalue", "applicant_raw", "joint_count"),
            ("count_multivalue_transferred", "applicant_raw", "joint_transferred_count", "recent_assignee_display_name"),
            ("count_singlevalue_transferred", "applicant_raw", "solo_transferred_count", "recent_assignee_display_name"),
            ("string_agg_co_values", "applicant_raw", "co_applicant_names"),
        ),
    ),
    "applicant_year_matrix": _counted("Applicants by year", "expanded", "applicant_display_name", "application_year"),
    "family_country_layout": _counted("Families by country", "family_country", "country_code", count="family_id", by_patent=False),
    "design_protection_detail": ReportSpec(
        "Designs in detail", "base", ("patent_id", "patent_type", "document_kind", "application_year", "country_code", "legal_status", "applicant_display_name", "title", "main_claim"),
        kind="detail", order=(("applicant_display_name", "asc"), ("application_year", "asc"), ("patent_id", "asc")), filled=("applicant_display_name",),
    ),
    "applicant_strength_profile": ReportSpec("Applicants' positions", "cluster", kind="cluster", by_patent=False),
    "cluster_topic_table": ReportSpec("Topics", "cluster", kind="cluster", by_patent=False),
    "opportunity_quadrant": ReportSpec("Opportunities", "cluster", kind="cluster", by_patent=False),
}

#: Reports that the catalog no longer offers; their source has ``cited_count`` and ``inventor_count``, too.
ARCHIVED: dict[str, ReportSpec] = {
    "top_cited_patents": ReportSpec(
        "Most cited patents", "base", ("patent_id", "title", "application_year", "applicant_display_name", "cited_count"),
        kind="detail", order=(("cited_count", "desc"), ("patent_id", "asc")), limit=50, filled=("cited_count",),
    ),
    "company_rd_energy": _counted(
        "Applicants by patents, citations and inventors", "base", "applicant_display_name", limit=30,
        aggregates=(("sum", "cited_count", "cited_total"), ("sum", "inventor_count", "inventor_total"), ("count", "cited_count", "cited_rows")),
    ),
}


def columns_of(spec: ReportSpec, filters: Mapping[str, Any] | None = None) -> set[str]:
    """Every column that a report reads."""
    return {*spec.columns, *spec.filled, *(c for a in spec.aggregates for c in (a[1], *a[3:])), *(c for c, _ in spec.patterns), *(filters or {})}


def predicate(spec: ReportSpec, filters: Mapping[str, Any] | None, df: DataFrame) -> Column:
    """Typed filters: a scalar equals, a list is one of (none matches an empty list), a mapping has from, to or values."""
    parts: list[Column] = [F.lit(True)]
    for name, want in (filters or {}).items():
        if name not in spec.filters or name not in df.columns:
            raise ValueError(f"{name} is no filter of this report")
        c = F.col(name)
        if isinstance(want, Mapping):
            if "from" in want:
                parts.append(c >= want["from"])
            if "to" in want:
                parts.append(c <= want["to"])
            if "values" in want:
                parts.append(c.isin(*want["values"]) if want["values"] else F.lit(False))
        elif isinstance(want, (list, tuple, set)):
            parts.append(c.isin(*want) if want else F.lit(False))
        else:
            parts.append(c == want)
    return reduce(lambda a, b: a & b, parts)


def in_scope(df: DataFrame, patent_ids: DataFrame | Sequence[int] | None) -> DataFrame:
    """Rows of a snapshot of patents: None is all, an empty list none."""
    if patent_ids is None:
        return df
    if isinstance(patent_ids, DataFrame):
        return df.join(patent_ids.select("patent_id").distinct(), "patent_id", "left_semi")
    return df.where(F.col("patent_id").isin(*patent_ids) if patent_ids else F.lit(False))


def family_scope(families: DataFrame, base: DataFrame, patent_ids: DataFrame | Sequence[int] | None, spec: ReportSpec, filters: Mapping[str, Any] | None) -> DataFrame:
    """Whole families of which a patent is in scope."""
    if patent_ids is None and not filters:
        return families
    base_spec = replace(spec, filters=REPORTS["application_trend"].filters)
    some = in_scope(base.where(predicate(base_spec, filters, base)), patent_ids)
    keep = some.select(surrogate_family(F.col("family_id_raw"), F.col("patent_id")).alias("family_id")).distinct()
    return families.join(keep, "family_id", "left_semi")


def joined_distinct(c: Column) -> Column:
    """Distinct values in order, joined; empty without any."""
    return F.array_join(F.array_sort(F.collect_set(c)), "; ")


def aggregate(function: str, name: str, group: str, extra: str | None) -> Column:
    """One aggregate of a report; ``group`` is its first grouping column."""
    value, key = F.col(name), F.col(group)
    text, filled = blank_to_null(value), is_filled(value)
    away = lambda c: is_filled(F.col(c)) & ~F.trim(F.col(c)).eqNullSafe(F.trim(key))
    several = F.coalesce(F.contains(F.coalesce(text, blank_to_null(F.col(extra)) if extra and not function.endswith("transferred") else F.lit(None).cast("string")), F.lit("|")), F.lit(False))
    match function:
        case "sum":
            return F.coalesce(F.sum(value), F.lit(0))
        case "count":
            return F.count(value)
        case "count_nonblank":
            return F.count_if(filled)
        case "string_agg_distinct_nonblank":
            return joined_distinct(text)
        case "count_distinct":
            return F.count_distinct(value)
        case "avg":
            return F.avg(value).cast("decimal(12,2)")
        case "max":
            return F.max(value)
        case "count_nonblank_excl_group":
            return F.count_if(away(name))
        case "count_distinct_family":
            return F.count_distinct(F.coalesce(text, F.col("patent_id").cast("string")))
        case "count_multivalue":
            return F.count_if(several)
        case "count_multivalue_transferred":
            return F.count_if(several & away(extra))
        case "count_singlevalue_transferred":
            return F.count_if(~several & away(extra))
        case "string_agg_distinct_nonblank_excl_group":
            return joined_distinct(F.when(away(name), text))
    raise ValueError(f"unknown aggregate {function}")


def count_as_value(source: DataFrame, name: str, group: str, out: str) -> DataFrame:
    """How many rows of the whole source, whatever the filters, have the group's key in another column."""
    value = blank_to_null(F.col(name))
    return source.where(value.isNotNull()).groupBy(value.alias(group)).agg(F.count(F.lit(1)).alias(out))


def co_values(df: DataFrame, aliases: DataFrame, name: str, group: str, out: str) -> DataFrame:
    """The other names on the rows of a group, each converged through the confirmed aliases, without the group's key."""
    rows = df.select(group, F.explode(split_multi_value(F.col(name))).alias("_name")).distinct()
    rows = rows.withColumn("alias_key", lookup_key(F.col("_name"))).join(lowest_alias_names(aliases), "alias_key", "left").withColumn("_name", F.coalesce("alias_name", "_name"))
    return rows.where(~F.col("_name").eqNullSafe(F.col(group))).groupBy(group).agg(joined_distinct(F.col("_name")).alias(out))


def run_report(sources: Mapping[str, DataFrame], name: str, filters: Mapping[str, Any] | None = None, patent_ids: DataFrame | Sequence[int] | None = None, limit: int | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """The rows of a report. ``sources`` has the tables that specs name, of either scope."""
    spec = REPORTS[name] if name in REPORTS else ARCHIVED[name]
    if spec.kind == "cluster":
        raise ValueError(f"{name} is made from topics, not from one table")
    source = sources.having(spec.source, columns_of(spec, filters)) if hasattr(sources, "having") else sources[spec.source]
    if spec.by_patent:
        df = in_scope(source.where(predicate(spec, filters, source)), patent_ids)
    else:
        df = family_scope(source, sources["base"], patent_ids, spec, filters)
    for c in spec.filled:
        df = df.where(is_filled(F.col(c)))
    for c, pattern in spec.patterns:
        df = df.where(F.trim(F.col(c)).rlike(pattern))
    if spec.kind == "detail":
        out = df.select(*spec.columns)
    else:
        group = spec.columns[0]
        simple = [a for a in spec.aggregates if a[0] not in ("count_as_value_of", "string_agg_co_values")]
        measures = [F.count(F.col(spec.count)).alias("patent_count"), *(aggregate(a[0], a[1], group, a[3] if len(a) > 3 else None).alias(a[2]) for a in simple)]
        out = df.groupBy(*spec.columns).agg(*measures)
        for a in spec.aggregates:
            if a[0] == "count_as_value_of":
                out = out.join(count_as_value(source, a[1], group, a[2]), group, "left").withColumn(a[2], F.coalesce(a[2], F.lit(0).cast("long")))
            elif a[0] == "string_agg_co_values":
                out = out.join(co_values(df, aliases, a[1], group, a[2]), group, "left").withColumn(a[2], F.coalesce(a[2], F.lit("")))
    out = out.orderBy(*[F.col(c).desc() if way == "desc" else F.col(c).asc_nulls_last() for c, way in spec.order])
    limit = limit if limit is not None else spec.limit
    return out.limit(limit) if limit is not None else out


def run_batch(sources: Mapping[str, DataFrame], names: Sequence[str], **more: Any) -> dict[str, DataFrame | str]:
    """Several reports; the reason, as text, where one cannot be made from a table."""
    return {n: run_report(sources, n, **more) if n in REPORTS and REPORTS[n].kind != "cluster" else "made from topics" if n in REPORTS else "unknown report" for n in names}
