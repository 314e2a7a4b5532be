"""Queries of the report catalog, of names and of families."""

from __future__ import annotations

from pyspark.sql import functions as F

from patquarry.functions import status, text
from patquarry.operators import pivots, profiles
from patquarry.plans import companies, family, reports, tables as t
from patquarry.plans.catalog import ORACLES, query
from patquarry.sources.projection import as_sql, project, with_tables


def _report(name, ids=None, filters=None, scope="company", **more):  # noqa: ANN001, ANN202
    def run(spark, d):  # noqa: ANN001, ANN202
        return reports.run_report(t.Sources(spark, d, scope), name, filters=filters, patent_ids=ids, aliases=t.aliases(spark, d), **more)

    return run


def _with(tables_sql: str, body: str) -> str:
    return f"with {tables_sql}\n{body}"


_CODES = "trim({0}) != '' and regexp_matches(trim({0}), '^[A-HY]')"

query("R1_application_trend", _with(t.BASE_SQL, "select application_year, count(patent_id) as patent_count, count(distinct coalesce(nullif(trim(family_id_raw), ''), patent_id::varchar)) as family_count from base where application_year is not null group by 1"))(_report("application_trend"))
query("R2_publication_trend", _with(t.BASE_SQL, "select grant_year, count(*) as patent_count from base where grant_year is not null group by 1"))(_report("publication_trend"))
query("R3_country_distribution", _with(t.BASE_SQL, "select country_code, legal_status, count(*) as patent_count from base where trim(country_code) != '' group by 1, 2"))(_report("country_distribution"))
query("R4_applicant_country", _with(t.EXPANDED_SQL, "select applicant_display_name, country_code, count(*) as patent_count from expanded where trim(applicant_display_name) != '' and trim(country_code) != '' group by 1, 2"))(_report("applicant_country_distribution"))
query("R5_ipc_main", _with(t.BASE_SQL, f"select ipc_main, count(*) as patent_count from base where {_CODES.format('ipc_main')} group by 1"))(_report("ipc_main_distribution"))
query("R6_cpc_main", _with(t.BASE_SQL, f"select cpc_main, count(*) as patent_count from base where {_CODES.format('cpc_main')} group by 1"))(_report("cpc_main_distribution"))
_RANKING = """, co as (
  select applicant_display_name, string_agg(name, '; ' order by name) as co_applicant_names from (
    select distinct e.applicant_display_name, coalesce(n.alias_name, trim(e.other)) as name
    from (select applicant_display_name, unnest(string_split(applicant_raw, '|')) as other from expanded) e left join low_names n on n.alias_key = lower(regexp_replace(trim(e.other), '\\s+', ' ', 'g')) where trim(e.other) != ''
  ) where name is distinct from applicant_display_name group by 1
), acquired as (select recent_assignee_display_name as applicant_display_name, count(*) as n from expanded where recent_assignee_display_name is not null group by 1),
r as (
  select applicant_display_name, count(*) as patent_count,
    count(*) filter (away) as recent_assignee_count, coalesce(string_agg(distinct case when away then trim(recent_assignee_display_name) end, '; ' order by case when away then trim(recent_assignee_display_name) end), '') as recent_assignee_display_names,
    count(*) filter (multi) as joint_count, count(*) filter (multi and away) as joint_transferred_count, count(*) filter (not multi and away) as solo_transferred_count
  from (select *, coalesce(trim(recent_assignee_display_name) != '' and trim(recent_assignee_display_name) is distinct from trim(applicant_display_name), false) as away, contains(applicant_raw, '|') as multi from expanded)
  where trim(applicant_display_name) != '' group by 1
)
select r.*, coalesce(a.n, 0) as acquired_count, coalesce(co.co_applicant_names, '') as co_applicant_names from r left join acquired a using (applicant_display_name) left join co using (applicant_display_name)
order by patent_count desc, applicant_display_name limit 100"""
RANKING_SQL = _with(t.EXPANDED_SQL, _RANKING)
query("R7_applicant_ranking", RANKING_SQL)(_report("applicant_ranking"))
query("R8_applicant_year", _with(t.EXPANDED_SQL, "select applicant_display_name, application_year, count(*) as patent_count from expanded where trim(applicant_display_name) != '' and application_year is not null group by 1, 2"))(_report("applicant_year_matrix"))

_FAMILY = f"""rows as (
  select *, {t.FAMILY_SQL} as family_id, trim(family_id_raw) = '' as is_surrogate, upper(trim(country_code)) as country, {t.state()} as state from patents
), country_rows as (
  select family_id, country as country_code, count(*) filter (state = 'alive') as direct_patent_count, 0::bigint as via_ep_count, count(*) filter (state = 'unknown') as unknown_status_count, count(*) filter (state = 'pending') as pending_status_count
  from rows where country != '' and (state in ('unknown', 'pending') or (state = 'alive' and country not in ('WO', 'EA', 'OA', 'AP', 'GC', 'BX', 'IB'))) group by 1, 2
), stated as (
  select family_id, min_by(family_counts_raw, patent_id) as raw from rows where trim(family_counts_raw) != '' group by 1
), expected as (
  select s.family_id, s.raw, b.bucket, coalesce((select sum(nullif(regexp_extract(trim(x), '^([A-Za-z]+)\\s*-\\s*(\\d+)$', 2), '')::int) from unnest(string_split(s.raw, '|')) as u(x) where upper(regexp_extract(trim(x), '^([A-Za-z]+)\\s*-\\s*(\\d+)$', 1)) = b.bucket), 0) as n,
    b.k, (select count(*) from rows r where r.family_id = s.family_id and r.country = b.bucket) as found
  from stated s, (values ('US', 1), ('EP', 2), ('JP', 3), ('KR', 4), ('CN', 5)) as b(bucket, k)
), details as (
  select family_id, coalesce(string_agg(case when n != found then bucket || ':' || n || '/' || found end, ',' order by k), '') as incomplete_detail from expected group by 1
), quality as (
  select r.family_id, r.is_surrogate, count(*) as member_rows, count(*) filter (state = 'unknown') as unknown_status_count, count(*) filter (state = 'pending') as pending_status_count,
    count(*) filter (state = 'alive' and (country = '' or country in ('WO', 'EA', 'OA', 'AP', 'GC', 'BX', 'IB'))) as non_country_row_count, 0::bigint as ep_in_transition_count, 0::bigint as ep_missing_epc_count,
    max(s.raw) as expected_counts_raw, coalesce(max(d.incomplete_detail), '') as incomplete_detail, coalesce(max(d.incomplete_detail), '') != '' as family_incomplete
  from rows r left join stated s using (family_id) left join details d using (family_id) group by 1, 2
)"""

query("R9_family_country_layout", with_tables(f", {_FAMILY} select country_code, count(family_id) as patent_count from country_rows group by 1", "patents"))(_report("family_country_layout"))
query("AG17_family_country", with_tables(f", {_FAMILY} select c.*, q.family_incomplete, q.is_surrogate as is_surrogate_family from country_rows c join quality q using (family_id)", "patents"))(lambda s, d: t.families(s, d))
query("AG17_family_quality", with_tables(f", {_FAMILY} select * from quality", "patents"))(lambda s, d: family.quality(t.patents(s, d)))
query("AG18_family_summary", with_tables(f""", {_FAMILY} select count(*) as family_count, count(*) filter (is_surrogate) as surrogate_family_count, count(*) filter (family_incomplete) as incomplete_family_count,
  sum(unknown_status_count)::bigint as unknown_status_count, sum(pending_status_count)::bigint as pending_status_count, sum(non_country_row_count)::bigint as non_country_row_count,
  (select count(*) from country_rows) as family_country_rows, (select count(distinct country_code) from country_rows) as protected_country_count from quality""", "patents"))(lambda s, d: family.summary(t.patents(s, d)))
query("F5_family_scope", with_tables(f", {_FAMILY} select country_code, count(family_id) as patent_count from country_rows where family_id in (select family_id from rows where country_code = 'US' and patent_id <= 500) group by 1", "patents"))(
    _report("family_country_layout", ids=list(range(1, 501)), filters={"country_code": "US"})
)
query("R10_design_detail", _with(t.BASE_SQL, "select patent_id, patent_type, document_kind, application_year, country_code, legal_status, applicant_display_name, title, main_claim from base where trim(applicant_display_name) != ''"))(_report("design_protection_detail"))
query("F1_typed_filters", _with(t.BASE_SQL, "select application_year, count(*) as patent_count, count(distinct coalesce(nullif(trim(family_id_raw), ''), patent_id::varchar)) as family_count from base where application_year between 1993 and 1997 and country_code in ('US', 'JP') group by 1"))(
    _report("application_trend", filters={"application_year": {"from": 1993, "to": 1997}, "country_code": ["US", "JP"]})
)
query("F4_empty_scope", "select 1::int as application_year, 1::bigint as patent_count, 1::bigint as family_count where false")(_report("application_trend", ids=[]))
_GROUPED = t.EXPANDED_SQL.replace("\nexpanded as (", "\nplain as (") + f""", company_groups as ({as_sql('company_groups')}), named as (select {t.key('company')} as k, min(group_name) as g from company_groups where review_status = 'confirmed' group by 1),
expanded as (select plain.* replace (coalesce(a.g, applicant_display_name) as applicant_display_name, coalesce(b.g, recent_assignee_display_name) as recent_assignee_display_name) from plain
  left join named a on a.k = {t.key('applicant_display_name')} left join named b on b.k = {t.key('recent_assignee_display_name')})"""
query("F6_group_ranking", _with(_GROUPED, _RANKING))(_report("applicant_ranking", scope="group"))

query("N1_N2_N3_display_names", _with(t.BASE_SQL, "select patent_id, applicant_display_name, current_assignee_display_name, recent_assignee_display_name from base"))(
    lambda s, d: t.base_table(s, d).select("patent_id", "applicant_display_name", "current_assignee_display_name", "recent_assignee_display_name")
)
query("N4_expanded_applicants", _with(t.EXPANDED_SQL, "select patent_id, applicant_no::int as applicant_no, applicant_no = 1 as is_primary, applicant_name, applicant_display_name from expanded"))(
    lambda s, d: t.expanded(s, d).select("patent_id", "applicant_no", "is_primary", "applicant_name", "applicant_display_name")
)
query("N5_group_names", _with(t.BASE_SQL + f", company_groups as ({as_sql('company_groups')})", f"""select b.patent_id, coalesce(g.group_name, b.applicant_display_name) as applicant_group
from base b left join (select {t.key('company')} as k, min(group_name) as group_name from company_groups where review_status = 'confirmed' group by 1) g on g.k = {t.key('b.applicant_display_name')}"""))(
    lambda s, d: companies.group_names(t.base_table(s, d), project(s, d, "company_groups"), "applicant_display_name", "applicant_group").select("patent_id", "applicant_group")
)
query("AG1_code_names", _with(t.NAMES_SQL, "select code, code_name from code_names"))(lambda s, d: companies.code_names(t.aliases(s, d)))
query("AG3_alias_names", _with(t.NAMES_SQL, "select alias_key, alias_name from alias_names"))(lambda s, d: companies.alias_names(t.aliases(s, d)))
query("AG28_pending_names", _with(t.NAMES_SQL, f"""select lookup, min(name) as name, string_agg(distinct field, ',' order by field) as fields, count(distinct patent_id) as patents from (
  select patent_id, field, trim(part) as name, {t.key('part')} as lookup from (
    select patent_id, 'applicant_raw' as field, unnest(string_split(applicant_raw, '|')) as part from patents union all select patent_id, 'owner_raw', unnest(string_split(owner_raw, '|')) from patents
    union all select patent_id, 'assignee_raw', unnest(string_split(assignee_raw, '|')) from patents) where trim(part) != '')
where lookup not in (select alias_key from confirmed where alias_key is not null) group by 1"""))(lambda s, d: companies.pending_names(t.patents(s, d), t.aliases(s, d), ["applicant_raw", "owner_raw", "assignee_raw"]))
query("J11_J2_alias_match", _with(t.NAMES_SQL, f"select p.patent_id, n.alias_name from patents p join alias_names n on n.alias_key = {t.key(t.first('p.applicant_raw'))}"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.lookup_key(text.first_part(F.col("applicant_raw"))).alias("alias_key")).join(companies.alias_names(t.aliases(s, d)), "alias_key").select("patent_id", "alias_name")
)

# shapes of report rows
_YEARS = list(range(1992, 2002))
query("W12_pivot_year", _with(t.EXPANDED_SQL, f"select applicant_display_name, {', '.join(f'nullif(count(*) filter (application_year = {y}), 0) as {chr(34)}{y}{chr(34)}' for y in _YEARS)}, count(*)::bigint as total from expanded where trim(applicant_display_name) != '' and application_year is not null group by 1"))(
    lambda s, d: pivots.by_year(_report("applicant_year_matrix")(s, d), "applicant_display_name", _YEARS)
)
_OFFICES = ["US", "EP", "JP", "CN"]
_CELLS = ", ".join(f"nullif(count(*) filter (country_code = '{c}'), 0) as {c}" for c in _OFFICES)
query("W13_pivot_entity", with_tables(f", r as (select * from patents where application_year is not null) select application_year::varchar as application_year, {_CELLS} from r group by 1 union all select '總件數', {_CELLS} from r", "patents"))(
    lambda s, d: pivots.by_entity(t.patents(s, d).where("application_year is not null").groupBy("application_year", "country_code").agg(F.count(F.lit(1)).alias("patent_count")), "country_code", _OFFICES)
)
query("W14_country_status", with_tables(f""", r as (select country_code, {t.state()} as s from patents where trim(country_code) != '')
select country_code, count(*) filter (s = 'alive') as granted, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'dead') as dead, count(*) filter (s = 'unknown') as unknown, count(*) as total from r group by 1""", "patents"))(
    lambda s, d: pivots.by_status(t.patents(s, d).where(text.is_filled(F.col("country_code"))).groupBy("country_code", "legal_status").agg(F.count(F.lit(1)).alias("patent_count")))
)
query("W15_year_summary", _with(t.EXPANDED_SQL, "select applicant_display_name, count(*) as patents, min(application_year) as first_year, max(application_year) as last_year, max(application_year) - min(application_year) + 1 as span, count(distinct application_year) as active_years from expanded where trim(applicant_display_name) != '' and application_year is not null group by 1"))(
    lambda s, d: pivots.year_summary(_report("applicant_year_matrix")(s, d))
)
query("W16_segments", f"select applicant_display_name, greatest(patent_count - joint_count, 0) as solo_count, joint_count, least(solo_transferred_count, greatest(patent_count - joint_count, 0)) as solo_transferred, least(joint_transferred_count, joint_count) as joint_transferred from ({RANKING_SQL})")(
    lambda s, d: pivots.segments(_report("applicant_ranking")(s, d))
)
query("AG20_class_collapse", with_tables(f", r as (select upper(regexp_replace(ipc_main, '[^A-Za-z0-9]', '', 'g')) as c from patents where {_CODES.format('ipc_main')}) select substr(c, 1, 4) as key, count(*) as patent_count from r group by 1", "patents"))(
    lambda s, d: pivots.collapse(_report("ipc_main_distribution")(s, d), text.classification_level(F.col("ipc_main"), 4))
)
query("J14_full_years", _with(t.BASE_SQL, "select coalesce(a.y, g.y) as year, coalesce(a.n, 0) as applications, coalesce(g.n, 0) as grants from (select application_year as y, count(*) as n from base where application_year is not null group by 1) a full join (select grant_year as y, count(*) as n from base where grant_year is not null group by 1) g on a.y = g.y"))(
    lambda s, d: pivots.full_years(_report("application_trend")(s, d), _report("publication_trend")(s, d))
)
query("SNK4_truncated", _with(t.EXPANDED_SQL, "select *, count(*) over () as rows_total from (select applicant_display_name, count(*) as patent_count from expanded group by 1) order by patent_count desc, applicant_display_name limit 20"))(
    lambda s, d: pivots.truncated(t.expanded(s, d).groupBy("applicant_display_name").agg(F.count(F.lit(1)).alias("patent_count")), [F.col("patent_count").desc(), F.col("applicant_display_name")], 20)
)
query("SNK5_fingerprint", f"""with r as (select * from ({ORACLES['R3_country_distribution']})),
j as (select sha256('{{' || array_to_string(list_filter([case when country_code is not null then '"country_code":' || to_json(country_code)::varchar end, case when legal_status is not null then '"legal_status":' || to_json(legal_status)::varchar end, '"patent_count":' || patent_count], lambda x: x is not null), ',') || '}}') as d from r)
select count(*) as rows, bit_xor(('0x' || substr(d, 1, 15))::bigint) as fingerprint from j""")(lambda s, d: pivots.fingerprint(_report("country_distribution")(s, d)))
query("A4_A5_A6_aggregates", _with(t.BASE_SQL, """select country_code, count(*) filter (trim(grant_no) != '') as granted, coalesce(string_agg(distinct nullif(trim(patent_type), ''), '; ' order by nullif(trim(patent_type), '')), '') as types,
  count(distinct application_year) as years, avg(application_year)::decimal(12, 2) as mean_year, max(application_year) as last_year from base group by 1"""))(
    lambda s, d: t.base_table(s, d).groupBy("country_code").agg(*[reports.aggregate(f, c, "country_code", None).alias(n) for f, c, n in (("count_nonblank", "grant_no", "granted"), ("string_agg_distinct_nonblank", "patent_type", "types"), ("count_distinct", "application_year", "years"), ("avg", "application_year", "mean_year"), ("max", "application_year", "last_year"))])
)

# profiles
_ONE = ", x as (select distinct on (applicant_display_name, patent_id) * from expanded where trim(applicant_display_name) != '')"
query("AG12_strength", _with(t.EXPANDED_SQL, f"""{_ONE} select applicant_display_name as applicant, count(*) as patent_count, count(distinct {t.FAMILY_SQL}) as family_count, count(distinct nullif(trim(country_code), '')) as country_count,
  count(*) filter ({t.state()} = 'alive') as granted_count, count(*) filter ({t.state()} = 'pending') as pending_count, count(*) filter ({t.state()} = 'dead') as dead_count, count(*) filter ({t.state()} = 'unknown') as unknown_count,
  count(*) filter (upper(trim(document_kind)) in ('S', 'S1')) as design_count, count(*) filter (upper(trim(document_kind)) not in ('S', 'S1') and patent_type = 'U') as utility_count, count(*) filter (upper(trim(document_kind)) not in ('S', 'S1') and patent_type = 'P') as invention_count,
  count(*) filter (upper(trim(document_kind)) not in ('S', 'S1') and patent_type is null) as unmarked_count, 0::bigint as topic_count, count(distinct substr(nullif(trim(ipc_main), ''), 1, 4)) as ipc_subclass_count from x group by 1 order by patent_count desc, applicant limit 10"""))(
    lambda s, d: profiles.strength(t.expanded(s, d))
)
query("AG13_key_players", _with(t.EXPANDED_SQL, f"""{_ONE}, h as (select patent_id, count(*) as n from x group by 1)
select applicant_display_name as applicant, count(*) as patent_count, coalesce(string_agg(distinct application_year::varchar, ',' order by application_year::varchar), '') as years, count(distinct application_year) >= 3 as has_trajectory, count(*) filter (n > 1) as joint_count, count(*) filter (n = 1) as solo_count from x join h using (patent_id) group by 1 order by patent_count desc, applicant limit 10"""))(
    lambda s, d: profiles.key_players(t.expanded(s, d))
)
query("J13_partners", _with(t.EXPANDED_SQL, f"{_ONE} select a.applicant_display_name as applicant, b.applicant_display_name as partner, count(*) as patents from x a join x b using (patent_id) where a.applicant_display_name != b.applicant_display_name group by 1, 2"))(lambda s, d: profiles.partners(t.expanded(s, d)))
query("AG15_AG16_designs", _with(t.EXPANDED_SQL, f"""{_ONE}, g as (select applicant_display_name as applicant, count(*) filter (dd) as design_count, count(*) filter (not dd) as tech_count, min(application_year) filter (dd) as first_design_year, max(application_year) filter (dd) as latest_design_year, min(application_year) filter (not dd) as first_tech_year,
  arg_min(patent_id, coalesce(application_year, 9999) * 100000000000 + patent_id) filter (dd) as representative_design_patent_id from (select *, upper(trim(document_kind)) in ('S', 'S1') as dd from x) group by 1)
select *, case when tech_count > 0 then '技術+設計' else '只走設計' end as strategy_type, case when first_design_year is null or first_tech_year is null then '' when first_design_year < first_tech_year then '設計先行 ' || (first_tech_year - first_design_year) || ' 年' when first_tech_year < first_design_year then '技術先行 ' || (first_design_year - first_tech_year) || ' 年' else '同年同步' end as filing_order
from g where design_count > 0 order by design_count desc, tech_count desc, applicant limit 20"""))(lambda s, d: profiles.designs(t.expanded(s, d)))
query("AG4_AG5_cover", with_tables(f", x as (select *, {t.state()} as s from patents) select count(*) as patents, count(distinct {t.FAMILY_SQL}) as families, count(distinct nullif(trim(country_code), '')) as countries, count(*) filter (s = 'alive') as granted, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'dead') as dead, count(*) filter (s = 'unknown') as unknown, min(application_year) as first_year, max(application_year) as last_year from x", "patents"))(
    lambda s, d: t.patents(s, d).agg(
        F.count(F.lit(1)).alias("patents"), F.count_distinct(text.surrogate_family(F.col("family_id_raw"), F.col("patent_id"))).alias("families"), F.count_distinct(text.blank_to_null(F.col("country_code"))).alias("countries"),
        *[F.count_if(status.normalize(F.col("legal_status")) == k).alias(n) for k, n in ((status.ALIVE, "granted"), (status.PENDING, "pending"), (status.DEAD, "dead"), (status.UNKNOWN, "unknown"))],
        F.min("application_year").alias("first_year"), F.max("application_year").alias("last_year"),
    )
)
query("AG6_kinds", with_tables(", x as (select case when upper(trim(document_kind)) in ('S', 'S1') then '設計' when patent_type = 'U' then '新型' when patent_type = 'P' then '發明' else '未標示' end as kind from patents) select kind, count(*) as patents from x group by 1", "patents"))(
    lambda s, d: t.patents(s, d).groupBy(status.patent_kind(F.col("document_kind"), F.col("patent_type")).alias("kind")).agg(F.count(F.lit(1)).alias("patents"))
)
