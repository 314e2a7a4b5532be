"""Derived tables that queries share, each as a DataFrame and as SQL."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from patquarry.plans import base, companies, family
from patquarry.sources.derived import derived
from patquarry.sources.projection import as_sql, project, sources as files


def patents(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "patents")


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "aliases")


def _derived(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return derived(spark, name, [*files(d, "patents"), *files(d, "aliases")], build)


def names(spark: SparkSession, d: str) -> companies.Names:
    """Names by alias and code, rebuilt when the aliases have changed."""
    made = {"alias_names": companies.alias_names, "lowest_alias_names": companies.lowest_alias_names, "code_names": companies.code_names}
    return companies.Names(*[derived(spark, n, files(d, "aliases"), lambda f=f: f(aliases(spark, d))) for n, f in made.items()])


def base_table(spark: SparkSession, d: str) -> DataFrame:
    """A row a patent with its display names, rebuilt when its sources have changed."""
    return _derived(spark, d, "report_base", lambda: base.patent_base(patents(spark, d), names(spark, d)))


def expanded(spark: SparkSession, d: str) -> DataFrame:
    """A row a patent and applicant, rebuilt when its sources have changed."""
    return _derived(spark, d, "report_applicants", lambda: base.applicant_expanded(patents(spark, d), names(spark, d), people(spark, d)))


def people(spark: SparkSession, d: str) -> DataFrame:
    """A row a patent and applicant with the names alone, rebuilt when its sources have changed."""
    return _derived(spark, d, "applicant_names", lambda: companies.applicants(patents(spark, d), names(spark, d)))


def families(spark: SparkSession, d: str) -> DataFrame:
    """A row a family and country, rebuilt when its sources have changed."""
    return _derived(spark, d, "family_country", lambda: family.by_country(patents(spark, d)))


class Sources(Mapping):
    """The tables that reports read, each built when it is asked for; in the group scope with groups' names."""

    def __init__(self, spark: SparkSession, d: str, scope: str = "company") -> None:
        if scope not in ("company", "group"):
            raise ValueError(f"unknown scope {scope}")
        self.spark, self.d, self.scope = spark, d, scope
        self.made = {"base": base_table, "expanded": expanded, "family_country": families}

    def __getitem__(self, name: str) -> DataFrame:
        df = self.made[name](self.spark, self.d)
        return base.with_groups(df, project(self.spark, self.d, "company_groups")) if self.scope == "group" and name != "family_country" else df

    def having(self, name: str, columns: Collection[str]) -> DataFrame:
        """A table that has these columns at least: without display names the base is the patents, and no names converge for it."""
        if name == "base" and not set(columns) & set(base.COLUMNS):
            return base.plain_base(patents(self.spark, self.d))
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


_KEY = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"


def key(c: str) -> str:
    return _KEY.format(c)


def first(c: str) -> str:
    return f"nullif(trim(split_part({c}, '|', 1)), '')"


def converged(raw: str, std: str, out: str, code: str | None, n: str) -> str:
    """SQL of one convergence: the CTE ``conv_n`` of patent_id and the name."""
    more = f"""
corpus_{n} as (
  select coalesce(s.code, r.code) as code, coalesce(s.v, r.v) as corpus_name from
  (select code, v from (select {code} as code, {first(std)} as v, row_number() over (partition by {code} order by count(*) desc, {first(std)}) as k from patents where trim({code}) != '' and {first(std)} is not null group by 1, 2) where k = 1) s
  full join (select code, v from (select {code} as code, {first(raw)} as v, row_number() over (partition by {code} order by count(*) desc, {first(raw)}) as k from patents where trim({code}) != '' and {first(raw)} is not null group by 1, 2) where k = 1) r on s.code = r.code
),""" if code else ""
    joins = f"left join code_names cn on cn.code = p.{code} left join corpus_{n} co on co.code = p.{code}" if code else ""
    ways = "cn.code_name, a1.alias_name, a2.alias_name, co.corpus_name" if code else "a1.alias_name, a2.alias_name"
    return f"""{more}
conv_{n} as (
  select p.patent_id, coalesce({ways}, {first(f'p.{std}')}, {first(f'p.{raw}')}) as {out} from patents p {joins}
  left join alias_names a1 on a1.alias_key = {key(first(f'p.{std}'))} left join alias_names a2 on a2.alias_key = {key(first(f'p.{raw}'))}
)"""


NAMES_SQL = f"""patents as ({as_sql('patents')}),
aliases as ({as_sql('aliases')}),
confirmed as (select alias_id, code, {key('alias')} as alias_key, nullif(trim(name_zh), '') as zh, nullif(trim(name_norm), '') as norm from aliases where review_status = 'confirmed'),
code_names as (
  select c.code, coalesce(max(c.zh), max(m.norm)) as code_name from confirmed c
  left join (select code, norm from (select code, norm, row_number() over (partition by code order by count(*) desc, norm) as k from confirmed where norm is not null group by code, norm) where k = 1) m on m.code = c.code
  where c.zh is not null or c.norm is not null group by c.code
),
alias_names as (select alias_key, name as alias_name from (select alias_key, coalesce(zh, norm) as name, row_number() over (partition by alias_key order by zh is null, alias_id) as k from confirmed where alias_key != '' and coalesce(zh, norm) is not null) where k = 1),
low_names as (select alias_key, name as alias_name from (select alias_key, coalesce(zh, norm) as name, row_number() over (partition by alias_key order by alias_id) as k from confirmed where alias_key != '' and coalesce(zh, norm) is not null) where k = 1)"""

BASE_SQL = f"""{NAMES_SQL},{converged('applicant_raw', 'applicant_std', 'applicant_display_name', 'applicant_code', 'a')},{converged('owner_raw', 'owner_std', 'current_assignee_display_name', 'owner_code', 'o')},{converged('assignee_raw', 'assignee_raw', 'recent_assignee_display_name', None, 'r')},
base as (
  select p.*, a.applicant_display_name, o.current_assignee_display_name, r.recent_assignee_display_name, try_cast(nullif(regexp_extract(p.grant_date_text, '^\\s*(\\d{{4}})', 1), '') as int) as grant_year
  from patents p join conv_a a using (patent_id) join conv_o o using (patent_id) join conv_r r using (patent_id)
)"""

EXPANDED_SQL = f"""{NAMES_SQL},{converged('assignee_raw', 'assignee_raw', 'recent_assignee_display_name', None, 'r')},
parts as (select p.*, unnest(string_split(p.applicant_raw, '|')) as part, generate_subscripts(string_split(p.applicant_raw, '|'), 1) as at from patents p),
expanded as (
  select p.*, trim(p.part) as applicant_name, row_number() over (partition by p.patent_id order by p.at) as applicant_no, coalesce(n.alias_name, trim(p.part)) as applicant_display_name, r.recent_assignee_display_name
  from parts p join conv_r r using (patent_id) left join low_names n on n.alias_key = {key('p.part')} where trim(p.part) != ''
)"""

#: The state of a legal status, and the surrogate family.
STATE_SQL = "case when trim({0}) in ('授权') then 'alive' when trim({0}) in ('审查中') then 'pending' when trim({0}) like '到期%' then 'dead' else 'unknown' end"
FAMILY_SQL = "coalesce(nullif(trim(family_id_raw), ''), 'P' || patent_id)"


def state(c: str = "legal_status") -> str:
    return STATE_SQL.format(c)

