"""Patent tables projected from order tables, so that every operator runs on rows of any scale.

One statement in the common part of Spark's and ANSI SQL serves both a Spark plan and an independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patquarry.sources.derived import derived

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

_FIRST_ITEM = "select l_orderkey, min(l_partkey) as pk, min(l_suppkey) as sk from {lineitem} group by l_orderkey"

PATENTS = f"""
select cast(o.o_orderkey + 1 as bigint) as patent_id,
  case when o.o_orderkey % 29 = 0 then '  '
       when o.o_orderkey % 7 = 0 then concat(c.c_name, ' | Customer#', lpad(cast(c.c_custkey % 40 as string), 9, '0'))
       else c.c_name end as applicant_raw,
  case when o.o_orderkey % 29 = 0 then null else upper(c.c_name) end as applicant_std,
  case when c.c_custkey % 3 = 0 then concat('AC', cast(c.c_custkey % 60 as string)) end as applicant_code,
  coalesce(s.s_name, '') as owner_raw, upper(s.s_name) as owner_std,
  case when s.s_suppkey % 2 = 0 then concat('AC', cast(s.s_suppkey % 60 as string)) end as owner_code,
  case when o.o_orderkey % 11 = 0 then c.c_name when o.o_orderkey % 4 = 0 then ' ' else s.s_name end as assignee_raw,
  case c.c_nationkey % 9 when 0 then 'US' when 1 then 'EP' when 2 then 'JP' when 3 then 'KR' when 4 then 'CN' when 5 then 'TW' when 6 then 'WO' when 7 then 'DE' else ' ' end as country_code,
  case when o.o_orderkey % 31 = 0 then null else cast(year(o.o_orderdate) as int) end as application_year,
  case when o.o_orderstatus = 'F' then concat(cast(year(o.o_orderdate) + 2 as string), '-03-01') else '' end as grant_date_text,
  case when o.o_orderkey % 37 = 0 then 'unseen' when o.o_orderkey % 41 = 0 then null
       when o.o_orderstatus = 'F' then '授权' when o.o_orderstatus = 'O' then '审查中' else '到期(Expiration of the term)' end as legal_status,
  case when o.o_orderkey % 5 = 0 then ' ' else concat('F', cast(cast(floor(o.o_orderkey / 3) as bigint) as string)) end as family_id_raw,
  case when o.o_orderkey % 6 = 0 then null else concat('US-', cast(o.o_orderkey % 3 as string), ' | EP-0 | JP-1 | oops | etc-2 | US-1') end as family_counts_raw,
  case when o.o_orderkey % 19 = 0 then '' when o.o_orderkey % 17 = 0 then '21-02'
       else concat(substr('ABCDEFGH', cast(coalesce(i.pk, 0) % 8 as int) + 1, 1), lpad(cast(coalesce(i.pk, 0) % 40 as string), 2, '0'), 'K ', cast(coalesce(i.pk, 0) % 50 as string), '/', lpad(cast(coalesce(i.pk, 0) % 20 as string), 2, '0')) end as ipc_main,
  case when o.o_orderkey % 13 = 0 then ' ' else concat('Y', lpad(cast(coalesce(i.pk, 0) % 30 as string), 2, '0'), 'B ', cast(coalesce(i.sk, 0) % 9 as string), '/00') end as cpc_main,
  case when o.o_orderpriority = '1-URGENT' then 'U' when o.o_orderpriority = '5-LOW' then null else 'P' end as patent_type,
  case when o.o_orderkey % 23 = 0 then ' s' else 'B2' end as document_kind,
  concat('Title of ', coalesce(p.p_name, 'nothing')) as title,
  case when o.o_orderkey % 3 = 0 then '' else concat('1. A ', coalesce(p.p_name, 'thing'), ' having a part.') end as independent_claims,
  concat('Main: ', coalesce(p.p_type, 'none')) as main_claim, cast(null as string) as all_claims,
  case when o.o_orderkey % 2 = 0 then concat('B', cast(o.o_orderkey as string)) else ' ' end as grant_no,
  concat(cast(year(o.o_orderdate) as string), cast(10000 + o.o_orderkey % 89999 as string)) as application_no,
  cast(o.o_orderdate as date) as application_date
from {{orders}} o join {{customer}} c on o.o_custkey = c.c_custkey
left join ({_FIRST_ITEM}) i on i.l_orderkey = o.o_orderkey
left join {{supplier}} s on s.s_suppkey = i.sk left join {{part}} p on p.p_partkey = i.pk
"""

ALIASES = """
select cast(c_custkey + 1 as bigint) as alias_id, concat('AC', cast(c_custkey % 60 as string)) as code,
  case when c_custkey % 4 = 0 then concat('公司', cast(c_custkey % 20 as string)) end as name_zh,
  case when c_custkey % 10 = 6 then '' else concat('COMPANY ', cast(c_custkey % 90 as string)) end as name_norm,
  concat(' ', replace(c_name, '#', ' #')) as alias_text, c_name as alias,
  case when c_custkey % 9 = 0 then 'review_required' else 'confirmed' end as review_status,
  cast(c_custkey % 13 as int) as updated
from {customer} where c_custkey % 2 = 0
union all
select cast(100000000 + s_suppkey as bigint), concat('AC', cast(s_suppkey % 60 as string)), null, concat('SUPPLY ', cast(s_suppkey % 7 as string)), s_name, s_name, 'confirmed', 0
from {supplier} where s_suppkey % 3 = 0
"""

GROUPS = """
select distinct concat('COMPANY ', cast(c_custkey % 90 as string)) as company, concat('GROUP ', cast(c_custkey % 90 % 7 as string)) as group_name,
  case when c_custkey % 90 % 5 = 0 then 'suggested' else 'confirmed' end as review_status
from {customer}
"""

#: (channel, patent, run): several runs; later ones win; a null distance and a merged topic occur.
ASSIGNMENTS = """
select cast(o_orderkey + 1 as bigint) as patent_id, 'technical' as channel, cast(1 + o_orderkey % 3 as int) as run_id,
  concat('T', lpad(cast(1 + (o_orderkey % 7) as string), 3, '0')) as topic_code,
  case when o_orderkey % 43 = 0 then null else cast(o_orderkey % 97 as double) / 97 end as distance
from {orders} where o_orderkey % 8 != 0
union all
select cast(o_orderkey + 1 as bigint), 'technical', 9, concat('T', lpad(cast(1 + (o_orderkey % 5) as string), 3, '0')), cast(o_orderkey % 89 as double) / 89
from {orders} where o_orderkey % 6 = 0
union all
select cast(o_orderkey + 1 as bigint), 'effect', 2, concat('T', lpad(cast(1 + (o_custkey % 4) as string), 3, '0')), cast(o_orderkey % 83 as double) / 83
from {orders} where o_orderkey % 10 != 0
"""

#: Workspaces of patent ids: every tenth order's customer nation names one.
MEMBERS = """
select cast(c.c_nationkey % 5 + 1 as int) as workspace_id, cast(o.o_orderkey + 1 as bigint) as patent_id, cast(o.o_orderkey as bigint) as added
from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 2 = 0
"""

NAMES = {"patents": PATENTS, "aliases": ALIASES, "company_groups": GROUPS, "assignments": ASSIGNMENTS, "members": MEMBERS}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(sf_dir: str, name: str) -> list[str]:
    """The files that one of ``NAMES`` is made from."""
    return [f"{sf_dir}/{t}.parquet" for t in TABLES if "{" + t + "}" in NAMES[name]]


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``NAMES`` made anew."""
    sql = NAMES[name]
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``NAMES``, built at its first use; after that only the columns that a query uses are read."""
    return derived(spark, name, sources(sf_dir, name), lambda: build(spark, sf_dir, name))


def as_sql(name: str) -> str:
    """The projection as SQL over tables of the plain names."""
    return NAMES[name].format(**{t: t for t in TABLES})


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the projections named before it."""
    head = ",\n".join(f"{n} as ({as_sql(n)})" for n in names)
    return f"with {'recursive ' if recursive else ''}{head}\n{body}" if not body.lstrip().startswith(",") else f"with {'recursive ' if recursive else ''}{head}{body}"
