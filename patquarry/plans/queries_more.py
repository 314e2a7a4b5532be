"""Queries of joins, imports, scopes and topic steps that the other modules leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from patquarry.functions import status, text
from patquarry.operators import clustering, profiles, sets, topics, upsert
from patquarry.plans import adhoc, family, reports, tables as t
from patquarry.plans.catalog import ORACLES, query
from patquarry.plans.queries_reports import RANKING_SQL
from patquarry.plans.queries_topics import opportunity
from patquarry.sources import readers
from patquarry.sources.projection import as_sql, load, project, with_tables

# joins
_LISTS = "lists as (select patent_id, list_filter(list_transform(string_split(applicant_raw, '|'), lambda x: trim(x)), lambda x: x != '') as a, list_filter(list_transform(string_split(coalesce(assignee_raw, ''), '|'), lambda x: trim(x)), lambda x: x != '') as b from patents)"


def _people(s, d):  # noqa: ANN001, ANN202
    return t.patents(s, d).select("patent_id", F.inline(text.merge_people(applicant=text.split_multi_value(F.col("applicant_raw")), assignee=text.split_multi_value(F.col("assignee_raw")))))


query("J1_left_people", with_tables(f", {_LISTS} select p.patent_id, p.title, l.a[1] as applicant, l.b[1] as assignee from patents p left join lists l using (patent_id)", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", "title").join(_people(s, d).where("sequence = 1").drop("sequence"), "patent_id", "left")
)


def _vectors(s, d):  # noqa: ANN001, ANN202
    return load(s, d, "embeddings").select((F.col("vec_id") + 1).alias("patent_id"), F.col("label").alias("created"), F.col("vec_id").alias("embedding_id"), F.col("embedding").alias("vector"))


_LAST = "last as (select vec_id + 1 as patent_id, arg_max(vec_id, label * 1000000000000 + vec_id) as embedding_id from embeddings group by 1)"
query("J4_T2_corpus", with_tables(f", members as ({as_sql('members')}), {_LAST} select patent_id, independent_claims as text, embedding_id from patents join last using (patent_id) where trim(independent_claims) != '' and upper(trim(document_kind)) not in ('S', 'S1') and patent_id in (select patent_id from members where workspace_id in (1, 2))", "patents"))(
    lambda s, d: clustering.corpus(t.patents(s, d), _vectors(s, d), "independent_claims", project(s, d, "members").where("workspace_id in (1, 2)")).drop("vector")
)
query("J5_P4_split_join", with_tables(" select patent_id, i::int as part, p[i + 1] as name from (select patent_id, regexp_split_to_array(applicant_raw, ' *\\| *') as p from patents), unnest(range(len(p))) as u(i)", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", F.posexplode(F.split("applicant_raw", r" *\| *")).alias("part", "name"))
)
query("J7_semi_join", with_tables(f", members as ({as_sql('members')}) select patent_id, title from patents where exists (select 1 from members m where m.patent_id = patents.patent_id and m.workspace_id = 3)", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", "title").join(project(s, d, "members").where("workspace_id = 3").select("patent_id"), "patent_id", "left_semi")
)
query("J9_one_subject", "with v as (select vec_id as patent_id, embedding::double[] as v from embeddings), s as (select v as w from v where patent_id = 3) select patent_id, round(1 - list_cosine_similarity(v, w), 9) as distance from v, s where patent_id != 3")(
    lambda s, d: _distances(load(s, d, "embeddings"), 3)
)


def _distances(vectors: DataFrame, subject: int) -> DataFrame:
    one = F.broadcast(vectors.where(F.col("vec_id") == subject).select(F.col("embedding").alias("w")))
    return vectors.where(F.col("vec_id") != subject).join(one).select(F.col("vec_id").alias("patent_id"), F.round(sets.cosine_distance(F.col("embedding"), F.col("w")), 9).alias("distance"))


query("J10_count_as_value", f"with {t.BASE_SQL} select recent_assignee_display_name as applicant_display_name, count(*) as acquired_count from base where recent_assignee_display_name is not null group by 1")(
    lambda s, d: reports.count_as_value(t.base_table(s, d), "recent_assignee_display_name", "applicant_display_name", "acquired_count")
)
query("J12_null_safe", with_tables(f" select patent_id, {t.first('applicant_raw')} is distinct from {t.first('assignee_raw')} as moved from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", (~text.first_part(F.col("applicant_raw")).eqNullSafe(text.first_part(F.col("assignee_raw")))).alias("moved"))
)
query("S3_union_all", with_tables(" select workspace_id, patent_id from members where workspace_id = 1 union all select workspace_id, patent_id from members where workspace_id in (1, 4)", "members"))(
    lambda s, d: reduce(DataFrame.unionByName, [project(s, d, "members").where(F.col("workspace_id").isin(*w)).select("workspace_id", "patent_id") for w in ([1], [1, 4])])
)
query("S4_normalized_ids", with_tables(" select patent_id, array_to_string(list_sort(list_distinct([patent_id, 7, patent_id % 5 + 1, patent_id])), ',') as ids from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", F.array_join(sets.normalize_ids(F.array("patent_id", F.lit(7).cast("long"), F.col("patent_id") % 5 + 1, "patent_id")), ",").alias("ids"))
)

# scalars
query("P12_kinds", with_tables(" select patent_id, upper(trim(document_kind)) in ('S', 'S1') as design, case when upper(trim(document_kind)) in ('S', 'S1') then '設計' when patent_type = 'U' then '新型' when patent_type = 'P' then '發明' else '未標示' end as kind from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", status.is_design(F.col("document_kind")).alias("design"), status.patent_kind(F.col("document_kind"), F.col("patent_type")).alias("kind"))
)
query("P17_ep_contribution", with_tables(" select patent_id, case when patent_id % 3 = 0 then 'countries' when patent_id % 4 = 0 then 'missing' when patent_id % 4 = 1 then 'countries' else 'in_transition' end as kind from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", family.ep_contribution(_designated(), F.when(F.col("patent_id") % 3 == 0, "GB").otherwise(" ")).alias("kind"))
)


def _designated():  # noqa: ANN202
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("C"), i.cast("string"))), " | ")
    return F.when(F.col("patent_id") % 4 == 0, "").when(F.col("patent_id") % 4 == 1, "DE | FR").otherwise(many)


query("P18_class_levels", with_tables(" select patent_id, substr(regexp_replace(ipc_main, '[^A-Za-z0-9]', '', 'g'), 1, 4) as subclass, trim(split_part(ipc_main, '/', 1)) as main_group from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.classification_level(F.col("ipc_main"), 4).alias("subclass"), text.classification_level(F.col("ipc_main"), 5).alias("main_group"))
)
query("P23_filing_order", with_tables(""", y as (select country_code, min(application_year) filter (upper(trim(document_kind)) in ('S', 'S1')) as a, min(application_year) filter (upper(trim(document_kind)) not in ('S', 'S1')) as b from patents group by 1)
select country_code, case when a is null or b is null then '' when a < b then '設計先行 ' || (b - a) || ' 年' when b < a then '技術先行 ' || (a - b) || ' 年' else '同年同步' end as filing_order from y""", "patents"))(
    lambda s, d: t.patents(s, d).groupBy("country_code").agg(
        F.min(F.when(status.is_design(F.col("document_kind")), F.col("application_year"))).alias("a"), F.min(F.when(~status.is_design(F.col("document_kind")), F.col("application_year"))).alias("b")
    ).select("country_code", profiles.filing_order(F.col("a"), F.col("b")).alias("filing_order"))
)

# imports
query("ING1_ING2_normalized", with_tables(""" select patent_id, title as name, coalesce(nullif(trim(legal_status), ''), patent_type) as legal_status,
  coalesce(try_cast(nullif(grant_date_text, '') as date), application_date)::varchar as publication_date from patents""", "patents"))(
    lambda s, d: _normalized(s, d)
)


def _normalized(s, d):  # noqa: ANN001, ANN202
    raw = readers.rename_headers(t.patents(s, d).select(F.col("patent_id").cast("string").alias("patent_id"), F.col("title").alias("標題"), F.col("title").alias("name"), "legal_status", "patent_type", "grant_date_text", F.col("application_date").cast("string").alias("filed")), {"標題": "name"})
    found = readers.normalized(raw, ["patent_id", "name"], {"publication_date": ["grant_date_text", "filed"]}, "legal_status", "patent_type")
    return found.withColumn("patent_id", F.col("patent_id").cast("long")).withColumn("publication_date", F.col("publication_date").cast("string"))


query("ING3_new_files", "select distinct sha256(text) as digest from documents where text is not null and sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0 and text is not null)")(
    lambda s, d: readers.new_files(load(s, d, "documents").where("text is not null").select(F.col("text").cast("binary").alias("content")), load(s, d, "documents").where("doc_id % 3 = 0 and text is not null").select(F.sha2("text", 256).alias("digest"))).select("digest")
)
query("ING7_scan_statistics", with_tables(" select nullif(trim(legal_status), '') as legal_status, count(*) as n from patents group by 1", "patents"))(lambda s, d: readers.scan_statistics(t.patents(s, d), "legal_status"))
query("ING7_bad_tokens", with_tables(" select trim(x) as token, count(*) as n from (select unnest(string_split(family_counts_raw, '|')) as x from patents) where trim(x) != '' and not regexp_matches(trim(x), '^[A-Za-z]+\\s*-\\s*\\d+$') group by 1", "patents"))(
    lambda s, d: t.patents(s, d).select(F.explode(family.bad_tokens(F.col("family_counts_raw"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
)
_ENTRY = "array<struct<from_status:string,to_status:string,source:string>>"
query("U2_status_guard", with_tables(""", h as (select *, patent_id % 3 = 0 as manual, patent_id % 4 = 1 as differs from patents)
select patent_id, case when differs and not manual then '公开' else legal_status end as legal_status, differs and manual as conflict, (patent_id % 3 < 2)::int + (differs and not manual)::int as entries from h""", "patents"))(
    lambda s, d: upsert.guard_status(
        t.patents(s, d).select(
            "patent_id", "legal_status", F.when(F.col("patent_id") % 4 == 0, " ").when(F.col("patent_id") % 4 == 1, "公开").otherwise(F.col("legal_status")).alias("incoming"),
            F.expr(f"cast(case patent_id % 3 when 0 then array(named_struct('a', null, 'b', '授权', 'c', null)) when 1 then array(named_struct('a', null, 'b', '公开', 'c', 'import')) end as {_ENTRY})").alias("history"),
        )
    ).select("patent_id", "legal_status", "conflict", F.size(F.coalesce("history", F.array())).alias("entries"))
)
query("U3_fold", "select o_custkey as patent_id, arg_max(o_orderpriority, o_orderkey) filter (o_orderkey % 3 != 0) as title, arg_max(o_orderstatus, o_orderkey) filter (o_orderkey % 2 = 0) as state from orders group by 1")(
    lambda s, d: upsert.fold(
        load(s, d, "orders").select(F.col("o_custkey").alias("patent_id"), F.col("o_orderkey").alias("row_no"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("state")), "patent_id", ["title", "state"]
    )
)

# reports
_CLUSTER = ("applicant_strength_profile", "cluster_topic_table", "opportunity_quadrant")
_MADE = ("application_trend", "country_distribution", "ipc_main_distribution")


def _batch(s, d):  # noqa: ANN001, ANN202
    found = reports.run_batch(t.Sources(s, d), [*_MADE, *_CLUSTER, "nothing"], aliases=t.aliases(s, d))
    rows = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count", F.lit(None).cast("string").alias("skipped")) for n, df in found.items() if isinstance(df, DataFrame)]
    skipped = s.createDataFrame([(n, None, why) for n, why in found.items() if isinstance(why, str)], "name string, row_count long, skipped string")
    return reduce(DataFrame.unionByName, [*rows, skipped])


query("R11_R12_R13_R14_batch", " union all ".join([f"select '{n}' as name, (select count(*) from ({ORACLES[q]})) as row_count, null::varchar as skipped" for n, q in zip(_MADE, ("R1_application_trend", "R3_country_distribution", "R5_ipc_main"), strict=True)] + [f"select '{n}', null, 'made from topics'" for n in _CLUSTER] + ["select 'nothing', null, 'unknown report'"]))(_batch)


def _cited(s, d):  # noqa: ANN001, ANN202
    """The base table with the items of an order as citations, none for some, and their largest number as inventors."""
    items = load(s, d, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("patent_id")).agg(F.count(F.lit(1)).alias("cited_count"), F.max("l_linenumber").cast("long").alias("inventor_count"))
    return {"base": t.base_table(s, d).join(items, "patent_id", "left")}


_CITED = f"with {t.BASE_SQL}, cited as (select * from base left join (select l_orderkey + 1 as patent_id, count(*) as cited_count, max(l_linenumber)::bigint as inventor_count from lineitem group by 1) using (patent_id))"
query("R15_top_cited", f"{_CITED} select patent_id, title, application_year, applicant_display_name, cited_count from cited where cited_count is not null order by cited_count desc, patent_id limit 50")(lambda s, d: reports.run_report(_cited(s, d), "top_cited_patents"))
query("R15_rd_energy", f"""{_CITED} select applicant_display_name, count(*) as patent_count, coalesce(sum(cited_count), 0)::bigint as cited_total, coalesce(sum(inventor_count), 0)::bigint as inventor_total, count(cited_count) as cited_rows
from cited where trim(applicant_display_name) != '' group by 1 order by patent_count desc, 1 limit 30""")(lambda s, d: reports.run_report(_cited(s, d), "company_rd_energy"))
query("W11_limits", f"select * from ({RANKING_SQL}) order by patent_count desc, applicant_display_name limit 7")(
    lambda s, d: reports.run_report(t.Sources(s, d), "applicant_ranking", limit=7, aliases=t.aliases(s, d))
)
query("W19_opportunity_rows", f"select channel, topic_code as label, patent_count, applicant_count, quadrant, case when leading_applicants = '' then '—' else leading_applicants end as leading_applicants, leading_applicant_count, patent_median, applicant_median from ({ORACLES['AG11_P22_opportunity']})")(
    lambda s, d: opportunity(s, d).withColumnRenamed("topic_code", "label").withColumn("leading_applicants", F.when(F.col("leading_applicants") == "", "—").otherwise(F.col("leading_applicants")))
)
query("AG14_player_groups", f"select *, case when has_trajectory then 'trajectory' else 'technical' end as part from ({ORACLES['AG13_key_players']})")(lambda s, d: profiles.key_player_groups(t.expanded(s, d)))
query("F13_narrative", with_tables(f", members as ({as_sql('members')}) select patent_id, title from patents where country_code = 'JP' and patent_id in (select patent_id from members where workspace_id = 2)", "patents"))(
    lambda s, d: adhoc.narrative_sql(s, "select patent_id, title from patents where country_code = 'JP'", {"patents": t.patents(s, d)}, project(s, d, "members").where("workspace_id = 2"))
)

# topics
query("T11_ladder", """with n as (select lang, count(*) as documents from documents group by 1 union all select 'all', count(*) from documents union all select 'vectors', count(*) from embeddings)
select lang, documents, case when documents < 50 then '3,5,8' when documents < 100 then '5,10' else (select string_agg(k, ',' order by k) from range(10, least(40, 15 + 5 * ((documents - 100) // 100)) + 1, 5) as r(k)) end as ks from n where documents >= 30""")(
    lambda s, d: _ladders(s, d)
)


def _ladders(s, d):  # noqa: ANN001, ANN202
    documents, vectors = load(s, d, "documents"), load(s, d, "embeddings")
    n = documents.groupBy("lang").count().unionByName(documents.groupBy(F.lit("all").alias("lang")).count()).unionByName(vectors.groupBy(F.lit("vectors").alias("lang")).count())
    rows = [(r.lang, r["count"], ",".join(map(str, clustering.ladder(r["count"])))) for r in n.where("count >= 30").collect()]  # a row a language
    return s.createDataFrame(rows, "lang string, documents long, ks string")




def _topics_of(s, d):  # noqa: ANN001, ANN202
    return load(s, d, "embeddings").select(F.col("vec_id").alias("patent_id"), F.col("label").alias("topic_code"), F.col("embedding").alias("vector"))


query("T17_incremental", """with p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 4 != 3), m as (select label, i, avg(x) as x from p group by 1, 2),
c as (select label, list(x order by i) as c from m group by 1), f as (select vec_id as patent_id, label as topic_code, list_distance(embedding::double[], c) as distance, from (select vec_id, embedding from embeddings where vec_id % 4 = 3), c)
select patent_id, arg_min(topic_code, distance) as topic_code, round(min(distance), 9) as distance from f group by 1""")(
    lambda s, d: topics.assign_unassigned(_topics_of(s, d).drop("topic_code"), _topics_of(s, d).where("patent_id % 4 != 3"), topics.centers(_topics_of(s, d).where("patent_id % 4 != 3"))).withColumn("distance", F.round("distance", 9))
)
