"""Queries of scalar functions, predicates, sets, search, vectors, claims and updates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patquarry.functions import status, text
from patquarry.operators import claims, misc, sets, upsert
from patquarry.plans import adhoc, companies, tables as t
from patquarry.plans.catalog import query
from patquarry.sources.projection import as_sql, load, project, with_tables

# scalars over every patent
query("P3_P13_P19_P20_scalars", with_tables(f""" select patent_id, {t.first('applicant_raw')} as first_applicant, {t.key('applicant_raw')} as lookup, {t.FAMILY_SQL} as family,
  try_cast(nullif(regexp_extract(grant_date_text, '^\\s*(\\d{{4}})', 1), '') as int) as grant_year from patents""", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.first_part(F.col("applicant_raw")).alias("first_applicant"), F.coalesce(text.lookup_key(F.col("applicant_raw")), F.lit("")).alias("lookup"), text.surrogate_family(F.col("family_id_raw"), F.col("patent_id")).alias("family"), text.leading_year(F.col("grant_date_text")).alias("grant_year"))
)
query("P10_status_terms", with_tables(f""" select patent_id, {t.state()} as state, case {t.state()} when 'alive' then '已授權' when 'pending' then '審查中' when 'dead' then '已失效' else '未知' end as bucket,
  case when coalesce(trim(legal_status), '') = '' then '未知' when legal_status like '到期%' then '到期' when legal_status = '授权' then '授權' when legal_status = '审查中' then '審查中' else legal_status end as term from patents""", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", status.normalize(F.col("legal_status")).alias("state"), status.bucket(F.col("legal_status")).alias("bucket"), status.display_term(F.col("legal_status")).alias("term"))
)
query("P9_transform_number", with_tables(" select patent_id, case when country_code = 'TW' then lpad((substr(application_no, 1, 4)::int - 1911)::varchar, 3, '0') || substr(application_no, 5) else application_no end as number from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.transform_number(F.col("country_code"), F.col("application_no")).alias("number"))
)
query("PR2_PR3_display", with_tables(" select patent_id, coalesce(nullif(trim(grant_no), ''), application_no) as number, coalesce(nullif(trim(independent_claims), ''), nullif(trim(main_claim), ''), nullif(trim(all_claims), '')) as claim from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.display_number(F.col("grant_no"), F.col("application_no")).alias("number"), text.display_number(F.col("independent_claims"), F.col("main_claim"), F.col("all_claims")).alias("claim"))
)
query("P2_P15_split", with_tables(" select patent_id, len(list_filter(string_split(applicant_raw, '|'), lambda x: trim(x) != '')) as parts, upper(array_to_string(list_filter(list_transform(string_split(applicant_raw, '|'), lambda x: trim(x)), lambda x: x != ''), ',')) as codes from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", F.size(text.split_multi_value(F.col("applicant_raw"))).alias("parts"), F.array_join(F.transform(text.split_multi_value(F.col("applicant_raw")), F.upper), ",").alias("codes"))
)
query("P14_loose_key", "select c_custkey, lower(c_name) as key from customer")(lambda s, d: load(s, d, "customer").select("c_custkey", text.loose_key(F.concat("c_name", F.lit(" Co., Ltd."))).alias("key")))
query("P25_P27_hashes", "select doc_id, sha256(text) as digest, md5(source) as ref from documents")(lambda s, d: load(s, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("digest"), text.opaque_ref(F.col("source")).alias("ref")))
query("P26_evidence", "select doc_id, case when length(text) > 120 then substr(text, 1, 120) || '...' else text end as evidence from documents")(lambda s, d: load(s, d, "documents").select("doc_id", text.truncate_evidence(F.col("text")).alias("evidence")))
query("P8_dates", "select o_orderkey, o_orderdate::date::varchar as a, date_trunc('month', o_orderdate)::date::varchar as b, o_orderdate::date::varchar as c from orders")(
    lambda s, d: load(s, d, "orders").select(
        "o_orderkey", text.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("a"), text.parse_date(F.date_format("o_orderdate", "yyyyMM")).cast("string").alias("b"), text.parse_date(F.date_format("o_orderdate", "yyyy/MM/dd")).cast("string").alias("c")
    )
)

# predicates, projections and search
query("F8_number_search", with_tables(" select patent_id from patents where coalesce(nullif(trim(grant_no), ''), application_no) ilike '%b10%'", "patents"))(
    lambda s, d: sets.number_search(t.patents(s, d), text.display_number(F.col("grant_no"), F.col("application_no")), "b10").select("patent_id")
)
query("F9_pending", with_tables(" select count(*) as patents, count(*) filter (coalesce(trim(legal_status), '') = '') as without_status from patents where country_code = 'TW'", "patents"))(lambda s, d: sets.pending(t.patents(s, d), ~text.is_filled(F.col("legal_status"))))
query("F10_designs_out", with_tables(" select patent_id from patents where upper(trim(document_kind)) not in ('S', 'S1')", "patents"))(lambda s, d: t.patents(s, d).where(~status.is_design(F.col("document_kind"))).select("patent_id"))
query("PR7_page", with_tables(" select patent_id, title from patents order by patent_id limit 25 offset 50", "patents"))(lambda s, d: t.patents(s, d).orderBy("patent_id").offset(50).limit(25).select("patent_id", "title"))
query("F11_F12_scoped_sql", with_tables(f", members as ({as_sql('members')}) select country_code, count(*) as n from patents where patent_id in (select patent_id from members where workspace_id = 2) group by 1", "patents"))(
    lambda s, d: adhoc.scoped_sql(s, "select country_code, count(*) as n from patents group by country_code", {"patents": t.patents(s, d)}, project(s, d, "members").where("workspace_id = 2"))
)
_TERMS = f"""terms as (select patent_id, field, lookup, min(term) as term, min(source_rank) as source_rank from (
  select patent_id, field, source_rank, trim(part) as term, {t.key('part')} as lookup from (
    select patent_id, 'title' as field, 1 as source_rank, unnest(string_split(title, '|')) as part from patents union all select patent_id, 'applicant_raw', 2, unnest(string_split(applicant_raw, '|')) from patents union all select patent_id, 'ipc_main', 3, unnest(string_split(ipc_main, '|')) from patents
  ) where trim(part) != '') group by 1, 2, 3)"""
_FIELDS = {"title": 1, "applicant_raw": 2, "ipc_main": 3}
query("SRC8_search_terms", with_tables(f", {_TERMS} select * from terms", "patents"))(lambda s, d: sets.search_terms(t.patents(s, d), _FIELDS))
query("F7_keyword", with_tables(f", {_TERMS} select patent_id from patents where patent_id in (select patent_id from terms where lookup like '%red w%')", "patents"))(lambda s, d: sets.keyword_search(t.patents(s, d), sets.search_terms(t.patents(s, d), _FIELDS), " Red  W").select("patent_id"))

# workspaces
query("S1_compose", with_tables(" select patent_id, count(distinct workspace_id) as sources from members where workspace_id in (1, 2, 3) group by 1", "members"))(lambda s, d: sets.compose(project(s, d, "members"), [1, 2, 3]))
query("S1_counts", with_tables(" select sum(n)::bigint as total, count(*) as distinct_count, sum(n)::bigint - count(*) as duplicate_count from (select patent_id, count(distinct workspace_id) as n from members where workspace_id in (1, 2) group by 1)", "members"))(lambda s, d: sets.composition_counts(project(s, d, "members"), [1, 2]))
_OLD, _NEW = "(select patent_id, added as position from members where workspace_id = 1)", "(select patent_id, added as position from members where workspace_id in (1, 4))"
query("S2_W4_add", with_tables(f" select patent_id, case when o.patent_id is not null then 0 else 1 end as part, coalesce(o.position, n.position) as position from {_OLD} o full join {_NEW} n using (patent_id)", "members"))(
    lambda s, d: sets.add_patents(*[project(s, d, "members").where(F.col("workspace_id").isin(*w)).select("patent_id", F.col("added").alias("position")) for w in ([1], [1, 4])])
)
query("T1_J8_members", with_tables(" select workspace_id, patent_id from members where workspace_id = 3 or patent_id % 3 != 0", "members"))(
    lambda s, d: sets.analysis_members(project(s, d, "members"), project(s, d, "members").where("patent_id % 3 = 0").withColumn("status", F.lit("excluded")), [3]).select("workspace_id", "patent_id")
)
query("S5_S6_lists", with_tables(" select workspace_id, count(*) as patents, min(patent_id) as first_id from members group by 1", "members"))(lambda s, d: project(s, d, "members").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("patents"), F.min("patent_id").alias("first_id")))
query("J6_membership", with_tables(f", arrays as (select workspace_id, list(patent_id) as ids from members group by 1) select a.workspace_id, p.country_code, count(*) as n from (select workspace_id, unnest(ids) as patent_id from arrays) a join ({as_sql('patents')}) p using (patent_id) group by 1, 2", "members"))(
    lambda s, d: project(s, d, "members").join(t.patents(s, d).select("patent_id", "country_code"), "patent_id").groupBy("workspace_id", "country_code").agg(F.count(F.lit(1)).alias("n"))
)

# vectors
query("V1_W5_similar", "with v as (select vec_id as patent_id, embedding::double[] as v from embeddings), s as (select v as w from v where patent_id = 7) select patent_id, round(1 - list_cosine_similarity(v, w), 9) as distance from v, s where patent_id != 7 order by 1 - list_cosine_similarity(v, w), patent_id limit 10")(
    lambda s, d: sets.similar(load(s, d, "embeddings").select(F.col("vec_id").alias("patent_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("created")), 7).withColumn("distance", F.round("distance", 9))
)
query("T16_centroids", "with p as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as mean from p group by 1, 2) select p.label as topic, vec_id as patent_id, round(sqrt(sum((x - mean) * (x - mean))), 9) as distance from p join m on m.label = p.label and m.i = p.i group by 1, 2")(
    lambda s, d: sets.centroid_distance(load(s, d, "embeddings").select(F.col("label").alias("topic"), F.col("vec_id").alias("patent_id"), F.col("embedding").alias("vector"))).withColumn("distance", F.round("distance", 9))
)
query("T7_weighted_mean", "with c as (select vec_id // 4 as patent_id, vec_id % 3 as tokens, embedding from embeddings), w as (select *, case when sum(tokens) over (partition by patent_id) > 0 then tokens / sum(tokens) over (partition by patent_id)::double else 1.0 / count(*) over (partition by patent_id) end as share from c), p as (select patent_id, share, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from w) select patent_id, pos::int as position, round(sum(share * x), 9) as value from p group by 1, 2")(
    lambda s, d: sets.weighted_mean(load(s, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("patent_id"), (F.col("vec_id") % 3).alias("tokens"), F.col("embedding").alias("vector"))).select("patent_id", F.col("at").alias("position"), F.round("value", 9).alias("value"))
)
query("T5_duplicates", "select doc_id, min(doc_id) over (partition by sha256(text)) as first_id from documents where text is not null")(
    lambda s, d: load(s, d, "documents").where("text is not null").join(load(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id")), F.sha2("text", 256) == F.col("h")).select("doc_id", "first_id")
)
query("T4_usability", "select doc_id, case when trim(coalesce(text, '')) = '' then 'empty_text' when length(trim(text)) < 50 then 'short_text' else 'ok' end as state from documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text").when(F.length(F.trim("text")) < 50, "short_text").otherwise("ok").alias("state"))
)

# claims, written from each patent
_CLAIMS = "concat('1. A ', title, ' having a part.', chr(10), '2. The thing of claim 1, wherein', chr(10), 'it is red. | 3. The thing of claims 1 to 2. | 4. See claim 9. | 5. (canceled) | 6-8. x | 9. Claim 3 and 5 together.')"


def _claims(s, d):  # noqa: ANN001, ANN202
    return t.patents(s, d).select("patent_id", F.expr(_CLAIMS).alias("claims"))


query("K1_K2_K3_claims", with_tables(""", c(number, type, parent, parents, multiple_dependent) as (values ('1', 'independent', null::int, '', false), ('2', 'dependent', 1, '1', false), ('3', 'dependent', null, '1,2', true), ('4', 'unknown', null, '', false),
  ('5', 'unknown', null, '', false), ('6-8', 'unknown', null, '', false), ('9', 'dependent', null, '3,5', true)) select patent_id, c.* from patents, c""", "patents"))(
    lambda s, d: claims.parse(_claims(s, d), "patent_id", "claims").drop("text")
)
query("K5_K6_verdicts", with_tables(""", c as (select patent_id, unnest([1, 2, 3]) as number from patents), own as (select patent_id, number, case when (patent_id + number) % 5 = 0 then 'not_established' when (patent_id * number) % 3 = 0 then 'needs_review' else 'possibly_established' end as own from c),
r as (select *, case own when 'not_established' then 1 when 'needs_review' then 2 else 3 end as k from own), x as (select *, min(k) over (partition by patent_id order by number rows between unbounded preceding and 1 preceding) as up from r)
select patent_id, number, case least(k, coalesce(up, 9)) when 1 then 'not_established' when 2 then 'needs_review' else 'possibly_established' end as status, coalesce(up = 1, false) as inferred from x""", "patents"))(
    lambda s, d: claims.infer(
        t.patents(s, d).select("patent_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("number")).withColumn("parent", F.when(F.col("number") > 1, F.col("number") - 1)).withColumn(
            "own", F.when((F.col("patent_id") + F.col("number")) % 5 == 0, "not_established").when((F.col("patent_id") * F.col("number")) % 3 == 0, "needs_review").otherwise("possibly_established")
        ), "patent_id",
    )
)

# updates
_STORED = "(select patent_id, title, country_code, legal_status from patents where patent_id % 2 = 0)"
_INCOMING = "(select patent_id, patent_id as row_no, case when patent_id % 6 = 0 then ' ' when patent_id % 4 = 0 then 'New ' || patent_id else title end as title, case when patent_id % 10 = 0 then 'XX' else country_code end as country_code from patents where patent_id % 4 = 0)"


def _stored(s, d):  # noqa: ANN001, ANN202
    return t.patents(s, d).where("patent_id % 2 = 0").select("patent_id", "title", "country_code", "legal_status", "application_no", "grant_no")


def _incoming(s, d):  # noqa: ANN001, ANN202
    p = t.patents(s, d).where("patent_id % 4 = 0")
    return p.select(
        "patent_id", F.col("patent_id").alias("row_no"), F.when(F.col("patent_id") % 6 == 0, " ").otherwise(F.concat(F.lit("New "), F.col("patent_id").cast("string"))).alias("title"), F.when(F.col("patent_id") % 10 == 0, "XX").otherwise(F.col("country_code")).alias("country_code")
    )


query("U1_differential", with_tables(f""" select s.patent_id, case when trim(i.title) != '' and i.title != s.title then i.title else s.title end as title, case when trim(i.country_code) != '' and i.country_code != s.country_code then i.country_code else s.country_code end as country_code,
  coalesce((trim(i.title) != '' and i.title != s.title) or (trim(i.country_code) != '' and i.country_code != s.country_code), false) as updated from {_STORED} s left join {_INCOMING} i using (patent_id)""", "patents"))(
    lambda s, d: upsert.differential(_stored(s, d), upsert.fold(_incoming(s, d), "patent_id", ["title", "country_code"]), "patent_id", ["title", "country_code"])
)
query("ING4_identity", with_tables(""", st as (select patent_id, nullif(trim(grant_no), '') as g, application_no as a from patents where patent_id % 2 = 0), inc as (select patent_id as row_no, nullif(trim(grant_no), '') as g, application_no as a from patents where patent_id % 3 = 0),
g as (select g, min(patent_id) as id from st where g is not null group by 1), a as (select a, min(patent_id) as id from st group by 1) select row_no, coalesce(g.id, a.id) as patent_id from inc left join g using (g) left join a using (a)""", "patents"))(
    lambda s, d: upsert.find_identity(t.patents(s, d).where("patent_id % 3 = 0").select(F.col("patent_id").alias("row_no"), "grant_no", "application_no"), _stored(s, d), ["grant_no", "application_no"])
)
_CONTEXT = "select patent_id as row_no, patent_id, substr(application_no, 1, 7) as application, nullif(trim(country_code), '') as country_code, case patent_id % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' end as database_name from"
query("ING4_application", with_tables(f""", r as ({_CONTEXT} patents), i as (select * from r where row_no % 3 = 0), st as (select application, country_code, database_name, min(patent_id) as patent_id from r where patent_id % 2 = 0 group by 1, 2, 3),
m as (select i.row_no, st.patent_id, row_number() over (partition by i.row_no order by coalesce(st.country_code = i.country_code, false) desc, coalesce(st.database_name = i.database_name, false) desc, st.patent_id) as k from i join st on st.application = i.application
  and (i.country_code is null or st.country_code is null or st.country_code = i.country_code) and (i.database_name is null or st.database_name is null or st.database_name = i.database_name))
select i.row_no, m.patent_id from i left join m on m.row_no = i.row_no and m.k = 1""", "patents"))(
    lambda s, d: upsert.find_by_application(_context(s, d).where("row_no % 3 = 0"), _context(s, d).where("patent_id % 2 = 0"), "application", ["country_code", "database_name"])
)


def _context(s, d):  # noqa: ANN001, ANN202
    return s.sql(f"{_CONTEXT} {{patents}}", patents=t.patents(s, d))


query("SNK2_insert_or_ignore", with_tables(" select patent_id, title from patents where patent_id % 2 = 0 or patent_id % 3 = 0", "patents"))(
    lambda s, d: upsert.insert_or_ignore(t.patents(s, d).where("patent_id % 2 = 0").select("patent_id", "title"), t.patents(s, d).where("patent_id % 3 = 0").select("patent_id", "title"), ["patent_id"])
)
query("ING5_figures", with_tables(" select patent_id, row_no from (select o_orderkey % 50 as patent_id, o_orderkey as row_no, row_number() over (partition by o_orderkey % 50 order by case o_orderkey % 3 when 0 then 2 when 1 then 1 else 0 end desc, o_orderkey) as k from orders) where k = 1", "members"))(
    lambda s, d: upsert.cached_figure(load(s, d, "orders").select((F.col("o_orderkey") % 50).alias("patent_id"), F.col("o_orderkey").alias("row_no"), F.get(F.array(F.lit("B1"), F.lit("a"), F.lit("?")), (F.col("o_orderkey") % 3).cast("int")).alias("document_kind"))).select("patent_id", "row_no")
)
query("ING6_backfill", with_tables(" select patent_id, coalesce(application_year, 2000 + (patent_id % 7)::int) as application_year from patents", "patents"))(
    lambda s, d: upsert.backfill(t.patents(s, d).select("patent_id", "application_year"), t.patents(s, d).select("patent_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).withColumn("application_year", F.when(F.col("version") == 2, (2000 + F.col("patent_id") % 7).cast("int")).otherwise(1)), "patent_id", "application_year", "version")
)


def _embedded(s, d):  # noqa: ANN001, ANN202
    """Odd documents as they are; even ones with an earlier text, or by an earlier preprocessing, model version or model."""
    nth = F.col("doc_id") % 8
    as_of = lambda k, old, new: F.when(nth == k, old).otherwise(new)
    return load(s, d, "documents").where("text is not null").select(
        "doc_id", as_of(2, "other", "model").alias("embedding_model"), as_of(4, "1", "2").alias("model_version"), as_of(6, "v1", "v2").alias("preprocessing_version"), F.sha2(F.when(nth == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text")), 256).alias("text_hash")
    )


query("T8_embedding_diff", "select doc_id from documents where doc_id % 2 = 0 and text is not null")(
    lambda s, d: upsert.pending_embeddings(load(s, d, "documents").select("doc_id", "text"), _embedded(s, d), "model", "2", "v2").select("doc_id")
)
query("AG31_data_status", "select (select count(*) from orders) as patents, (select count(*) from documents) as texts, (select max(o_orderdate) from orders) as refreshed")(
    lambda s, d: load(s, d, "orders").agg(F.count(F.lit(1)).alias("patents"), F.max("o_orderdate").alias("refreshed")).join(load(s, d, "documents").agg(F.count(F.lit(1)).alias("texts"))).select("patents", "texts", "refreshed")
)
query("AG2_mode", with_tables(" select code, std as name from (select applicant_code as code, nullif(trim(split_part(applicant_std, '|', 1)), '') as std, row_number() over (partition by applicant_code order by count(*) desc, nullif(trim(split_part(applicant_std, '|', 1)), '')) as k from patents where applicant_code is not null and applicant_std is not null group by 1, 2) where k = 1", "patents"))(
    lambda s, d: companies.mode_by(t.patents(s, d).select(F.col("applicant_code").alias("code"), text.first_part(F.col("applicant_std")).alias("std")), "code", "std", "name")
)
query("AG29_distinct_pending", with_tables(f" select country_code, count(distinct {t.key('applicant_raw')}) as names from patents where trim(applicant_raw) != '' group by 1", "patents"))(
    lambda s, d: t.patents(s, d).where(text.is_filled(F.col("applicant_raw"))).groupBy("country_code").agg(F.count_distinct(text.lookup_key(F.col("applicant_raw"))).alias("names"))
)
query("W3_latest_company", with_tables(" select code, alias_id from (select code, alias_id, row_number() over (partition by code order by updated desc, alias_id desc) as k from aliases) where k = 1", "aliases"))(
    lambda s, d: t.aliases(s, d).withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.col("updated").desc(), F.col("alias_id").desc()))).where("k = 1").select("code", "alias_id")
)
query("AG33_grouped_aliases", with_tables(" select code, alias_id, alias, review_status, count(*) filter (review_status = 'confirmed') over (partition by code) as confirmed from aliases where review_status in ('confirmed', 'review_required')", "aliases"))(
    lambda s, d: misc.grouped_aliases(t.aliases(s, d))
)
