"""Queries of the smaller operators and of topic discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from patquarry.functions import status, text
from patquarry.operators import actions, claims, clustering, misc, profiles, topics
from patquarry.plans import adhoc, family, tables as t
from patquarry.plans.catalog import query
from patquarry.plans.queries_core import _claims
from patquarry.plans.queries_topics import _LATEST, _latest
from patquarry.sources import derived
from patquarry.sources.projection import as_sql, load, project, sources, with_tables


def _names(s, d):  # noqa: ANN001, ANN202
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("applicant_raw", "assignee_raw")]))
    return t.patents(s, d).select("patent_id", pairs.alias("p")).select("patent_id", "p.field", F.explode(text.split_multi_value(F.col("p.value"))).alias("name"))


def _asked(s, d):  # noqa: ANN001, ANN202
    return load(s, d, "customer").where("c_custkey % 3 = 0").select(F.lower("c_name").alias("lookup"), (F.col("c_custkey") % 20).alias("patents"))


_QUEUE = f"""names as (select patent_id, 'applicant_raw' as field, unnest(string_split(applicant_raw, '|')) as part from patents union all select patent_id, 'assignee_raw', unnest(string_split(assignee_raw, '|')) from patents),
counted as (select {t.key('part')} as lookup, min(trim(part)) as name, count(distinct patent_id) as patents, string_agg(distinct field, ',' order by field) as fields from names where trim(part) != '' and {t.key('part')} not in (select alias_key from confirmed where alias_key is not null) group by 1),
queue as (select c.*, a.patents as asked from counted c left join (select lower(c_name) as lookup, c_custkey % 20 as patents from customer where c_custkey % 3 = 0) a using (lookup) where a.patents is null or c.patents > a.patents)"""
query("AG21_queue", f"with {t.NAMES_SQL}, {_QUEUE} select * from queue")(lambda s, d: misc.normalization_queue(_names(s, d), t.aliases(s, d), _asked(s, d)))
query("AG22_queue_counts", f"with {t.NAMES_SQL}, {_QUEUE} select count(*) as remaining, count(*) filter (asked is null) as never_asked from queue")(lambda s, d: misc.queue_counts(misc.normalization_queue(_names(s, d), t.aliases(s, d), _asked(s, d))))
query("AG23_targets", with_tables(" select code, max(nullif(trim(name_zh), '')) as name_zh, max(nullif(trim(name_norm), '')) as name_norm from aliases where review_status = 'confirmed' group by 1 having max(nullif(trim(name_zh), '')) is not null or max(nullif(trim(name_norm), '')) is not null", "aliases"))(lambda s, d: misc.targets(t.aliases(s, d)))
query("AG30_codes_without", f"with {t.NAMES_SQL} select code, norm as name from (select code, norm, row_number() over (partition by code order by count(*) desc, norm) as k from confirmed where norm is not null group by 1, 2) where k = 1 and code not in (select code from confirmed where zh is not null) and code not in ('AC2', 'AC3')")(
    lambda s, d: misc.codes_without(t.aliases(s, d), s.createDataFrame([("AC2",), ("AC3",)], "code string"))
)
query("AG24_groups", with_tables(" select group_name, string_agg(distinct company, ',' order by company) as members, count(distinct company) as n from company_groups group by 1", "company_groups"))(lambda s, d: misc.groups_with_members(project(s, d, "company_groups"), project(s, d, "company_groups")))
query("AG25_top_applicants", f"with {t.EXPANDED_SQL}, members as ({as_sql('members')}) select * from (select workspace_id, applicant_display_name, patents, row_number() over (partition by workspace_id order by patents desc, applicant_display_name) as rank from (select workspace_id, applicant_display_name, count(distinct patent_id) as patents from members join expanded using (patent_id) group by 1, 2)) where rank <= 10")(
    lambda s, d: misc.top_applicants(t.expanded(s, d), project(s, d, "members"))
)
query("AG27_population", with_tables(" select (select count(*) from patents where application_year is not null) as covered, count(*) as total, 'covers ' || (select count(*) from patents where application_year is not null) || ' of ' || count(*) || ': no year' as note from patents", "patents"))(
    lambda s, d: misc.population_note(t.patents(s, d).where("application_year is not null").groupBy("application_year").agg(F.count(F.lit(1)).alias("patent_count")), t.patents(s, d), "no year")
)
query("AG32_PR5_notes", with_tables(" select patent_id, case when trim(independent_claims) != '' then 'independent_claims' else 'main_claim' end as field, case when trim(independent_claims) != '' then independent_claims else main_claim end as text from patents", "patents"))(lambda s, d: misc.note_source(t.patents(s, d), ["independent_claims", "main_claim"]))
query("PR4_claim_source", with_tables(" select patent_id, nullif(trim(independent_claims), '') as claims, case when trim(independent_claims) != '' then 'independent_claims' else 'missing' end as claim_source from patents", "patents"))(lambda s, d: misc.claim_source(t.patents(s, d)))
query("PR1_PR6_flags", with_tables(" select patent_id, trim(independent_claims) != '' as has_text, trim(grant_no) != '' as has_number from patents", "patents"))(lambda s, d: misc.flags(t.patents(s, d), has_text="independent_claims", has_number="grant_no"))
query("F15_snapshot", with_tables(" select patent_id from patents where country_code = 'JP' and application_year >= 1995", "patents"))(lambda s, d: misc.snapshot(t.patents(s, d), (F.col("country_code") == "JP") & (F.col("application_year") >= 1995)))
query("F14_evidence", with_tables(" select patent_id, country_code, count(*) over () as total, false as truncated from patents where patent_id in (1, 5, 9)", "patents"))(lambda s, d: adhoc.evidence(t.patents(s, d).select("patent_id", "country_code"), "patent_id", ["1", "5", "9"]))
query("F2_F3_blank_and_pattern", with_tables(" select patent_id from patents where trim(ipc_main) != '' and regexp_matches(trim(ipc_main), '^[A-HY]') and trim(family_id_raw) != ''", "patents"))(
    lambda s, d: t.patents(s, d).where(text.is_filled(F.col("family_id_raw")) & F.trim("ipc_main").rlike("^[A-HY]")).select("patent_id")
)
query("N7_N8_name_pairs", with_tables(" select distinct nullif(code, '') as code, name from (select applicant_code as code, nullif(trim(split_part(applicant_raw, '|', 1)), '') as name from patents union all select null, nullif(trim(split_part(applicant_raw, '|', 2)), '') from patents union all select null, nullif(trim(assignee_raw), '') from patents) where name is not null", "patents"))(
    lambda s, d: misc.name_pairs(t.patents(s, d), [("applicant_raw", "applicant_code"), ("assignee_raw", None)])
)
#: Pairs of a batch as in N7, and aliases by code.
_GOVERN = f"""pairs as (
  select distinct nullif(code, '') as code, name from (select applicant_code as code, nullif(trim(split_part(applicant_raw, '|', 1)), '') as name from patents union all select null, nullif(trim(split_part(applicant_raw, '|', 2)), '') from patents union all select null, nullif(trim(assignee_raw), '') from patents) where name is not null
), a as (select code, {t.key('alias')} as lookup, coalesce(trim(name_zh), '') as zh, coalesce(trim(name_norm), '') as norm from known),
g as (select code, count(distinct case when zh != '' or norm != '' then {{'zh': zh, 'norm': norm}} end) as names, min(case when zh != '' or norm != '' then {{'zh': zh, 'norm': norm}} end) as own from a group by 1),
exact as (select distinct code, lookup from (select code, lookup from a union all select code, {t.key('zh')} from a union all select code, {t.key('norm')} from a) where lookup != ''),
same as (select lookup, min(code) as same from exact group by 1), x as (select p.code, p.name, {t.key('p.name')} as lookup, coalesce(p.code, same.same) as target_code from pairs p left join same on same.lookup = {t.key('p.name')}),
y as (select x.*, g.names, g.own, exists (select 1 from a where a.code = x.target_code and a.lookup = x.lookup) as has, x.name = min(x.name) over (partition by target_code, x.lookup) as first,
  row_number() over (partition by target_code order by x.name, x.code nulls last) as nth from x left join g on g.code = x.target_code),
z as (select *, case when target_code is null then 'unmatched' when has then 'known' when names is null and nth = 1 then 'new group' when names > 1 and code is not null then 'conflict' when first then 'add alias' else 'known' end as action from y)"""
query("N6_N9_govern", with_tables(f""", known as (select * from aliases where code not in ('AC3', 'AC6')), {_GOVERN} select code, name, action, target_code, case when action in ('add alias', 'new group') and names = 1 then nullif(own.zh, '') end as name_zh,
case when action in ('add alias', 'new group') then case when names = 1 then nullif(own.norm, '') when names is null then min(case when action = 'new group' then name end) over (partition by target_code) end end as name_norm,
case action when 'new group' then 'review_required' when 'add alias' then case when names is null then 'review_required' else 'confirmed' end end as review_status from z""", "patents", "aliases"))(
    lambda s, d: misc.govern(misc.name_pairs(t.patents(s, d), [("applicant_raw", "applicant_code"), ("assignee_raw", None)]), t.aliases(s, d).where("code not in ('AC3', 'AC6')"))
)
query("W7_representatives", f"""with {t.EXPANDED_SQL}, assignments as ({as_sql('assignments')}), {_LATEST},
rows as (select l.topic_code, e.applicant_display_name as applicant, e.patent_id, e.application_year, replace(e.application_no, '-', chr(8209)) as n from latest l join expanded e using (patent_id) where l.channel = 'technical'),
ranked as (select topic_code, applicant, row_number() over (partition by topic_code order by count(distinct patent_id) desc, applicant) as k from rows group by 1, 2),
one as (select topic_code, k, arg_min(n, -coalesce(application_year, -1)::bigint * 100000000000 + patent_id) as n from rows join ranked using (topic_code, applicant) where k <= 3 group by 1, 2),
kept as (select topic_code, n, min(k) as k from one group by 1, 2)
select topic_code, string_agg(n, '、' order by k) as representative from kept group by 1""")(lambda s, d: _representatives(s, d))


def _representatives(s, d):  # noqa: ANN001, ANN202
    from pyspark.sql.window import Window

    rows = _latest(s, d).where("channel = 'technical'").select("patent_id", "topic_code").join(t.expanded(s, d).select("patent_id", F.col("applicant_display_name").alias("applicant"), "application_year", F.col("application_no").alias("number")), "patent_id")
    k = F.row_number().over(Window.partitionBy("topic_code").orderBy(F.col("c").desc(), "applicant"))
    ranked = rows.groupBy("topic_code", "applicant").agg(F.count_distinct("patent_id").alias("c")).withColumn("k", k).where("k <= 3").select("topic_code", "applicant", "k")
    return misc.representatives(rows, ranked, "number")


query("W8_J3_earliest", with_tables(" select country_code, arg_min(patent_id, coalesce(application_year, 9999) * 100000000000 + patent_id) as patent_id from patents group by 1", "patents"))(
    lambda s, d: t.patents(s, d).groupBy("country_code").agg(F.min(F.struct(F.coalesce("application_year", F.lit(9999)).alias("y"), "patent_id"))["patent_id"].alias("patent_id"))
)
query("W10_latest_batch", with_tables(f", {_LATEST} select o_orderkey + 1 as patent_id from orders where o_orderkey % 4 = 3 and o_orderkey + 1 not in (select patent_id from latest where channel = 'technical')", "assignments"))(
    lambda s, d: misc.latest_batch(load(s, d, "orders").select((F.col("o_orderkey") + 1).alias("patent_id"), (F.col("o_orderkey") % 4).alias("exported_at")), _latest(s, d).where("channel = 'technical'")).select("patent_id")
)
query("T22_S7_backfill", with_tables(f", members as ({as_sql('members')}), {_LATEST} select patent_id from patents where coalesce(trim(independent_claims), '') = '' and upper(trim(document_kind)) not in ('S', 'S1') and patent_id in (select patent_id from members where workspace_id = 1) and patent_id not in (select patent_id from latest where channel = 'effect')", "patents", "assignments"))(
    lambda s, d: misc.backfill_candidates(t.patents(s, d), project(s, d, "members").where("workspace_id = 1"), _latest(s, d).where("channel = 'effect'"), "independent_claims", status.is_design(F.col("document_kind"))).select("patent_id")
)
query("T24_validation", "select count(*) filter (vec_id % 7 = 0) as stale, count(*) filter (len(embedding) != 64) as odd_vectors, count(distinct label % 2) as models from embeddings")(
    lambda s, d: misc.validate_corpus(_vector_texts(s, d), 64)
)


def _vector_texts(s, d):  # noqa: ANN001, ANN202
    """Vectors with texts of which every seventh has changed since its hash was stored."""
    number = F.col("vec_id").cast("string")
    old = F.when(F.col("vec_id") % 7 == 0, F.concat(number, F.lit(" before"))).otherwise(number)
    return load(s, d, "embeddings").select(number.alias("text"), F.sha2(old, 256).alias("hash"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("model"))


def _parsed(s, d):  # noqa: ANN001, ANN202
    """The claims without their texts, parsed once; what reads them filters the stored rows, not the patterns' results."""
    return derived.derived(s, "claims", sources(d, "patents"), lambda: claims.parse(_claims(s, d), "patent_id", "claims").drop("text"))


query("K4_skeleton", with_tables(" select patent_id, '1' as independent, '2,3,9' as dependent, '4,5,6-8' as unknown from patents", "patents"))(lambda s, d: misc.skeleton(claims.parse(_claims(s, d), "patent_id", "claims")))
_ELEMENTS = "case (patent_id + cast(number as int)) % 4 when 0 then array('met', 'not_met') when 1 then array('met', 'met') when 2 then array('met', 'unclear') end"
query("K7_aggregate", with_tables(""", k as (select patent_id, n, case (patent_id + n) % 4 when 0 then 1 when 1 then 3 when 2 then 2 end as k from patents, (values (1), (2), (3), (9)) as v(n)),
p as (select patent_id, max(k) filter (n = 1) as a, max(k) filter (n = 2) as b from k group by 1),
u as (select k.*, case n when 1 then 9 when 2 then coalesce(a, 9) when 3 then least(coalesce(a, 9), coalesce(b, 9)) end as up from k join p using (patent_id))
select patent_id, n::varchar as number, case when n < 9 then case least(k, up) when 1 then 'not_established' when 2 then 'needs_review' when 3 then 'possibly_established' end end as status, coalesce(n < 9 and up = 1, false) as inferred from u""", "patents"))(
    lambda s, d: claims.aggregate(_parsed(s, d), _parsed(s, d).where("type != 'unknown'").select("patent_id", "number", F.expr(_ELEMENTS).alias("elements")), "patent_id")
)
query("P21_W17_positions", f"""with {t.EXPANDED_SQL}, assignments as ({as_sql('assignments')}), {_LATEST}, x as (select distinct on (applicant_display_name, patent_id) * from expanded where trim(applicant_display_name) != ''),
p as (select applicant_display_name as applicant, count(distinct nullif(trim(country_code), '')) as country_count, count(*) filter ({t.state()} = 'alive') as granted_count, count(*) filter ({t.state()} = 'dead') as dead_count, count(distinct l.topic_code) as topic_count, count(*) as n
  from x left join (select patent_id, topic_code from latest where channel = 'technical') l using (patent_id) group by 1 order by n desc, applicant limit 10),
m as (select median(country_count) as cm, median(topic_count) as tm from p)
select applicant, country_count, topic_count, granted_count, dead_count, case when granted_count = 0 and dead_count > 0 then '{profiles.PRIOR_ART}' when country_count >= cm and topic_count >= tm then '{profiles.FULL}' when country_count >= cm then '{profiles.SINGLE}' else '{profiles.NICHE}' end as position from p, m""")(lambda s, d: _positions(s, d))


def _positions(s, d):  # noqa: ANN001, ANN202
    rows = profiles.strength(t.expanded(s, d), _latest(s, d).where("channel = 'technical'"))
    middle = rows.agg(F.median("country_count").alias("cm"), F.median("topic_count").alias("tm"))
    return rows.join(F.broadcast(middle)).withColumn("position", profiles.position(F.col("cm"), F.col("tm"))).select("applicant", "country_count", "topic_count", "granted_count", "dead_count", "position")


query("T3_clean")(lambda s, d: load(s, d, "pages").select("page_id", clustering.clean(F.col("html")).alias("text")))
query("T6_chunks", "with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') as w from documents), c as (select doc_id, w, unnest(range(0, (len(w) - 1) // 256 + 1)) as chunk from w where len(w) > 0) select doc_id, chunk::int as chunk, len(w[chunk * 256 + 1 : chunk * 256 + 256])::int as words from c")(
    lambda s, d: clustering.chunks(load(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "words")
)
query("T9_T10_T16_topics")(lambda s, d: clustering.assign(clustering.reduce_dimensions(load(s, d, "embeddings"), "embedding"), "reduced", 8).select("vec_id", "topic"))


def _discovered(s, d):  # noqa: ANN001, ANN202
    return load(s, d, "documents").where("text is not null").select("doc_id", "text", F.expr("cast(array_position(array('de', 'en', 'es', 'fr'), lang) - 1 as int)").alias("topic"))


#: Words and pairs of words of each language's documents, their weights and ranks.
_TERMS = """w as (
  select list_position(['de', 'en', 'es', 'fr'], lang)::int - 1 as topic, doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) > 1) as w from documents where text is not null
), term as (select topic, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from w
), counts as (select topic, term, count(*) as n from term group by 1, 2), sizes as (select topic, sum(n)::bigint as size from counts group by 1), mean as (select avg(size) as mean from sizes),
whole as (select term, sum(n)::bigint as whole from counts group by 1),
weights as (select topic, term, n / size * ln(1 + mean / whole) as weight from counts join sizes using (topic) join whole using (term), mean),
ranked as (select *, row_number() over (partition by topic order by weight desc, term) as rank from weights)"""
query("T12_quality", f"""with {_TERMS}, n as (select topic, count(*) as n from w group by 1), p as (select n, n / sum(n) over () as p from n)
select round(-sum(p * ln(p)) / greatest(ln(count(*)), 1e-12), 9) as balance, avg(case when n < 5 then 1.0 else 0.0 end)::double as small, count(*) as topics, (select count(distinct term) / count(*) from ranked where rank <= 10) as diversity from p""")(
    lambda s, d: clustering.quality(_discovered(s, d), clustering.keywords(_discovered(s, d), "text")).withColumn("balance", F.round("balance", 9))
)
query("T15_T25_keywords", f"with {_TERMS} select topic, string_agg(term, ' / ' order by rank) as label, 'T' || lpad((topic + 1)::varchar, 3, '0') as topic_code from ranked where rank <= 3 group by 1")(
    lambda s, d: clustering.labels(clustering.keywords(_discovered(s, d), "text"))
)
query("T15_representative", f"""with {_TERMS}, norms as (select topic, sqrt(sum(weight * weight)) as norm from weights group by 1), c as (select topic, doc_id, term, count(*) as c from term group by 1, 2, 3),
dots as (select topic, doc_id, sum(c * weight) as dot, sqrt(sum(c * c)) as own from c join weights using (topic, term) group by 1, 2),
r as (select w.topic, w.doc_id, round(coalesce(dot / (own * norm), 0.0), 9) as cosine from w left join dots using (topic, doc_id) left join norms on norms.topic = w.topic),
k as (select *, row_number() over (partition by topic order by cosine desc, doc_id) as nearest, row_number() over (partition by topic order by cosine, doc_id) as farthest from r)
select topic, doc_id, cosine, case when nearest <= 3 then nearest end as nearest, case when farthest <= 3 then farthest end as farthest from k where nearest <= 3 or farthest <= 3""")(
    lambda s, d: clustering.representative(_discovered(s, d), "doc_id", "text")
)
query("T9_T14_candidates")(lambda s, d: clustering.candidates(_embedded_texts(s, d), "text", "embedding")[0])
query("T9_T16_discovered")(lambda s, d: _profiles(s, d))
query("T6_claim_chunks")(lambda s, d: clustering.claim_chunks(_claims(s, d), "patent_id", "claims", 12).select("patent_id", "chunk", "words"))


def _embedded_texts(s, d):  # noqa: ANN001, ANN202
    """Documents with the vector of the same number."""
    return load(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("patent_id"), "text").join(load(s, d, "embeddings").select(F.col("vec_id").alias("patent_id"), "embedding"), "patent_id")


def _profiles(s, d):  # noqa: ANN001, ANN202
    found, rows = clustering.candidates(_embedded_texts(s, d), "text", "embedding")
    return rows.join(F.broadcast(found.where("profile is not null").select("k", "profile")), "k").select("profile", "k", "patent_id", "topic", "distance")


#: A row a source of documents, judged by its texts.
_JUDGED = "select cast(substr(source, 4) as bigint) as k, avg(n_chars) as coherence, cast(count(distinct lang) as double) as diversity, 1.0D as balance, avg(case when n_chars < 1000 then 1.0D else 0.0D end) as small from {documents} group by 1"
_SCORED = """j as (select cast(substr(source, 4) as bigint) as k, avg(n_chars) as coherence, count(distinct lang)::double as diversity, 1.0::double as balance, avg(case when n_chars < 1000 then 1.0 else 0.0 end)::double as small from documents group by 1),
scored as (select *, 0.4 * case when max(coherence) over () = min(coherence) over () then 1 else (coherence - min(coherence) over ()) / (max(coherence) over () - min(coherence) over ()) end + 0.25 * case when max(diversity) over () = min(diversity) over () then 1 else (diversity - min(diversity) over ()) / (max(diversity) over () - min(diversity) over ()) end
  + 0.25 + 0.1 * (1 - case when max(small) over () = min(small) over () then 1 else (small - min(small) over ()) / (max(small) over () - min(small) over ()) end) as score from j)"""


def _scored(s, d):  # noqa: ANN001, ANN202
    return clustering.score(s.sql(_JUDGED, documents=load(s, d, "documents"))).withColumn("score", F.round("score", 9))


query("T13_score", f"with {_SCORED} select k, coherence, diversity, balance, small, round(score, 9) as score from scored")(_scored)
query("W2_latest_labels", with_tables(" select channel, topic_code, arg_max('label ' || run_id || ' of ' || topic_code, run_id) as label from assignments group by 1, 2", "assignments"))(
    lambda s, d: topics.latest_labels(_states(s, d))
)


def _states(s, d):  # noqa: ANN001, ANN202
    """A state for each run as JSON, and two that have no topics."""
    label = F.concat(F.lit("label "), F.col("run_id").cast("string"), F.lit(" of "), F.col("topic_code")).alias("label")
    runs = project(s, d, "assignments").select("channel", "run_id", F.struct("topic_code", label).alias("t")).groupBy("channel", "run_id").agg(F.to_json(F.struct(F.collect_set("t").alias("topics"))).alias("topic_state_json"))
    return runs.unionByName(s.createDataFrame([("technical", 99, "{}"), ("effect", 98, None)], "channel string, run_id int, topic_state_json string"))


# scalars that work on lists, over text made from each patent
_PEOPLE = "concat(applicant_raw, '; ', coalesce(assignee_raw, ''), ' ； Extra')"
query("P1_P5_P7_lists", with_tables(""" select patent_id, regexp_replace(trim(applicant_raw), '\\s+', ' ', 'g') as clean_name,
  (select count(*) from (select unnest(regexp_split_to_array(applicant_raw || '; ' || coalesce(assignee_raw, '') || ' ； Extra', '[;；|]+')) as x) where trim(x) != '') as people,
  (select count(*) from (select unnest(regexp_split_to_array(ipc_main || ',' || cpc_main, '[,;|]+')) as x) where trim(x) != '') as classes from patents""", "patents"))(
    lambda s, d: t.patents(s, d).select(
        "patent_id", F.coalesce(text.clean_text(F.col("applicant_raw")), F.lit("")).alias("clean_name"), F.size(text.split_people(F.expr(_PEOPLE))).cast("long").alias("people"),
        F.size(text.split_classifications(F.concat("ipc_main", F.lit(","), "cpc_main"))).cast("long").alias("classes"),
    )
)
query("P6_people", with_tables(""", c as (select patent_id, list_filter(list_transform(string_split(applicant_raw, '|'), lambda x: trim(x)), lambda x: x != '') as a, list_filter(list_transform(string_split(coalesce(assignee_raw, ''), '|'), lambda x: trim(x)), lambda x: x != '') as b from patents)
select patent_id, i::int as sequence, a[i] as applicant, b[i] as assignee from c, unnest(range(1, greatest(len(a), len(b)) + 1)) as u(i)""", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", F.inline(text.merge_people(applicant=text.split_multi_value(F.col("applicant_raw")), assignee=text.split_multi_value(F.col("assignee_raw")))))
)
query("P11_registered", with_tables(" select patent_id, case legal_status when '审查中' then 'pending' when '授权' then 'alive' else 'unknown' end as state from patents", "patents"))(lambda s, d: t.patents(s, d).select("patent_id", status.normalize_registered(status.display(F.col("legal_status"))).alias("state")))
query("P16_family_counts", with_tables(" select patent_id, upper(regexp_extract(trim(x), '^([A-Za-z]+)\\s*-\\s*(\\d+)$', 1)) as bucket, sum(regexp_extract(trim(x), '^([A-Za-z]+)\\s*-\\s*(\\d+)$', 2)::int)::bigint as n from (select patent_id, unnest(string_split(family_counts_raw, '|')) as x from patents) where regexp_matches(trim(x), '^([A-Za-z]+)\\s*-\\s*(\\d+)$') group by 1, 2", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", F.explode(family.family_counts(F.col("family_counts_raw"))).alias("c")).where("c.bucket is not null").groupBy("patent_id", F.upper("c.bucket").alias("bucket")).agg(F.sum("c.n").alias("n"))
)
query("P24_numbers", with_tables(" select patent_id, case when country_code = 'TW' then 'TW' || coalesce(nullif(trim(grant_no), ''), lpad((substr(application_no, 1, 4)::int - 1911)::varchar, 3, '0') || substr(application_no, 5)) else trim(country_code) || coalesce(nullif(trim(grant_no), ''), application_no) end as number from patents", "patents"))(
    lambda s, d: t.patents(s, d).select("patent_id", text.resolve_number(F.col("country_code"), F.col("grant_no"), F.col("application_no")).alias("number"))
)
query("C8_citations", with_tables(" select patent_id as ref, 'country' as field, case when patent_id % 3 = 0 then 'differs' when patent_id % 5 = 0 then 'missing' else 'ok' end as verdict from patents where patent_id % 3 = 0 or patent_id % 5 = 0 or patent_id % 7 = 0", "patents"))(
    lambda s, d: actions.check_citations(
        t.patents(s, d).where("patent_id % 3 = 0 or patent_id % 5 = 0 or patent_id % 7 = 0").select(F.col("patent_id").alias("ref"), F.lit("country").alias("field"), F.when(F.col("patent_id") % 3 == 0, "??").otherwise(F.col("country_code")).alias("value")),
        t.patents(s, d).where("patent_id % 5 != 0 or patent_id % 3 = 0").select(F.col("patent_id").alias("ref"), F.lit("country").alias("field"), F.col("country_code").alias("found")),
    ).select("ref", "field", "verdict")
)
query("T18_merge", with_tables(f", {_LATEST} select channel, case when topic_code in ('T003', 'T004') then 'T001' else topic_code end as topic_code, count(*) as patents from latest group by 1, 2", "assignments"))(
    lambda s, d: topics.merge(
        _latest(s, d).select("channel", "topic_code").distinct(), _latest(s, d), _latest(s, d).select("channel", "topic_code").distinct().where("topic_code in ('T003', 'T004')").withColumn("merged_into", F.when(F.col("topic_code") == "T004", "T003").otherwise("T001"))
    )[1].groupBy("channel", "topic_code").agg(F.count(F.lit(1)).alias("patents"))
)
query("T23_closest_topics", "with p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as x from p group by 1, 2), c as (select label, list(x order by i) as c from m group by 1) select 'technical' as channel, a.label as topic_code, b.label as other, round(list_distance(a.c, b.c), 9) as distance from c a join c b on a.label < b.label order by list_distance(a.c, b.c), 2, 3 limit 5")(
    lambda s, d: topics.closest_topics(_centers(s, d)).withColumn("distance", F.round("distance", 9))
)


def _centers(s, d):  # noqa: ANN001, ANN202
    parts = load(s, d, "embeddings").select(F.col("label").alias("topic_code"), F.posexplode("embedding").alias("at", "x")).groupBy("topic_code", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    center = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])
    return parts.groupBy("topic_code").agg(center.alias("center")).withColumn("channel", F.lit("technical"))


query("T14_profiles", f"with {_SCORED}, thirds as (select k, round(score, 9) as score, ntile(3) over (order by k) as part from scored) select k, score, part::int as part from thirds qualify row_number() over (partition by part order by score desc, k) = 1")(
    lambda s, d: clustering.profiles(_scored(s, d)).select("k", "score", "part")
)
