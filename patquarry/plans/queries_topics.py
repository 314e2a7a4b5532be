"""Queries of topics, trends and actions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patquarry.operators import actions, topics
from patquarry.plans import tables as t
from patquarry.plans.catalog import query
from patquarry.sources.derived import derived
from patquarry.sources.projection import as_sql, project, sources as files, with_tables


def _latest(s, d):  # noqa: ANN001, ANN202
    return derived(s, "latest_assignments", files(d, "assignments"), lambda: topics.latest_assignments(project(s, d, "assignments")))


def _applicants(s, d):  # noqa: ANN001, ANN202
    return t.people(s, d).select("patent_id", F.col("applicant_display_name").alias("applicant"))


def topic_table(s, d):  # noqa: ANN001, ANN202
    return derived(s, "topic_table", [*files(d, "patents"), *files(d, "assignments")], lambda: topics.topic_table(_latest(s, d), _applicants(s, d), t.patents(s, d)))


_LATEST = "latest as (select channel, patent_id, run_id, topic_code, distance from (select *, row_number() over (partition by channel, patent_id order by run_id desc, topic_code) as k from assignments) where k = 1)"
_WINDOWS = f"""years as (
  select application_year as y, count(*) filter ({t.state()} = 'pending') / count(*)::double >= 0.6 as open from patents where application_year is not null and trim(legal_status) != '' group by 1
), tails as (
  select case when count(*) = 0 then 2 else least(count(*) filter (y > coalesce((select max(y) from years where not open), -1)), count(*) - 1) end as tail from years
), span as (select min(application_year) as a, max(application_year) as b from patents), win as (
  select case when ok then a else 2011 end as early_from, case when ok then cut - 5 else 2019 end as early_to, case when ok then cut - 4 else 2020 end as recent_from, case when ok then cut else 2024 end as recent_to
  from (select a, b - tail as cut, coalesce(b - tail - 5 >= a, false) as ok from span, tails)
)"""
_TOPICS = f"""{_LATEST},
{_WINDOWS},
rows as (
  select l.channel, l.topic_code, l.patent_id, p.application_year as y, {t.state('p.legal_status')} as state,
    coalesce(p.application_year between w.recent_from and w.recent_to, false) as recent, coalesce(p.application_year between w.early_from and w.early_to, false) as early
  from latest l left join patents p using (patent_id), win w
), named as (
  select distinct r.*, e.applicant_display_name as applicant from rows r join expanded e using (patent_id)
), counts as (
  select channel, topic_code, applicant, count(*) as c, count(*) filter (recent) as cr, count(*) filter (early) as ce from named group by 1, 2, 3
), top as (select *, row_number() over (partition by channel, topic_code order by c desc, applicant) as k from counts),
topr as (select *, row_number() over (partition by channel, topic_code order by cr desc, applicant) as k from counts where cr > 0),
tope as (select *, row_number() over (partition by channel, topic_code order by ce desc, applicant) as k from counts where ce > 0),
agg as (
  select channel, topic_code, count(*) as patent_count, count(*) filter (recent) as recent_count, count(*) filter (early) as early_count, min(y) as first_year, max(y) as last_year,
    count(*) filter (state = 'pending') as pending_count, count(*) filter (state = 'alive') as granted_count, count(*) filter (state = 'dead') as inactive_count, count(*) filter (state = 'unknown') as unknown_status_count from rows group by 1, 2
), shares as (
  select a.*, coalesce((select count(*) from counts c where c.channel = a.channel and c.topic_code = a.topic_code), 0) as applicant_count,
    coalesce((select string_agg(applicant || ' ' || c, '; ' order by k) from top x where x.channel = a.channel and x.topic_code = a.topic_code and k <= 3), '') as top_applicants,
    round_even(coalesce((select sum(c) from top x where x.channel = a.channel and x.topic_code = a.topic_code and k <= 3), 0)::double / patent_count * 100, 1) as top3_share,
    round_even(coalesce((select max(c) from top x where x.channel = a.channel and x.topic_code = a.topic_code), 0)::double / patent_count * 100, 1) as max_share,
    (select count(*) from topr x where x.channel = a.channel and x.topic_code = a.topic_code) as recent_applicants, (select count(*) from tope x where x.channel = a.channel and x.topic_code = a.topic_code) as early_applicants,
    case when recent_count = 0 then 0 else round_even(coalesce((select sum(cr) from topr x where x.channel = a.channel and x.topic_code = a.topic_code and k <= 3), 0)::double / recent_count * 100, 1) end as concentration_recent,
    case when early_count = 0 then 0 else round_even(coalesce((select sum(ce) from tope x where x.channel = a.channel and x.topic_code = a.topic_code and k <= 3), 0)::double / early_count * 100, 1) end as concentration_early
  from agg a
), summed as (
  select s.*, median(patent_count) over (partition by channel) as median_count, sum(recent_count) over (partition by channel)::double as rs, sum(early_count) over (partition by channel)::double as es from shares s
), scaled as (
  select *, round_even(recent_count / greatest(rs, 1), 4) as share_recent, round_even(early_count / greatest(es, 1), 4) as share_early, case when rs + es > 0 then rs / (rs + es) end as baseline, case when recent_count + early_count > 0 then recent_count::double / (recent_count + early_count) else 0 end as ratio from summed
), topic_table as (
  select * exclude (rs, es, baseline, ratio), case when channel = 'technical' then case
    when patent_count < 5 then '樣本不足' when recent_count < early_count and share_recent < share_early and recent_applicants < early_applicants then '申請下降'
    when patent_count >= median_count and recent_applicants < early_applicants and concentration_recent > concentration_early then '少數申請人集中'
    when recent_count > early_count and recent_applicants > early_applicants then '申請成長'
    when patent_count >= median_count and ratio between coalesce(round_even(greatest(0, baseline - 0.1), 4), 0.59) and coalesce(round_even(least(1, baseline + 0.1), 4), 0.79) then '申請趨穩'
    when patent_count < median_count and ratio >= coalesce(baseline, 0.7) and share_recent > share_early then '近期新進' else '未分類' end end as status from scaled
)"""
_ALL = f"with {t.EXPANDED_SQL}, assignments as ({as_sql('assignments')}), {_TOPICS}"

query("W1_latest_assignment", with_tables(f", {_LATEST} select * from latest", "assignments"))(lambda s, d: _latest(s, d).select("channel", "patent_id", "run_id", "topic_code", "distance"))
query("C1_C2_windows", with_tables(f", {_WINDOWS} select * from win", "patents"))(lambda s, d: topics.windows(t.patents(s, d)))
query("AG7_AG8_AG9_AG10_C3_C4_topic_table", f"{_ALL} select * from topic_table")(topic_table)


def opportunity(s, d):  # noqa: ANN001, ANN202
    names, latest = _applicants(s, d), _latest(s, d)
    leaders = names.groupBy("applicant").agg(F.count_distinct("patent_id").alias("n")).orderBy(F.col("n").desc(), "applicant").limit(3).select("applicant")
    counts = latest.join(names.distinct(), "patent_id").groupBy("channel", "topic_code", "applicant").agg(F.count_distinct("patent_id").alias("c"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("channel", "topic_code").orderBy(F.col("c").desc(), "applicant")))
    return topics.opportunity(topic_table(s, d), leaders, ranked.where("k <= 3")).select("channel", "topic_code", "patent_count", "applicant_count", "patent_median", "applicant_median", "quadrant", "leading_applicant_count", "leading_applicants")


_QUADRANT = """case when patent_count >= pm and applicant_count >= am then '多方投入技術' when patent_count < pm and applicant_count >= am then '低件數·多申請人' when patent_count >= pm then '集中持有' else '低件數·少申請人' end"""
_OPP = f"""{_ALL}, leaders as (select applicant_display_name as applicant from expanded group by 1 order by count(distinct patent_id) desc, 1 limit 3),
opp as (select *, {_QUADRANT} as quadrant from (select *, median(patent_count) over (partition by channel) as pm, median(applicant_count) over (partition by channel) as am from topic_table))"""
query("AG11_P22_opportunity", f"""{_OPP} select o.channel, o.topic_code, o.patent_count, o.applicant_count, o.pm as patent_median, o.am as applicant_median, o.quadrant,
  (select count(*) from top x where x.channel = o.channel and x.topic_code = o.topic_code and k <= 3 and applicant in (select applicant from leaders)) as leading_applicant_count,
  coalesce((select string_agg(applicant, '；' order by applicant) from top x where x.channel = o.channel and x.topic_code = o.topic_code and k <= 3 and applicant in (select applicant from leaders)), '') as leading_applicants from opp o""")(opportunity)

_J = "case when {0} then '成立' else '不成立' end"
_UNKNOWN = "case when {0} then '證據不足' else " + _J.format("{1}") + " end"
_RULES = [
    ("優先投入", _UNKNOWN.format("status is null", "status in ('近期新進', '申請成長')")),
    ("差異化開發", _UNKNOWN.format("false", "coalesce(status in ('申請趨穩', '少數申請人集中'), false) or quadrant = '多方投入技術'")),
    ("探索性研發", _UNKNOWN.format("status is null", "status = '樣本不足' or (status = '近期新進' and patent_count < median_count)")),
    ("維持／漸進改善", _UNKNOWN.format("status is null", "status = '申請趨穩' and patent_count >= median_count")),
    ("降低投入", _UNKNOWN.format("status is null", "status = '申請下降'")),
    ("追蹤他人審查中案件", _UNKNOWN.format("false", "pending_count >= 1")),
    ("檢視請求項範圍重疊", _UNKNOWN.format("false", "quadrant = '多方投入技術'")),
    ("覆核代表專利", _UNKNOWN.format("false", "quadrant = '低件數·少申請人'")),
    ("確認權利集中程度", _UNKNOWN.format("false", "quadrant = '集中持有' or max_share >= mms")),
    ("評估利基切入", _UNKNOWN.format("false", "quadrant = '低件數·少申請人' and patent_count >= 1")),
]
query("C5_C6_C7_actions", f"{_OPP}, m as (select *, median(max_share) over (partition by channel) as mms from opp) " + " union all ".join(f"select channel, topic_code, '{k}' as action, {v} as judgement from m" for k, v in _RULES))(
    lambda s, d: actions.scan(topic_table(s, d).join(opportunity(s, d).select("channel", "topic_code", "quadrant"), ["channel", "topic_code"]))
)
_PAIRS = "pairs as (select e.topic_code as effect_topic, x.topic_code as technical_topic, count(*) as patents from latest e join latest x on x.patent_id = e.patent_id and x.channel = 'technical' where e.channel = 'effect' group by 1, 2)"
query("J15_channel_intersection", with_tables(f", {_LATEST}, {_PAIRS} select * from pairs", "assignments"))(lambda s, d: topics.channel_intersection(_latest(s, d)))
query("W6_technical_means", with_tables(f", {_LATEST}, {_PAIRS} select effect_topic, string_agg(technical_topic || ' ' || patents, '、' order by patents desc, technical_topic) as tech_means from (select *, row_number() over (partition by effect_topic order by patents desc, technical_topic) as k from pairs) where k <= 3 group by 1", "assignments"))(
    lambda s, d: topics.technical_means(topics.channel_intersection(_latest(s, d)))
)
query("W9_farthest", with_tables(f", {_LATEST} select channel, topic_code, patent_id, rank from (select *, row_number() over (partition by channel, topic_code order by coalesce(distance, 0) desc, patent_id desc) as rank from latest) where rank <= 5", "assignments"))(
    lambda s, d: topics.ranked_by_distance(_latest(s, d), 5, farthest=True).select("channel", "topic_code", "patent_id", "rank")
)
query("W18_nearest", with_tables(f", {_LATEST} select channel, topic_code, patent_id, rank from (select *, row_number() over (partition by channel, topic_code order by distance nulls last, patent_id) as rank from latest) where rank <= 15", "assignments"))(
    lambda s, d: topics.ranked_by_distance(_latest(s, d), 15).select("channel", "topic_code", "patent_id", "rank")
)
query("AG19_topic_year", with_tables(f", {_LATEST} select topic_code, application_year, count(*) as patents from latest join patents using (patent_id) where channel = 'technical' and application_year is not null group by 1, 2", "assignments", "patents"))(
    lambda s, d: _latest(s, d).where("channel = 'technical'").join(t.patents(s, d).where("application_year is not null").select("patent_id", "application_year"), "patent_id").groupBy("topic_code", "application_year").agg(F.count(F.lit(1)).alias("patents"))
)
#: Topic n of a channel merges into topic n // 2 unless it is the first.
_MERGES = "select channel, topic_code, case when n > 1 then concat('T', lpad(cast(cast(floor(n / 2) as int) as string), 3, '0')) end as merged_into from (select distinct channel, topic_code, cast(substr(topic_code, 2) as int) as n from {assignments})"


def merges(s, d):  # noqa: ANN001, ANN202
    return s.sql(_MERGES, assignments=project(s, d, "assignments"))


query("T19_merge_chain", f"with recursive assignments as ({as_sql('assignments')}), m as ({_MERGES.format(assignments='assignments')}), walk as (select channel, topic_code, topic_code as target from m union select w.channel, w.topic_code, m.merged_into from walk w join m on m.channel = w.channel and m.topic_code = w.target where m.merged_into is not null) select channel, topic_code, min(target) as target from walk group by 1, 2")(
    lambda s, d: topics.resolve_merges(merges(s, d))
)
query("T20_AG26_state", f"with assignments as ({as_sql('assignments')}), {_LATEST} select channel, 'T001' as target, count(*) as patents from latest group by 1")(
    lambda s, d: _latest(s, d).join(topics.resolve_merges(merges(s, d)), ["channel", "topic_code"]).groupBy("channel", "target").agg(F.count(F.lit(1)).alias("patents"))
)
