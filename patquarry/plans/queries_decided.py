"""Queries of states that events decide, over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from patquarry.operators import decisions
from patquarry.plans.catalog import query
from patquarry.sources.projection import load

_EXCLUDING = """select user_id as patent_id, event_id as seq, case event_id % 7 when 0 then 'assign' when 1 then 'flag' when 2 then 'confirm' when 3 then 'exclude' when 4 then 'keep' when 5 then 'restore' else event_type end as action,
  concat('reason ', event_id) as reason, case when event_id % 2 = 0 then event_type end as verdict, concat('T', cast(event_id % 9 as {0})) as topic from {1}"""
_SUGGESTING = """select user_id as member_id, event_id as seq, case event_id % 5 when 0 then 'suggest' when 1 then 'confirm' when 2 then 'reject' when 3 then 'undo' else event_type end as action,
  case when user_id % 3 > 0 then concat('seen in ', props) end as evidence from {0}"""
query("T21_exclusions", f"""with recursive e as ({_EXCLUDING.format('varchar', 'events')}), n as (select *, row_number() over (partition by patent_id order by seq) as i from e),
st(patent_id, i, status, reason, verdict, source, topic, kept) as (
  select distinct patent_id, 0::bigint, 'none', null::varchar, null::varchar, null::varchar, null::varchar, null::varchar from n
  union all
  select n.patent_id, n.i,
    case when action = 'flag' and status != 'excluded' then 'pending' when action = 'exclude' or (action = 'confirm' and status = 'pending') then 'excluded' when (action = 'keep' and status = 'pending') or (action = 'restore' and status = 'excluded') then 'none' else status end,
    case when (action = 'flag' and status != 'excluded') or action = 'exclude' then n.reason when (action = 'keep' and status = 'pending') or (action = 'restore' and status = 'excluded') then null else st.reason end,
    case when action = 'flag' and status != 'excluded' then n.verdict when (action = 'keep' and status = 'pending') or (action = 'restore' and status = 'excluded') then null else st.verdict end,
    case when action = 'flag' and status != 'excluded' then 'ai' when action = 'exclude' then 'manual' when (action = 'keep' and status = 'pending') or (action = 'restore' and status = 'excluded') then null else st.source end,
    case when action = 'assign' then n.topic when action = 'exclude' or (action = 'confirm' and status = 'pending') then null when action = 'restore' and status = 'excluded' then coalesce(st.topic, kept) else st.topic end,
    case when action = 'exclude' or (action = 'confirm' and status = 'pending') then st.topic when action = 'restore' and status = 'excluded' then null else kept end
  from st join n on n.patent_id = st.patent_id and n.i = st.i + 1
) select patent_id, status, reason, verdict, source, topic, kept from st qualify row_number() over (partition by patent_id order by i desc) = 1""")(
    lambda s, d: decisions.fold(s.sql(_EXCLUDING.format("string", "{events}"), events=load(s, d, "events")), "patent_id", "seq", decisions.Exclusions)
)
_DECIDED = f"""e as ({_SUGGESTING.format('events')}), n as (select *, row_number() over (partition by member_id order by seq) as i from e),
st(member_id, i, status, source, evidence) as (
  select distinct member_id, 0::bigint, 'none', null::varchar, null::varchar from n
  union all
  select n.member_id, n.i, case when action = 'suggest' and status = 'none' then 'suggested' when action = 'confirm' and status = 'suggested' then 'confirmed' when action = 'reject' and status = 'suggested' then 'rejected' when action = 'undo' and status = 'confirmed' and st.evidence is not null then 'suggested' else status end,
    case when (action = 'suggest' and status = 'none') or (action = 'undo' and status = 'confirmed' and st.evidence is not null) then 'cli_ai' when action in ('confirm', 'reject') and status = 'suggested' then 'manual' else st.source end,
    case when action = 'suggest' and status = 'none' then n.evidence else st.evidence end
  from st join n on n.member_id = st.member_id and n.i = st.i + 1
), decided as (select member_id, status, source, evidence from st qualify row_number() over (partition by member_id order by i desc) = 1)"""


def _members(s, d):  # noqa: ANN001, ANN202
    return decisions.fold(s.sql(_SUGGESTING.format("{events}"), events=load(s, d, "events")), "member_id", "seq", decisions.Suggestions)


query("N10_suggestions", f"with recursive {_DECIDED} select * from decided")(_members)
query("N10_group_status", f"""with recursive {_DECIDED} select member_id // 4 as group_id, case when bool_or(status = 'confirmed') then 'confirmed' when bool_or(status = 'suggested') then 'suggested' else 'rejected' end as review_status,
  case when bool_or(status = 'suggested') then 'cli_ai' else 'manual' end as source from decided where status != 'none' group by 1""")(
    lambda s, d: decisions.group_status(_members(s, d).withColumn("group_id", F.floor(F.col("member_id") / 4)))
)
