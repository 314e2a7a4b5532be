"""Queries of rows that link to each other, of topics that grow, and of what decides between topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from patquarry.operators import clustering, hierarchy, linking, online, sets, substrings, tokens, topics
from patquarry.operators.sets import mean_vector
from patquarry.plans import tables as t
from patquarry.plans.catalog import query
from patquarry.plans.queries_core import _FIELDS, _TERMS
from patquarry.plans.queries_misc import _TERMS as _WEIGHTS, _discovered, _embedded_texts
from patquarry.plans.queries_topics import _LATEST, _latest
from patquarry.sources import derived
from patquarry.sources.projection import load, sources, with_tables

#: Four rows a patent that name it by one identifier after another. Every fifth patent's third row comes first, and every seventh row has another country:
#: then rows of one patent found two, as the identifier that joins them comes too late.
_FILE = """select patent_id * 8 + at as row_no, patent_id as p, k, case when k in (1, 2) then concat('G', patent_id) end as grant_no, cast(null as string) as examined_no, case when k in (2, 3) then concat('P', patent_id) end as publication_no,
  case when k in (3, 4) then concat('A', patent_id) end as application_no, case when k = 4 and patent_id % 7 = 0 then 'XX' when k = 3 then 'US' end as country_code, cast(null as string) as database_name, case when k = 2 then ' ' else concat('title ', k, ' of ', patent_id) end as title
from (select patent_id, k, case when patent_id % 5 = 0 then case k when 3 then 0 else k end else k end as at from {patents} cross join (select explode(array(1, 2, 3, 4)) as k) where patent_id % 2 = 1) x"""
_THERE = "select patent_id, concat('G', patent_id) as grant_no, cast(null as string) as examined_no, cast(null as string) as publication_no, cast(null as string) as application_no, cast(null as string) as country_code, cast(null as string) as database_name, title from {patents} where patent_id % 6 = 1"
_KEYS, _CONTEXT = ["grant_no", "examined_no", "publication_no"], ["country_code", "database_name"]


def _linked(s, d):  # noqa: ANN001, ANN202
    there, rows = (s.sql(x, patents=t.patents(s, d)) for x in (_THERE, _FILE))
    return there, rows, linking.resolve(rows, there, _KEYS, "application_no", _CONTEXT)[0]


#: Who founds what in the rows above: the first row in order, the third where it came first, and the fourth where its country is another.
_LINKS = """f as (select patent_id as p, k, patent_id * 8 + case when patent_id % 5 = 0 and k = 3 then 0 else k end as row_no, patent_id % 5 = 0 as early, patent_id % 7 = 0 as abroad, patent_id % 6 = 1 as known, (select max(patent_id) + 1 from patents where patent_id % 6 = 1) as base from patents, unnest([1, 2, 3, 4]) as u(k) where patent_id % 2 = 1),
owner as (select f.*, case when k = 4 and abroad then base + row_no when early and k in (3, 4) then base + p * 8 when known then p else base + p * 8 + 1 end as patent_id from f)"""
query("U3_ING4_linked_rows", with_tables(f", {_LINKS} select row_no, patent_id, patent_id < base or row_no != patent_id - base as found from owner", "patents"))(lambda s, d: _linked(s, d)[2])
query("U3_file_applied", with_tables(f""", {_LINKS}, filled as (select *, 'title ' || k || ' of ' || p as title from owner where k != 2), folded as (select patent_id, arg_max(title, row_no) as title, min(base) as base from filled group by 1)
select patent_id, coalesce(x.title, p.title) as title, case when patent_id >= base then 'new' when x.title is null then 'same' else 'updated' end as state from folded x full join (select patent_id, title from patents where patent_id % 6 = 1) p using (patent_id)""", "patents"))(
    lambda s, d: (lambda there, rows, found: linking.apply_file(there, rows, found, ["title"]))(*_linked(s, d))
)


def _batches(s, d):  # noqa: ANN001, ANN202
    """Centers of three quarters of the vectors, by label, and the last quarter."""
    rows = load(s, d, "embeddings").select(F.col("vec_id").alias("patent_id"), F.col("label").cast("int").alias("topic"), F.col("embedding").alias("vector"))
    centers = rows.where("patent_id % 4 != 3").groupBy("topic").agg(mean_vector(F.col("vector")).alias("center"), F.count(F.lit(1)).cast("double").alias("n"))
    return centers, rows.where("patent_id % 4 = 3").drop("topic")


query("T17_partial_fit", """with p as (select label as topic, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select topic, i, avg(x) as x, count(*) as n from p where vec_id % 4 != 3 group by 1, 2),
far as (select p.vec_id, m.topic, sum((p.x - m.x) * (p.x - m.x)) as far from p join m using (i) where vec_id % 4 = 3 group by 1, 2), near as (select vec_id, arg_min(topic, (sqrt(far), topic)) as topic from far group by 1),
new as (select near.topic, i, sum(x) as x, count(*) as n from near join p using (vec_id) group by 1, 2)
select m.topic::int as topic, (m.i - 1)::int as position, round((m.x * m.n + coalesce(new.x, 0)) / (m.n + coalesce(new.n, 0)), 9) as value, (m.n + coalesce(new.n, 0))::double as n from m left join new using (topic, i)""")(
    lambda s, d: online.partial_fit(*_batches(s, d)).select("topic", "n", F.posexplode("center").alias("position", "value")).withColumn("value", F.round("value", 9))
)

# topics that say alike
query("T23_topic_distances", f"""with {_WEIGHTS}, n as (select topic, sqrt(sum(weight * weight)) as norm from weights group by 1), dots as (select x.topic as a, y.topic as b, sum(x.weight * y.weight) as dot from weights x join weights y using (term) where x.topic < y.topic group by 1, 2)
select p.topic as a, q.topic as b, round(greatest(0.0, 1 - coalesce(dot, 0) / (p.norm * q.norm)), 9) as distance from n p join n q on p.topic < q.topic left join dots on dots.a = p.topic and dots.b = q.topic""")(
    lambda s, d: hierarchy.between(clustering.term_lists(_discovered(s, d), "text")).withColumn("distance", F.round("distance", 9))
)


def _labelled(s, d):  # noqa: ANN001, ANN202
    """Documents with the label of the vector of the same number as their topic."""
    return _embedded_texts(s, d).join(load(s, d, "embeddings").select(F.col("vec_id").alias("patent_id"), F.col("label").cast("int").alias("topic")), "patent_id")


def _hierarchy(s, d):  # noqa: ANN001, ANN202
    return hierarchy.as_table(s, hierarchy.hierarchy(clustering.term_lists(_labelled(s, d), "text")))


def _suggestions(s, d):  # noqa: ANN001, ANN202
    """Every third topic has been merged into the one before."""
    code = F.format_string("T%03d", F.col("topic") - F.when(F.col("topic") % 3 == 2, 1).otherwise(0))
    active = load(s, d, "embeddings").select(F.col("label").cast("int").alias("topic")).distinct().select("topic", code.alias("topic_code"), F.lit(None).cast("string").alias("label"))
    return hierarchy.merge_suggestions(_hierarchy(s, d), active)


query("T23_hierarchy")(_hierarchy)
query("T23_merge_suggestions")(_suggestions)
_UNDONE = "case topic_code when 'T003' then 'T001' when 'T004' then 'T003' when 'T005' then 'T004' end"
query("T18_unmerge", with_tables(f", {_LATEST} select channel, case when topic_code in ('T004', 'T005') then 'T003' else topic_code end as topic_code, count(*) as patents from latest group by 1, 2", "assignments"))(
    lambda s, d: (lambda codes: topics.unmerge(codes, _latest(s, d), codes.where("topic_code in ('T003', 'T004', 'T005')").withColumn("merged_into", F.expr(_UNDONE)), codes.where("topic_code = 'T003'"))[1])(_latest(s, d).select("channel", "topic_code").distinct())
    .groupBy("channel", "topic_code").agg(F.count(F.lit(1)).alias("patents"))
)

# keywords by trigrams
_INDEXES: dict[tuple, str] = {}
#: Words, parts of words, wildcards, and keywords too short for a trigram.
_KEYWORDS = ("red w", "Red", "almond", "almond antique", "#0000001", "sup%r#", "b_ue", "ti_le of", "k 3%/0", "zz", "e", "no such term", "customer#000000007", "gr%en", "of %d", "_")


def _index(s, d):  # noqa: ANN001, ANN202
    """The index of all patents' search terms, built anew when their sources change."""
    key = (s.sparkContext.applicationId, derived.state(s, sources(d, "patents")))
    if key not in _INDEXES:
        path = f"{derived.folder(s)}/substrings-{len(_INDEXES)}"
        substrings.build(sets.lookups(t.patents(s, d), _FIELDS), path)
        _INDEXES[key] = path
    return substrings.load(s, _INDEXES[key])


query("F7_keyword_index", with_tables(f", {_TERMS}, k as (select unnest([{', '.join(repr(k) for k in _KEYWORDS)}]) as keyword) select distinct keyword, patent_id from k join terms on terms.lookup like '%' || lower(keyword) || '%'", "patents"))(lambda s, d: substrings.matches(_index(s, d), _KEYWORDS))
query("F7_scanned_share")(lambda s, d: substrings.scanned(_index(s, d), _KEYWORDS))


def _token_chunks(s, d):  # noqa: ANN001, ANN202
    import public_tokenizers

    return tokens.chunks(load(s, d, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 256, 16).select("doc_id", "chunk", "tokens", "start", "end", "within")


query("T6_token_chunks")(_token_chunks)
