"""Topics: latest assignments, merges, trends and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions import status
from patquarry.operators import chains
from patquarry.operators.sets import mean_vector

#: Names of a topic's status (fixed values).
EMERGING, GROWING, MATURE, CONCENTRATED, DECLINING, UNCLASSIFIED, INSUFFICIENT = "近期新進", "申請成長", "申請趨穩", "少數申請人集中", "申請下降", "未分類", "樣本不足"
#: Parameters of the windows and of the classification (fixed values).
RECENT_YEARS, TAIL_YEARS, TAIL_RATIO, GROWTH_HIGH, BAND, HALF_WIDTH, MIN_SAMPLE = 5, 2, 0.60, 0.70, (0.59, 0.79), 0.10, 5
EARLY, RECENT = (2011, 2019), (2020, 2024)


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark limits each group before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """Of all runs the latest assignment of each patent and channel."""
    return latest_by(assignments, ["channel", "patent_id"], F.col("run_id").desc(), F.col("topic_code"))


def latest_labels(runs: DataFrame) -> DataFrame:
    """``channel, topic_code, label``: of all runs' states, JSON with ``topics``, the label that the latest run gives a code.

    ``runs``: channel, run_id, topic_state_json; a state without topics, or one that is no JSON, gives none."""
    topics = F.from_json("topic_state_json", "topics array<struct<topic_code:string,label:string>>")["topics"]
    rows = runs.select("channel", "run_id", F.explode(topics).alias("t")).select("channel", "run_id", "t.topic_code", "t.label").where("topic_code is not null")
    return latest_by(rows, ["channel", "topic_code"], F.col("run_id").desc(), F.col("label")).drop("run_id")


def unmerge(topics: DataFrame, assigned: DataFrame, merges: DataFrame, undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new run with some merges taken back: those of ``merges`` (channel, topic_code, merged_into) that ``undone`` (channel, topic_code) does
    not name are made again on the topics and assignments from before, so later merges into an undone topic lead to it."""
    return merge(topics, assigned, merges.join(undone.select("channel", "topic_code"), ["channel", "topic_code"], "left_anti"))


def resolve_merges(topics: DataFrame) -> DataFrame:
    """``channel, topic_code, target``: where a chain of merges ends, however long. A code on a cycle, or before one, resolves to the smallest
    code of the cycle, one whose chain names a code that is not there to that code."""
    ends = chains.follow(topics.select("channel", "topic_code", F.when(F.col("merged_into") != F.col("topic_code"), F.col("merged_into")).alias("merged_into")), ["channel"], "topic_code", "merged_into")
    return ends.select("channel", "topic_code", F.when(F.col("ended") | F.col("missing"), F.col("at")).otherwise(F.col("low")).alias("target"))


def tail_years(patents: DataFrame) -> DataFrame:
    """One row: how many of the newest years in a row are mostly pending, leaving one year at least."""
    judged = patents.where(F.col("application_year").isNotNull() & (F.trim("legal_status") != ""))
    years = judged.groupBy("application_year").agg((F.count_if(status.normalize(F.col("legal_status")) == status.PENDING) / F.count(F.lit(1)) >= TAIL_RATIO).alias("open"))
    # the newest settled year bounds the tail; the table has a row a year
    settled = years.agg(F.max(F.when(~F.col("open"), F.col("application_year"))).alias("settled"), F.count(F.lit(1)).alias("n"))
    tail = years.join(F.broadcast(settled)).agg(F.max("n").alias("n"), F.count_if(F.col("settled").isNull() | (F.col("application_year") > F.col("settled"))).alias("tail"))
    return tail.select(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(TAIL_YEARS)).otherwise(F.least("tail", F.col("n") - 1)).cast("int").alias("tail"))


def windows(patents: DataFrame) -> DataFrame:
    """One row: the early and the recent window of years, of this data where it spans enough, else the fixed ones."""
    span = patents.agg(F.min("application_year").alias("first"), F.max("application_year").alias("last")).join(F.broadcast(tail_years(patents)))
    cutoff = F.col("last") - F.col("tail")
    ok = F.coalesce(cutoff - RECENT_YEARS >= F.col("first"), F.lit(False))
    return span.select(
        F.when(ok, F.col("first")).otherwise(EARLY[0]).alias("early_from"), F.when(ok, cutoff - RECENT_YEARS).otherwise(EARLY[1]).alias("early_to"),
        F.when(ok, cutoff - RECENT_YEARS + 1).otherwise(RECENT[0]).alias("recent_from"), F.when(ok, cutoff).otherwise(RECENT[1]).alias("recent_to"),
    )


def _leaders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of all, the recent and the early patents: distinct applicants and the sum of the three with most; counted once for all three."""
    parts = {"": F.lit(True), "_recent": F.col("recent"), "_early": F.col("early")}
    counts = rows.groupBy(*keys, "applicant").agg(*[F.count_if(c).alias(f"c{s}") for s, c in parts.items()])
    for s in parts:
        counts = counts.withColumn(f"r{s}", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(f"c{s}").desc(), "applicant")))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "applicant", "c")))), lambda x: F.concat(x["applicant"], F.lit(" "), x["c"].cast("string")))
    sums = [x for s in parts for x in (F.count_if(F.col(f"c{s}") > 0).alias(f"applicants{s}"), F.sum(F.when(F.col(f"r{s}") <= 3, F.col(f"c{s}"))).alias(f"top3{s}"))]
    return counts.groupBy(*keys).agg(*sums, F.max("c").alias("top1"), F.array_join(named, "; ").alias("top_applicants"))


def topic_table(assigned: DataFrame, applicants: DataFrame, patents: DataFrame) -> DataFrame:
    """A row a channel and topic: patents, applicants, leading ones and shares; windows, statuses of the law, and status.

    ``assigned``: channel, topic_code, patent_id. ``applicants``: patent_id, applicant. ``patents``: patent_id,
    application_year, legal_status."""
    keys = ["channel", "topic_code"]
    rows = assigned.select(*keys, "patent_id").distinct().join(patents.select("patent_id", "application_year", status.normalize(F.col("legal_status")).alias("state")), "patent_id", "left")
    rows = rows.join(F.broadcast(windows(patents)))
    rows = rows.withColumn("recent", F.col("application_year").between(F.col("recent_from"), F.col("recent_to"))).withColumn("early", F.col("application_year").between(F.col("early_from"), F.col("early_to")))
    state = lambda *s: F.count_if(F.coalesce("state", F.lit(status.UNKNOWN)).isin(*s))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patent_count"), F.count_if("recent").alias("recent_count"), F.count_if("early").alias("early_count"), F.min("application_year").alias("first_year"), F.max("application_year").alias("last_year"),
        state(status.PENDING).alias("pending_count"), state(status.ALIVE).alias("granted_count"), state(status.DEAD).alias("inactive_count"), state(status.UNKNOWN).alias("unknown_status_count"),
    )
    named = rows.join(applicants.select("patent_id", "applicant").distinct(), "patent_id")
    base = base.join(_leaders(named, keys), keys, "left")
    share = lambda part, whole: F.bround(F.coalesce(F.col(part), F.lit(0)) / F.col(whole) * 100, 1)
    per = Window.partitionBy("channel")
    out = base.select(
        *keys, "patent_count", "recent_count", "early_count", "first_year", "last_year", "pending_count", "granted_count", "inactive_count", "unknown_status_count",
        F.coalesce("applicants", F.lit(0)).alias("applicant_count"), F.coalesce("top_applicants", F.lit("")).alias("top_applicants"), share("top3", "patent_count").alias("top3_share"), share("top1", "patent_count").alias("max_share"),
        F.coalesce("applicants_recent", F.lit(0)).alias("recent_applicants"), F.coalesce("applicants_early", F.lit(0)).alias("early_applicants"),
        F.when(F.col("recent_count") == 0, 0.0).otherwise(share("top3_recent", "recent_count")).alias("concentration_recent"), F.when(F.col("early_count") == 0, 0.0).otherwise(share("top3_early", "early_count")).alias("concentration_early"),
        F.median("patent_count").over(per).alias("median_count"), F.sum("recent_count").over(per).alias("_recent"), F.sum("early_count").over(per).alias("_early"),
    )
    out = out.withColumn("share_recent", F.bround(F.col("recent_count") / F.greatest("_recent", F.lit(1)), 4)).withColumn("share_early", F.bround(F.col("early_count") / F.greatest("_early", F.lit(1)), 4))
    return out.withColumn("status", F.when(F.col("channel") == "technical", classify())).drop("_recent", "_early")


def classify() -> Column:
    """The status of a topic from its row; the order of the cases decides."""
    total, recent, early = F.col("patent_count"), F.col("recent_count"), F.col("early_count")
    fewer = F.col("recent_applicants") < F.col("early_applicants")
    all_ = F.col("_recent") + F.col("_early")
    baseline = F.when(all_ > 0, F.col("_recent") / all_)
    low = F.coalesce(F.bround(F.greatest(F.lit(0.0), baseline - HALF_WIDTH), 4), F.lit(BAND[0]))
    high = F.coalesce(F.bround(F.least(F.lit(1.0), baseline + HALF_WIDTH), 4), F.lit(BAND[1]))
    ratio = F.when(recent + early > 0, recent / (recent + early)).otherwise(0.0)
    many = total >= F.col("median_count")
    return (
        F.when(total < MIN_SAMPLE, INSUFFICIENT)
        .when((recent < early) & (F.col("share_recent") < F.col("share_early")) & fewer, DECLINING)
        .when(many & fewer & (F.col("concentration_recent") > F.col("concentration_early")), CONCENTRATED)
        .when((recent > early) & (F.col("recent_applicants") > F.col("early_applicants")), GROWING)
        .when(many & (ratio >= low) & (ratio <= high), MATURE)
        .when(~many & (ratio >= F.coalesce(baseline, F.lit(GROWTH_HIGH))) & (F.col("share_recent") > F.col("share_early")), EMERGING)
        .otherwise(UNCLASSIFIED)
    )


#: Names of the quadrants by many patents and many applicants (fixed values).
QUADRANTS = {(True, True): "多方投入技術", (True, False): "集中持有", (False, True): "低件數·多申請人", (False, False): "低件數·少申請人"}


def opportunity(table: DataFrame, leaders: DataFrame, top: DataFrame) -> DataFrame:
    """Each topic's quadrant by its channel's medians, and how many of the leading applicants take part in it.

    ``leaders``: applicant. ``top``: channel, topic_code, applicant, the three leading ones of each topic."""
    per = Window.partitionBy("channel")
    x, y = F.median("patent_count").over(per), F.median("applicant_count").over(per)
    involved = top.join(F.broadcast(leaders), "applicant", "left_semi").groupBy("channel", "topic_code").agg(F.count(F.lit(1)).alias("leading_applicant_count"), F.array_join(F.array_sort(F.collect_set("applicant")), "；").alias("leading_applicants"))
    df = table.withColumn("patent_median", x).withColumn("applicant_median", y).withColumn("many", F.col("patent_count") >= x).withColumn("wide", F.col("applicant_count") >= y)
    name = F
    for (many, wide), text in QUADRANTS.items():
        name = name.when((F.col("many") == many) & (F.col("wide") == wide), F.lit(text))
    df = df.withColumn("quadrant", name).join(involved, ["channel", "topic_code"], "left")
    return df.withColumn("leading_applicant_count", F.coalesce("leading_applicant_count", F.lit(0))).withColumn("leading_applicants", F.coalesce("leading_applicants", F.lit(""))).drop("many", "wide")


def channel_intersection(assigned: DataFrame) -> DataFrame:
    """Effect topics by technical topics with the patents that both have."""
    one = lambda c, name: assigned.where(F.col("channel") == c).select("patent_id", F.col("topic_code").alias(name)).distinct()
    return one("effect", "effect_topic").join(one("technical", "technical_topic"), "patent_id").groupBy("effect_topic", "technical_topic").agg(F.count(F.lit(1)).alias("patents"))


def technical_means(pairs: DataFrame, most: int = 3) -> DataFrame:
    """For each effect topic the technical ones that share most patents, as text."""
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("effect_topic").orderBy(F.col("patents").desc(), "technical_topic"))).where(F.col("r") <= most)
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", "technical_topic", "patents"))), lambda x: F.concat(x["technical_topic"], F.lit(" "), x["patents"].cast("string")))
    return ranked.groupBy("effect_topic").agg(F.array_join(text, "、").alias("tech_means"))


def ranked_by_distance(assigned: DataFrame, n: Column | int, farthest: bool = False) -> DataFrame:
    """The nearest or farthest ``n`` patents of each topic; a missing distance comes last, or counts as 0 from afar."""
    order = [F.coalesce("distance", F.lit(0.0)).desc(), F.col("patent_id").desc()] if farthest else [F.col("distance").asc_nulls_last(), F.col("patent_id")]
    rank = F.row_number().over(Window.partitionBy("channel", "topic_code").orderBy(*order))
    return assigned.withColumn("rank", rank).where(F.col("rank") <= n)


def merge(topics: DataFrame, assigned: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The topics and assignments of a new run after a merge; nothing of the old run changes.

    ``sources``: channel, topic_code, merged_into. Merged topics stay, marked, with their pointer; their patents move to
    the end of the pointers, so a merge can be undone by leaving it out."""
    marked = topics.join(sources, ["channel", "topic_code"], "left").withColumn("status", F.when(F.col("merged_into").isNotNull(), "merged").otherwise("active"))
    moved = assigned.join(resolve_merges(marked), ["channel", "topic_code"], "left").withColumn("topic_code", F.coalesce("target", "topic_code")).drop("target")
    return marked, moved


def closest_topics(centers: DataFrame, most: int = 5) -> DataFrame:
    """Pairs of topics of a channel whose centers are nearest: suggestions to merge. A row a topic comes in.

    ``centers``: channel, topic_code, center."""
    other = centers.select("channel", F.col("topic_code").alias("other"), F.col("center").alias("_other"))
    far = F.sqrt(F.aggregate(F.zip_with("center", "_other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = centers.join(other, "channel").where("topic_code < other").withColumn("distance", far)
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("distance", "topic_code", "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("channel", "topic_code", "other", "distance")


def centers(assigned: DataFrame) -> DataFrame:
    """``topic_code, center``: the mean of each topic's vectors."""
    return assigned.groupBy("topic_code").agg(mean_vector(F.col("vector")).alias("center"))


def assign_unassigned(vectors: DataFrame, assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """``patent_id, topic_code, distance``: the nearest topic of each patent that has none yet, the smaller code on a tie.

    Topics are few, 40 at most, so their centers travel as one row."""
    one = centers.agg(F.collect_list(F.struct("topic_code", "center")).alias("_centers"))
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("vector", c, lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(far(c["center"]).alias("distance"), c["topic_code"].alias("topic_code"))))
    new = vectors.join(assigned.select("patent_id"), "patent_id", "left_anti")
    return new.join(F.broadcast(one)).select("patent_id", best.alias("b")).select("patent_id", "b.topic_code", "b.distance")
