"""Candidate actions for a topic: every rule judged, with three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.operators import topics as t

#: The three judgements and the actions (fixed values).
HOLDS, FAILS, UNKNOWN = "成立", "不成立", "證據不足"


def _judge(known: Column, holds: Column) -> Column:
    return F.when(~known, UNKNOWN).when(F.coalesce(holds, F.lit(False)), HOLDS).otherwise(FAILS)


def rules() -> dict[str, Column]:
    """Action to judgement, over status, quadrant, patent_count, pending_count, max_share and the medians."""
    s, q, n = F.col("status"), F.col("quadrant"), F.col("patent_count")
    many = n >= F.col("median_count")
    by_status = lambda *x: _judge(s.isNotNull(), s.isin(*x))
    by_quadrant = lambda x: _judge(q.isNotNull(), q == x)
    crowded, held, small = t.QUADRANTS[True, True], t.QUADRANTS[True, False], t.QUADRANTS[False, False]
    share = F.col("max_share")
    return {
        "優先投入": by_status(t.EMERGING, t.GROWING),
        "差異化開發": _judge(s.isNotNull() | q.isNotNull(), F.coalesce(s.isin(t.MATURE, t.CONCENTRATED), F.lit(False)) | F.coalesce(q == crowded, F.lit(False))),
        "探索性研發": _judge(s.isNotNull() & n.isNotNull(), (s == t.INSUFFICIENT) | ((s == t.EMERGING) & ~many)),
        "維持／漸進改善": _judge(s.isNotNull() & n.isNotNull(), (s == t.MATURE) & many),
        "降低投入": by_status(t.DECLINING),
        "追蹤他人審查中案件": _judge(F.col("pending_count").isNotNull(), F.col("pending_count") >= 1),
        "檢視請求項範圍重疊": by_quadrant(crowded),
        "覆核代表專利": by_quadrant(small),
        "確認權利集中程度": F.when(F.coalesce(q == held, F.lit(False)), HOLDS).otherwise(_judge(share.isNotNull() & F.col("median_max_share").isNotNull(), share >= F.col("median_max_share"))),
        "評估利基切入": _judge(q.isNotNull() & n.isNotNull(), (q == small) & (n >= 1)),
    }


def scan(table: DataFrame) -> DataFrame:
    """A row a topic and action, none left out: ``channel, topic_code, action, judgement``."""
    df = table.withColumn("median_max_share", F.median("max_share").over(Window.partitionBy("channel")))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("action"), v.alias("judgement")) for k, v in rules().items()]))
    return df.select("channel", "topic_code", pairs.alias("p")).select("channel", "topic_code", "p.*")


def check_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations ``ref, field, value`` against ``evidence`` (``ref, field, found``): ok, differs or missing."""
    joined = citations.join(evidence, ["ref", "field"], "left")
    return joined.withColumn("verdict", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("value"), "ok").otherwise("differs"))
