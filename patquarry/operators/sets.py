"""Workspaces as sets of patents, search terms, and exact vector search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from patquarry.functions.text import blank_to_null, lookup_key, split_multi_value


def compose(members: DataFrame, workspaces: Sequence[int]) -> DataFrame:
    """The union of two workspaces or more, each patent with the number of sources that have it."""
    if len(set(workspaces)) < 2:
        raise ValueError("a composition needs two different workspaces")
    return members.where(F.col("workspace_id").isin(*workspaces)).groupBy("patent_id").agg(F.count_distinct("workspace_id").alias("sources"))


def composition_counts(members: DataFrame, workspaces: Sequence[int]) -> DataFrame:
    """One row: sum of the sources' sizes, size of the union, and duplicates."""
    n = compose(members, workspaces).agg(F.sum("sources").alias("total"), F.count(F.lit(1)).alias("distinct_count"))
    return n.withColumn("duplicate_count", F.col("total") - F.col("distinct_count"))


def add_patents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ordered union: ``patent_id, position``; what was there first stays first."""
    both = old.select("patent_id", F.lit(0).alias("part"), "position").unionByName(new.select("patent_id", F.lit(1).alias("part"), "position"))
    return both.groupBy("patent_id").agg(F.min(F.struct("part", "position")).alias("at")).select("patent_id", F.col("at.part").alias("part"), F.col("at.position").alias("position"))


def normalize_ids(ids: Column) -> Column:
    """Positive whole numbers, each once, in order; raises on others."""
    bad = F.exists(ids, lambda x: F.coalesce(x.try_cast("long") <= 0, F.lit(True)) | (x.cast("string").contains(".")))
    return F.when(bad, F.raise_error(F.lit("ids must be positive whole numbers"))).otherwise(F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("long")))))


def analysis_members(members: DataFrame, excluded: DataFrame, global_workspaces: Sequence[int] = ()) -> DataFrame:
    """Members without those excluded from their workspace; a global workspace keeps all."""
    keeps = F.col("workspace_id").isin(*global_workspaces) if global_workspaces else F.lit(False)
    gone = excluded.where("status = 'excluded'").select("workspace_id", "patent_id")
    return members.where(~keeps).join(gone, ["workspace_id", "patent_id"], "left_anti").unionByName(members.where(keeps))


def search_terms(patents: DataFrame, fields: Mapping[str, int]) -> DataFrame:
    """``patent_id, field, term, lookup, source_rank``: each field's parts; one row for each patent, field and lookup."""
    return _entries(patents, fields).groupBy("patent_id", "field", "lookup").agg(F.min("term").alias("term"), F.min("source_rank").alias("source_rank"))


def lookups(patents: DataFrame, fields: Mapping[str, int]) -> DataFrame:
    """``patent_id, lookup`` of the search terms, without grouping: a patent may have a lookup several times."""
    return _entries(patents, fields).select("patent_id", "lookup")


def _entries(patents: DataFrame, fields: Mapping[str, int]) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("source_rank"), F.col(f).cast("string").alias("value")) for f, r in fields.items()]))
    rows = patents.select("patent_id", entries.alias("e")).select("patent_id", "e.field", "e.source_rank", F.explode(split_multi_value(F.col("e.value"))).alias("term"))
    return rows.withColumn("lookup", lookup_key(F.col("term"))).where("lookup is not null")


def keyword_search(patents: DataFrame, terms: DataFrame, keyword: str) -> DataFrame:
    """Patents of which a term has the keyword, in which % and _ are wildcards; a blank keyword filters nothing."""
    key = " ".join(keyword.lower().split())
    return patents.join(terms.where(F.col("lookup").like(f"%{key}%")).select("patent_id"), "patent_id", "left_semi") if key else patents


def number_search(patents: DataFrame, number: Column, text: str) -> DataFrame:
    """Patents whose display number has the text in either case; a blank text finds none."""
    return patents.where(number.ilike(f"%{text.strip()}%") if text.strip() else F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(vectors: DataFrame, subject: int, most: int = 10) -> DataFrame:
    """The patents nearest to one by cosine distance, each by its nearest vector. The subject's vector is one row: the latest one, the smallest
    of several of that time; a subject without a vector raises."""
    own = vectors.where((F.col("patent_id") == subject) & F.col("vector").isNotNull())
    one = own.agg(F.max("created").alias("created")).join(own, "created").agg(F.min("vector").alias("_subject")).where("_subject is not null")
    if one.isEmpty():
        raise ValueError(f"patent {subject} has no vector")
    rows = vectors.where(F.col("patent_id") != subject).join(F.broadcast(one)).select("patent_id", cosine_distance(F.col("vector"), F.col("_subject")).alias("distance"))
    return rows.groupBy("patent_id").agg(F.min("distance").alias("distance")).orderBy("distance", "patent_id").limit(most)


def mean_vector(vector: Column, weight: Column | None = None) -> Column:
    """The mean of vectors in a group, merged from each task's, so that no component is a row of its own."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    return vector_to_array(Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def centroid_distance(rows: DataFrame) -> DataFrame:
    """Euclidean distance of each vector to the mean of its topic: ``topic, patent_id, distance``."""
    means = rows.groupBy("topic").agg(mean_vector(F.col("vector")).alias("_mean"))
    return rows.join(means, "topic").select("topic", "patent_id", euclidean(F.col("vector"), F.col("_mean")).alias("distance"))


def weighted_mean(chunks: DataFrame) -> DataFrame:
    """The mean of each patent's chunk vectors by their shares of tokens, or by equal shares where there are no tokens."""
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("double")
    means = chunks.groupBy("patent_id").agg(mean_vector(F.col("vector"), tokens).alias("by_tokens"), mean_vector(F.col("vector")).alias("equal"), F.sum(tokens).alias("n"))
    return means.select("patent_id", F.posexplode(F.when(F.col("n") > 0, F.col("by_tokens")).otherwise(F.col("equal"))).alias("at", "value"))


def pending(patents: DataFrame, blank: Column, country: str = "TW") -> DataFrame:
    """How many patents of a country there are and how many lack a status."""
    return patents.where(F.upper(F.trim("country_code")) == country).agg(F.count(F.lit(1)).alias("patents"), F.count_if(blank).alias("without_status"))


def display(patents: DataFrame, columns: Sequence[str]) -> DataFrame:
    return patents.select("patent_id", *[blank_to_null(F.col(c)).alias(c) for c in columns])
