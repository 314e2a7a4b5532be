"""Identity of incoming rows, and the differential update of stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions.text import blank_to_null


def find_identity(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], row: str = "row_no") -> DataFrame:
    """``row, patent_id``: the stored patent that an incoming row names, by the first of ``keys`` that finds one, the lowest id of those."""
    pairs = lambda df, *c: df.select(*c, F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), blank_to_null(F.col(k)).alias("value")) for i, k in enumerate(keys)])).alias("k")).select(*c, "k.*").where("value is not null")
    found = pairs(incoming, row).join(pairs(stored, "patent_id").groupBy("priority", "value").agg(F.min("patent_id").alias("patent_id")), ["priority", "value"])
    best = found.groupBy(row).agg(F.min(F.struct("priority", "patent_id")).alias("b")).select(row, F.col("b.patent_id").alias("patent_id"))
    return incoming.select(row).join(best, row, "left")


def find_by_application(incoming: DataFrame, stored: DataFrame, number: str, context: Sequence[str], row: str = "row_no") -> DataFrame:
    """``row, patent_id``: the stored patent of an incoming row's application number whose context (country, database) is the same or null on
    either side; equal ones first, in the order of ``context``, then the lowest id. Stored patents of one number and context are one candidate."""
    known = stored.where(F.col(number).isNotNull()).groupBy(number, *context).agg(F.min("patent_id").alias("patent_id")).select(number, "patent_id", *[F.col(c).alias(f"_{c}") for c in context])
    pairs = incoming.select(row, number, *context).join(known, number)
    for c in context:
        pairs = pairs.where(F.col(c).isNull() | F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
    order = F.struct(*[(~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))).alias(c) for c in context], "patent_id")
    best = pairs.groupBy(row).agg(F.min(order)["patent_id"].alias("patent_id"))
    return incoming.select(row).join(best, row, "left")


def fold(incoming: DataFrame, key: str, columns: Sequence[str], row: str = "row_no") -> DataFrame:
    """Several rows of one patent as one: of each column the last filled value in the order of rows."""
    last = lambda c: F.max(F.when(blank_to_null(F.col(c)).isNotNull(), F.struct(row, c)))[c].alias(c)
    return incoming.groupBy(key).agg(*map(last, columns))


def differential(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored rows with every column replaced where the incoming value is filled and differs, and ``updated``: whether any was."""
    new = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    changed = {c: blank_to_null(F.col(f"_new_{c}")).isNotNull() & ~F.col(f"_new_{c}").cast("string").eqNullSafe(F.col(c).cast("string")) for c in columns}
    any_: Column = F.lit(False)
    for c in changed.values():
        any_ = any_ | c
    out = stored.join(new, key, "left")
    return out.select(key, *[F.when(changed[c], F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], any_.alias("updated"))


def guard_status(rows: DataFrame) -> DataFrame:
    """A status that someone registered, i.e. a history entry without source, is kept; a differing incoming one is a conflict.

    A change by an import joins the history; of its entries' fields ``from_status``, ``to_status`` and ``source`` are filled."""
    before = F.coalesce("history", F.array())
    manual = F.exists(before, lambda h: h["source"].isNull())
    differs = blank_to_null(F.col("incoming")).isNotNull() & ~F.col("incoming").eqNullSafe(F.col("legal_status"))
    known = {"from_status": F.col("legal_status"), "to_status": F.col("incoming"), "source": F.lit("import")}
    entry = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema["history"].dataType.elementType.fields])
    return rows.withColumns(
        {
            "conflict": manual & differs,
            "history": F.when(differs & ~manual, F.concat(before, F.array(entry))).otherwise(F.col("history")),
            "legal_status": F.when(differs & ~manual, F.col("incoming")).otherwise(F.col("legal_status")),
        }
    )


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those incoming ones, one a key, that are new."""
    return stored.unionByName(incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def pending_embeddings(texts: DataFrame, stored: DataFrame, model: str, model_version: str, preprocessing: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with a text for which the model's version has no embedding of the same id, preprocessing version and text.

    ``stored`` has ``key, embedding_model, model_version, preprocessing_version, text_hash`` (SHA-256 in hex)."""
    keys = [key, "preprocessing_version", "text_hash"]
    known = stored.where((F.col("embedding_model") == model) & (F.col("model_version") == model_version)).select(*keys)
    asked = texts.where(F.col(text).isNotNull()).withColumns({"preprocessing_version": F.lit(preprocessing), "text_hash": F.sha2(text, 256)})
    return asked.join(known, keys, "left_anti").select(*texts.columns)


def backfill(df: DataFrame, raw: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Missing values from the latest raw record of each row."""
    latest = raw.groupBy(key).agg(F.max(F.struct(order, column))[column].alias("_raw"))
    return df.join(latest, key, "left").withColumn(column, F.coalesce(column, "_raw")).drop("_raw")


def figure_rank(kind: Column) -> Column:
    """Of a document's stage: granted before published, others after."""
    k = F.substring(F.upper(F.trim(kind)), 1, 1)
    return F.when(k == "B", 2).when(k == "A", 1).otherwise(0)


def cached_figure(figures: DataFrame) -> DataFrame:
    """The figure of the highest stage of each patent, the first on a tie."""
    order = [figure_rank(F.col("document_kind")).desc(), F.col("row_no")]
    return figures.withColumn("_nth", F.row_number().over(Window.partitionBy("patent_id").orderBy(*order))).where("_nth = 1").drop("_nth")
