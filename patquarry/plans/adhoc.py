"""Read-only SQL over registered tables, limited to a population."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Relations that a checked statement may end in (empty private tables, constant rows, its own common tables), and expressions that
#: reach out of the engine.
_LEAVES = {"LocalRelation", "LogicalRDD", "OneRowRelation", "Range", "CTERelationRef"}
_OUTSIDE = {"CallMethodViaReflection", "TryReflect"}


def _items(seq):  # noqa: ANN001, ANN202
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan):  # noqa: ANN001, ANN202
    """A plan's nodes with those of subqueries in expressions."""
    yield plan
    for part in (*_items(plan.children()), *_items(plan.subqueries())):
        yield from _nodes(part)


def _kinds(expression):  # noqa: ANN001, ANN202
    yield expression.getClass().getSimpleName()
    for child in _items(expression.children()):
        yield from _kinds(child)


def checked_plan(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> list[str]:
    """The kinds of node in the analysed plan of one query over ``tables``; raises for a statement that reads anything else.

    The statement is parsed alone first, so it cannot close what is put around it, and analysed over empty tables of private
    names: its plan may end in those, in constant rows and in its own common tables, but in no file or table of the session."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    except Exception as e:
        raise ValueError("not one query") from e
    names = {}
    for name, df in tables.items():
        names[name] = f"{name}_{uuid.uuid4().hex}"
        spark.createDataFrame([], df.schema).createOrReplaceTempView(names[name])
    try:
        head = ", ".join(f"{name} as (select * from {view})" for name, view in names.items())
        nodes = list(_nodes(spark.sql(f"with {head} select * from (\n{sql}\n)")._jdf.queryExecution().analyzed()))
        kinds = []
        for node in nodes:
            kind = node.getClass().getSimpleName()
            kinds.append(kind)
            if kind == "View" and node.desc().identifier().table() not in names.values():
                raise ValueError(f"a statement may only read {', '.join(tables)}")
            if not node.children().size() and kind not in _LEAVES:
                raise ValueError(f"a statement may only read {', '.join(tables)}, not a {kind}")
            if _OUTSIDE.intersection(k for e in _items(node.expressions()) for k in _kinds(e)):
                raise ValueError("a statement may not call methods of the machine")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    return kinds


def scoped_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], patents: DataFrame, most: int | None = None) -> DataFrame:
    """One SELECT over ``tables``, each of which shows only the patents of the population.

    A statement refers to tables by the plain name. Scoping the tables themselves, before any limit of the statement, cannot be escaped
    by it: ``checked_plan`` refuses every other relation. Views have private names. With ``most`` the result is cut to
    that many rows."""
    checked_plan(spark, sql, tables)
    ids = patents.select("patent_id").distinct()
    names = {}
    for name, df in tables.items():
        view = f"{name}_{uuid.uuid4().hex[:8]}"
        (df.join(ids, "patent_id", "left_semi") if "patent_id" in df.columns else df).createOrReplaceTempView(view)
        names[name] = view
    head = ", ".join(f"{name} as (select * from {view})" for name, view in names.items())
    out = spark.sql(f"with {head} select * from (\n{sql}\n)")
    return out.limit(most) if most is not None else out


def rows_within(df: DataFrame, seconds: float = 120) -> list:
    """The rows of a small result, or a TimeoutError: the jobs of a statement that takes longer are cancelled."""
    context, tag, late = df.sparkSession.sparkContext, f"adhoc-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def narrative_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], patents: DataFrame) -> DataFrame:
    """One SELECT whose rows are patents of the population: it must return ``patent_id`` and neither aggregate nor use windows.

    The statement's own plan is judged, over empty tables of the same columns, so how the tables came about does not count."""
    if {"Aggregate", "Window"}.intersection(checked_plan(spark, sql, tables)):
        raise ValueError("a narrative shows patents, not aggregates or windows over them")
    out = scoped_sql(spark, sql, tables, patents)
    if "patent_id" not in out.columns:
        raise ValueError("a narrative must return patent_id")
    return out.join(patents.select("patent_id").distinct(), "patent_id", "left_semi")


def evidence(df: DataFrame, column: str, values: list[str], most: int = 50) -> DataFrame:
    """Rows whose value, as text, is one of the given ones, with their total and whether more were left out."""
    rows = df.where(F.col(column).cast("string").isin(*values) if values else F.lit(False))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.limit(most).join(F.broadcast(total)).withColumn("truncated", F.col("total") > most)
