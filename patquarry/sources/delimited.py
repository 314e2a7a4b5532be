"""Large delimited files read by many tasks, quoted line ends included.

Spark parts a text file at any line end, also at one inside quotes. Whether a part begins inside quotes follows from the number of quotes before
it in its file, so a first pass counts quotes by part, and a second one joins each part's lines to records, knowing how it begins. A
record that goes over the end of a part leaves a piece in each; the pieces of a file are few and are joined in order.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Parts of files that may be told apart; each is a split of Spark's, of some 100 MB as a rule.
MOST_PARTS = 1_000_000
RECORDS = "file string, part long, nth long, kind int, record string"
_NAMES, _TYPES = ("file", "part", "nth", "kind", "record"), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``value, file, part``: lines, with the byte at which the split that they are read with begins."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))


def _records(batches: Iterator[pa.RecordBatch], inside: dict[tuple[str, int], bool]) -> Iterator[pa.RecordBatch]:
    """Records of each part (kind 0), and pieces of others: one that a later part goes on with (2), one that ends a record begun before (3), or neither
    begins nor ends one (1)."""
    key, held, open_, first, nth = None, [], False, False, 0
    out: list[tuple] = []

    def put(kind: int) -> None:
        nonlocal nth
        out.append((*key, nth, kind, "\n".join(held)))
        nth += 1
        held.clear()

    for batch in batches:
        for value, *now in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if tuple(now) != key:
                if held:
                    put(1 if first else 2)
                key, nth = tuple(now), 0
                open_ = first = inside.get(key, False)
            held.append(value)
            if value.count('"') % 2:
                open_ = not open_
            if not open_:
                put(3 if first else 0)
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
            out = []
    if held:
        put(1 if first else 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, part, nth, record``: the records of UTF-8 files in the order of (part, nth) in each, quoted line ends in them.

    The driver gets a row a split. Quotes are doubled inside quotes; one that is never closed makes what follows in its file one record."""
    lines = _lines(spark, path)
    parts = lines.groupBy("file", "part").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("file", "part", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")).where("inside")
    known = begins.limit(MOST_PARTS + 1).collect()
    if len(known) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts begin inside quotes")
    found = lines.select("file", "part", "value").select("value", "file", "part").mapInArrow(partial(_records, inside={(r.file, r.part): True for r in known}), RECORDS)
    whole = found.where("kind = 0").select("file", "part", "nth", "record")
    if not known:
        return whole.unionByName(found.where("kind = 2").select("file", "part", "nth", "record"))  # the end of a file inside quotes
    pieces = found.where("kind != 0")
    chain = F.sum((F.col("kind") == 2).cast("int")).over(Window.partitionBy("file").orderBy("part", "nth"))
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_sort(F.collect_list(F.struct("part", "nth", "record"))).alias("p"))
    return whole.unionByName(joined.select("file", F.col("p")[0]["part"].alias("part"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))


def _cells(batches: Iterator[pa.RecordBatch], delimiter: str, header: list[str], at: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in at]
        kept: list[int] = []
        for i, record in enumerate(batch.column(3).to_pylist()):
            row = next(csv.reader(io.StringIO(record.removesuffix("\r"), newline=""), delimiter=delimiter), [])
            row = [x.removeprefix("﻿") for x in row[:1]] + row[1:]
            if not any(row) or [x.strip() for x in row[: len(header)]] == header:
                continue
            kept.append(i)
            for c, k in zip(columns, at, strict=True):
                c.append((row[k] or None) if k < len(row) else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(kept, pa.int32())) for k in range(3)), *(pa.array(c, pa.string()) for c in columns)], names=["file", "part", "nth", *(f"c{k}" for k in at)])


def read(spark: SparkSession, path: str | Sequence[str], header: Sequence[str], delimiter: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Files of one header as text columns, ``columns`` of it or all, with ``file, part, nth``, which order the rows of a file.

    Empty cells are null, short rows end in nulls, further cells are left out, as are empty rows and rows that are the header."""
    chosen = list(columns or header)
    at = [list(header).index(c) for c in chosen]
    schema = "file string, part long, nth long, " + ", ".join(f"c{k} string" for k in at)
    cells = records(spark, path).mapInArrow(partial(_cells, delimiter=delimiter, header=list(header), at=at), schema)
    return cells.toDF("file", "part", "nth", *chosen)
