"""Vendor export files as DataFrames of text columns, and their normalisation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patquarry.functions.text import blank_to_null, clean_long_text, parse_date
from patquarry.sources import workbook

#: Encodings in the order in which they are tried, the headers that mark a patent table, and delimiters (fixed values).
ENCODINGS = ("utf-8-sig", "utf-16", "big5", "cp950", "gb18030")
MARKERS = ("申请号", "标题", "申请日")
DELIMITERS = (",", "\t", ";", "|")
#: Those that Spark's own reader takes.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-16": "UTF-16"}


def head(spark: SparkSession, path: str, most: int = 65_536) -> bytes:
    """The first bytes of a file of any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def sniff(raw: bytes) -> tuple[str, str]:
    """Encoding and delimiter of a delimited file, from its first bytes; the delimiter that the first line has most of."""
    for encoding in ENCODINGS:
        if encoding == "utf-16" and not raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            continue
        for cut in range(4):  # the last character may be cut off
            try:
                text = raw[: len(raw) - cut].decode(encoding)
            except UnicodeDecodeError:
                continue
            line = text.partition("\n")[0]
            return encoding, max(DELIMITERS, key=line.count)
    raise ValueError("no known encoding fits")


def _decoded(spark: SparkSession, path: str, encoding: str, delimiter: str, header: list[str]) -> DataFrame:
    """Files in an encoding that Spark's reader does not take, each decoded and parsed in one task."""
    import csv
    import io

    import pandas as pd

    def parse(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for content in batch["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode(encoding), newline=""), delimiter=delimiter))[1:]
                full = [[x or None for x in r[: len(header)]] + [None] * (len(header) - len(r)) for r in rows if any(r)]
                yield pd.DataFrame(full, columns=range(len(header)), dtype=object)

    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    df = spark.read.format("binaryFile").load(path).select("content")
    return df.mapInPandas(lambda it: (x.rename(columns=lambda i: f"c{i}") for x in parse(it)), schema).toDF(*header)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header: quoted line ends stay, short rows end in nulls, all columns are text."""
    raw = head(spark, path)
    encoding, delimiter = sniff(raw)
    if encoding not in _SPARK_NAMES:
        line = raw.partition(b"\n")[0].decode(encoding).strip("\r")
        return _decoded(spark, path, encoding, delimiter, [c.strip().strip('"') for c in line.split(delimiter)])
    df = spark.read.csv(path, header=True, sep=delimiter, encoding=_SPARK_NAMES[encoding], multiLine=True, inferSchema=False, escape='"', mode="PERMISSIVE")
    return df.toDF(*[c.lstrip(chr(0xFEFF)).strip() for c in df.columns])


#: Attributes that name the field which an element holds (fixed values).
FIELD_NAMES = ("name", "field", "label", "title")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _flat(element) -> dict[str, str | None]:  # noqa: ANN001
    """An element's fields: its attributes, its children's texts and other attributes, and what those below hold; the first value of a name stays."""
    found: dict[str, str | None] = {_local(k): v for k, v in element.attrib.items()}
    if not len(element):
        text = (element.text or "").strip()
        return {_local(element.tag): text} if text else found
    for child in element:
        name = next((child.attrib[a].strip() for a in FIELD_NAMES if child.attrib.get(a)), _local(child.tag))
        if len(child):
            more = _flat(child)
        else:
            more = {name: (child.text or "").strip() or None} | {f"{name}_{_local(k)}": v for k, v in child.attrib.items() if k not in FIELD_NAMES}
        for k, v in more.items():
            found.setdefault(k, v)
    return found


def row_tag_of(raw: bytes, markers: Sequence[str] = MARKERS) -> str:
    """The tag of a file's rows, as it is written there, from its first bytes: that whose elements have most markers as fields, the more frequent of
    several; without markers that of the first element below the root."""
    from xml.etree import ElementTree

    parser, depth, first, seen = ElementTree.XMLPullParser(("start", "end")), 0, None, {}
    try:
        parser.feed(raw)
        for event, element in parser.read_events():
            depth += 1 if event == "start" else -1
            if event == "start" and depth == 2 and first is None:
                first = _local(element.tag)
            if event == "end" and depth and (score := len(set(markers) & set(_flat(element)))):
                n, best = seen.get(_local(element.tag), (0, 0))
                seen[_local(element.tag)] = (n + 1, max(best, score))
    except ElementTree.ParseError:
        pass  # what follows the bytes that were read
    tag = max(seen, key=lambda t: (seen[t][1], seen[t][0])) if seen else first
    if tag is None:
        raise ValueError("no elements below the root")
    import re

    return re.search(rf"<((?:[\w.-]+:)?{re.escape(tag)})[\s/>]", raw.decode("utf-8", "replace"))[1]


def _fragments(tag: str):
    """Rows of the text that ends before each end tag; prefixes go, as what they stand for is outside."""
    import re
    from xml.etree import ElementTree

    import pyarrow as pa

    start, prefix = re.compile(rf"<{re.escape(tag)}[\s/>]"), re.compile(r"(</?|\s)(?!xml\b)[\w.-]+:(?=[\w.-]+[\s=/>])")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                at = start.search(x)
                if at is None:
                    continue
                text = re.sub(r"\sxmlns(:[\w.-]+)?=(\"[^\"]*\"|'[^']*')", "", x[at.start() :] + f"</{tag}>")
                fields = _flat(ElementTree.fromstring(prefix.sub(r"\1", text)))
                if any(v for v in fields.values()):
                    out.append(list(fields.items()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.map_(pa.string(), pa.string()))], names=["cells"])

    return run


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Elements of one tag as rows of text columns; without a tag that is chosen by its elements' fields.

    Files are split at the end tag, so a large one is read by many tasks. A row is flattened: attributes, children by their name
    or by the attribute that names the field, and theirs. Columns are all fields of any row, in alphabetical order; rows without a value are left out."""
    tag = row_tag or row_tag_of(head(spark, path))
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).mapInArrow(_fragments(tag), "cells map<string,string>")
    names = sorted(r.k for r in rows.select(F.explode(F.map_keys("cells")).alias("k")).distinct().collect())  # a row a column
    return rows.select(*[F.col("cells")[n].alias(n) for n in names])


def read_jdbc(spark: SparkSession, path: str, table: str | Sequence[str], driver: str, **options: str) -> DataFrame:
    """A table of a database file through a driver that the cluster has; of several the one whose columns have most markers."""
    of = lambda t: spark.read.format("jdbc").options(url=path, dbtable=t, driver=driver, **options).load()
    if isinstance(table, str):
        return of(table)
    return max(map(of, table), key=lambda df: len(set(MARKERS) & set(df.columns)))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The sheet of a workbook whose header has most markers; see ``workbook.read_workbook``."""
    return workbook.read_workbook(spark, path, MARKERS)


READERS: dict[str, Callable[..., DataFrame]] = {".xlsx": read_workbook, ".csv": read_delimited, ".txt": read_delimited, ".tsv": read_delimited, ".xml": read_xml, ".mdb": read_jdbc, ".accdb": read_jdbc}


def load(spark: SparkSession, path: str, **more: str) -> DataFrame:
    """A vendor file by its suffix; raises for one that no reader takes."""
    suffix = f".{path.rpartition('.')[2].lower()}"
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix}")
    return READERS[suffix](spark, path, **more)


#: Headers of an alias file (fixed values) and the columns they become.
ALIAS_HEADERS = {"申請人代碼": "code", "公司中文名稱": "name_zh", "正規化名稱": "name_norm", "別稱": "alias"}


def load_aliases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alias rows of a file and those dropped; see ``aliases``. Missing columns are null, and rows count in the file's order."""
    df = rename_headers(load(spark, path), ALIAS_HEADERS)
    return aliases(df.select(*[(F.trim(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ALIAS_HEADERS.values()], F.monotonically_increasing_id().alias("row_no")))


def is_patent_table(columns: Sequence[str]) -> bool:
    return set(MARKERS) <= set(columns)


def rename_headers(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns under their canonical names; where two have one name the first stays."""
    seen: dict[str, str] = {}
    for c in df.columns:
        seen.setdefault(names.get(c, c), c)
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in seen.items()])


def normalized(df: DataFrame, text: Sequence[str], dates: Mapping[str, Sequence[str]], status: str, fallback: str) -> DataFrame:
    """Cleaned text columns, the first date that parses of each group, and the status with its fallback."""
    first: Callable[[Sequence[str]], Column] = lambda cs: F.coalesce(*[parse_date(F.col(c)) for c in cs])
    return df.select(*[clean_long_text(F.col(c)).alias(c) for c in text], *[first(cs).alias(name) for name, cs in dates.items()], F.coalesce(blank_to_null(F.col(status)), blank_to_null(F.col(fallback))).alias(status))


def new_files(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files whose content was not imported before; ``digest`` is the SHA-256 of their bytes."""
    return files.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"]).join(imported.select("digest"), "digest", "left_anti")


def scan_statistics(df: DataFrame, column: str) -> DataFrame:
    """How often each value of a column occurs, blank ones as null."""
    return df.groupBy(blank_to_null(F.col(column)).alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def aliases(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alias rows by code and lookup key, the first of each kept, and those dropped. ``row_no`` numbers the file's rows."""
    from pyspark.sql.window import Window

    from patquarry.functions.text import lookup_key

    keyed = df.withColumn("lookup", lookup_key(F.col("alias"))).withColumn("_nth", F.row_number().over(Window.partitionBy("code", "lookup").orderBy("row_no")))
    ok = (F.col("_nth") == 1) & F.col("lookup").isNotNull() & (blank_to_null(F.col("name_zh")).isNotNull() | blank_to_null(F.col("name_norm")).isNotNull())
    return keyed.where(ok).drop("_nth"), keyed.where(~ok).drop("_nth")
