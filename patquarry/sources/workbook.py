"""Workbooks (.xlsx): zipped XML, read with the standard library inside tasks, a file to a task."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Numbers of the built-in formats that show dates or times (fixed values of the format).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "file string, sheets array<string>, sheet string, row_number int, headers array<string>, cells map<string,string>, image binary, images int"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


class Workbook:
    """Sheets, their rows of texts and their pictures, from a file's bytes."""

    def __init__(self, raw: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        targets = self._relations("xl/workbook.xml")
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): targets[s.get(f"{_R}id")] for s in root.iter() if _name(s.tag) == "sheet"}
        self.from_1904 = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
        self.shared, self.dates = [], set()
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for _, e in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
                if _name(e.tag) == "si":
                    self.shared.append("".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"))
                    e.clear()
        if "xl/styles.xml" in self.zip.namelist():
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(e.get("numFmtId")) for e in styles.iter() if _name(e.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))}
            formats = [int(x.get("numFmtId", 0)) for e in styles.iter() if _name(e.tag) == "cellXfs" for x in e]
            self.dates = {i for i, n in enumerate(formats) if n in DATE_FORMATS or n in own}

    def _relations(self, part: str) -> dict[str, str]:
        """Paths in the archive that a part's relations point to, by their ids."""
        base, name = posixpath.split(part)
        path = f"{base}/_rels/{name}.rels"
        if path not in self.zip.namelist():
            return {}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{base}/{t}")
        return {e.get("Id"): place(e.get("Target")) for e in ElementTree.fromstring(self.zip.read(path)) if e.get("TargetMode") != "External"}

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if _name(t.tag) == "t")
        value = next((e.text for e in cell if _name(e.tag) == "v"), None)
        if value is None or kind in ("str", "e"):
            return value
        if kind == "s":
            return self.shared[int(value)]
        if kind == "b":
            return "True" if value == "1" else "False"
        number = float(value)
        if int(cell.get("s", 0)) in self.dates:
            at = datetime(1904, 1, 1) if self.from_1904 else datetime(1899, 12, 30)
            when = at + timedelta(seconds=round(number * 86_400))
            return when.isoformat(" ") if when.time() != when.min.time() else when.date().isoformat()
        return str(int(number)) if number.is_integer() and "e" not in value.lower() else repr(number)

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """Number and texts of each row of a sheet."""
        at = 0
        for _, e in ElementTree.iterparse(self.zip.open(self.sheets[sheet])):
            if _name(e.tag) != "row":
                continue
            at = int(e.get("r", at + 1))
            found: dict[int, str | None] = {}
            for cell in e:
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                found[column - 1 if letters else len(found)] = self._text(cell)
            yield at, [found.get(i) for i in range(max(found, default=-1) + 1)]
            e.clear()

    def pictures(self, sheet: str) -> dict[int, list[bytes]]:
        """Pictures by the row in which they begin, in order."""
        found: dict[int, list[bytes]] = {}
        for drawing in self._relations(self.sheets[sheet]).values():
            if "/drawings/" not in drawing or not drawing.endswith(".xml") or drawing not in self.zip.namelist():
                continue
            media = self._relations(drawing)
            for anchor in ElementTree.fromstring(self.zip.read(drawing)):
                row = next((int(r.text) for f in anchor if _name(f.tag) == "from" for r in f if _name(r.tag) == "row"), None)
                blip = next((e.get(f"{_R}embed") for e in anchor.iter() if _name(e.tag) == "blip"), None)
                if row is not None and media.get(blip) in self.zip.namelist():
                    found.setdefault(row + 1, []).append(self.zip.read(media[blip]))
        return found

    def best_sheet(self, markers: Sequence[str]) -> str:
        """The sheet whose first row has most of the markers, the first of several."""
        first = {s: next(self.rows(s), (1, []))[1] for s in self.sheets}
        return max(self.sheets, key=lambda s: len(set(markers) & {(x or "").strip() for x in first[s]}))


def _parse(markers: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                book = Workbook(content)
                sheet = book.best_sheet(markers)
                rows, pictures = book.rows(sheet), book.pictures(sheet)
                headers = [(x or "").strip() for x in next(rows, (1, []))[1]]
                out: list[dict] = [{"row_number": 1, "cells": [], "image": None, "images": 0}]
                for number, values in rows:
                    cells = {h: v for h, v in zip(headers, values) if h}  # noqa: B905
                    if any(v not in (None, "") for v in cells.values()):
                        images = pictures.get(number, [])
                        out.append({"row_number": number, "cells": list(cells.items()), "image": images[0] if images else None, "images": len(images)})
                for start in range(0, len(out), 1000):
                    part = out[start : start + 1000]
                    same = lambda x, t, n=len(part): pa.array([x] * n, t)
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(file, pa.string()), same(list(book.sheets), pa.list_(pa.string())), same(sheet, pa.string()), pa.array([r["row_number"] for r in part], pa.int32()),
                            same([h for h in headers if h], pa.list_(pa.string())), pa.array([r["cells"] for r in part], pa.map_(pa.string(), pa.string())), pa.array([r["image"] for r in part], pa.binary()), pa.array([r["images"] for r in part], pa.int32()),
                        ],
                        names=["file", "sheets", "sheet", "row_number", "headers", "cells", "image", "images"],
                    )

    return run


def read_workbook(spark: SparkSession, path: str, markers: Sequence[str]) -> DataFrame:
    """Rows of the sheet whose header has most markers, as columns of text, with ``_row_number`` (the header is 1), the first
    picture that begins in the row, ``_image``, and how many do, ``_images``. Rows without a value are left out.

    Dates are ISO text. Several files may be read at once; columns are those of all headers, in the order of their first place.
    A workbook is read in one task; the format allows a million rows."""
    parsed = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse(markers), CELLS)
    heads = parsed.where("row_number = 1").select("file", "headers").orderBy("file").collect()  # a row a file
    names = list(dict.fromkeys(h for r in heads for h in r.headers))
    rows = parsed.where("row_number > 1")
    return rows.select(*[F.col("cells")[n].alias(n) for n in names], F.col("row_number").alias("_row_number"), F.col("image").alias("_image"), F.col("images").alias("_images"))
