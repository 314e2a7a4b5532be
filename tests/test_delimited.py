"""Delimited files in parts, against Python's own reader of whole files."""

import csv
import io
import random

import pytest

from patquarry.sources import delimited


def written(path, r, rows, end):
    text = io.StringIO()
    out = csv.writer(text, lineterminator=end)
    out.writerow(["id", "a", "b", "c"])
    cell = lambda: r.choice(["", "x", "with, comma", 'a "quoted" word', "two\nlines", "a\n\nb\n", "é" * r.randint(1, 30), "y" * r.randint(1, 200)])
    for i in range(rows):
        out.writerow([i, *(cell() for _ in range(r.choice((3, 3, 3, 2, 4))))])
    path.write_bytes(text.getvalue().encode("utf-8"))
    return text.getvalue()


@pytest.mark.parametrize("size", ["300", "5000", "134217728"])
def test_parts_give_what_a_whole_reader_does(spark, tmp_path, size):
    """With parts of a few hundred bytes records go over several of them, and quotes hold whole parts."""
    r = random.Random(int(size))
    texts = {f"f{k}.csv": written(tmp_path / f"f{k}.csv", r, n, end) for k, (n, end) in enumerate(((200, "\n"), (150, "\r\n"), (0, "\n")))}
    long = 'id,a,b,c\n1,"' + "line\n" * 500 + '",2,3\n4,5,6,7\n'
    (tmp_path / "long.csv").write_text(long)
    texts["long.csv"] = long
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = delimited.read(spark, str(tmp_path), ["id", "a", "b", "c"])
        got = {}
        for x in df.collect():
            got.setdefault(x.file.rpartition("/")[2], []).append(x)
        if size == "300":
            assert len({x.part for x in got["f0.csv"]}) > 20
        some = delimited.read(spark, str(tmp_path), ["id", "a", "b", "c"], columns=["c", "id"])
        assert some.columns == ["file", "part", "nth", "c", "id"] and some.count() == df.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        want = [(x + [""] * 4)[:4] for x in list(csv.reader(io.StringIO(text, newline="")))[1:] if any(x)]
        own = sorted(got.get(name, []), key=lambda x: (x.part, x.nth))
        assert [[x.id or "", x.a or "", x.b or "", x.c or ""] for x in own] == want, name


def test_an_open_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,a\n1,"never closed\n2,x\n')
    (tmp_path / "b.csv").write_text("")
    rows = delimited.read(spark, str(tmp_path), ["id", "a"]).collect()
    assert [(r.id, r.a) for r in rows] == [("1", "never closed\n2,x")]
