from pyspark.sql import functions as F

from patquarry.sources import readers, sinks
from patquarry.streaming import incremental


def test_delimited(spark, tmp_path):
    for encoding, sep in (("utf-8-sig", ","), ("utf-16", "\t"), ("big5", ";"), ("gb18030", "|")):
        title = "标题" if encoding == "gb18030" else "標題"
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(f'{title}{sep}n\n"a\nb"{sep}1\n申請{sep}2\n'.encode(encoding) if encoding != "gb18030" else f'{title}{sep}n\n"a\nb"{sep}1\n申请{sep}2\n'.encode(encoding))
        df = readers.load(spark, str(path))
        assert df.columns[1] == "n" and [r.n for r in df.collect()] == ["1", "2"]
        assert df.first()[0] == "a\nb"


def test_xml_and_unknown(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><p><a>1</a><b>x</b></p><p><a>2</a></p></r>")
    assert readers.load(spark, str(tmp_path / "a.xml"), row_tag="p").count() == 2
    try:
        readers.load(spark, "x.zip")
    except ValueError as e:
        assert ".zip" in str(e)


def test_xml_chooses_its_rows(spark, tmp_path):
    """Rows are those with most markers; attributes name fields; prefixes, nesting, empty rows and a flat file."""
    rows = "".join(f"<p:item id='{i}'><f name='申请号'>A{i}</f><f label='标题' lang='x'>t {i}</f><more><申请日>2020-01-0{i}</申请日><deep><申请号>no</申请号></deep></more></p:item>" for i in (1, 2, 3))
    (tmp_path / "a.xml").write_text(f"<r xmlns:p='urn:x'><head><标题>h</标题></head><list>{rows}<p:item></p:item></list></r>", encoding="utf-8")
    df = readers.load(spark, str(tmp_path / "a.xml"))
    assert sorted((r["申请号"], r["标题"], r["标题_lang"], r["申请日"], r["id"]) for r in df.collect()) == [(f"A{i}", f"t {i}", "x", f"2020-01-0{i}", str(i)) for i in (1, 2, 3)]
    (tmp_path / "b.xml").write_text("<r><p><a>1</a><b>x</b></p><p><a>2</a></p></r>")
    assert readers.load(spark, str(tmp_path / "b.xml")).count() == 2


def make_workbook(path):
    """Two sheets, the second with markers; shared and inline texts, numbers, a date, an empty row, and two pictures in one row."""
    import zipfile

    ns = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'"
    rel = lambda *t: "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='r{i}' Target='{x}'/>" for i, x in enumerate(t)) + "</Relationships>"
    anchor = "<x:oneCellAnchor><x:from><x:row>1</x:row></x:from><x:pic><a:blip r:embed='r{}'/></x:pic></x:oneCellAnchor>"
    parts = {
        "xl/workbook.xml": f"<workbook {ns}><sheets><sheet name='notes' r:id='r0'/><sheet name='data' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rel("worksheets/sheet1.xml", "/xl/worksheets/sheet2.xml"),
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>申请号</t></si><si><r><t>标</t></r><r><t>题</t></r></si><si><t>申请日</t></si></sst>",
        "xl/styles.xml": f"<styleSheet {ns}><numFmts><numFmt numFmtId='170' formatCode='yyyy\\-mm'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='170'/></cellXfs></styleSheet>",
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData><row r='1'><c r='A1' t='inlineStr'><is><t>x</t></is></c></row></sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='D1' t='s'><v>2</v></c></row>"
        "<row r='2'><c r='A2'><v>12</v></c><c r='B2' t='inlineStr'><is><t>one</t></is></c><c r='D2' s='1'><v>43831</v></c></row><row r='3'><c r='C3'><v>9</v></c></row>"
        "<row r='4'><c r='A4' t='str'><v>B7</v></c><c r='D4'><v>1.5</v></c></row></sheetData></worksheet>",
        "xl/worksheets/_rels/sheet2.xml.rels": rel("../drawings/drawing1.xml"),
        "xl/drawings/drawing1.xml": f"<x:wsDr xmlns:x='urn:x' xmlns:a='urn:a' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'>{anchor.format(0)}{anchor.format(1)}</x:wsDr>",
        "xl/drawings/_rels/drawing1.xml.rels": rel("../media/a.png", "../media/b.png"),
        "xl/media/a.png": "first",
        "xl/media/b.png": "second",
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_workbook(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx")
    df = readers.load(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["申请号", "标题", "申请日", "_row_number", "_image", "_images"]
    got = [(r[0], r[1], r[2], r[3], bytes(r[4]) if r[4] else None, r[5]) for r in df.orderBy("_row_number").collect()]
    assert got == [("12", "one", "2020-01-01", 2, b"first", 2), ("B7", None, "1.5", 4, None, 0)]


def test_alias_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("申請人代碼,公司中文名稱,正規化名稱,別稱\nC,甲,,X  co\nC,乙,,x CO\nC,,,y\n", encoding="big5")
    kept, dropped = readers.load_aliases(spark, str(tmp_path / "a.csv"))
    assert [(r.code, r.name_zh, r.alias) for r in kept.collect()] == [("C", "甲", "X  co")] and dropped.count() == 2


def test_headers_and_aliases(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert readers.rename_headers(df, {"b": "a"}).columns == ["a"]
    rows = spark.createDataFrame([(1, "C", "X ", "甲", ""), (2, "C", " x", "乙", ""), (3, "C", "y", " ", " ")], "row_no int, code string, alias string, name_zh string, name_norm string")
    kept, dropped = readers.aliases(rows)
    assert [r.row_no for r in kept.collect()] == [1] and sorted(r.row_no for r in dropped.collect()) == [2, 3]


def test_sinks_and_stream(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(10).select(F.col("id").alias("patent_id"))
    sinks.rebuild(df, path)
    sinks.append_new(spark.range(5, 15).select(F.col("id").alias("patent_id")), path, ["patent_id"])
    assert spark.read.parquet(path).count() == 15
    for _ in range(2):
        stream = incremental.stream_table(spark, path, df)
        incremental.assign_new(stream, lambda b: b.withColumn("topic", F.lit("T001")), target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 15


def test_windowed_counts(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a' as kind union all select timestamp'2024-01-01 00:02:00', 'a' union all select timestamp'2024-01-01 02:00:00', 'b'")
    events.write.parquet(str(tmp_path / "e"))
    out = incremental.windowed_counts(incremental.stream_table(spark, str(tmp_path / "e"), events), "ts", "kind")
    q = out.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
