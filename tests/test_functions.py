import datetime

import pytest
from pyspark.sql import functions as F

from patquarry.functions import status, text
from patquarry.operators import claims, sets, upsert
from patquarry.plans import family, reports


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("授权", "alive"), (" 到期(Expiration of the term) ", "dead"), ("到期（a(b)）", "dead"), ("GRANTED", "alive"), ("审查中", "pending"), ("?", "unknown"), ("", "unknown"), (None, "unknown")])
def test_status(spark, raw, want):
    assert one(spark, status.normalize(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("kind", "type_", "want"), [("S", "P", "設計"), (" s1", "U", "設計"), ("B", "u", "新型"), ("B", "P", "發明"), (None, None, "未標示")])
def test_kind(spark, kind, type_, want):
    assert one(spark, status.patent_kind(F.col("k"), F.col("t")), k=kind, t=type_) == want


@pytest.mark.parametrize(("raw", "want"), [("20240131", datetime.date(2024, 1, 31)), ("202402", datetime.date(2024, 2, 1)), ("2024-03-05", datetime.date(2024, 3, 5)), ("2024.03.05", datetime.date(2024, 3, 5)), ("20241399", None), ("", None), (None, None), ("soon", None)])
def test_dates(spark, raw, want):
    assert one(spark, text.parse_date(F.col("d")), d=raw) == want


@pytest.mark.parametrize(("country", "number", "want"), [("TW", "202421229", "11321229"), ("tw", "1911x", "1911x"), ("US", "202421229", "202421229"), ("TW", " ", None), ("TW", "M1234", "M1234"), ("TW", "1912-1", "001-1")])
def test_numbers(spark, country, number, want):
    assert one(spark, text.transform_number(F.col("c"), F.col("n")), c=country, n=number) == want


@pytest.mark.parametrize(("raw", "want"), [("X Co., Ltd.", "x"), ("SKI-ROW INC DBA ENERGYFIT", "ski-row"), ("Ltd", "ltd"), ("CO OP Machinery", "co op machinery"), ("某某 有限公司", "某某"), (None, None)])
def test_loose_names(spark, raw, want):
    assert one(spark, text.loose_key(F.col("n")), n=raw) == want


def test_lists(spark):
    assert one(spark, text.split_people(F.col("x")), x=" A; B；C、 D ") == ["A", "B", "C", "D"]
    assert one(spark, text.split_codes(F.col("x")), x="de | ES | de | ") == ["DE", "ES"]
    assert one(spark, text.clean_text(F.col("x")), x=" a　\n b ") == "a b"
    assert one(spark, family.bad_tokens(F.col("x")), x="US-1 | oops | etc-2") == ["oops"]
    got = spark.sql("select array('A','B') as a, array('x') as b").select(text.merge_people(a=F.col("a"), b=F.col("b")).alias("p")).first().p
    assert [(r.sequence, r.a, r.b) for r in got] == [(1, "A", "x"), (2, "B", None)]


def test_ep_contribution(spark):
    many = " | ".join(f"C{i}" for i in range(30))
    for valid, invalid, want in (("", "", "missing"), (many, "", "in_transition"), (many, "DE", "countries"), ("DE", "", "countries")):
        assert one(spark, family.ep_contribution(F.col("v"), F.col("i")), v=valid, i=invalid) == want


def test_filters(spark):
    df = spark.createDataFrame([(1, "US", 2000), (2, "JP", 2001)], "patent_id long, country_code string, application_year int")
    spec = reports.REPORTS["application_trend"]
    assert df.where(reports.predicate(spec, {"country_code": []}, df)).count() == 0
    assert df.where(reports.predicate(spec, {"application_year": {"from": 2001}}, df)).count() == 1
    with pytest.raises(ValueError):
        reports.predicate(spec, {"title": "x"}, df)
    with pytest.raises(ValueError):
        reports.run_report({}, "cluster_topic_table")


def test_claims(spark):
    text_ = "preamble\n1. A device having a 1.5 mm part.\n2. The device of claim 1, wherein\nit is red.\n3. A device as in any of claims 1 to 2 | 4. (Canceled) | 5-7. x | 8. As in claim 9."
    df = spark.createDataFrame([(1, text_)], "id long, c string")
    got = {r.number: r for r in claims.parse(df, "id", "c").collect()}
    assert {k: r.type for k, r in got.items()} == {"1": "independent", "2": "dependent", "3": "dependent", "4": "unknown", "5-7": "unknown", "8": "unknown"}
    assert got["2"].parent == 1 and got["2"].text.endswith("it is red.") and got["3"].parents == "1,2" and got["3"].multiple_dependent


def test_verdict_of_a_cycle_is_null(spark):
    df = spark.createDataFrame([(1, 1, 2, "needs_review"), (1, 2, 1, "possibly_established"), (1, 3, None, "not_established"), (1, 4, 3, "possibly_established"), (1, 5, 9, "needs_review")], "id int, number int, parent int, own string")
    got = {r.number: (r.status, r.inferred) for r in claims.infer(df, "id").collect()}
    assert got == {1: (None, False), 2: (None, False), 3: ("not_established", False), 4: ("not_established", True), 5: (None, False)}


def test_manual_status_is_kept(spark):
    df = spark.createDataFrame([("a", "b", [(None,)]), ("a", "b", [("file",)]), ("a", " ", None)], "legal_status string, incoming string, history array<struct<source:string>>")
    assert [(r.legal_status, r.conflict) for r in upsert.guard_status(df).collect()] == [("a", True), ("b", False), ("a", False)]


def test_compose_needs_two(spark):
    with pytest.raises(ValueError):
        sets.compose(spark.createDataFrame([(1, 1)], "workspace_id int, patent_id long"), [1, 1])


def test_import_joins_the_history(spark):
    schema = "legal_status string, incoming string, history array<struct<from_status:string,to_status:string,source:string>>"
    df = spark.createDataFrame([("a", "b", None), ("a", "b", [("x", "a", None)]), (None, "b", [("x", "a", "import")])], schema)
    got = [(r.legal_status, [tuple(h) for h in r.history]) for r in upsert.guard_status(df).collect()]
    assert got == [("b", [("a", "b", "import")]), ("a", [("x", "a", None)]), ("b", [("x", "a", "import"), (None, "b", "import")])]


def test_narratives_show_patents_only(spark):
    from patquarry.plans import adhoc

    patents = spark.createDataFrame([(1, "US"), (2, "JP"), (3, "JP")], "patent_id long, country string").dropDuplicates()
    some = patents.where("patent_id < 3")
    run = lambda sql: adhoc.narrative_sql(spark, sql, {"patents": patents}, some)
    assert [r.patent_id for r in run("select patent_id from patents where country = 'JP'").collect()] == [2]
    for bad in ("select max(patent_id) as patent_id from patents", "select patent_id, count(*) over () as n from patents", "select country from patents", "select patent_id from patents group by patent_id"):
        with pytest.raises(ValueError):
            run(bad)


def test_class_levels_keep_case(spark):
    assert one(spark, text.classification_level(F.col("c"), 4), c="a01d-034/416") == "a01d"
    assert one(spark, text.classification_level(F.col("c"), 5), c="A01D-034/416") == "A01D-034"


def test_changed_texts_are_embedded_again(spark):
    import hashlib

    from patquarry.plans import catalog
    from tests.compare import assert_same

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "same"), (2, "changed"), (3, "new"), (4, None), (5, "other model"), (6, "old model"), (7, "old preprocessing"), (8, "twice")], "doc_id long, text string")
    stored = spark.createDataFrame(
        [(1, "m", "2", "p2", h("same")), (2, "m", "2", "p2", h("before")), (5, "n", "2", "p2", h("other model")), (6, "m", "1", "p2", h("old model")), (7, "m", "2", "p1", h("old preprocessing")), (8, "m", "2", "p1", h("once")), (8, "m", "2", "p2", h("twice"))],
        "doc_id long, embedding_model string, model_version string, preprocessing_version string, text_hash string",
    )
    got = upsert.pending_embeddings(texts, stored, "m", "2", "p2")
    assert got.columns == ["doc_id", "text"] and sorted(r.doc_id for r in got.collect()) == [2, 3, 5, 6, 7]
    assert_same(catalog.QUERIES["T8_embedding_diff"], catalog.ORACLES["T8_embedding_diff"], spark)
