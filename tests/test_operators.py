import random
import re
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from patquarry.operators import claims, clustering, misc, sets
from patquarry.plans import adhoc, tables
from patquarry.sources import derived
from tests.compare import DATA


@pytest.fixture
def scope(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "patent_id long, title string")
    return {"patents": rows}, rows.where("patent_id < 3")


@pytest.mark.parametrize(
    "sql",
    [
        "select * from parquet.`{data}/orders.parquet`",
        "select java_method('java.lang.System', 'getProperty', 'user.home') as x from patents",
        "select reflect('java.lang.System', 'getProperty', 'user.home') as x",
        "select try_reflect('java.lang.System', 'getProperty', 'user.home') as x",
        "select 1 a) union all (select count(*) from parquet.`{data}/orders.parquet`",
        "select (select count(*) from parquet.`{data}/orders.parquet`) as n",
        "select patent_id from patents where exists (select 1 from csv.`{data}/orders.parquet`)",
        "with x as (select * from parquet.`{data}/orders.parquet`) select * from x",
        "select * from identifier('outside')",
        "select * from outside",
        "drop view outside",
        "select 1; select 2",
        "insert into patents select 1, 'x'",
    ],
)
def test_scoped_statements_read_nothing_else(spark, scope, sql):
    spark.range(5).createOrReplaceTempView("outside")
    with pytest.raises(Exception) as e:
        adhoc.scoped_sql(spark, sql.format(data=DATA), *scope).collect()
    assert isinstance(e.value, ValueError) or "TABLE_OR_VIEW_NOT_FOUND" in str(e.value)
    assert spark.table("outside").count() == 5


def test_scoped_statements_see_the_population(spark, scope):
    run = lambda sql: sorted(tuple(r) for r in adhoc.scoped_sql(spark, sql, *scope).collect())
    assert run("select count(*) as n from patents") == [(2,)]
    assert run("with x as (select * from patents) select a.patent_id, (select max(patent_id) from x) as m from x a join patents using (patent_id) where a.title in (select title from x) order by 1 limit 5") == [(1, 2), (2, 2)]
    assert run("select explode(sequence(1, 2)) as i from patents union all select 9") == [(1,), (1,), (2,), (2,), (9,)]
    assert adhoc.rows_within(adhoc.scoped_sql(spark, "select 1 as x", *scope), 60) == [(1,)]
    slow = spark.range(0, 4, 1, 4).select(F.expr("aggregate(sequence(1, 20000), 0D, (s, x) -> s + aggregate(sequence(1, 20000), 0D, (t, y) -> t + sqrt(y)))").alias("x"))
    with pytest.raises(TimeoutError):
        adhoc.rows_within(slow, 1)


def test_claims_with_large_numbers(spark):
    text = "99999999999. A thing. | 2. A thing as in claim 99999999999. | 3. A thing as in claims 1-2000000000. | 4. As in claims 1-2, 3."
    rows = {r.number: r for r in claims.parse(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert set(rows) == {"99999999999", "2", "3", "4"}
    assert rows["2"].type == "independent" and rows["3"].parents == "1" and rows["4"].parents == "1,2,3"


def test_long_chains_of_claims_are_followed(spark):
    n = 1500
    df = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, "not_established" if i == 1 else "possibly_established") for i in range(1, n + 1)], "id int, number int, parent int, own string")
    assert {r.status for r in claims.infer(df, "id").collect()} == {"not_established"}


def test_claim_chunks_equal_a_plain_packing(spark):
    r, rows = random.Random(3), []
    for i in range(60):
        parts = [f"{k}. " + " ".join(f"w{r.randrange(50)}" for _ in range(r.choice((1, 4, 9, 30)))) for k in range(1, r.randint(1, 7))]
        rows.append((i, r.choice(("\n", " | ", "\r\n")).join(parts)))
    rows += [(100, None), (101, ""), (102, "no number at all " * 20)]
    for most, step in ((10, None), (10, 7), (1000, None)):
        want = []
        for i, t in rows:
            packed = []
            for part in re.split(r"(?:^|[\r\n|])\s*(?=\d+\s*[.．、])", t or ""):
                w = part.split()
                if not w:
                    continue
                if packed and len(packed[-1]) + len(w) <= most:
                    packed[-1] = packed[-1] + w
                else:
                    at = 0
                    while True:
                        packed.append(w[at : at + most])
                        if at + most >= len(w):
                            break
                        at += step or most
            want += [(i, k, " ".join(w)) for k, w in enumerate(packed)]
        got = clustering.claim_chunks(spark.createDataFrame(rows, "id int, t string"), "id", "t", most, step).select("id", "chunk", "text").collect()
        assert sorted(map(tuple, got)) == want


def test_coherence_equals_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.choice((1, 3, 12, 40)))) for _ in range(30)]
    sets = {0: ["alpha", "beta", "gamma"], 1: ["beta", "theta", "unseen"], 2: ["eta"]}
    words = spark.createDataFrame([(t, w) for t, ws in sets.items() for w in [*ws, "alpha beta"]], "topic int, term string")
    width = 5
    windows = [set(w[i : i + width]) for w in map(str.split, texts) for i in range(max(1, len(w) - width + 1))]
    p = lambda *ws: sum(all(w in x for w in ws) for x in windows) / len(windows)

    def npmi(a, b):
        if not p(a) or not p(b) or p(a, b) >= 1:
            return float(a == b or p(a, b) >= 1)
        return log((p(a, b) + 1e-12) / (p(a) * p(b))) / -log(p(a, b) + 1e-12)

    got = clustering.coherence(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t", words, width=width)
    for t, ws in sets.items():
        ws = sorted(ws)
        v = [[npmi(a, b) for b in ws] for a in ws]
        whole = [sum(c) for c in zip(*v, strict=True)]
        cos = [sum(x * y for x, y in zip(u, whole, strict=True)) / sqrt(sum(x * x for x in u) * sum(x * x for x in whole)) for u in v]
        assert got[t] == pytest.approx(sum(cos) / len(cos), rel=1e-6)


def test_topics_are_fitted_judged_and_chosen(spark):
    r = random.Random(1)
    rows = [(i, f"word{i % 4} thing{i % 4} common", [float(j == i % 4) * 5 + r.random() for j in range(6)]) for i in range(48)]
    found, members = clustering.candidates(spark.createDataFrame(rows, "id int, t string, v array<double>"), "t", "v", reduced=3)
    found = found.orderBy("k").collect()
    assert [x.k for x in found] == [3, 5, 8] and [x.profile for x in found] == ["low", "middle", "high"] and all(0 <= x.score <= 1 for x in found)
    members = members.select("k", "id", "topic", "distance").collect()
    assert len(members) == 3 * 48 and all(m.distance >= 0 and m.topic < m.k for m in members)
    assert len({(m.topic, m.id % 4) for m in members if m.k == 5}) == 5  # groups are split, not mixed


def test_derived_tables_follow_their_sources(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert derived.derived(spark, "t", [path], build).count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert derived.derived(spark, "t", [path], build).count() == 5 and len(built) == 2
    parted = str(tmp_path / "parted")
    spark.range(3).selectExpr("id", "id % 2 as p").write.partitionBy("p").parquet(parted)
    before = derived.state(spark, [parted])
    spark.range(1).write.mode("append").parquet(f"{parted}/p=1")  # a new file in an old folder
    assert len(derived.state(spark, [parted])) > len(before)
    base = tables.base_table(spark, DATA)
    assert "parquet" in base._jdf.queryExecution().toString() and base.select("country_code").groupBy("country_code").count().count() > 1


def test_a_corpus_that_is_not_fit_raises(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    good = [(1, "a", sha("a"), [1.0, 2.0], "m"), (2, "b", sha("b"), [3.0, 4.0], "m")]
    make = lambda rows: spark.createDataFrame(rows, "patent_id long, text string, hash string, vector array<double>, model string")
    assert misc.require_valid(make(good), 2).count() == 2
    for bad, what in (([(7, "c", sha("d"), [1.0, 2.0], "m")], "patent 7 is of an earlier"), ([(7, "c", None, [1.0, 2.0], "m")], "patent 7 is of an earlier"), ([(8, "c", sha("c"), [1.0], "m")], "patent 8 has no vector of 2"), ([(8, "c", sha("c"), None, "m")], "patent 8 has no"), ([(9, "c", sha("c"), [1.0, 2.0], None)], "several models")):
        with pytest.raises(ValueError, match=what):
            misc.require_valid(make(good + bad), 2)
    with pytest.raises(ValueError, match="no patents"):
        misc.require_valid(make([]), 2)


def test_similar_needs_the_subjects_vector(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (1, [0.0, 2.0], 2), (2, [0.0, 3.0], 1), (3, [1.0, 1.0], 1), (3, [1.0, 0.0], 5), (4, None, 1)]
    df = spark.createDataFrame(rows, "patent_id long, vector array<double>, created int")
    got = sets.similar(df.where("patent_id != 4"), 1).collect()
    assert [r.patent_id for r in got] == [2, 3] and got[0].distance == pytest.approx(0) and got[1].distance == pytest.approx(1 - 0.5**0.5)
    for subject in (4, 99):
        with pytest.raises(ValueError, match="no vector"):
            sets.similar(df, subject)


def test_names_converge_once_a_spelling(spark):
    from patquarry.plans import base, companies

    rows = [(1, "ACME", "Acme | B", "C1"), (2, "ACME", "Acme | B", "C1"), (3, None, "zeta", None), (4, None, "zeta", None), (5, None, None, "C1"), (6, None, " ", None)]
    patents = spark.createDataFrame(rows, "patent_id long, std string, raw string, own_code string")
    none = lambda k: spark.createDataFrame([], f"{k}_key string, {k}_name string")
    names = companies.Names(none("alias"), none("alias"), spark.createDataFrame([], "code string, code_name string"))
    want = {r.patent_id: r.out for r in companies.converge(patents, names, "std", "raw", "own_code", "out").collect()}
    assert {r.patent_id: r.out for r in companies.converged(patents, names, "std", "raw", "own_code", "out").collect()} == want
    assert want[1] == want[5] == "ACME" and want[3] == "zeta"
    assert base.plain_base(patents.withColumn("grant_date_text", patents["std"])).columns[-1] == "grant_year"


def test_reports_without_names_need_none(spark):
    from patquarry.plans import base, tables
    from tests.compare import DATA

    sources = tables.Sources(spark, DATA)
    assert not set(sources.having("base", {"application_year", "country_code"}).columns) & set(base.COLUMNS)
    assert set(base.COLUMNS) <= set(sources.having("base", {"applicant_display_name"}).columns)
