"""Rows that link through each other, against rows applied one by one."""

import random

import pytest
from pyspark.sql import functions as F

from patquarry.operators import linking

KEYS, NUMBER, CONTEXT = ["grant_no", "examined_no", "publication_no"], "application_no", ["country_code", "database_name"]
COLUMNS = [*KEYS, NUMBER, *CONTEXT, "title"]
STORED = "patent_id long, " + ", ".join(f"{c} string" for c in COLUMNS)
INCOMING = STORED.replace("patent_id", "row_no")


def one_by_one(stored, rows):
    """What applying the rows in order gives: each row's patent and the patents after it."""
    filled = lambda x: x is not None and x.strip() != ""
    patents = {r[0]: dict(zip(COLUMNS, r[1:], strict=True)) for r in stored}
    base, found = max(patents, default=0) + 1, {}
    for r in sorted(rows):
        row = dict(zip(COLUMNS, (x if filled(x) else None for x in r[1:]), strict=True))
        at = None
        for k in KEYS:
            at = min((p for p, v in patents.items() if row[k] and v[k] == row[k]), default=None) if at is None else at
        if at is None and row[NUMBER]:
            fits = [p for p, v in patents.items() if v[NUMBER] == row[NUMBER] and all(row[c] is None or v[c] is None or row[c] == v[c] for c in CONTEXT)]
            at = min(fits, key=lambda p: (*[row[c] is None or patents[p][c] != row[c] for c in CONTEXT], p), default=None)
        found[r[0]] = (at if at is not None else base + r[0], at is not None)
        if at is None:
            patents[base + r[0]] = row
        else:
            patents[at].update({c: v for c, v in row.items() if v is not None})
    return found, patents


def table(r, n, kinds, tag, first, blank=0.5):
    """Rows whose identifiers come from few values, so that they meet, part and overwrite each other."""
    out = []
    for i in range(n):
        pick = lambda c, many: None if r.random() < blank else f"{tag}{c}{r.randrange(many)}"  # noqa: E731, B023
        values = [pick(c, kinds) for c in "gepa"] + [r.choice((None, "US", "TW")), r.choice((None, None, "A", "B"))]
        out.append((first + i, *values, r.choice((None, " ", f"{tag} title {i}"))))
    return out


def check(spark, stored, rows, hot):
    s, i = spark.createDataFrame(stored, STORED), spark.createDataFrame(rows, INCOMING)
    want, patents = one_by_one(stored, rows)
    found, rounds = linking.resolve(i, s, KEYS, NUMBER, CONTEXT, hot=hot)
    assert {r.row_no: (r.patent_id, r.found) for r in found.collect()} == want
    after = linking.apply_file(s, i, found, COLUMNS).collect()
    before = {r[0]: dict(zip(COLUMNS, r[1:], strict=True)) for r in stored}
    got = {r.patent_id: {c: r[c] for c in COLUMNS} for r in after}
    assert got == patents and len(after) == len(patents)
    for r in after:
        assert r.state == ("new" if r.patent_id not in before else "same" if before[r.patent_id] == patents[r.patent_id] else "updated")
    return rounds


@pytest.mark.parametrize("hot", [linking.HOT, 7])
def test_random_files_equal_rows_applied_one_by_one(spark, hot):
    """Several files side by side, dense and sparse; with a small bound every value and patent is dealt out by blocks."""
    r = random.Random(17)
    stored, rows, at = [], [], 0
    for k, (kinds, n, blank) in enumerate(((200, 200, 0.6), (40, 60, 0.6), (150, 80, 0.3), (12, 30, 0.7)) if hot > 7 else ((60, 60, 0.6), (10, 40, 0.5))):
        stored += table(r, 30, kinds, f"f{k}", 1 + 30 * k, blank)
        rows += table(r, n, kinds, f"f{k}", at, blank)
        at += n
    r.shuffle(rows)
    check(spark, stored, rows, hot)


def test_identifiers_that_many_rows_share(spark):
    """A hub of a third of all rows, whose patent changes another identifier with each, takes few rounds, and is dealt out by blocks."""
    rows = [(i, "hub" if i % 3 == 0 else f"g{i // 9}", None, f"p{i}" if i % 3 == 0 else None, f"a{i // 6}" if i % 3 else None, "US", None, f"t{i}") for i in range(600)]
    rows += [(600 + i, None, None, f"p{3 * i}", None, None, None, None) for i in range(200)]  # only the last of these finds the hub's patent
    stored = [(5, "hub", None, None, None, None, None, "old"), (9, "hub", None, None, "a7", "US", None, "x")]
    random.Random(3).shuffle(rows)
    assert check(spark, stored, rows, 20) <= 6


def test_overwritten_identifiers_name_no_longer(spark):
    rows = [(0, "G1", None, None, None, None, None, "a"), (1, "G1", None, "P1", None, None, None, None), (2, None, None, "P1", "A1", "US", None, None), (3, None, None, "P2", "A1", None, None, " "), (4, None, None, "P1", None, None, None, None), (5, None, None, None, "A1", "TW", None, "b")]
    want, _ = one_by_one([], rows)
    assert want == {0: (1, False), 1: (1, True), 2: (1, True), 3: (1, True), 4: (5, False), 5: (6, False)}
    assert check(spark, [], rows, linking.HOT) >= 2


def test_no_rows(spark):
    none, rows = spark.createDataFrame([], INCOMING), spark.createDataFrame([], STORED)
    found, rounds = linking.resolve(none, rows, KEYS, NUMBER, CONTEXT)
    assert found.count() == 0 and rounds == 1
    blank = spark.createDataFrame([(0, " ", None, "", None, None, None, None), (1, None, " ", None, "", "US", None, None)], INCOMING)
    assert sorted(map(tuple, linking.resolve(blank, rows, KEYS, NUMBER, CONTEXT)[0].collect())) == [(0, 1, False), (1, 2, False)]


def test_aligned_ranges(spark):
    df = spark.createDataFrame([(a, b) for a in range(12) for b in range(a, 14)], "a long, b long")
    for r in df.withColumn("c", linking._cover(F.col("a"), F.col("b"))).collect():
        assert sorted(x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level)) == list(range(r.a, r.b))


def test_short_chains_take_one_round(spark):
    """Four rows a patent, each of which is found by the identifier that the one before brought, and a stored patent for some."""
    rows, stored = [], [(p + 1, f"G{p}", None, None, None, None, None, "old") for p in range(0, 40, 3)]
    for p in range(40):
        rows += [(4 * p, f"G{p}", None, None, None, None, None, "a"), (4 * p + 1, f"G{p}", None, f"P{p}", None, None, None, None), (4 * p + 2, None, None, f"P{p}", f"A{p}", "US", None, "b"), (4 * p + 3, None, None, None, f"A{p}", "XX" if p % 7 == 0 else None, None, "c")]
    assert check(spark, stored, rows, linking.HOT) == 1
