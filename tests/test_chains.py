"""Chains of pointers against a walk."""

import random

from pyspark.sql import functions as F

from patquarry.operators import chains, claims, topics
from patquarry.plans import catalog, queries_misc
from tests.compare import DATA


def walked(to):
    """For each node where its chain ends, the least rank on the way (ranks are node numbers modulo 3 plus 1), and the smallest node of a cycle."""
    out = {}
    for n in to:
        at, seen, up = n, [n], 9
        while True:
            nxt = to[at]
            if nxt is None:
                out[n] = (at, up, True, None)
                break
            if nxt not in to:
                out[n] = (nxt, None, False, None)
                break
            up = min(up, nxt % 3 + 1)
            if nxt in seen:
                out[n] = (None, None, False, min(seen[seen.index(nxt) :]))
                break
            seen.append(nxt)
            at = nxt
    return out


def test_chains_equal_a_walk(spark):
    r = random.Random(2)
    graphs = [{i: r.choice([None, *range(n), *range(n), n + 5]) for i in range(n)} for n in (1, 2, 3, 5, 9, 30, 30, 60)]
    graphs += [{i: i + 1 if i < 699 else None for i in range(700)}, {i: (i + 1) % 37 for i in range(37)}, {i: i + 1 if i < 99 else 40 for i in range(100)}, {0: 0}]
    rows = [(g, n, to, n % 3 + 1) for g, graph in enumerate(graphs) for n, to in graph.items()]
    got = chains.follow(spark.createDataFrame(rows, "g int, n int, to int, rank int"), ["g"], "n", "to", "rank").collect()
    assert len(got) == len(rows)
    want = {(g, n): x for g, graph in enumerate(graphs) for n, x in walked(graph).items()}
    for x in got:
        at, up, ended, low = want[x.g, x.n]
        assert x.ended == ended, x
        if ended:
            assert (x.at, x.up) == (at, up), x
        elif low is None:
            assert x.missing and x.at == at, x
        else:
            assert x.low == low and not x.missing, x
    assert chains.follow(spark.createDataFrame([], "g int, n int, to int"), ["g"], "n", "to").count() == 0


def test_long_chains_have_plans_of_bounded_size(spark):
    n = 5000
    rows = [(1, i, i - 1 if i > 1 else None, "needs_review" if i == 7 else "possibly_established") for i in range(1, n + 1)]
    df = claims.infer(spark.createDataFrame(rows, "id int, number int, parent int, own string"), "id")
    assert df._jdf.queryExecution().toString().count("Join") < 12
    got = {r.number: r.status for r in df.collect()}
    assert all(got[i] == ("possibly_established" if i < 7 else "needs_review") for i in range(1, n + 1))


def test_merges_of_any_length(spark):
    rows = [("a", f"T{i:03}", f"T{i + 1:03}" if i < 60 else None) for i in range(61)] + [("b", "T001", "T002"), ("b", "T002", "T003"), ("b", "T003", "T002"), ("b", "T004", "gone"), ("b", "T005", "T005"), ("b", "T006", None)]
    got = {(r.channel, r.topic_code): r.target for r in topics.resolve_merges(spark.createDataFrame(rows, "channel string, topic_code string, merged_into string")).collect()}
    assert {got["a", f"T{i:03}"] for i in range(61)} == {"T060"}
    assert [got["b", f"T00{i}"] for i in range(1, 7)] == ["T002", "T002", "T002", "gone", "T005", "T006"]


def test_inference_reads_its_claims_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rank = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    rows = spark.createDataFrame([(1, i, i - 1 if i > 1 else None, "possibly_established") for i in range(1, 9)], "id int, number int, parent int, own string")
    got = claims.infer(rows.withColumn("own", rank("own")), "id").collect()
    assert len(got) == 8 and {r.status for r in got} == {"possibly_established"} and seen.value == 8


def test_claims_are_parsed_before_they_are_filtered(spark):
    catalog.QUERIES["K7_aggregate"](spark, DATA)
    assert "Filter" in (plan := queries_misc._parsed(spark, DATA).where("type != 'unknown'")._jdf.queryExecution().toString()) and "regexp" not in plan.lower()
