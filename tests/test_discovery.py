"""Topic hierarchy, keyword index and chunks by tokens, against brute force."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patquarry.operators import clustering, hierarchy, sets, substrings, tokens
from patquarry.plans import catalog, queries_core, tables  # noqa: F401
from tests.compare import DATA


def plain_ward(names, far):
    """The nearest two clusters merge, again and again; distances from the merged points by their definition."""
    groups, d, out = {(n,): 1 for n in names}, {frozenset(((a,), (b,))): far[i][j] for (i, a), (j, b) in combinations(enumerate(names), 2)}, []
    while len(groups) > 1:
        pair = min(d, key=lambda p: d[p])
        a, b = pair
        near, new = d.pop(pair), tuple(sorted(a + b))
        out.append((new, near))
        for k in groups:
            if k not in pair:
                x, y, n = d.pop(frozenset((a, k))), d.pop(frozenset((b, k))), len(k)
                d[frozenset((new, k))] = (((len(a) + n) * x * x + (len(b) + n) * y * y - n * near * near) / (len(a) + len(b) + n)) ** 0.5
        del groups[a], groups[b]
        groups[new] = 1
    return sorted(out, key=lambda x: x[1])


def test_linkage_equals_merging_the_nearest():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20, 40):
        x = r.normal(size=(n, 5))
        far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        names = [int(i) for i in r.permutation(n)]
        got = hierarchy.linkage(names, far)
        want = plain_ward(names, far)
        assert [g.topics for g in got] == [w[0] for w in want] and np.allclose([g.distance for g in got], [w[1] for w in want])


def test_hierarchy_of_texts(spark):
    texts = ["red apple pie", "red apple tart", "blue whale sea", "blue whale ocean", "iron steel mill", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "topic int, t string")
    weights = clustering.term_weights(df, "t")
    w = {}
    for r in weights.collect():
        w.setdefault(r.topic, {})[r.term] = r.weight
    cos = lambda a, b: sum(v * w[b].get(t, 0) for t, v in w[a].items()) / (sum(v * v for v in w[a].values()) * sum(v * v for v in w[b].values())) ** 0.5
    got = {(r.a, r.b): r.distance for r in hierarchy.distances(weights).collect()}
    assert set(got) == set(combinations(range(5), 2)) and all(v == pytest.approx(1 - cos(*k)) for k, v in got.items())
    nodes = hierarchy.hierarchy(weights)
    assert {n.topics for n in nodes[:2]} == {(0, 1), (2, 3)} and nodes[-1].topics == (0, 1, 2, 3, 4)
    # topic 3 has been merged into 2: the node of both is one topic, and nodes of three model topics may be two
    active = spark.createDataFrame([(0, "T001", "apples"), (1, "T002", None), (2, "T003", "whales"), (3, "T003", "whales")], "topic int, topic_code string, label string")
    rows = hierarchy.merge_suggestions(hierarchy.as_table(spark, nodes), active).collect()
    assert rows[0].topic_codes == ["T001", "T002"] and rows[0].labels == ["apples", "T002"] and all(len(r.topic_codes) == 2 for r in rows)
    assert hierarchy.hierarchy(weights.where("topic = 0")) == []


def test_keywords_by_index_equal_a_scan(spark, tmp_path):
    terms = sets.search_terms(tables.patents(spark, DATA), queries_core._FIELDS)
    path = str(tmp_path / "index")
    substrings.build(terms, path)
    index = substrings.load(spark, path)
    r = random.Random(8)
    lookups = [x.lookup for x in index.lookups.orderBy("lookup").collect()]
    words = []
    for _ in range(170):
        t = r.choice(lookups)
        a = r.randrange(len(t))
        words.append(t[a : a + r.randint(1, 12)])
    words = [w for w in words if w.strip()] + ["%", "_", "re%d", "a_d", "%%%", "ab", "zzzzz", " Red  W", "of__r", "title%of%gree", "customer#00000000_", "x" * 40, "_____b", "CUSTOMER", "%a%b%c%"]
    got = {}
    for x in substrings.matches(index, words).collect():
        got.setdefault(x.keyword, []).append(x.patent_id)
    every = {}
    for x in terms.select("patent_id", "lookup").collect():
        every.setdefault(x.lookup, []).append(x.patent_id)
    like = {w: {p for t, ps in every.items() if plain_like(t, substrings.pattern(w)) for p in ps} for w in dict.fromkeys(words)}
    for w in like:
        assert sorted(got.get(w, [])) == sorted(like[w]), w
    for w in words[:3] + ["re%d"]:
        assert {x.patent_id for x in sets.keyword_search(tables.patents(spark, DATA), terms, w).collect()} == like[w]
    share = {x.keyword: x.share for x in substrings.scanned(index, words).collect()}
    assert share["zzzzz"] == 0 and share["ab"] == 1 and np.median([share[w] for w in words if len(w) >= 6]) < 0.2
    plan = index.postings.where("gram = 'abc'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)]" in plan


def plain_like(text, pattern):
    import re

    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def test_chunks_by_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    r = random.Random(6)
    rows = [(100, None), (101, " \n "), (102, "no number at all " * 30), (103, "preamble\n1. A thing. | 2. The thing of claim 1.\r\n3. Another ünïcödé 装置 thing"), (104, "1. " + "x" * 900), (105, "1. " + "装置" * 300)]
    for i in range(40):
        parts = [f"{k}. " + " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(r.choice((1, 5, 20, 120)))) for k in range(1, r.randint(2, 7))]
        rows.append((i, r.choice(("\n", " | ", "\r\n")).join(parts)))
    for most, overlap in ((40, 0), (40, 12), (1000, 0)):
        got = {}
        for x in tokens.chunks(spark.createDataFrame(rows, "id long, t string"), "id", "t", path, most, overlap).collect():
            got.setdefault(x.id, []).append(x)
        assert 100 not in got and 101 not in got
        for i, t in rows:
            own = sorted(got.get(i, []), key=lambda x: x.chunk)
            spans = tokens.claims(t or "")
            assert [x.chunk for x in own] == list(range(len(own))) and all(x.tokens == count(x.text) <= most for x in own)
            covered = set()
            for x in own:
                covered |= set(range(x.start, x.end))
                assert x.text == t[x.start : x.end] if x.within else x.text == tokens.GAP.join(t[a:b] for _, a, b in spans if x.start <= a and b <= x.end)
            assert all(k in covered or t[k].isspace() for _, a, b in spans for k in range(a, b)), (i, most)  # tokens leave no letter out
            for x, y in zip(own, own[1:], strict=False):  # whole claims are packed as long as they fit
                if not x.within and not y.within:
                    first = next((a, b) for _, a, b in spans if a == y.start)
                    assert count(x.text + tokens.GAP + t[first[0] : first[1]]) > most
                elif x.within and y.within and x.claims == y.claims:
                    assert y.start <= x.end + 1 and (overlap == 0 or y.start < x.end)
    with pytest.raises(ValueError, match="overlap"):
        tokens.pack("1. a", path, 5, 5)


def test_best_terms_are_those_of_all_terms(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=r.choice((0, 1, 2, 30, 90)))) for _ in range(80)]
    rows = [(t, [(3, i % 3), (5, i % 5 if i % 7 else None)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t string, g array<struct<k:int,topic:int>>").repartition(3)
    counts = {}
    for text, groups in rows:
        words = text.split()
        for k, topic in groups:
            for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                at = counts.setdefault(k, {}).setdefault(topic, {})
                at[term] = at.get(term, 0) + 1
    want = set()
    for k, by in counts.items():
        mean = sum(sum(c.values()) for c in by.values()) / len(by)
        for topic, c in by.items():
            weights = {t: n / sum(c.values()) * np.log(1 + mean / sum(o.get(t, 0) for o in by.values())) for t, n in c.items()}
            best = sorted(weights, key=lambda t: (-weights[t], t))[:4]
            want |= {(k, topic, i, t) for i, t in enumerate(best, 1) if topic is not None}
    got = {(x.k, x.topic, x["rank"], x.term) for x in clustering.best_terms(df, "t", df["g"], 4).collect()}
    assert got == want


def test_terms_of_all_topics_are_shuffled_once(spark):
    df = spark.createDataFrame([(0, "red apple pie"), (1, "red apple tart"), (2, None), (None, "red")], "topic int, t string")
    weights = clustering.term_weights(df, "t")
    assert weights._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.topic for r in weights.collect()} == {0, 1}
    wide = {(r.topic, r.term, r.n, r.weight) for r in weights.collect()}
    before, clustering.WIDE = clustering.WIDE, 0
    try:
        assert {(r.topic, r.term, r.n, r.weight) for r in clustering.term_weights(df, "t").collect()} == wide
    finally:
        clustering.WIDE = before


def test_representatives_of_texts_that_share_a_key(spark):
    df = spark.createDataFrame([(0, 1, "red apple"), (0, 1, "red"), (0, 2, "red apple tart"), (1, 3, ""), (1, 4, "sea")], "topic int, k long, t string")
    got = {r.k: r.cosine for r in clustering.representative(df, "k", "t").collect()}
    weights = {(r.topic, r.term): r.weight for r in clustering.term_weights(df, "t").collect()}
    norm = sum(w * w for (t, _), w in weights.items() if t == 0) ** 0.5
    one = (2 * weights[0, "red"] + weights[0, "apple"] + weights[0, "red apple"]) / (6**0.5 * norm)
    assert got[1] == pytest.approx(one, abs=1e-8) and got[3] == 0 and got[4] == pytest.approx(1)


@pytest.mark.parametrize(("heavy", "width", "narrow"), [(65_536, 8, 8), (12, 1, 8), (0, 8, 2)])
def test_representatives_are_those_of_all_weights(spark, monkeypatch, heavy, width, narrow):
    """Whatever terms are heavy and however often hashes meet; texts share keys, topics are null and cosines tie."""
    monkeypatch.setattr(clustering, "HEAVY", heavy)
    monkeypatch.setattr(clustering, "HASH_BYTES", width)
    monkeypatch.setattr(clustering, "NARROW", narrow)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(r.choice(("x", "y", None)), r.randrange(90), " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(14)], k=r.choice((0, 1, 2, 9, 40))))) for _ in range(120)]
    rows += [(t, k + 100, text) for t, k, text in rows[:20]] + [("z", 1, None), ("z", None, "w1 w2"), ("x", 500, "once"), ("y", 501, "w1 alone")]
    documents, counts = {}, {}
    for topic, k, text in rows:
        words = (text or "").split()
        own = documents.setdefault((topic, k), {})
        for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            for c in (own, counts.setdefault(topic, {})):
                c[term] = c.get(term, 0) + 1
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    weights = {topic: {t: n / sum(c.values()) * np.log(1 + mean / sum(o.get(t, 0) for o in counts.values())) for t, n in c.items()} for topic, c in counts.items()}
    length = lambda x: sum(v * v for v in x) ** 0.5
    cosines = {(topic, k): round(sum(c * weights[topic][t] for t, c in own.items()) / (length(own.values()) * length(weights[topic].values())), 9) if own and topic and k is not None else 0.0 for (topic, k), own in documents.items()}
    want = {}
    for topic in {t for t, _ in documents}:
        of = [(x, k) for (t, k), x in cosines.items() if t == topic]
        low = lambda x: (x[1] is not None, x[1] or 0)
        for name, order in (("nearest", lambda x: (-x[0], low(x))), ("farthest", lambda x: (x[0], low(x)))):
            for i, (x, k) in enumerate(sorted(of, key=order)[:3], 1):
                want.setdefault((topic, k, x), {})[name] = i
    df = spark.createDataFrame(rows, "topic string, k long, t string").repartition(3)
    got = {(x.topic, x.k, x.cosine): {n: x[n] for n in ("nearest", "farthest") if x[n]} for x in clustering.representative(df, "k", "t").collect()}
    assert got == want


def test_no_texts_have_no_representatives(spark):
    assert clustering.representative(spark.createDataFrame([], "topic int, k long, t string"), "k", "t").collect() == []


def test_representatives_shuffle_no_row_a_document_and_term(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    same = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(i % 2, i, f"{same} w{i}") for i in range(500)], "topic int, k long, t string").repartition(2).localCheckpoint()
    before = written()
    assert len(clustering.representative(df, "k", "t").collect()) == 12
    assert written() - before < 500 * 401 / 10


def test_a_long_claim_is_encoded_about_twice(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    real, seen = tokens._tokenizer(path), []

    class Counting:
        def encode(self, x, **more):
            seen.append(len(x))
            return real.encode(x, **more)

    monkeypatch.setattr(tokens, "_tokenizer", lambda p: Counting())
    text = "red apple pie " * 2000
    assert len(tokens.pack(text, path, 256)) > 10
    assert sum(seen) < 2.5 * len(text)


def test_an_index_takes_terms_that_come_twice_and_groups_a_row_a_patent(spark, tmp_path):
    """More keywords than a number has bits; the terms are computed once, and nothing is grouped by keyword and patent together."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(i % 400, f"term {i % 400:03} of {i % 7}") for i in range(800)]
    same = F.udf(lambda x: seen.add(1) or x, "string").asNondeterministic()
    substrings.build(spark.createDataFrame(rows, "patent_id long, lookup string").withColumn("lookup", same("lookup")), str(tmp_path / "index"))
    assert seen.value == 800
    index = substrings.load(spark, str(tmp_path / "index"))
    words = [f"term {i:03}" for i in range(150)] + ["e", "no such", "m 39_", "%", "of 3", "e"]
    found = substrings.matches(index, words)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted({(w, p) for w in words for p, t in rows if plain_like(t, substrings.pattern(w))})
    import re

    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert keys and all("," not in k for k in keys)
    assert {x.keyword: x.scanned for x in substrings.scanned(index, words).collect() if x.keyword in ("e", "no such")} == {"e": len(set(rows)), "no such": 0}
    assert substrings.matches(index, []).count() == 0
