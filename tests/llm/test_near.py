import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patquarry.llm import ann, components, minhash, scratch, sieve, vectordup
from tests.compare import assert_same
from tests.llm.conftest import prose


def sets(text, size):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    """Smallest id that links reach for each id, over rows of (id, text)."""
    forest, items = components.Forest(), [(i, sets(t, size)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                forest.join(i, j)
    return {i: forest.root(i) for i, _ in items}


def check(df, size, percent):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, size, percent)
    got = minhash.near_duplicates(df, size, percent).collect()
    assert len(got) == len(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.kept == (r.doc_id == r.component_id or r.doc_id is None)
    assert sorted(r.n_shingles for r in got) == sorted(len(sets(t, size)) for _, t in rows)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_minhash_on_odd_rows(odd, empty, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    monkeypatch.setattr(sieve, "BITS", 1 if hot == 1 else 1 << 25)
    check(odd, 3, 85)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_on_chains_of_edits(spark):
    """A large group whose members are alike to very different degrees, beside small ones."""
    r, rows = random.Random(4), []
    base = prose(9, 150).split()
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = prose(r.random(), 1)
        rows.append((1000 - i, " ".join(w)))
    for i in range(20):
        rows += [(2000 + i, prose(i, 40)), (3000 + i, prose(i, 40) + " x"), (4000 + i, prose(i, 30) + " " + prose(-i - 1, 10))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r, base = random.Random(6), prose(8, 120).split()
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_bounds_keep_pairs_at_the_threshold():
    for n, m in minhash.least_matches(0.85):
        assert 0 < m < 0.85 * n


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(7, None), (9, 9)]
    forest = components.Forest()
    for a, b in links:
        if b is not None:
            forest.join(a, b)
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: forest.root(n) for a, b in links if b is not None and a != b for n in (a, b)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_superseded_tables_are_deleted(spark):
    """Turns of the components leave one table, and cleanup leaves none; off a local master a shared folder must be set."""
    import os
    import types

    base = scratch.base(spark)
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.component for r in components.connected(links).collect()} == {0}
    assert len(set(os.listdir(base)) - before) == 1
    scratch.cleanup(spark)
    assert not os.path.exists(base)
    far = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(applicationId="x", master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.base(far)


def vectors():
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16).tolist(), 0) for i in range(200)]
    for i in range(40):
        v = np.array(rows[i][1])
        rows += [(300 + i, v.tolist(), 0), (400 + i, (3 * v + 0.4 * r.standard_normal(16)).tolist(), 0)]
    rows += [(i, [1.0] * 16, 1) for i in range(600, 660)] + [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] * 16, 0), (704, [float("inf")] + [0.0] * 15, 0), (None, [1.0] * 16, 0), (600, [1.0] * 16, 1)]
    return rows


@pytest.mark.parametrize("hot", [1, 10_000])
def test_vector_links(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").withColumn("embedding", F.col("embedding").cast("array<float>"))
    good = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    forest = components.Forest()
    for i, j in zip(*np.nonzero(linked), strict=True):
        forest.join(good[i][0], good[j][0])
    want = sorted((i, int(linked[k].sum()) - 1, forest.root(i)) for k, (i, _) in enumerate(good))
    got = vectordup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ids = {i for i, _ in good}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in ids) == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in ids)
    assert vectordup.near_duplicates(df.limit(0)).count() == 0


def test_vector_links_equal_sql(spark):
    from patquarry.llm import queries

    assert_same(queries.QUERIES["op7_vectordup"], queries.ORACLES["op7_vectordup"], spark)


def test_nearest(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, rank int")
    good = {}
    for r in df.collect():
        if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding):
            good[r.vec_id] = np.array(r.embedding)
    got = {}
    for r in ann.nearest(df, every=20, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in good if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        true = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        found = sorted(found)
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(abs(s - float(np.sqrt(((good[i] - good[q]) ** 2).sum()))) < 1e-9 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len({i for _, i in true} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.limit(3), every=1).count() == 6


def recall(spark, x, every=10, k=10):
    """Share of true neighbors found, and the share of lists that a query takes."""
    fitted, fit = [], ann.Quantiser.fit.__func__

    def spy(cls, *a):
        fitted.append(fit(cls, *a))
        return fitted[-1]

    ann.Quantiser.fit = classmethod(spy)
    try:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        got = ann.nearest(df, every=every, k=k).toPandas()
    finally:
        ann.Quantiser.fit = classmethod(fit)
    x, hits, asked = x.astype(np.float32).astype(float), 0, range(0, len(x), every)
    for i in asked:
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        hits += (got[got.query_id == i].score.to_numpy() <= np.sort(far)[k - 1] + 1e-9).sum()
    return hits / (k * len(asked)), fitted[0].taken / len(fitted[0].centers)


def test_nearest_prunes_clusters(spark):
    r = np.random.default_rng(2)
    found, share = recall(spark, r.standard_normal((60, 24))[r.integers(0, 60, 4000)] + 0.3 * r.standard_normal((4000, 24)), every=40)
    assert found >= 0.9 and share <= 0.15


def test_nearest_prunes_vectors_of_all_directions(spark):
    found, share = recall(spark, np.random.default_rng(3).standard_normal((4000, 24)), every=40)
    assert found >= 0.9 and share <= 0.5


def test_nearest_of_one_direction_and_extreme_sizes(spark):
    x = np.array([[10.0**e, 10.0**e] for e in (-160, -159, 0, 1, 150, 155)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df, every=1, k=5).collect()}
    assert len(got) == 30 and all(np.isclose(s, np.sqrt(2) * abs(x[i, 0] - x[j, 0]), rtol=1e-12, atol=0) for (i, j), s in got.items())
    assert {r.n_links for r in vectordup.near_duplicates(df).collect()} == {5}


def test_vector_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", 8)
    r = np.random.default_rng(8)
    base = r.standard_normal((6, 12))
    x = base[r.integers(0, 6, 240)] + 0.15 * r.standard_normal((240, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    forest = components.Forest()
    for i, j in zip(*np.nonzero(linked), strict=True):
        forest.join(int(i), int(j))
    got = vectordup.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, int(linked[i].sum()) - 1, forest.root(i)) for i in range(240)]


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == odd.columns
    kept = {r.doc_id for r in docs.collect()}
    assert sorted(r.text for r in docs.where("doc_id = 7").collect()) == ["   \n\t ", "other text of a repeated id"]  # two texts of one id are no duplicates
    assert 1 in kept and 2 not in kept and {5, 6, 8, 10, 11, 12, 14, None} <= kept and 13 not in kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()} == kept


def test_sieve(spark):
    """No row that has a key is called free of it, whatever the keys; most others are."""
    from patquarry.llm import sieve

    rows = spark.createDataFrame([(i % 500 - 250 if i % 7 else None, f"t{i}") for i in range(3000)], "k long, t string")
    keys = rows.where("k % 5 = 0 or k is null").select("k").distinct()
    may, free = sieve.sifted(rows, sieve.table(keys, "keys"), "k")
    assert may.columns == free.columns == ["k", "t"] and may.count() + free.count() == rows.count()
    asked = {r.k for r in keys.collect()}
    assert not asked & {r.k for r in free.select("k").distinct().collect()} and {r.k for r in may.select("k").distinct().collect()} - asked == set()
    none = sieve.table(keys.where("false"), "none")
    assert sieve.sifted(rows, none, "k")[1].count() == rows.count() and none.count() == 0


def test_near_duplicates_lose_no_other_text_of_a_kept_id(spark):
    import corpus_pipeline
    from tests.llm.conftest import SCHEMA, prose

    a, b = prose(1, 90), prose(2, 90)
    texts = [(1, a), (1, a.upper() + "  "), (1, b), (2, a + " more"), (3, prose(3, 90)), (None, a), (None, a), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, "z") for i, t in texts], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=repr)
    want = [(1, min(a, a.upper() + "  ")), (1, b), (3, prose(3, 90)), (None, a), (None, a), (5, None)]
    assert got == sorted(want, key=repr)
