"""Quality rules, periodic runs and the Merkle manifest, against SQL, plain definitions and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patquarry.llm import manifest, periodic, quality
from tests.compare import assert_same


@pytest.mark.parametrize("name", ["op11_quality", "op12_periodic", "op13_manifest"])
def test_query_equals_its_sql(name, spark):
    from patquarry.llm import queries

    assert_same(queries.QUERIES[name], queries.ORACLES[name], spark)


def plain_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


def test_quality_measures(spark, odd, empty):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(plain_measures(r.text or ""))
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)
    assert {r.kept for r in rows if r.doc_id == 1} == {True}
    assert quality.judge(empty).count() == 0
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choices("ab \n\t\x0b\x1c é#", k=r.randint(0, 60)))
        m = quality.Measures(text)
        assert plain_measures(text) == (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])


def test_windows_of_many_distinct_words():
    """Past 2**20 distinct words, pairs are numbered first."""
    words = [b"%d" % i for i in range((1 << 20) + 5)]
    assert quality.repeated_words(words + words[7:11]) == 8


def test_cascade_order():
    rules = [quality.Rule(x, needs, lambda m: False) for x, needs in (("dear", ("a",)), ("cheap", ("b",)), ("shares", ("a", "c")), ("never", ("c",)))]
    cost = {"a": 100.0, "b": 10.0, "c": 1.0}
    sets = [(0b0001, 50), (0b0010, 10), (0b0101, 30), (0, 110)]  # the first three rules reject 80, 10 and 30 of 200
    steps = quality.greedy(rules, sets, cost)
    assert [(s.rule, s.reached, s.rejected) for s in steps] == [("cheap", 200, 10), ("dear", 190, 80), ("shares", 110, 0), ("never", 110, 0)]
    assert [s.cost for s in steps] == [11.0, 101.0, 2.0, 1.0]  # what an earlier rule measured is free
    steps = quality.greedy(rules, sets, cost, given=["a"])
    assert [s.rule for s in steps] == ["dear", "cheap", "shares", "never"]
    assert [s.rejected for s in quality.greedy(rules, [], {})] == [0] * 4


def test_cascade_stops_early_and_keeps_the_same(spark, odd, empty):
    rows = quality.cascade(odd).collect()
    names = [r.name for r in quality.RULES]
    assert all((r.rejected_by is None) == (r.n_tried == len(names)) or r.rejected_by is not None for r in rows)
    assert any(r.n_tried == 1 for r in rows) and all(r.rejected_by in (None, *names) for r in rows)
    kept = quality.judge(odd).where("kept").count()
    assert kept == sum(r.rejected_by is None for r in rows) == quality.cascade(odd, quality.RULES[::-1]).where("rejected_by is null").count()
    left = quality.keep(odd)
    assert left.schema == odd.schema and left.count() == kept and quality.keep(empty).count() == 0
    steps = quality.estimate(odd)
    assert sorted(s.rule for s in steps) == sorted(names) and steps[0].reached == odd.count() and all(s.cost > 0 for s in steps)


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                part = words[i : j + q]
                if not any(all(x == y for x, y in zip(part, part[d:], strict=False)) for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences():
    r = random.Random(11)
    for k in range(500):
        n, kinds, out = r.randint(0, 80), r.choice((1, 2, 3, 8)), []
        while len(out) < n:
            unit = [r.randrange(kinds) for _ in range(r.randint(1, 7))]
            out += unit * r.choice((1, 1, 4, 5, 9))
        yield np.array(out, np.int64)
    yield np.array([0] * 301)
    yield np.array([0, 1] * 90 + [0] + [1, 0] * 90)
    yield np.array(([0] * 9 + [1]) * 30)  # runs of one word inside a run of ten
    yield np.array((([0] * 9 + [1]) * 5 + [2]) * 6)
    yield np.concatenate([np.arange(1000), np.tile(np.arange(25), 4), np.arange(1000)])


def test_runs_equal_the_definition():
    for codes in sequences():
        n = len(codes)
        assert periodic.runs(codes) == plain_runs(codes.tolist())
        most = n // 4
        if n:
            want = [0, *(int((codes[:-q] == codes[q:]).sum()) for q in range(1, most + 1))]
            assert periodic.lag_matches(codes, most).tolist() == want


def test_lags_of_frequent_and_rare_words():
    """Words on both sides of the bound, and more frequent ones than one call of the FFT takes."""
    r = np.random.default_rng(2)
    codes = np.concatenate([r.integers(0, 9, 20_000), r.integers(9, 3000, 20_000)])
    r.shuffle(codes)
    got = periodic.lag_matches(codes, 10_000)
    for q in (1, 2, 17, 999, 9_999, 10_000):
        assert got[q] == (codes[:-q] == codes[q:]).sum()


def test_long_periodic_texts_end_soon():
    codes = np.concatenate([np.zeros(200_000, np.int64), np.tile(np.arange(300), 400)])
    assert periodic.runs(codes) == [(0, 200_001, 1), (200_000, 120_000, 300)]


def plain_scan(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(words), len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_scan(spark, odd, empty):
    r = random.Random(9)
    more = [(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(0, 60)))) for i in range(100, 400)]
    texts = {}
    for x in odd.select("doc_id", "text").collect():
        if len(x.text or "") < 10_000:
            texts.setdefault(x.doc_id, []).append(plain_scan(x.doc_id, x.text))
    for i, t in more:
        texts.setdefault(i, []).append(plain_scan(i, t))
    rows = periodic.scan(odd).collect() + periodic.scan(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert len(rows) == odd.count() + len(more) and any(r.n_runs for r in rows if (r.doc_id or 0) >= 100)
    for r in rows:
        if r.doc_id == 10:
            assert (r.n_words, r.length, r.period) == (60_000, 60_000, 1)
        else:
            assert tuple(r)[1:] in texts[r.doc_id]
    assert periodic.scan(empty).count() == 0


def plain_tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(out[-1]), 8)])
    return out


def plain_path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append(("".join(level[i // 8 * 8 : i]), "".join(level[i + 1 : i // 8 * 8 + 8])))
        i //= 8
    return out


def plain_leaf(r, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = []
    for r in rows:
        hit = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 0
        made.append((r, plain_leaf(r, r.text), plain_leaf(r, r.text.translate(lower) if hit and r.text is not None else r.text)))
    trees, out = {}, []
    for lang in sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((m for m in made if m[0].lang == lang), key=lambda m: (m[0].doc_id is not None, m[0].doc_id or 0, m[1], m[2]))
        trees[lang] = (own, plain_tree([m[1] for m in own]))
    top = plain_tree([t[1][-1][0] for t in trees.values()])
    for k, (own, tree) in enumerate(trees.values()):
        for i, (r, leaf, now) in enumerate(own):
            path = plain_path(tree, i) + plain_path(top, k)
            for left, right in path:
                now = hashlib.sha256(f"{left}{now}{right}".encode()).hexdigest()
            siblings = hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()
            out.append((r.doc_id, leaf, tree[-1][0], top[-1][0], siblings, now, now == top[-1][0]))
    return out


def test_manifest(spark, odd, empty):
    """Trees of one leaf, of a block, of several blocks whose last is short, more languages than the fanout, and odd rows."""
    r = random.Random(4)
    langs = ["en"] * 1300 + ["de"] * 513 + ["fr"] * 512 + ["es"] * 64 + [None] * 9 + [f"x{i}" for i in range(9)] + ["é", "", "中", "\U0001f600"]
    rows = [(i, f"Text {i}" if i % 7 else None, x, f"s{i % 3}" if i % 5 else None, i if i % 4 else None) for i, x in enumerate(r.sample(langs, len(langs)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = manifest.manifest(df, manifest.tampered(df)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(df.collect()))
    assert {x.verified for x in got} == {True, False}
    assert all(x.verified for x in manifest.manifest(odd).collect())
    one = manifest.manifest(odd.where("doc_id = 12")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert manifest.manifest(empty, manifest.tampered(empty)).count() == 0


def test_depth():
    assert [manifest.depth(n) for n in (1, 2, 8, 9, 64, 65, 512, 513, 10**9)] == [0, 1, 1, 2, 2, 3, 3, 3, 3]
