import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from patquarry.llm import arrowstream, bpe, packing, scratch, tokens
from tests.llm.conftest import BYTE, WORD

ALPHABET = [*"abCD 'stllΣσς é́İ\n\n\t\r\x1c\x85\xa0 中文٣Ⅷ½_-!?<|>", "<|endoftext|>", "<|startoftext|>", "'re", " \n", "\n\n\n", "\0", "  "]


def texts(n=3000):
    r = random.Random(5)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("path", "width"), [(WORD, 2), (BYTE, 4)])
def test_encoder_equals_the_library(path, width):
    library, own = Tokenizer.from_file(path), tokens.Encoder(path, width)
    for t in texts():
        assert np.frombuffer(own.encode(t), own.type).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_segment_tree_equals_the_library():
    library, own = Tokenizer.from_file(WORD), bpe.SegmentTreeBPE(WORD)
    for t in texts():
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_query(odd, empty):
    library = Tokenizer.from_file(WORD)
    want = defaultdict(list)
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id].append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = defaultdict(list)
    for r in bpe.round_trip(odd, WORD).collect():
        got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.round_trip(empty, WORD).count() == 0


def test_arrow_files(spark, odd, empty):
    library = Tokenizer.from_file(WORD)
    manifest = arrowstream.write(odd, scratch.folder(spark, "t"), WORD, end_id=1, length=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in arrowstream.read(manifest).collect())
    want = defaultdict(list)
    for r in odd.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    at, ids = 0, [g[1] for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for start, doc_id, n, crc in got:
        assert start == at and (n, crc) in want[doc_id]
        at += n
    assert len(got) == odd.count()
    file = max(manifest.collect(), key=lambda r: r.n_tokens)
    sequence, mask = arrowstream.read_sequence(file.file, 3)
    assert len(sequence) == len(mask) == 64 and mask.all()
    assert arrowstream.read(arrowstream.write(empty, scratch.folder(spark, "t"), WORD, end_id=1)).count() == 0


def test_packing(odd, empty):
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack(odd, BYTE, capacity=256).collect()
    by_sequence, total = defaultdict(list), sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert 1 <= r.length <= 256
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in rows) == total and len(by_sequence) <= -(-total // 256) * 1.05 + 1
    one = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 10)
    ids = np.array([*library.encode("x " * 60_000, add_special_tokens=False).ids, 0], "<u4")
    assert [(p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, s, n, _ in one] == [(p, s, n, c) for p, s, n, c in one] and one[0][2] == (len(ids) % 256 or 256)
    assert packing.pack(empty, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 500)
    histogram = np.bincount(lengths, minlength=101)
    made = packing.plan(histogram)
    chosen = made.plan
    assert made.placed >= 0.8 * made.pieces == 0.8 * 500  # the programs place them, not best fit
    held = np.zeros(101, int)
    for filling, n in chosen:
        assert sum(k * c for k, c in filling) <= 100
        for k, c in filling:
            held[k] += n * c
    assert (held == histogram).all()
    bins = sum(n for _, n in chosen)
    assert bins <= sum(n for _, n in packing.best_fit(histogram)) * 1.01 + 1
    places = packing.Places(chosen, 100)
    rank = np.concatenate([np.arange(n) for n in histogram[1:]])
    length = np.repeat(np.arange(1, 101), histogram[1:])
    sequence, offset = places(length, rank)
    cells = {(s, o + i) for s, o, n in zip(sequence, offset, length, strict=True) for i in range(n)}
    assert len(cells) == lengths.sum() and sequence.max() < bins


def test_program_has_a_cover_and_a_bound():
    """The fractional cover covers, its value and the dual bound enclose the optimum, and fillings fit."""
    histogram = np.bincount(np.random.default_rng(7).integers(20, 70, 3000), minlength=101)
    found = packing.cover(histogram, gap=0.02)
    assert found.bound <= found.value <= found.bound * 1.06
    covered = np.zeros(101)
    for filling, n in found.fillings.items():
        assert sum(k * c for k, c in filling) <= 100
        for k, c in filling:
            covered[k] += n * c
    lack = np.maximum(0, histogram - covered)
    assert (lack * np.ceil(1 / np.maximum(1, 100 // np.maximum(1, np.arange(101))))).sum() <= 0.05 * 3000
    assert sum(found.fillings.values()) <= found.value + 1e-6


def test_program_beats_best_fit():
    """Best-fit decreasing pairs 45 with 45 and strands the rest; the program mixes lengths."""
    histogram = np.zeros(101, int)
    histogram[[45, 35, 20]] = 600
    made = packing.plan(histogram)
    assert sum(n for _, n in made.plan) == 600 and made.placed == made.pieces and round(made.bound, 6) == 600
    assert sum(n for _, n in packing.best_fit(histogram)) > 600


def test_files_are_read_in_as_many_tasks(spark):
    df = spark.range(600).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of few rows
    manifest = arrowstream.write(df, scratch.folder(spark, "t"), WORD, end_id=1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = arrowstream.read(manifest)
    assert out.rdd.getNumPartitions() == manifest.count() > 1


def test_documents_across_batches_and_sequences(tmp_path):
    """Documents of none, one and many sequences read back whole, whatever batches and sequences they end in."""
    r = np.random.default_rng(4)
    docs = [(i, r.integers(0, 60_000, n).astype("<u2")) for i, n in enumerate((0, 1, 63, 64, 65, 128, 5000, 0, 3, 16_384, 1, 200))]
    out = arrowstream.SequenceWriter(str(tmp_path / "a"), 64, 2, batch=16)
    for i, ids in docs:
        out.add(i, ids.tobytes())
    out.close()
    got = list(arrowstream.read_documents(str(tmp_path / "a")))
    starts = np.cumsum([0, *(len(ids) for _, ids in docs)])
    assert [(i, start, ids.tolist()) for i, start, ids in got] == [(i, int(s), ids.tolist()) for (i, ids), s in zip(docs, starts, strict=False)]
    flat = np.concatenate([ids for _, ids in docs])
    for k in (0, 15, 16, 100, len(flat) // 64):
        ids, mask = arrowstream.read_sequence(str(tmp_path / "a"), k)
        assert ids[mask].tolist() == flat[64 * k : 64 * (k + 1)].tolist()


def test_vocabularies_with_other_rules_are_refused(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    path = str(tmp_path / "t.json")
    for change in ({"normalizer": None}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
        with pytest.raises(ValueError, match="rules"):
            bpe.SegmentTreeBPE(path)
