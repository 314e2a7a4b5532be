"""MinHash near-duplicates with sequential Bayesian verification (after BayesLSH, Satuluri et al., 2012).

1. Rows with the same words form a class, named by its smallest id. A class has the set of its word shingles, a
   signature of minima and band keys of several minima each.
2. Classes that share a band key form a bucket. In a first round each is paired with its bucket's hub, the smallest.
   A second round takes the buckets whose members are not yet in one component, and in them all pairs across
   components, the most alike first, until they are joined or verified. A pair counts in its first shared band
   only, a large bucket is dealt out in pairs of blocks, and only links that join components leave a task. Blocks get
   signatures first; words follow only for classes with a pair that those leave possible.
3. Signatures are compared in batches. After each batch the posterior probability that the similarity reaches the
   threshold, from a uniform prior, decides: below ``miss`` the pair is dropped.
4. Survivors are verified on the full sets, and connected components are taken of those that pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from patquarry.llm import scratch, sieve
from patquarry.llm.components import Forest, connected, with_classes
from patquarry.llm.runs import grouped

#: Bands of so many minima: a pair at similarity 0.85 shares no band with a chance of 7.7e-7.
BANDS, ROWS = 24, 5
#: Signature bytes and how many are compared in a batch; the posterior below which a pair is dropped.
HASHES, BATCH, MISS = 128, 16, 1e-6
#: Members of a bucket's block, the salts over which a bucket's members are spread in joins (bits of a mask), and bytes of sets that a
#: task keeps while it verifies.
BLOCK, SALTS, HELD = 1024, 64, 64 << 20

_random = np.random.default_rng(20240601)
_A = _random.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(tokens: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words where there are fewer."""
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), len(tokens))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = len(h) - size + 1
    s = h[:n].copy()
    for i in range(1, size):
        s ^= s >> np.uint64(31)
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[i : i + n]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def minima(items: np.ndarray) -> np.ndarray:
    """The signature: the least value of each hash function over a set that is not empty."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    return np.min([(_A * x[k : k + 4096] + _B).min(1) for k in range(0, len(x), 4096)], 0)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype("<u4")
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


@cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """After so many hashes, the fewest matches at which the posterior of reaching the threshold is at least ``miss``.

    With a uniform prior the posterior is the chance of at most m successes in n + 1 draws of that probability; one
    byte of a minimum also matches by chance in one of 256 cases.
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the signature pairs (rows of ``a`` and ``b``) may reach the threshold, and their matches."""
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in least_matches(threshold):
        matches = matches + (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(1)
        keep = matches >= least
        live, matches = live[keep], matches[keep]
        if not len(live):
            break
    return live, matches


def _fixed(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Binary values of one width as rows of an array."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), width).view(kind)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig, band = [], [], [], []
            for x in batch.column(1):
                tokens = words(x.as_py() or "")
                items = shingles(tokens, size)
                n.append(len(items))
                if len(items):
                    m = minima(items)
                    key.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                    sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                    band.append(bands(m).tolist())
                else:
                    key.append(None), sig.append(None), band.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "sig", "bands"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class key and the words, compressed, of each text that has words."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        key, out = [], []
        for x in batch.column(1):
            raw = b" ".join(words(x.as_py() or ""))
            key.append(xxhash.xxh3_128_digest(raw) if raw else None)
            out.append(squeeze.compress(raw) if raw else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "key", "packed"])


def _prune(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live, _ = survivors(_fixed(batch.column(2), HASHES, "u1"), _fixed(batch.column(3), HASHES, "u1"), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(live)) for i in (0, 1)], names=["a", "b"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets without repeats."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        held: dict[bytes, np.ndarray] = {}
        n = 0

        def items(packed: bytes) -> np.ndarray:
            nonlocal n
            found = held.get(packed)
            if found is None:
                found = shingles(expand.decompress(packed).split(), size)
                if n + len(packed) + found.nbytes > HELD:
                    held.clear()
                    n = 0
                held[packed] = found
                n += len(packed) + found.nbytes
            return found

        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if similar(items(x), items(y), percent)]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return run


def _possible(part: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a run (bucket, block pair), across components, that the signatures leave possible, the most alike first."""
    block, rep, label, hub, band = (part.column(i).to_numpy() for i in range(3, 8))
    if label.min() == label.max():
        return np.zeros(0, int), np.zeros(0, int)
    sig, keys = _fixed(part.column(8), HASHES, "u1"), _fixed(part.column(9), 8 * BANDS, "<u8")
    n, one_block = len(rep), block.min() == block.max()
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, n, 64):
        i, j = np.nonzero(np.ones((min(64, n - start), n), bool))
        i = i + start
        ok = (label[i] != label[j]) & (rep[i] != hub[0]) & (rep[j] != hub[0]) & (rep[i] < rep[j] if one_block else (block[i] < block[j]))
        i, j = i[ok], j[ok]
        first = np.argmax(keys[i] == keys[j], 1) == band[0]  # each pair in its first shared band only
        i, j = i[first], j[first]
        live, matches = survivors(sig[i], sig[j], threshold)
        found.append((i[live], j[live], matches))
    i, j, matches = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-matches, kind="stable")
    return i[order], j[order]


def _close(threshold: float):
    """The rows of each run that have a possible pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, 3):
            i, j = _possible(part, threshold)
            if len(i):
                yield part.take(pa.array(np.union1d(i, j)))

    return run


def _across(threshold: float, size: int, percent: int):
    """Verified links across components within runs of (bucket, block pair), those that join two of them only.

    Pairs that the signatures leave possible are verified on the full sets, the most alike first; a pair whose
    components a link of the run has joined already is skipped. So a run gives fewer links than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for part in grouped(batches, 3):
            i, j = _possible(part, threshold)
            if not len(i):
                continue
            rep, label = part.column(4).to_pylist(), part.column(5).to_pylist()
            items: dict[int, np.ndarray] = {}
            forest, links = Forest(), []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.root(label[x]) == forest.root(label[y]):
                    continue
                for k in (x, y):
                    if k not in items:
                        items[k] = shingles(expand.decompress(part.column(10)[k].as_py()).split(), size)
                if similar(items[x], items[y], percent):
                    forest.join(label[x], label[y])
                    links.append((rep[x], rep[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of texts whose shingle sets are ``percent`` per cent alike or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row: the size of its set, the smallest id that links
    reach and whether that is its own. Sets are of distinct runs of ``size`` words; a text with fewer words has its
    whole sequence as the one run.

    A null text counts as empty. Texts without words have no shingles, link with nothing and are kept. A null key
    takes no part: its component is null and it is kept. Rows that repeat a key are one node of the graph, each
    returned. Other columns are not read; an empty table gives an empty result.
    """
    scratch.bounded(df.sparkSession)
    threshold = percent / 100
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"
    described = scratch.table(rows.mapInArrow(_describe(size), schema), "signatures")
    named = described.where("doc_id is not null and key is not null")
    classes = scratch.table(
        named.groupBy("key").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("c"), F.count(F.lit(1)).alias("copies")).select("key", F.col("c.doc_id").alias("rep"), "c.sig", "c.bands", "copies"), "classes"
    )
    # a bucket joins its members once for each salt that they have, so a hot one is spread
    salted = lambda df: df.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda x: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x)) != 0))).drop("mask")
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("mask")
    place = ["bucket", "band", "salt"]
    member = classes.select("rep", F.posexplode("bands").alias("band", "bucket")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    buckets = member.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub"), F.max("rep").alias("last"), mask).where("n > 1 and hub != last").drop("last")
    member = scratch.table(member.join(salted(scratch.table(buckets, "buckets")), place), "bucket-members")
    keys = F.to_binary(F.array_join(F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit("hex"))
    signed = scratch.table(classes.join(member.select("rep").distinct(), "rep", "left_semi").select("rep", "key", "sig", keys.alias("keys")), "bucket-signatures")
    # words are made and shuffled of the rows whose id may be a bucket member's
    wanted = signed.select(F.col("rep").alias("doc_id"), "key")
    asked, _ = sieve.sifted(rows.where("doc_id is not null"), sieve.table(wanted.select("doc_id"), "wanted-ids"), "doc_id")
    packed = asked.mapInArrow(_packed, "doc_id long, key binary, packed binary")
    packed = packed.join(wanted.hint("merge"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    packed = scratch.table(packed.select(F.col("doc_id").alias("rep"), "packed"), "bucket-words")

    def attach(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
        left = values.select(F.col("rep").alias("a"), F.col(value).alias("x"))
        right = values.select(F.col("rep").alias("b"), F.col(value).alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    hubs = member.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    hubs = scratch.table(attach(hubs, signed, "sig").mapInArrow(_prune(threshold), "a long, b long").distinct(), "hub-pairs")
    links = scratch.table(attach(hubs, packed, "packed").mapInArrow(_verify(size, percent), "a long, b long").distinct(), "hub-links")
    components = connected(links)
    labelled = member.where("n > 2").join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    labelled = scratch.table(labelled, "labelled")
    open_ = labelled.groupBy("bucket", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), mask).where("lo != hi").select("bucket", "band", "mask")
    some = labelled.join(salted(scratch.table(open_, "open-buckets")), place, "left_semi")
    some = some.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    some = some.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    deal = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    columns = [*(F.col(c).cast("long").alias(c) for c in ("bucket", "i", "j", "block", "rep", "label", "hub", "band")), "sig", "keys"]
    close = deal(some.join(signed.select("rep", "sig", "keys"), "rep").select(columns))
    close = scratch.table(close.mapInArrow(_close(threshold), close.schema), "block-candidates")
    worded = deal(close.join(packed, "rep").select(*close.columns, "packed"))
    more = scratch.table(worded.mapInArrow(_across(threshold, size, percent), "a long, b long"), "block-links")
    components = connected(more.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    of = classes.select("key", "copies", F.col("rep").alias("node")).join(components, "node", "left").select("key", "copies", F.coalesce("component", "node").alias("component"))
    of = scratch.table(of, "text-components")
    # rows without an id have no class here, whatever their text
    keys = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    return with_classes(keys, of).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same rows by joining on every shingle, for small tables; three words and 85 per cent.
ORACLE = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s from w
), items as (select doc_id, len(s) as n, unnest(s) as x from s
), links as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id != b.doc_id group by 1, 2 having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(node, other) as (
  select doc_id, doc_id from s union select r.node, l.b from reach r join links l on r.other = l.a
), comp as (select node, min(other) as component_id from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join comp c on c.node = s.doc_id
"""
