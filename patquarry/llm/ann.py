"""Approximate nearest neighbors: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. A query takes the lists of its
nearest centroids, ranks their vectors by asymmetric distance tables, i.e. of the query itself against codes, and the
best are ranked again by their exact distance. How many lists a query takes is fitted, too: as many as find a stated share of
true neighbors in the sample, few where the vectors form clusters and more where they spread over all directions.

Queries meet the index in blocks of queries whose nearest lists are neighbors; a list goes only to blocks that take it.
Equal vectors are indexed once, with the smallest ids that have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.llm import scratch
from patquarry.llm.runs import grouped
from patquarry.llm.vectors import binary, dimension, keyed, prepare, raw, stored_kind

#: Vectors that centroids and codebooks are fitted on, at most, and the share of them that only counts neighbors; those that codebooks
#: are fitted on; turns of the fit; components of a sub-vector; codes.
SAMPLE, ASIDE, BOOK_SAMPLE, TURNS, PART, CODES = 32_768, 0.25, 8192, 6, 4, 256
#: The most lists, the vectors a list has at least on average, and the share of true neighbors that the lists taken shall hold, by
#: so many of the sample's vectors.
LISTS, IN_LIST, RECALL, ASKED = 4096, 4, 0.95, 512
#: Codes kept from each run, which is also the least that a query's lists hold, and candidates ranked exactly, as multiples of k.
NEAR, RERANK = 8, 32
#: Queries of a block, indexed vectors that meet one in a run, and the most runs of a block: beyond that runs grow, but are streamed.
QUERIES, RUN, RUNS = 512, 16_384, 256


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norm = (centers * centers).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(norm - 2 * x[i : i + 4096] @ centers.T, 1)
    return out


def k_means(x: np.ndarray, k: int, seed: int, turns: int = TURNS) -> np.ndarray:
    """Centers of ``x``; an empty cluster keeps its center."""
    r = np.random.default_rng(seed)
    centers = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(turns):
        of = _nearest(x, centers)
        n = np.bincount(of, minlength=len(centers))
        total = np.stack([np.bincount(of, x[:, c], len(centers)) for c in range(x.shape[1])], 1)
        centers[n > 0] = (total[n > 0] / n[n > 0, None]).astype(x.dtype)
    return centers


@dataclass
class Quantiser:
    """Coarse centroids, of which a query takes ``taken``, and a codebook for each sub-vector of the residuals.

    Works in single precision on vectors divided by ``scale``; only exact ranking needs more."""

    centers: np.ndarray
    books: np.ndarray  # (part, code, component)
    scale: float
    taken: int = 1
    sizes: np.ndarray | None = None  # indexed vectors of each list

    @classmethod
    def fit(cls, x: np.ndarray, n: int, k: int) -> Quantiser:
        """From sample rows in random order, for ``n`` vectors and ``k`` neighbors."""
        scale = float(np.abs(x).max())
        x = _padded(x, scale)
        seen = x[int(ASIDE * len(x)) :]
        centers = k_means(seen, max(1, min(LISTS, len(seen) // IN_LIST)), 1)
        near = _nearest(centers, k_means(centers, max(1, int(len(centers) ** 0.5)), 2))
        centers = centers[np.argsort(near, kind="stable")]  # neighbors get neighboring numbers
        some = seen[:BOOK_SAMPLE]
        rest = some - centers[_nearest(some, centers)]
        books = [k_means(rest[:, i : i + PART], CODES, 3 + i) for i in range(0, x.shape[1], PART)]
        out = cls(centers, np.stack(books), scale)
        out.taken = out._enough(x, len(x) - len(seen), min(1.0, len(seen) / max(n, 1)), k)
        return out

    def _enough(self, x: np.ndarray, aside: int, share: float, k: int) -> int:
        """The fewest lists that hold ``RECALL`` of the ``k`` nearest of sample rows, of rows that the fit has seen and others in the share of the whole."""
        if len(x) < 2 or len(self.centers) == 1:
            return len(self.centers)
        of, norm = _nearest(x, self.centers), (x * x).sum(1)
        depth, seen = [], []
        for i in np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int):
            far = norm - 2 * x @ x[i]
            far[i] = np.inf
            best = np.argpartition(far, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            place = np.empty(len(self.centers), np.int64)
            place[np.argsort(self.to_centers(x[i : i + 1])[0], kind="stable")] = np.arange(len(place))
            depth.append(place[of[best]])
            seen.append(best >= aside)
        depth, seen = np.concatenate(depth), np.concatenate(seen)
        held = np.zeros(len(self.centers))
        for which, weight in ((seen, share if (~seen).any() else 1.0), (~seen, 1 - share if seen.any() else 1.0)):
            if which.any():
                held += weight * np.cumsum(np.bincount(depth[which], minlength=len(held))) / which.sum()
        return int(np.searchsorted(held, RECALL)) + 1

    def to_centers(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return np.maximum((x * x).sum(1)[:, None] + (self.centers * self.centers).sum(1) - 2 * x @ self.centers.T, 0)

    def takes(self, far: np.ndarray, least: int) -> np.ndarray:
        """Which lists each query takes, by its distances to the centroids: its nearest ones, and more until they hold ``least`` vectors."""
        order = np.argsort(far, 1, kind="stable")
        held = np.cumsum(self.sizes[order], 1)
        number = np.maximum(self.taken, (held < least).sum(1) + 1)
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, np.arange(far.shape[1]) < number[:, None], 1)
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the part of the squared distance that no query changes, of each row."""
        x = _padded(x, self.scale)
        of = _nearest(x, self.centers)
        rest = x - self.centers[of]
        codes = np.stack([_nearest(rest[:, i * PART : (i + 1) * PART], b) for i, b in enumerate(self.books)], 1)
        coded = self.books[np.arange(len(self.books)), codes].reshape(len(x), -1)
        return of, codes.astype(np.uint8), ((coded + 2 * self.centers[of]) * coded).sum(1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """For each query and part what every code adds to the squared distance: (query, part, code)."""
        return -2 * np.einsum("qpc,pkc->qpk", x.reshape(len(x), -1, PART), self.books)


def _padded(x: np.ndarray, scale: float) -> np.ndarray:
    return np.pad(x / scale, ((0, 0), (0, -x.shape[1] % PART))).astype(np.float32)


def _index(shared, kind: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, codes, fixed = shared.value.encode(raw(batch.column(1), kind).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int64()), pa.array(fixed, pa.float64()), binary(codes)], names=["rep", "list", "fixed", "codes"])

    return run


def _first(shared, kind: str):  # noqa: ANN001, ANN202
    """The nearest list of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = _nearest(_padded(raw(batch.column(1), kind).astype(np.float64), shared.value.scale), shared.value.centers)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64())], names=["query_id", "q", "first"])

    return run


def _lists(shared, kind: str, least: int):  # noqa: ANN001, ANN202
    """The lists that some query of each sorted run (block of queries) takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for group in grouped(batches, 1):
            wanted = np.zeros(len(index.centers), bool)
            for at in range(0, group.num_rows, QUERIES):
                q = _padded(raw(group.column(1).slice(at, QUERIES), kind).astype(np.float64), index.scale)
                wanted |= index.takes(index.to_centers(q), least).any(0)
            lists = np.nonzero(wanted)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), group.column(0)[0].as_py())), pa.array(lists)], names=["j", "list"])

    return run


class _Block:
    """Queries of a block and the best codes that each has met so far."""

    def __init__(self, index: Quantiser, ids: np.ndarray, q: np.ndarray, near: int) -> None:
        q = _padded(q, index.scale)
        self.ids, self.near, self.far, self.tables = ids, near, index.to_centers(q), index.tables(q)
        self.takes = index.takes(self.far, near)
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def meet(self, rep: np.ndarray, lists: np.ndarray, fixed: np.ndarray, codes: np.ndarray) -> None:
        parts = np.arange(codes.shape[1])
        for k, (ids, far) in enumerate(self.found):
            rows = np.nonzero(self.takes[k, lists])[0]
            if not len(rows):
                continue
            new = self.far[k, lists[rows]] + fixed[rows] + self.tables[k][parts, codes[rows]].sum(1)
            ids, far = np.concatenate([ids, rep[rows]]), np.concatenate([far, new])
            if len(far) > self.near:
                best = np.argpartition(far, self.near - 1)[: self.near]
                ids, far = ids[best], far[best]
            self.found[k] = ids, far

    def rows(self) -> pa.RecordBatch:
        n = [len(f) for f, _ in self.found]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([f for f, _ in self.found])), pa.array(np.concatenate([f for _, f in self.found]).astype(np.float64))], names=["query_id", "rep", "far"]
        )


def _search(shared, kind: str, near: int):  # noqa: ANN001, ANN202
    """Sorted runs of (query block, run), in each the queries first; indexed rows are streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = None, None
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            starts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                if (key[0, start], key[1, start]) != last:
                    if block is not None:
                        yield block.rows()
                    block, asked, last = None, [], (key[0, start], key[1, start])
                if not key[2, start]:
                    asked.append((part.column(3).to_numpy(), raw(part.column(6), kind).astype(np.float64)))
                    continue
                if block is None:
                    block = _Block(shared.value, *(np.concatenate(x) for x in zip(*asked, strict=True)), near)
                block.meet(part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), raw(part.column(6), "u1"))
        if block is not None:
            yield block.rows()

    return run


def _scores(kind: str):
    """Exact distances in double precision of pairs of vectors; squares neither overflow nor vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = raw(batch.column(3), kind).astype(np.float64) - raw(batch.column(4), kind).astype(np.float64)
                most = np.maximum(np.abs(d).max(1), np.finfo(np.float64).tiny)
                safe = np.where((most > 1e100) | (most < 1e-100), most, 1.0)
                d = d / safe[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.sqrt((d * d).sum(1)) * safe)], names=["query_id", "asked", "key", "score"])

    return run


def nearest(df: DataFrame, every: int = 50, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by Euclidean distance found for each row whose id ``every`` divides.

    Returns ``query_id, rank, vec_id, score``: the score is the exact distance on the original vectors in double
    precision; ties go to the smaller id. Candidates are all rows but the query's own.

    Vectors that are null, empty or zero, or have null or non-finite components, and null ids take no part. Rows that
    repeat an id are one candidate, with its nearest vector, and one query each. Fewer candidates than ``k`` are all
    returned. Other columns are not read; an empty table gives an empty result; vectors of
    different lengths raise. Equal vectors are told by a hash of 128 bits.
    """
    spark = df.sparkSession
    rows, kind = prepare(df, key, vector), stored_kind(df, vector)
    dimension(rows.where("ok"))
    good = scratch.table(keyed(rows, kind), "vectors")
    one = Window.partitionBy("key").orderBy("vec_id")
    # the smallest ids of each distinct vector: no answer needs more
    members = scratch.table(good.select("key", "vec_id").distinct().withColumn("nth", F.row_number().over(one)).where(F.col("nth") <= k + 1), "vector-members")
    classes = scratch.table(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v")).withColumn("hash", F.xxhash64("key")), "vector-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = classes.orderBy("hash", "rep", "key").limit(SAMPLE).select("v").collect()  # bounded
    index = Quantiser.fit(np.frombuffer(b"".join(r.v for r in sample), kind).reshape(len(sample), -1).astype(np.float64), n, k)
    shared = spark.sparkContext.broadcast(index)
    # a class is known by the hash of its key in the search, and by the key itself before it is ranked exactly
    indexed = scratch.table(classes.select(F.col("hash").alias("rep"), "v").mapInArrow(_index(shared, kind), "rep long, list long, fixed double, codes binary"), "vector-index")
    index.sizes = np.zeros(len(index.centers), np.int64)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a list, LISTS at most
        index.sizes[r.list] = r.n
    searched = spark.sparkContext.broadcast(index)
    asked = good.where(F.col("vec_id") % every == 0).withColumn("query_id", F.xxhash64("vec_id", "key")).select("vec_id", "key", "query_id", "v").dropDuplicates(["vec_id", "key"])
    asked = scratch.table(asked, "vector-queries")
    first = scratch.table(asked.select("query_id", "v").mapInArrow(_first(shared, kind), "query_id long, q binary, first long"), "vector-first-lists")
    sizes = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))  # a row a list, LISTS at most
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    queries = first.join(F.broadcast(sizes), "first").withColumn("j", F.floor((F.col("base") + F.pmod(F.col("query_id"), F.col("n"))) / QUERIES).cast("long")).select("j", "q", "query_id")
    queries = scratch.table(queries, "vector-query-blocks")
    wanted = scratch.table(queries.repartition("j").sortWithinPartitions("j").select("j", "q").mapInArrow(_lists(searched, kind, NEAR * k), "j long, list long"), "vector-wanted-lists")
    runs = max(1, min(RUNS, -(-n // RUN)))
    none = lambda t: F.lit(None).cast(t)
    left = indexed.join(wanted, "list").select("j", F.pmod("rep", F.lit(runs)).alias("i"), F.lit(1).cast("long").alias("indexed"), F.col("rep").alias("id"), "list", "fixed", F.col("codes").alias("value"))
    right = queries.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).select("j", "i", F.lit(0).cast("long").alias("indexed"), F.col("query_id").alias("id"), none("long").alias("list"), none("double").alias("fixed"), F.col("q").alias("value"))
    dealt = left.unionByName(right).repartition("j", "i").sortWithinPartitions("j", "i", "indexed")
    found = dealt.mapInArrow(_search(searched, kind, NEAR * k), "query_id long, rep long, far double")
    best = Window.partitionBy("query_id").orderBy("far", "rep")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= RERANK * k).select("query_id", F.col("rep").alias("hash"))
    found = scratch.table(found, "vector-candidates")
    pairs = found.join(classes.select("hash", "key", F.col("v").alias("w")), "hash").join(asked.select("query_id", F.col("vec_id").alias("asked"), "v"), "query_id")
    scored = pairs.select("query_id", "asked", "key", "v", "w").mapInArrow(_scores(kind), "query_id long, asked long, key binary, score double")
    ranked = Window.partitionBy("query_id").orderBy("score")
    scored = scored.withColumn("nth", F.rank().over(ranked)).where(F.col("nth") <= k + 1).drop("nth")
    rows = scored.join(members.select("vec_id", "key"), "key").where("vec_id != asked").groupBy("query_id", "asked", "vec_id").agg(F.min("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(F.col("asked").alias("query_id"), "rank", "vec_id", "score")
