"""Topic discovery: texts, terms, and the choice between numbers of topics; numbers differ from other libraries', invariants do not."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence
from itertools import count
from math import log, sqrt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from patquarry.functions.status import is_design
from patquarry.functions.text import is_filled
from patquarry.operators import online
from patquarry.sources import derived


def ladder(n: int) -> tuple[int, ...]:
    """Numbers of topics to try for ``n`` documents; raises below 30."""
    if n < 30:
        raise ValueError("too few documents for topics")
    if n < 50:
        return (3, 5, 8)
    if n < 100:
        return (5, 10)
    return tuple(range(10, min(40, 15 + 5 * ((n - 100) // 100)) + 1, 5))


def corpus(patents: DataFrame, vectors: DataFrame, text: str, members: DataFrame | None = None) -> DataFrame:
    """What topics are found in: patents with text and a vector, the latest one, that are no designs, of a workspace if given."""
    rows = patents.where(is_filled(F.col(text)) & ~is_design(F.col("document_kind")))
    if members is not None:
        rows = rows.join(members.select("patent_id"), "patent_id", "left_semi")
    latest = vectors.groupBy("patent_id").agg(F.max(F.struct("created", "embedding_id", "vector")).alias("v"))
    return rows.join(latest, "patent_id").select("patent_id", F.col(text).alias("text"), "v.embedding_id", "v.vector")


@F.pandas_udf(StringType())
def _unescape(x):  # noqa: ANN001, ANN202
    return x.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


def clean(text: Column) -> Column:
    """Entities resolved, NFKC, no control characters, spaces collapsed, one blank line at most."""
    t = F.regexp_replace(_unescape(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\t ]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def chunks(df: DataFrame, key: str, text: str, most: int = 256) -> DataFrame:
    """``key, chunk, words, text``: whole texts in runs of at most ``most`` words, nothing left out."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    rows = df.select(key, words.alias("w")).where(F.size("w") > 0)
    rows = rows.select(key, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / most).cast("int"))).alias("chunk"))
    part = F.slice("w", F.col("chunk") * most + 1, F.lit(most))
    return rows.select(key, "chunk", F.size(part).alias("words"), F.array_join(part, " ").alias("text"))


def reduce_dimensions(df: DataFrame, vector: str, most: int = 100) -> DataFrame:
    """The rows with ``reduced``, their first ``min(most, rows, dimensions)`` principal components."""
    return online.components(online.moments(df, vector), most).project(df, vector)


def assign(df: DataFrame, vector: str, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """A topic from 0 for each row that has a vector, by the best of several starts of k-means."""
    fits, _ = online.kmeans(df, vector, [k], starts, seed=seed)
    return online.assigned(df.where(F.col(vector).isNotNull()), vector, fits).withColumn("topic", F.col("topics")[0]).drop("topics", "distances")


def claim_chunks(df: DataFrame, key: str, text: str, most: int = 256, step: int | None = None) -> DataFrame:
    """``key, chunk, words, text``: whole claims packed in order into chunks of at most ``most`` words.

    A claim begins at ``n.``, after a line end or bar. One of more than ``most`` words makes chunks of its own, which begin every
    ``step`` words, ``most`` by default, until its end is reached."""
    step = step or most
    split = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?:^|[\r\n|])\s*(?=\d+\s*[.．、])"), split)

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - most + step - 1, F.lit(0)) / step).cast("int"))
        return F.transform(starts, lambda i: F.slice(words, i * step + 1, F.lit(most)))

    def add(found: Column, words: Column) -> Column:
        last = F.element_at(found, -1)
        fits = (F.size(found) > 0) & F.coalesce(F.size(F.try_element_at(found, F.lit(-1))) + F.size(words) <= most, F.lit(False))
        return F.when(fits, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.concat(last, words)))).otherwise(F.concat(found, cut(words)))

    packed = F.aggregate(F.filter(parts, lambda w: F.size(w) > 0), F.array().cast("array<array<string>>"), add)
    return df.select(key, F.posexplode(packed).alias("chunk", "w")).select(key, "chunk", F.size("w").alias("words"), F.array_join("w", " ").alias("text"))


def words_of(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of two characters and more in order, without ``stop_words`` (lower case)."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) > 1)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def pairs_of(words: Column) -> Column:
    """Pairs of neighbors among words, as text."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def terms_of(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words of two characters and more in order, without ``stop_words`` (lower case), and pairs of neighbors among them."""
    words = words_of(text, stop_words)
    return F.concat(words, pairs_of(words))


def _weight(n: Column, size: Column, mean: Column, whole: Column) -> Column:
    """Class-based TF-IDF of a term that stands ``n`` times in a topic and ``whole`` times in all."""
    return n / size * F.log(1 + mean / whole)


#: Up to so many topics have a column each where terms are counted.
WIDE = 64


def term_lists(df: DataFrame, text: str, topic: str = "topic", stop_words: Sequence[str] = ()) -> DataFrame:
    """``term, w``: every word and pair of words once, with its ``topic, n, weight`` in each topic that has it; see ``term_weights``.

    Counts are shuffled once, by term. The sizes of topics come from a pass before, a row a topic for the driver."""
    rows = df.select(topic, words_of(F.col(text), stop_words).alias("_words"))
    sizes = [(r[0], r[1]) for r in rows.groupBy(topic).agg(F.sum(F.greatest(2 * F.size("_words") - 1, F.lit(0)))).collect() if r[1]]
    mean, size = F.lit(float(sum(n for _, n in sizes)) / max(1, len(sizes))), dict(sizes)
    terms = rows.select(topic, F.explode(F.concat("_words", pairs_of(F.col("_words")))).alias("term"))
    if len(sizes) <= WIDE:
        columns = [f"_n{i}" for i in range(len(sizes))]
        counts = terms.groupBy("term").agg(*[F.count_if(F.col(topic).eqNullSafe(F.lit(t))).alias(c) for c, (t, _) in zip(columns, sizes, strict=True)])
        whole = sum((F.col(c) for c in columns), F.lit(0).cast("long"))
        each = [F.when(F.col(c) > 0, F.struct(F.lit(t).alias(topic), F.col(c).alias("n"), _weight(F.col(c), F.lit(n), mean, whole).alias("weight"))) for c, (t, n) in zip(columns, sizes, strict=True) if t is not None]
        kind = f"array<struct<{topic}:{df.schema[topic].dataType.simpleString()},n:bigint,weight:double>>"
        return counts.select("term", F.array_compact(F.array(*each)).cast(kind).alias("w"))
    counts = terms.groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.collect_list(F.struct(topic, "n")).alias("_w"), F.sum("n").alias("_all"))
    of = F.create_map(*[F.lit(x) for t, n in size.items() if t is not None for x in (t, n)])
    return counts.select("term", F.transform(F.filter("_w", lambda x: x[topic].isNotNull()), lambda x: F.struct(x[topic].alias(topic), x["n"].alias("n"), _weight(x["n"], of[x[topic]], mean, F.col("_all")).alias("weight"))).alias("w"))


def term_weights(df: DataFrame, text: str, topic: str = "topic", stop_words: Sequence[str] = ()) -> DataFrame:
    """Class-based TF-IDF of every word and pair of words in each topic: ``topic, term, n, weight``; no term is left out but ``stop_words``."""
    return term_lists(df, text, topic, stop_words).select("term", F.inline("w")).select(topic, "term", "n", "weight")


#: So many words at most are sent to the tasks to choose pairs by; with more of them all pairs are counted.
SIEVED = 200_000


def best_terms(df: DataFrame, text: str, groups: Column, most: int = 10, stop_words: Sequence[str] = ()) -> DataFrame:
    """``k, topic, rank, term, weight``: the ``most`` best words and pairs of words of each topic by class-based TF-IDF, ties to the smaller term.

    ``groups``: the topics that a text is in, an array of ``k, topic``; each ``k`` is a corpus of its own. The result is that of weighing every term,
    but most pairs are never counted: one stands no more often in a topic than either of its words, and at the same place in all others
    at least, so a word whose own count gives less than the topic's words have already is in no pair that matters."""
    spark, by = df.sparkSession, ["k", "topic"]
    rows = df.select(words_of(F.col(text), stop_words).alias("_words"), groups.alias("_in"))
    # a null word a text counts the texts: each has a pair less than words
    ended = F.when(F.size("_words") > 0, F.concat("_words", F.array(F.lit(None).cast("string"))))
    every = rows.select(F.explode(ended).alias("term"), "_in").select("term", F.inline("_in"))
    words, drop_words = derived.stored(every.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")), "words")
    sizes = words.groupBy(*by).agg(F.sum(F.when(F.col("term").isNull(), -F.col("n")).otherwise(2 * F.col("n"))).alias("size"))
    sizes, drop_sizes = derived.stored(sizes.withColumn("mean", F.avg("size").over(Window.partitionBy("k"))), "sizes")  # a row a topic

    def weighed(counts: DataFrame) -> DataFrame:
        whole = counts.groupBy("k", "term").agg(F.sum("n").alias("_all"))
        return counts.join(F.broadcast(sizes), by).join(whole, ["k", "term"]).select(*by, "term", "n", "size", "mean", _weight(F.col("n"), F.col("size"), F.col("mean"), F.col("_all")).alias("weight"))

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("weight").desc(), "term"))
    ranked = lambda weights: weights.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "rank", "term", "weight")
    words = words.where("term is not null")
    first, drop_first = derived.stored(ranked(weighed(words)), "best-words")
    least = first.groupBy(*by).agg(F.min(F.when(F.col("rank") == most, F.col("weight"))).alias("least"))
    bound = _weight(F.col("n"), F.col("size"), F.col("mean"), F.col("n"))
    able = words.join(F.broadcast(sizes), by).join(F.broadcast(least), by).where(F.col("least").isNull() | (bound >= F.col("least") * (1 - 1e-9)))
    able, drop_able = derived.stored(able.select("term").distinct(), "able-words")
    pairs = rows.select("_in", F.explode(F.arrays_zip(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))).alias("a"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("b"))).alias("p")).select("_in", "p.a", "p.b")
    if able.count() <= SIEVED:
        for c in ("a", "b"):
            pairs = pairs.join(F.broadcast(able.withColumnRenamed("term", c)), c, "left_semi")
    pairs = pairs.select(F.concat("a", F.lit(" "), "b").alias("term"), "_in").select("term", F.inline("_in"))
    pairs, drop_pairs = derived.stored(pairs.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")), "pairs")
    found, _ = derived.stored(ranked(first.select(*by, "term", "weight").unionByName(ranked(weighed(pairs)).select(*by, "term", "weight"))), "best-terms")  # a few rows a topic
    for path in (drop_words, drop_sizes, drop_first, drop_able, drop_pairs):
        derived.delete(spark, path)
    return found


def keywords(df: DataFrame, text: str, topic: str = "topic", most: int = 10, stop_words: Sequence[str] = ()) -> DataFrame:
    """``topic, rank, term, weight``, with the best terms of each topic by class-based TF-IDF."""
    found = best_terms(df, text, F.array(F.struct(F.lit(0).alias("k"), F.col(topic).alias("topic"))), most, stop_words)
    return found.select(F.col("topic").alias(topic), "rank", "term", "weight")


def _hashes(words, seed: str):  # noqa: ANN001, ANN202
    """Hashes of 8 bytes of different words."""
    from pandas.util import hash_array

    return hash_array(words.to_numpy(zero_copy_only=False), hash_key=f"{seed:>16}", categorize=False).view("int64")


def _parsed(words, seed: int, width: int):  # noqa: ANN001, ANN202
    """Of the words of a batch of texts each one's row and place in the list of different words, where a pair begins, that list, and its hashes.

    A hash is of ``width`` bytes and never 0."""
    import numpy as np
    import pyarrow.compute as pc

    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    hashes = _hashes(flat.dictionary, f"{seed}") & ((1 << 8 * width) - 1 if width < 8 else -1)
    return row, flat.indices.to_numpy().astype(np.int64), np.flatnonzero(row[:-1] == row[1:]), flat.dictionary, np.where(hashes == 0, 1, hashes)


def _sliced(columns, names: list[str], rows: int = 200_000):  # noqa: ANN001, ANN202
    """The columns as batches of so many rows at most."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(columns, names=names)
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _batch_counts(seed: int, width: int):
    """Rows ``topic, _a, _b, _n, _check`` of rows ``topic, words``: how often a batch's texts have a word, of hash ``_a``, or a pair, of hashes ``_a`` and ``_b``, in a
    topic. ``_b`` is 0 for a word, of which ``_check`` is another hash; both are 0 for the number of all of them."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row, ids, first, words, hashes = _parsed(batch.column(1), seed, width)
            topics = batch.column(0).dictionary_encode()
            names = pa.concat_arrays([topics.dictionary, pa.nulls(1, topics.dictionary.type)])
            t = pc.fill_null(topics.indices, len(names) - 1).to_numpy().astype(np.int64)[row]
            u, zero = max(1, len(words)), lambda x: np.zeros(len(x))
            of = lambda at, *more: _sliced([names.take(pa.array(at)), *(pa.array(x.astype(np.int64)) for x in more)], [batch.schema.names[0], "_a", "_b", "_n", "_check"])  # noqa: E731, B023
            size = np.bincount(t, minlength=len(names)) + np.bincount(t[first], minlength=len(names))
            at = np.flatnonzero(size)
            yield from of(at, zero(at), zero(at), size[at], zero(at))
            terms, n = np.unique(t * u + ids, return_counts=True)
            yield from of(terms // u, hashes[terms % u], zero(terms), n, _hashes(words, f"check {seed}")[terms % u])
            terms, n = np.unique((t[first] * u + ids[first]) * u + ids[first + 1], return_counts=True)
            yield from of(terms // u // u, hashes[terms // u % u], hashes[terms % u], n, zero(terms))

    return run


def _document_counts(seed: int, width: int):
    """Rows ``topic, key, _a, _b, _c`` of rows ``topic, key, words``: how often a text has a word or pair, as hashes."""

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, ids, first, words, hashes = _parsed(batch.column(2), seed, width)
            u = max(1, len(words))
            of = lambda at, a, b, c: _sliced([*(batch.column(k).take(pa.array(at)) for k in (0, 1)), *(pa.array(x.astype(np.int64)) for x in (a, b, c))], [*batch.schema.names[:2], "_a", "_b", "_c"])  # noqa: E731, B023
            terms, c = np.unique(row * u + ids, return_counts=True)
            yield from of(terms // u, hashes[terms % u], np.zeros(len(terms)), c)
            terms, c = np.unique((row[first] * u + ids[first]) * u + ids[first + 1], return_counts=True)
            yield from of(terms // u // u, hashes[terms // u % u], hashes[terms % u], c)

    return run


def _document_bounds(seed: int, width: int, heavy: list[tuple]):
    """Rows ``topic, key, _heavy, _light, _terms, _squares`` of rows ``topic, key, words``: the product of a text's counts with the weights in ``heavy``, rows of a topic, two hashes and
    a weight, the number of terms that have none there, that of all, and the sum of their counts' squares."""
    import numpy as np

    topics = list(dict.fromkeys(r[0] for r in heavy))
    place = {t: i for i, t in enumerate(topics)}
    of, a, b = (np.array([f(r) for r in heavy], np.int64) for f in (lambda r: place[r[0]], lambda r: r[1], lambda r: r[2]))
    known = np.unique(np.concatenate([[0], a, b]))  # 0 stands for no second word
    coded = lambda t, x, y: (t * len(known) + x) * len(known) + y
    codes, weights = coded(of, np.searchsorted(known, a), np.searchsorted(known, b)), np.array([r[3] for r in heavy], float)
    order = np.argsort(codes)
    codes, weights, none = np.append(codes[order], -1), np.append(weights[order], 0.0), int(np.searchsorted(known, 0))

    def found(code):  # noqa: ANN001, ANN202
        at = np.searchsorted(codes[:-1], code)
        return np.where(codes[at] == code, weights[at], 0.0)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row, ids, first, words, hashes = _parsed(batch.column(2), seed, width)
            u, n = max(1, len(words)), batch.num_rows
            t = pc.fill_null(pc.index_in(batch.column(0), value_set=pa.array(topics, batch.column(0).type)), -1).to_numpy().astype(np.int64)[row]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            at = np.where(known[at] == hashes, at, -1)[ids]
            one = found(np.where((t >= 0) & (at >= 0), coded(t, at, none), -2))
            x, y, s = at[first], at[first + 1], t[first]
            two = found(np.where((s >= 0) & (x >= 0) & (y >= 0), coded(s, x, y), -2))
            total = lambda a, b: np.bincount(row, a, n) + np.bincount(row[first], b, n)  # noqa: E731, B023
            terms, c = np.unique(row * u + ids, return_counts=True)
            pairs, d = np.unique((row[first] * u + ids[first]) * u + ids[first + 1], return_counts=True)
            squares = np.bincount(terms // u, c.astype(float) ** 2, n) + np.bincount(pairs // u // u, d.astype(float) ** 2, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total(one, two)), *(pa.array(total(a, b).astype(np.int64)) for a, b in ((one == 0, two == 0), (one >= 0, two >= 0))), pa.array(squares)],
                names=[*batch.schema.names[:2], "_heavy", "_light", "_terms", "_squares"],
            )

    return run


#: Terms of all topics together whose weights are sent to the tasks that bound cosines.
HEAVY = 65_536
#: So many terms of the texts that are left are sent to the tasks at most; with more of them both sides are shuffled.
FEW = 500_000
#: Up to so many topics have a column each where pairs are counted.
NARROW = 8
#: Bytes of a batch of texts in a Python worker, and of the hash of a word.
BATCH_BYTES, HASH_BYTES = 8 << 20, 8
#: Bytes of texts whose terms are counted by one task.
DEALT = 16 << 20


def _repeated_terms(rows: DataFrame, topic: str, kind: str, sizes: dict) -> tuple[DataFrame, str, int]:
    """``topic, _a, _b, _n, _all``: terms that stand more than once, as hashes, how often in a topic and in all; where that is stored; and the seed of the hashes.

    Where words of one hash differ in another one, all are counted again with another seed. Hashes of 0 have the topics' sizes.
    ``sizes``: the bytes of each topic's texts; a task gets the terms of ``DEALT`` of them, or fewer if Spark's own number of partitions is larger."""
    parted, by = sum(sizes.values()) // DEALT, ["_a", "_b"]
    deal = [parted] if parted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    checks = [F.min("_check").alias("_low"), F.max("_check").alias("_high")]
    for seed in count():
        parts = rows.select(topic, "_words").mapInArrow(_batch_counts(seed, HASH_BYTES), f"{kind}, _a long, _b long, _n long, _check long").repartition(*deal, *by)
        if 0 < len(sizes) <= NARROW:
            columns = [(f"_n{i}", t) for i, t in enumerate(sizes)]
            counts = parts.groupBy(*by).agg(*checks, *[F.sum(F.when(F.col(topic).eqNullSafe(F.lit(t)), F.col("_n")).otherwise(0)).alias(c) for c, t in columns])
            each = F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(t).cast(rows.schema[topic].dataType).alias(topic), F.col(c).alias("_n"))) for c, t in columns])
            counts = counts.withColumn("_all", sum((F.col(c) for c, _ in columns), F.lit(0).cast("long")))
            kept = counts.where("_all > 1 or _a = 0").select(*by, "_all", (F.col("_low") != F.col("_high")).alias("_met"), F.inline(F.array_compact(each)))
        else:
            counts, over = parts.groupBy(*by, topic).agg(*checks, F.sum("_n").alias("_n")), Window.partitionBy(*by)
            counts = counts.withColumns({"_all": F.sum("_n").over(over), "_met": F.min("_low").over(over) != F.max("_high").over(over)}).drop("_low", "_high")
            kept = counts.where("_all > 1 or _a = 0")
        terms, path = derived.stored(kept, "terms")
        if terms.where("_met").isEmpty():
            return terms.drop("_met"), path, seed
        derived.delete(rows.sparkSession, path)


def _levels(terms: DataFrame, topic: str, kind: StructField) -> tuple[DataFrame, DataFrame]:
    """Terms with their ``_weight`` and ``_level``, its logarithm in steps; and a row a topic: its size, the weight of a term that stands once, the norm of all
    weights, the level from which terms are heavy, and the smallest and largest weight below."""
    spark, sizes = terms.sparkSession, {r[0]: r[1] for r in terms.where("_a = 0").select(topic, "_n").collect()}
    mean = float(sum(sizes.values())) / max(1, len(sizes))
    size = spark.createDataFrame([(t, n) for t, n in sizes.items() if t is not None], StructType([kind, StructField("_size", LongType())]))
    weighed = terms.where("_a != 0").join(F.broadcast(size), topic).withColumn("_weight", _weight(F.col("_n"), F.col("_size"), F.lit(mean), F.col("_all")))
    weighed = weighed.withColumn("_level", F.floor(F.log2("_weight") * 16))
    of: dict = {t: [] for t in sizes if t is not None}
    found = weighed.groupBy(topic, "_level").agg(F.count(F.lit(1)).alias("many"), F.min("_weight").alias("least"), F.max("_weight").alias("most"), F.sum(F.col("_weight") * F.col("_weight")).alias("squares"), F.sum("_n").alias("n"))
    for r in found.collect():  # some hundred rows a topic
        of[r[0]].append(r)
    rows = []
    for t, levels in of.items():
        once, left, cut = log(1 + mean) / sizes[t], HEAVY // len(of), None
        least = most = once
        for r in sorted(levels, key=lambda r: -r._level):
            left -= r.many
            if left >= 0:
                cut = r._level
            else:
                least, most = min(least, r.least), max(most, r.most)
        singles = sizes[t] - sum(r.n for r in levels)
        rows.append((t, once, sqrt(sum(r.squares for r in levels) + singles * once * once), cut, least, most))
    names = [("_once", DoubleType()), ("_norm", DoubleType()), ("_cut", LongType()), ("_light_least", DoubleType()), ("_light_most", DoubleType())]
    return weighed, spark.createDataFrame(rows, StructType([kind, *(StructField(*x) for x in names)]))


def _able(bounds: DataFrame, key: str, topic: str, most: int) -> DataFrame:
    """Of rows with ``_low`` and ``_high``, between which their cosine is, those that can be among the ``most`` largest or smallest of their topic."""
    found = bounds
    for name, sure, able in (("_near", 0.0 - F.col("_low"), 0.0 - F.col("_high")), ("_far", F.col("_high"), F.col("_low"))):
        last = bounds.select(F.col(topic).alias("_t"), F.struct(sure.alias("x"), F.col(key).alias("k")).alias(name))
        last = last.withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy(name))).where(F.col("_r") == most).drop("_r")
        found = found.join(F.broadcast(last), F.col(topic).eqNullSafe(F.col("_t")), "left").drop("_t").withColumn(f"{name}_able", F.col(name).isNull() | (F.struct(able.alias("x"), F.col(key).alias("k")) <= F.col(name))).drop(name)
    return found.where("_near_able or _far_able").drop("_near_able", "_far_able")


def representative(df: DataFrame, key: str, text: str, topic: str = "topic", most: int = 3) -> DataFrame:
    """``topic, key, cosine, nearest, farthest``: documents by the cosine of their terms' counts with the topic's weights, the
    ``most`` nearest and farthest of each topic with their ranks, null for the other kind; ties go to the smaller key. Documents without terms count 0.

    The result is that of weighing every term of every document, but most documents are only bounded: the heaviest terms are few and known to every task, and
    a document's other terms weigh between the lightest and the heaviest of the rest. Only those that can be among the nearest or farthest meet all weights. Terms are hashes of
    words that are checked to differ, counted a batch before they are shuffled."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    try:
        found = _cosines(df, key, text, topic, most)
    finally:
        spark.conf.set(name, before)
    by = lambda *o: F.row_number().over(Window.partitionBy(topic).orderBy(*o))
    ranked = found.select(topic, key, "cosine", by(F.col("cosine").desc(), key).alias("nearest"), by("cosine", key).alias("farthest")).where((F.col("nearest") <= most) | (F.col("farthest") <= most))
    return ranked.select(topic, key, "cosine", *[F.when(F.col(c) <= most, F.col(c)).alias(c) for c in ("nearest", "farthest")])


def _cosines(df: DataFrame, key: str, text: str, topic: str, most: int) -> DataFrame:
    """``topic, key, cosine`` of the documents that can be among the ``most`` nearest or farthest, stored."""
    spark, kinds = df.sparkSession, {c: f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (topic, key)}
    both, coded = ", ".join(kinds.values()), lambda d: d.select(topic, key, words_of(F.col(text)).alias("_words"))
    rows = coded(df)
    sizes = {r[0]: r[1] or 0 for r in df.groupBy(topic).agg(F.sum(F.octet_length(text))).collect()}  # a row a topic
    terms, drop_terms, seed = _repeated_terms(rows, topic, kinds[topic], sizes)
    weighed, topics = _levels(terms, topic, df.schema[topic])
    topics = F.broadcast(topics)
    heavy = [tuple(r) for r in weighed.join(topics, topic).where("_level >= _cut").select(topic, "_a", "_b", "_weight").collect()]  # HEAVY rows at most
    bounds = rows.mapInArrow(_document_bounds(seed, HASH_BYTES, heavy), f"{both}, _heavy double, _light long, _terms long, _squares double")
    # the texts of a document have a norm together that is between that of terms apart and that of the same terms
    bounds = bounds.groupBy(topic, key).agg(*[F.sum(c).alias(c) for c in ("_heavy", "_light", "_terms")], F.sqrt(F.sum("_squares")).alias("_least"), F.sum(F.sqrt("_squares")).alias("_most")).join(topics, topic, "left")
    bound = lambda x, own: F.round(F.when((F.col("_least") > 0) & F.col(key).isNotNull(), x / (F.col(own) * F.col("_norm"))).otherwise(0.0), 9)
    error = (F.col("_terms") + 10) * 1e-15  # sums in another order differ by less
    low, high = (bound((F.col("_heavy") + F.col("_light") * F.col(f"_light_{x}")) * near, own) for x, near, own in (("least", 1 - error, "_most"), ("most", 1 + error, "_least")))
    bounds, drop_bounds = derived.stored(bounds.select(topic, key, "_terms", F.coalesce(low, F.lit(0.0)).alias("_low"), F.coalesce(high, F.lit(0.0)).alias("_high")), "bounds")  # a row a document
    able, drop_able = derived.stored(_able(bounds, key, topic, most), "able")
    many, size = able.agg(F.count(F.lit(1)), F.coalesce(F.sum("_terms"), F.lit(0))).first()
    few = lambda d, n, limit: F.broadcast(d) if n <= limit else d
    own = coded(df.join(few(able.select(topic, key), many, SIEVED), [topic, key], "left_semi")).mapInArrow(_document_counts(seed, HASH_BYTES), f"{both}, _a long, _b long, _c long")
    own, drop_own = derived.stored(own.groupBy(topic, key, "_a", "_b").agg(F.sum("_c").alias("_c")), "able-terms")
    met = weighed.join(few(own, size, FEW), [topic, "_a", "_b"]).groupBy(topic, key).agg(F.sum(F.col("_c") * F.col("_weight")).alias("_dot"), F.sum("_c").alias("_met"))
    whole = own.groupBy(topic, key).agg(F.sum("_c").alias("_size"), F.sum(F.col("_c") * F.col("_c")).alias("_own"))
    dots = whole.join(met, [topic, key], "left").join(topics, topic)
    # a term that was not met stands once
    dot = F.coalesce("_dot", F.lit(0.0)) + (F.col("_size") - F.coalesce("_met", F.lit(0))) * F.col("_once")
    dots = dots.select(topic, key, (dot / (F.sqrt(F.col("_own").cast("double")) * F.col("_norm"))).alias("_x"))
    found, _ = derived.stored(able.select(topic, key).join(dots, [topic, key], "left").select(topic, key, F.round(F.coalesce("_x", F.lit(0.0)), 9).alias("cosine")), "cosines")
    for path in (drop_terms, drop_bounds, drop_able, drop_own):
        derived.delete(spark, path)
    return found


def _windows(sets: dict[int, list[str]], width: int, rows: int = 4096):
    """How many windows of the texts have each word, and each pair of words of one topic; a row a word or pair and task.

    ``rows`` windows at a time are a matrix of which words each has, whose product with itself counts pairs."""
    import numpy as np
    import pyarrow as pa

    names = sorted({w for words in sets.values() for w in words})
    index = {w: i for i, w in enumerate(names)}
    member = np.zeros((len(names), len(sets)), np.float32)
    for t, words in enumerate(sets.values()):
        member[[index[w] for w in words], t] = 1
    together = np.triu(member @ member.T > 0)

    def run(batches):  # noqa: ANN001, ANN202
        total, n = np.zeros(together.shape, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                tokens = value.as_py()
                starts = max(1, len(tokens) - width + 1)
                n += starts
                found = [(i, index[w]) for i, w in enumerate(tokens) if w in index]
                if not found:
                    continue
                at, ids = np.array(found).T
                own, ids = np.unique(ids, return_inverse=True)
                for first in range(0, starts, rows):
                    many = min(rows, starts - first)
                    a, b = np.searchsorted(at, (first, first + many + width - 1))
                    change = np.zeros((many + 1, len(own)), np.int32)
                    np.add.at(change, (np.maximum(at[a:b] - width + 1 - first, 0), ids[a:b]), 1)
                    np.add.at(change, (np.minimum(at[a:b] + 1 - first, many), ids[a:b]), -1)
                    there = (change[:-1].cumsum(0) > 0).astype(np.float32)
                    total[np.ix_(own, own)] += (there.T @ there).astype(np.int64)
        x, y = np.nonzero(together & (total > 0))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(names[i] for i in x)]), pa.array(["", *(names[i] for i in y)]), pa.array([n, *total[x, y].tolist()], pa.int64())], names=["a", "b", "n"])

    return run


def coherence(df: DataFrame, text: str, words: DataFrame, topic: str = "topic", width: int = 110) -> dict[int, float]:
    """The c_v coherence of each topic's words over the texts (Röder et al., 2015).

    In sliding windows of ``width`` words each word of a topic has a vector of its normalised pointwise mutual information
    with all of them; the mean cosine of these vectors with their sum is the topic's. Only single words count. The driver gets
    counts of the topics' words, not of the texts'."""
    sets: dict[int, list[str]] = {}
    for r in words.select(topic, "term").orderBy(topic, "term").collect():  # a few words a topic
        if " " not in r.term:
            sets.setdefault(r[topic], []).append(r.term)
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) > 1)
    rows = df.select(tokens.alias("w")).where(F.size("w") > 0).mapInArrow(_windows(sets, width), "a string, b string, n long")
    n = {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    total, out = n.get(("", ""), 0), {}
    for t, ws in sets.items():
        p = lambda a, b: n.get((min(a, b), max(a, b)), 0) / max(1, total)  # noqa: E731, B023
        npmi = [[log((p(a, b) + 1e-12) / (p(a, a) * p(b, b))) / -log(p(a, b) + 1e-12) if p(a, a) and p(b, b) and p(a, b) < 1 else float(a == b or p(a, b) == 1) for b in ws] for a in ws]
        whole = [sum(c) for c in zip(*npmi, strict=True)]
        dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
        cosines = [dot(v, whole) / sqrt(dot(v, v) * dot(whole, whole)) if dot(v, v) and dot(whole, whole) else 0.0 for v in npmi]
        out[t] = sum(cosines) / len(cosines)
    return out


def quality(assigned: DataFrame, words: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: diversity of keywords, entropy of sizes over its maximum, and the share of topics under five rows."""
    sizes = assigned.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row a topic
    balance = sizes.withColumn("p", share).agg((-F.sum(F.col("p") * F.log("p")) / F.greatest(F.log(F.count(F.lit(1)).cast("double")), F.lit(1e-12))).alias("balance"), F.avg((F.col("n") < 5).cast("double")).alias("small"), F.count(F.lit(1)).alias("topics"))
    return balance.join(words.agg((F.count_distinct("term") / F.count(F.lit(1))).alias("diversity")))


def candidates(df: DataFrame, text: str, vector: str, reduced: int = 100, starts: int = 10, stop_words: Sequence[str] = (), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Every number of topics of the ladder fitted, judged and scored, and what is in which topic.

    Returns the candidates, ``k, coherence, diversity, balance, small, score, profile`` (null, or low, middle or high), and the
    rows of ``df`` that have a vector with ``k, topic, distance`` to the topic's center, once for each ``k``. All numbers and ``starts`` are fitted in
    the same passes over stored components; terms are counted for all numbers together."""
    spark = df.sparkSession
    ready, drop_ready = derived.stored(reduce_dimensions(df.where(F.col(vector).isNotNull()), vector, reduced), "reduced")
    ks = ladder(ready.count())
    fits, _ = online.kmeans(ready, "reduced", ks, starts, seed=seed)
    near, _ = derived.stored(online.assigned(ready, "reduced", fits), "assigned")
    derived.delete(spark, drop_ready)
    words = best_terms(near, text, F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.col("topics").alias("topic")), stop_words=stop_words)
    held = coherence(near, text, words.withColumn("_topic", F.col("k") * 1000 + F.col("topic")), "_topic")
    per_topic = spark.createDataFrame(list(held.items()), "_topic int, c double").groupBy(F.floor(F.col("_topic") / 1000).cast("int").alias("k")).agg(F.avg("c").alias("coherence"))
    diverse = words.groupBy("k").agg((F.count_distinct("term") / F.count(F.lit(1))).alias("diversity"))
    rows = near.select(*df.columns, "reduced", F.inline(F.arrays_zip(F.array(*map(F.lit, ks)).alias("k"), F.col("topics").alias("topic"), F.col("distances").alias("distance"))))
    sizes = rows.groupBy("k", "topic").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("k")))
    even = sizes.groupBy("k").agg((-F.sum(F.col("p") * F.log("p")) / F.greatest(F.log(F.count(F.lit(1)).cast("double")), F.lit(1e-12))).alias("balance"), F.avg((F.col("n") < 5).cast("double")).alias("small"))
    scored = score(even.join(per_topic, "k").join(diverse, "k"))
    chosen = profiles(scored).select("k", F.element_at(F.array(F.lit("low"), F.lit("middle"), F.lit("high")), F.col("part")).alias("profile"))
    return scored.join(chosen, "k", "left"), rows


def score(rows: DataFrame) -> DataFrame:
    """Candidates ``k, coherence, diversity, balance, small`` with their weighted score of values scaled to 0..1."""
    w = Window.partitionBy(F.lit(0))  # a row a candidate
    scaled = lambda c: F.when(F.max(c).over(w) == F.min(c).over(w), 1.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    return rows.withColumn("score", 0.40 * scaled("coherence") + 0.25 * scaled("diversity") + 0.25 * scaled("balance") + 0.10 * (1 - scaled("small")))


def labels(words: DataFrame, topic: str = "topic") -> DataFrame:
    """Codes in the order of topics and labels of their three best terms."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ")
    return words.where("rank <= 3").groupBy(topic).agg(text.alias("label")).withColumn("topic_code", F.format_string("T%03d", F.col(topic) + 1))


def profiles(rows: DataFrame) -> DataFrame:
    """Of scored candidates one each from the low, middle and high third of the numbers of topics: the best, the smaller on a tie."""
    w = Window.partitionBy(F.lit(0)).orderBy("k")  # a row a candidate
    third = rows.withColumn("part", F.ntile(3).over(w))
    best = F.row_number().over(Window.partitionBy("part").orderBy(F.col("score").desc(), "k"))
    return third.withColumn("_nth", best).where("_nth = 1").drop("_nth")
