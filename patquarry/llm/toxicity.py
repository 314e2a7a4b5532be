"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its embedding, from a vocabulary learnt in training, beside the summed embeddings of its short
runs of characters. The network reads windows of ``WINDOW`` words that overlap by half and together cover the whole text; a
text's score is that of its worst window. Training knows labels of texts only: in each epoch the window that the
network finds worst stands for its text. A long clean text is offered in turns, every so many windows in one epoch and those
after them in the next, so that all of its windows are looked at in the course of training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patquarry.llm import scratch
from patquarry.llm.licenses import words

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, GRAMS = 8, 8, 12, 16_384
#: Stands for no word where a text ends within a window.
PAD = b"\n"
#: The bounds of training: rows of each label (taken by a hash of the id), characters of each label's rows together,
#: vocabulary, epochs.
TOXIC_ROWS, CLEAN_ROWS, TOXIC_CHARS, CLEAN_CHARS, VOCABULARY, EPOCHS = 2000, 4000, 12_000_000, 24_000_000, 8192, 8
#: Windows of a clean text that an epoch offers, or more where the epochs would not get through all of them.
AT_ONCE = 10
#: The optimizer's step, and how often a word's embedding is hidden in training.
RATE, DROP = 0.015, 0.4
#: Words whose inputs a worker keeps; it starts anew beyond that. Words, and windows, scored
#: together.
KEPT, TOGETHER, CHUNK = 80_000, 100_000, 2048


def grams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three and of five characters (bytes) of the words with their ends marked, and each one's word.

    Every word has one of either kind at least."""
    marked = [b"^" + w + b"$$$" for w in tokens]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    first = np.cumsum(size) - size
    buckets, owners = [], []
    for n, seed in ((3, 2_654_435_761), (5, 2_246_822_519)):
        count = size - n + 1 - (2 if n == 3 else 0)  # runs of three end at the first mark
        owner = np.repeat(np.arange(len(tokens)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        code = np.zeros(len(at), np.uint32)
        for i in range(n):
            code = code * np.uint32(16_777_619) ^ flat[at + i]
        buckets.append((code * np.uint32(seed) >> np.uint32(18)).astype(np.int64) % GRAMS)
        owners.append(owner)
    return np.concatenate(buckets), np.concatenate(owners)


def blocks(n: int) -> int:
    """Into how many blocks of ``STRIDE`` words a text of ``n`` words is padded: two neighbors are a window."""
    return max(2, -(-n // STRIDE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + x.dtype.type(0.5)


@dataclass
class Network:
    """Parameters and the two passes; ``vocabulary`` maps words to rows of the embedding, row 0 being for others.

    Arrays run (step, unit, window), so that units are contiguous over windows."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the score of every text where training had one label only

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        shapes = {"word": (len(vocabulary) + 1, WORD_DIM), "gram": (GRAMS, CHAR_DIM), "attention": (2 * h,), "out": (2 * h,), "bias": (1,)}
        for way in "fb":
            shapes |= {f"x{way}": (d, 3 * h), f"u{way}": (3 * h, h), f"c{way}": (3 * h,)}
        scale = {"word": 0.3, "gram": 0.3, "bias": 0.0, "cf": 0.0, "cb": 0.0, "uf": 0.3, "ub": 0.3}
        return cls(vocabulary, {k: (r.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()})

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, 0) for w in tokens), np.int64, len(tokens))

    def inputs(self, tokens: list[bytes], rows: np.ndarray | None = None) -> np.ndarray:
        """Inputs of distinct words."""
        bucket, owner = grams(tokens)
        total = np.stack([np.bincount(owner, self.p["gram"][bucket, k], len(tokens)) for k in range(CHAR_DIM)], 1)
        mean = total / np.sqrt(np.bincount(owner, minlength=len(tokens)))[:, None]
        return np.concatenate([self.p["word"][self.rows(tokens) if rows is None else rows], mean.astype(self.p["gram"].dtype)], 1)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in "fb"}

    def run(self, step: Callable[[str, int], np.ndarray], n: int, keep: list | None = None) -> np.ndarray:
        """Logits of ``n`` windows; ``step(way, t)`` gives the gate inputs at a step. ``keep`` gets what training needs."""
        h, kind = HIDDEN, self.p["out"].dtype
        states = np.empty((WINDOW, 2 * h, n), kind)
        for way, order, part in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            s, u = np.zeros((h, n), kind), self.p[f"u{way}"]
            for t in order:
                x, q = step(way, t), u @ s
                zr = x[: 2 * h] + q[: 2 * h]
                zr *= kind.type(0.5)
                np.tanh(zr, out=zr)
                zr *= kind.type(0.5)
                zr += kind.type(0.5)
                z, r = zr[:h], zr[h:]
                new = r * q[2 * h :]
                new += x[2 * h :]
                np.tanh(new, out=new)
                if keep is not None:
                    keep.append((way, t, s, z, r, new, q[2 * h :]))
                s = s - new
                s *= z
                s += new
                states[t, part] = s
        weight = np.matmul(self.p["attention"], states)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,thb->hb", weight, states)
        if keep is not None:
            keep.append((states, weight, pooled))
        return self.p["out"] @ pooled + self.p["bias"][0]

    def gradient(self, tokens: list[bytes], index: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean logistic loss over windows; ``index`` is into the distinct ``tokens``."""
        p, h, n = self.p, HIDDEN, len(index)
        rows = self.rows(tokens) if rows is None else rows
        x, keep = self.inputs(tokens, rows), []
        gates = self.gates(x)
        logit = self.run(lambda way, t: np.ascontiguousarray(gates[way][index[:, t]].T), n, keep)
        states, weight, pooled = keep.pop()
        d_logit = ((_sigmoid(logit) - label) / n).astype(p["out"].dtype)
        d = {"out": pooled @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = p["out"][:, None] * d_logit
        d_weight = np.einsum("hb,thb->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d["attention"] = np.einsum("tb,thb->h", d_score, states)
        d_gates = {way: np.zeros((len(tokens), 3 * h), p["out"].dtype) for way in "fb"}
        d_u = {way: np.zeros_like(p[f"u{way}"]) for way in "fb"}
        carry = {way: np.zeros((h, n), p["out"].dtype) for way in "fb"}
        for way, t, last, z, r, new, q in reversed(keep):
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            ds = carry[way] + weight[t] * d_pooled[part] + d_score[t] * p["attention"][part, None]
            d_new = ds * (1 - z) * (1 - new**2)
            d_z = ds * (last - new) * z * (1 - z)
            d_r = d_new * q * r * (1 - r)
            d_q = np.concatenate([d_z, d_r, d_new * r])
            d_u[way] += d_q @ last.T
            np.add.at(d_gates[way], index[:, t], np.concatenate([d_z, d_r, d_new]).T)
            carry[way] = ds * z + p[f"u{way}"].T @ d_q
        d_in = np.zeros_like(x)
        for way in "fb":
            d[f"u{way}"], d[f"c{way}"], d[f"x{way}"] = d_u[way], d_gates[way].sum(0), x.T @ d_gates[way]
            d_in += d_gates[way] @ p[f"x{way}"].T
        d["word"], d["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(d["word"], rows, d_in[:, :WORD_DIM])
        bucket, owner = grams(tokens)
        d_mean = d_in[:, WORD_DIM:] / np.sqrt(np.bincount(owner, minlength=len(tokens)))[:, None]
        for k in range(CHAR_DIM):
            d["gram"][:, k] = np.bincount(bucket, d_mean[owner, k], GRAMS)
        return d, float(np.mean(np.logaddexp(0, logit) - label * logit))

    def scores(self, texts: list[list[bytes]], memo: Memo) -> np.ndarray:
        """The worst window's probability for each text; 0 for a text without words."""
        has = np.fromiter(map(bool, texts), bool, len(texts))
        if self.constant is not None:
            return np.where(has, self.constant, 0.0)
        flat: list[bytes] = []
        count = [blocks(len(t)) for t in texts]
        for t, n in zip(texts, count, strict=True):
            flat += t
            flat += [PAD] * (n * STRIDE - len(t))
        index = memo.index(flat).reshape(-1, STRIDE)
        owner = np.repeat(np.arange(len(texts)), count)
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(index) - 1, CHUNK):
            some = index[i : i + CHUNK + 1]
            # (word in block, unit, block): a window's steps are slices of it
            x = {way: np.ascontiguousarray(memo.gates[way][some.T].transpose(0, 2, 1)) for way in "fb"}
            n = len(some) - 1
            logit = self.run(lambda way, t, x=x, n=n: x[way][t % STRIDE][:, t // STRIDE : t // STRIDE + n], n)
            whose = owner[i : i + n]
            inside = whose == owner[i + 1 : i + n + 1]
            np.maximum.at(best, whose[inside], logit[inside])
        return np.where(has, _sigmoid(best), 0.0)

    def token(self) -> int:
        """A hash of all that scores depend on."""
        h = xxhash.xxh64(repr((self.constant, list(self.vocabulary.items()))).encode())
        for k in sorted(self.p):
            h.update(k.encode() + self.p[k].tobytes())
        return h.intdigest()


class Memo:
    """Gate inputs of words, each computed once; holds ``KEPT`` words and those of one call at most."""

    def __init__(self, network: Network) -> None:
        self.network, self.row = network, {}
        self.gates = {way: np.zeros((0, 3 * HIDDEN), np.float32) for way in "fb"}

    def index(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.row) > KEPT:
            self.row = {}
        new = [w for w in set(tokens) if w not in self.row]
        if new:
            used = len(self.row)
            fresh = self.network.gates(self.network.inputs(new))
            if used + len(new) > len(self.gates["f"]):
                for way in "fb":
                    grown = np.zeros((int(1.2 * (used + len(new))), 3 * HIDDEN), np.float32)
                    grown[:used] = self.gates[way][:used]
                    self.gates[way] = grown
            for way in "fb":
                self.gates[way][used : used + len(new)] = fresh[way]
            self.row.update(zip(new, range(used, used + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))


def train(toxic: list[list[bytes]], clean: list[list[bytes]], seed: int = 11) -> Network:
    """Fit the network to labelled texts, given as words."""
    toxic, clean = [t for t in toxic if t], [t for t in clean if t]
    if not toxic or not clean:
        return Network(constant=float(bool(toxic)))
    r = np.random.default_rng(seed)

    def odds_of(keys) -> dict[bytes, float]:  # noqa: ANN001
        """Log odds of the label by the presence of a key, which start the choice of windows."""
        one, zero = (Counter(k for t in texts for k in {key for w in set(t) for key in keys(w)}) for texts in (toxic, clean))
        return {k: np.log((one[k] + 0.5) / (len(toxic) + 1)) - np.log((zero[k] + 0.5) / (len(clean) + 1)) for k in one | zero}

    by_word, by_start = odds_of(lambda w: (w,)), odds_of(lambda w: (w[:4], w[:6]))
    total = Counter(w for t in toxic + clean for w in set(t))
    chosen = [w for w, n in sorted(total.items(), key=lambda e: (-e[1], e[0]))[:VOCABULARY] if n >= 3]
    net = Network.new({w: i + 1 for i, w in enumerate(chosen)})
    known = [PAD, *sorted(total)]
    of = {w: i for i, w in enumerate(known)}
    odds = np.array([0.0, *(max(by_word[w], by_start[w[:4]], by_start[w[:6]]) for w in known[1:])])
    rows = net.rows(known)

    def cut(t: list[bytes]) -> np.ndarray:
        ids = np.zeros(blocks(len(t)) * STRIDE, np.int32)
        ids[: len(t)] = [of[w] for w in t]
        at = np.arange(0, len(ids) - STRIDE, STRIDE)
        return ids[at[:, None] + np.arange(WINDOW)]

    texts = [(cut(t), 1.0) for t in toxic] + [(cut(t), 0.0) for t in clean]
    turns = lambda n: min(EPOCHS, -(-n // AT_ONCE))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        offered = [np.arange(0 if y else (epoch + k) % turns(len(w)), len(w), 1 if y else turns(len(w))) for k, (w, y) in enumerate(texts)]
        flat = np.concatenate([w[s] for (w, _), s in zip(texts, offered, strict=True)])
        if epoch:
            gates = {way: np.empty((len(known), 3 * HIDDEN), np.float32) for way in "fb"}
            for i in range(0, len(known), 16_384):  # bounds the memory of the words' characters
                for way, g in net.gates(net.inputs(known[i : i + 16_384], rows[i : i + 16_384])).items():
                    gates[way][i : i + 16_384] = g
            logit = lambda part: net.run(lambda way, t: np.ascontiguousarray(gates[way][part[:, t]].T), len(part))  # noqa: E731, B023
            value = np.concatenate([logit(flat[i : i + CHUNK]) for i in range(0, len(flat), CHUNK)])
        else:
            parts = (odds[flat[i : i + CHUNK]] for i in range(0, len(flat), CHUNK))
            value = np.concatenate([x.max(1) + x.clip(0).sum(1) / WINDOW for x in parts])
        index, labels, at = [], [], 0
        for (w, y), some in zip(texts, offered, strict=True):
            picks = [some[int(np.argmax(value[at : at + len(some)]))]]
            at += len(some)
            if not y:
                picks.append(int(r.integers(len(w))))
            index += [w[k] for k in picks]
            labels += [y] * len(picks)
        index, labels = np.array(index), np.array(labels, np.float32)
        order = r.permutation(len(index))
        rate = RATE if epoch < EPOCHS - 3 else RATE / 4
        size = max(16, min(256, len(index) // 24))
        for i in range(0, len(order), size):
            part = order[i : i + size]
            used, inverse = np.unique(index[part], return_inverse=True)
            shown = np.where(r.random(len(used)) < DROP, 0, rows[used])  # some words are known by their characters only
            grad, _ = net.gradient([known[k] for k in used], inverse.reshape(len(part), WINDOW), labels[part], shown)
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: F.Column) -> F.Column:
    """Whether the CRC-32 of the id as text leaves 0 on division by 5; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fifth, each read whole.

    Of each label the rows with the smallest hashes of their ids are taken, ``TOXIC_ROWS`` and ``CLEAN_ROWS`` at most; one
    that would exceed ``TOXIC_CHARS`` or ``CLEAN_CHARS`` with those before it is passed over. Null ids, labels and texts are
    left out; of texts that repeat an id the smallest counts. With rows of one label only, or none, the network is a
    constant.
    """
    spark = df.sparkSession
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.where(F.col("y") == y).orderBy(*by_hash).limit(n) for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    label_of = {r.doc_id: r.y for part in some for r in part.collect()}  # bounded, in the order of the hashes
    ids = spark.createDataFrame([(i,) for i in label_of], "doc_id long")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    rows = scratch.table(rows.groupBy("doc_id").agg(F.min("text").alias("text")), "labelled-texts")
    size = {r.doc_id: r.n for r in rows.select("doc_id", F.length("text").alias("n")).collect()}  # a row an id of the sample
    left, chosen = {1: TOXIC_CHARS, 0: CLEAN_CHARS}, []
    for i, y in label_of.items():
        if size.get(i, left[y] + 1) <= left[y]:
            left[y] -= size[i]
            chosen.append((i,))
    rows = rows.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    one: dict[bytes, bytes] = {}  # equal words are one object
    taken = {r.doc_id: [one.setdefault(w, w) for w in words(r.text)] for r in rows.toLocalIterator()}  # bounded by the sample
    parts: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for i in sorted(taken):
        parts[label_of[i]].append(taken[i])
    del taken, one
    return train(parts[1], parts[0])


_memos: dict[int, Memo] = {}


def score(df: DataFrame, network: Network, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. A null text, or one without words, scores 0. Null and repeated keys pass
    through, a row for each row; other columns are not read; an empty table gives an empty result. All
    windows of very long texts are scored, in bounded batches.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key).cast("long")).alias("held_out"), F.col(text).alias("text"))
    scored = rows.mapInArrow(_scorer(df, network), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _batches(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """Texts as words, about ``TOGETHER`` words at a time."""
    group, n = [], 0
    for x in texts:
        tokens = words(x or "")
        group.append(tokens)
        n += len(tokens)
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def _scorer(df: DataFrame, network: Network, text: str | None = None):
    """Scores of the last column, or of the field ``text`` of the last column's rows."""
    scratch.bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(network)
    token = network.token()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _memos:
            _memos.clear()
            _memos[token] = Memo(shared.value)
        memo = _memos[token]
        for batch in batches:
            last = batch.num_columns - 1
            texts = (x.as_py() for x in (batch.column(last) if text is None else batch.column(last).field(text)))
            found = [memo.network.scores(group, memo) for group in _batches(texts)]
            value = np.concatenate(found) if found else np.zeros(0)
            keep = batch.num_columns if text else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(value, pa.float64())], names=[*batch.schema.names[:keep], "score"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return run


def reject(df: DataFrame, network: Network, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` without the rows whose text scores ``threshold`` or more; all columns stay, whatever their names."""
    schema = df.select(F.struct("*").alias("row")).schema.add("score", "double")
    return df.select(F.struct("*").alias("row")).mapInArrow(_scorer(df, network, text), schema).where(F.col("score") < threshold).select("row.*")
