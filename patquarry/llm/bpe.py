"""Byte-pair encoding of words by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree hold ``rank * size + position`` of each adjacent pair (a large number where no merge
exists), inner nodes the minimum of their children. The root is therefore the leftmost merge of the lowest rank.
A merge changes three leaves, each put right on its path to the root, until the root holds no merge. Words of
like size are done together, one tree to a row of an array.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patquarry.llm.tokens import KEPT, WORD_PATTERN, WORD_RULES, byte_letters, lower_nfc, rules, split_space

_NONE = np.int64(1) << 60


class SegmentTreeBPE:
    """The vocabulary with word ends of a tokenizers file: encodes words, decodes ids.

    Raises for a file whose rules of splitting are not ``WORD_RULES``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix")
        if not self.end:
            raise ValueError(f"{path} has no word ends; its words cannot be told apart")
        if rules(spec) != WORD_RULES:
            raise ValueError(f"{path} has other rules of splitting than those that are built in")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in (vocab | self.special).items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.n = max(self.token) + 1
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """What the leaf ``at`` holds for a pair of symbols; a symbol of -1 means there is none."""
        key = left * self.n + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.ranks[i] * size + at, _NONE)

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 after the end, size a power of two; merged symbols are -2 where one was taken up."""
        rows, size = symbols.shape
        pad = np.full((rows, 1), -1, np.int64)
        sym = np.concatenate([symbols, pad], 1)  # a last column stands for "no neighbour", as does index -1
        after = np.broadcast_to(np.minimum(np.arange(1, size + 2), size), (rows, size + 1)).copy()
        before = np.broadcast_to(np.concatenate([[size], np.arange(size)]), (rows, size + 1)).copy()
        tree = np.full((rows, 2 * size), _NONE, np.int64)
        at = np.arange(size)
        tree[:, size:] = self._leaves(sym[:, :-1], sym[:, 1:], at, size)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(live):
            root = tree[live, 1]
            i = root % size
            right = after[live, i]
            far, near = after[live, right], before[live, i]
            sym[live, i] = self.merged[root // size]
            sym[live, right] = -2
            after[live, i] = far
            before[live, far] = i
            before[live, size] = size
            sym[live, size] = -1
            new = sym[live, i]
            tree[live, size + right] = _NONE
            tree[live, size + i] = self._leaves(new, sym[live, far], i, size)
            has = near < size
            tree[live[has], size + near[has]] = self._leaves(sym[live[has], near[has]], new[has], near[has], size)
            for leaf, rows_of in ((right, live), (i, live), (near[has], live[has])):
                node = (size + leaf) >> 1
                while len(node) and node[0]:
                    tree[rows_of, node] = np.minimum(tree[rows_of, 2 * node], tree[rows_of, 2 * node + 1])
                    node >>= 1
            live = live[tree[live, 1] < _NONE]
        return sym[:, :-1]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, a maximal run that the split pattern gives."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        found: list[list[int]] = [[] for _ in raw]
        size_of = np.maximum(1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64), 2)
        for size in np.unique(size_of):
            where = np.nonzero((size_of == size) & (length > 0))[0]
            step = max(1, (1 << 18) // int(size))  # bounds the arrays' memory
            for k in range(0, len(where), step):
                part = where[k : k + step]
                flat = np.frombuffer(b"".join([raw[j] for j in part]), np.uint8)
                n = length[part]
                row = np.repeat(np.arange(len(part)), n)
                col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                symbols = np.full((len(part), int(size)), -1, np.int64)
                symbols[row, col] = self.inner[flat]
                symbols[np.arange(len(part)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
                done = self._merge(symbols)
                keep = done >= 0
                ids, ends = done[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
                start = 0
                for j, end in zip(part.tolist(), ends, strict=True):
                    found[j] = ids[start:end]
                    start = end
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the tokenizers library gives them, without added tokens."""
        return [int(i) for piece in self.pieces([text])[0][0] for i in piece.split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, special ones included: this vocabulary file names no decoder."""
        return " ".join(self.token[i] for i in ids)

    def pieces(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """For each text the ids and the decoded strings of its chunks; distinct chunks are encoded together."""
        if not hasattr(self, "ids_of"):
            self.ids_of, self.text_of, self.young = {}, {}, {}
        chunked = []
        for text in texts:
            if self.specials and self.specials.search(text):
                parts = self.specials.split(text)
                chunked.append([x for k, p in enumerate(parts) for x in ([f"\0{p}"] if k % 2 else split_space(lower_nfc(p)))])
            else:
                chunked.append(split_space(lower_nfc(text)))
        known, young = self.ids_of.keys(), self.young.keys()
        need = list(dict.fromkeys(c for c in set().union(*chunked) if c not in known and c not in young)) if chunked else []
        if need:
            if len(self.young) > KEPT // 4:
                for c in self.young:
                    del self.text_of[c]
                    del self.ids_of[c]
                self.young = {}
                known = self.ids_of.keys()
                need = [c for c in set().union(*chunked) if c not in known]
            split = [[] if c[0] == "\0" and c[1:] in self.special else WORD_PATTERN.findall(c) for c in need]
            distinct = list({w for ws in split for w in ws})
            ids_of = dict(zip(distinct, self.words(distinct), strict=True))
            for chunk, ws in zip(need, split, strict=True):
                ids = [i for w in ws for i in ids_of[w]] if ws else [self.special[chunk[1:]]] if chunk[0] == "\0" and chunk[1:] in self.special else []
                if len(self.ids_of) >= KEPT:
                    self.young[chunk] = None
                self.ids_of[chunk] = " ".join(map(str, ids))
                self.text_of[chunk] = self.decode(ids)
        get_ids, get_text = self.ids_of.__getitem__, self.text_of.__getitem__
        return [(list(map(get_ids, c)), list(map(get_text, c))) for c in chunked]


@lru_cache(maxsize=2)
def model(path: str) -> SegmentTreeBPE:
    """One model for each file and worker process."""
    return SegmentTreeBPE(path)


def _groups(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of at most ``most`` characters together, one at least."""
    group, n = [], 0
    for text in texts:
        if group and n + len(text) > most:
            yield group
            group, n = [], 0
        group.append(text)
        n += len(text)
    if group:
        yield group


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the hex digests of the decimal ids joined by one
    space and of the decoded text in UTF-8. ``path`` is a tokenizers file with word ends that every worker has.

    A null text counts as empty: no tokens and the digests of the empty string. Null or repeated keys pass
    through, a row for each row; other columns are not read; an empty table gives an empty result. Very long
    texts are encoded whole; a worker's memory is bounded by its chunk cache and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            n, ids, back = [], [], []
            for group in _groups([x or "" for x in batch.column(1).to_pylist()]):
                for a, b in bpe.pieces(group):
                    joined = " ".join(filter(None, a))
                    n.append(joined.count(" ") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(" ".join(filter(None, b)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
