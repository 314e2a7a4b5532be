"""Periodic runs of words, found by counting matches at every lag with one way for frequent words and another for rare ones.

A run is a stretch of words with smallest period q, of at least ``max(6, 4 * q)`` words, that no neighboring word extends. It
makes ``length - q`` matches at lag q (equal words q apart), so a lag with fewer matches than ``need`` has no run. The matches at
each lag are counted exactly without looking at a lag alone: a word that stands more than sqrt(n) times by the autocorrelation of
its places (FFT, rounded to whole numbers), all others by differences of their places. Both take
about n ** 1.5 steps at most. Only lags with enough matches that no run of a smaller period explains are scanned for islands.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Numbers that one call of the FFT holds at most, unless one word alone needs more.
CELLS = 1 << 20


def need(lag: int) -> int:
    """Matches at ``lag`` that a run of that period has at least."""
    return max(6, 4 * lag) - lag


def lag_matches(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to ``most``, the number of places i with ``codes[i] == codes[i + lag]`` (lag 0 is left at 0)."""
    n = len(codes)
    found = np.zeros(most + 1, np.int64)
    often = np.bincount(codes)
    heavy = np.flatnonzero(often * often > n)
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        rows, power = max(1, CELLS // size), 0
        for at in range(0, len(heavy), rows):
            spectrum = np.fft.rfft(codes[None, :] == heavy[at : at + rows, None], size, axis=1)
            power = power + (spectrum.real**2 + spectrum.imag**2).sum(0)
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    light = order[(often * often <= n)[codes[order]]]
    word = codes[light]
    last = np.searchsorted(word, word, "right")  # past the word's last place
    i, k = np.arange(len(light)), 1
    i = i[i + k < last]
    while len(i):
        lag = light[i + k] - light[i]
        near = lag <= most
        found += np.bincount(lag[near], minlength=most + 1)
        i, k = i[near], k + 1
        i = i[i + k < last[i]]
    found[0] = 0
    return found


def _stretches(true: np.ndarray) -> np.ndarray:
    """Start and end of each stretch of true values, as rows."""
    return np.flatnonzero(np.diff(np.concatenate(([0], true, [0])).astype(np.int8))).reshape(-1, 2)


def islands(codes: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Start and number of matches of each longest stretch of matches at ``lag`` that has ``need(lag)`` of them.

    Such a stretch holds three neighboring multiples of the lag, so places between are compared only around three that match.
    """
    end = len(codes) - lag
    at = np.arange(0, end, lag)
    for a, b in _stretches(codes[at] == codes[at + lag]).tolist():
        if b - a >= 3:
            low, high = max(0, (a - 1) * lag + 1), min(end, b * lag)
            for s, t in _stretches(codes[low:high] == codes[low + lag : high + lag]).tolist():
                if t - s >= need(lag):
                    yield low + s, t - s


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of small whole numbers as ``(start, length, period)``, by start, then period.

    A run of period d matches itself at every multiple of d too. These matches are taken off, and what is left is at least
    ``need`` where a run begins whose smallest period is the lag: two runs of periods d and q, d a divisor of q, share fewer than q
    words, so they share no match at lag q. A stretch found again at a multiple of its period is thus known by its place.
    """
    n = len(codes)
    most = n // 4
    if n < 6:
        return []
    left = lag_matches(codes, most)
    lags = np.arange(most + 1)
    least = np.maximum(6, 4 * lags) - lags
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(left >= least).tolist():
        if lag and left[lag] >= least[lag]:
            for start, matches in islands(codes, lag):
                length = matches + lag
                if (start, length) not in found:
                    found[start, length] = lag
                    again = np.arange(2 * lag, min(most, length - 1) + 1, lag)
                    left[again] -= length - again
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated(n: int, key: int | None) -> np.ndarray | None:
    """Places of the words that stand in a text of ``n`` words after every tenth id's end is made periodic; None for no change."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _codes(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()  # bytes split at space and \x09 to \x0d only
            codes, places = _codes(words), repeated(len(words), key)
            if places is not None:
                words, codes = [words[i] for i in places.tolist()], codes[places]
            found = runs(codes)
            longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            out.append(
                (key, len(words), len(found), *longest, None if not found else 1000 * longest[1] // longest[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
            )
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The periodic runs of every text's words, with the end of every tenth id's text made periodic first (``repeated``).

    Returns ``doc_id, n_words, n_runs``, the ``start, length, period, exponent_milli`` of the longest run (ties: the smallest start;
    nulls without runs), ``runs_sha256`` of all runs and ``collapsed_sha256`` of the words that ``collapsed`` leaves.

    A null text has no words, and the digests are those of nothing; a row without an id keeps its words as they are; rows that repeat
    an id are scanned each; other columns are not read. An empty table gives an empty result. No row meets another: nothing
    is shuffled, and a task holds one batch and one text's counts.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)


#: The same rows from SQL: pairs of equal words a lag apart, islands of neighboring pairs, the smallest lag of each stretch.
ORACLE = r"""
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from (select unnest(range(256)) as i)
  )
), docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as h
  from documents, crc
), sized as (
  select r, doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as made, (h // 10) % greatest(len(words), 1) as a, h // 10 as g from docs
), changed as (
  select r, doc_id, n, case when made then list_transform(range(n), lambda i: words[1 + (case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end)]) else words end as words from sized
), placed as (
  select r, n, unnest(words) as w, unnest(range(n)) as i from changed
), pairs as (
  select x.r, x.i, y.i - x.i as q from placed x join placed y on x.r = y.r and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n
), islands as (
  select r, q, min(i) as s, count(*) + q as length from (select r, q, i, i - row_number() over (partition by r, q order by i) as k from pairs) group by r, q, k having count(*) + q >= greatest(6, 4 * q)
), found as (
  select r, s, length, min(q) as q from islands group by all
), listed as (
  select r, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as listed, first(s order by length desc, s, q) as start, max(length) as length, first(q order by length desc, s, q) as period from found group by r
), dropped as (
  select distinct r, unnest(range(s + q, s + length)) as i from found
), rest as (
  select p.r, string_agg(p.w, ' ' order by p.i) as left_over from placed p anti join dropped d on p.r = d.r and p.i = d.i group by p.r
)
select c.doc_id, c.n as n_words, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(left_over, '')) as collapsed_sha256
from changed c left join listed using (r) left join rest using (r)
"""
