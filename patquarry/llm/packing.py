"""Best-fit packing of token pieces into sequences of one capacity.

The configuration linear program has a variable for each way to fill a sequence and a constraint for each piece
length: cover as many pieces as the length histogram counts, with as few fillings as can be. Multiplicative weights
solve it. In each round a knapsack dynamic program prices the lengths' weights. It gives the best filling of all, by which the
prices become a solution of the dual program and so a lower bound, and the best one with each length in it; those of
nearly the best value are used until they have covered a small share of their lengths, whose weights then fall. The cover,
scaled so that no length lacks, is an upper bound, and rounds end when the two are close.

Fillings are rounded to whole numbers, the pieces left make a program of their own, and so on (after Karmarkar and Karp,
1982). Best-fit decreasing places the few that no rounding takes, in the sequences' remaining room where they fit. All
of that works on the histogram, whose size is the capacity whatever the data's. Pieces find their places from their rank
among the pieces of the same length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.llm import scratch
from patquarry.llm.tokens import encoder

#: Rounds of the first program and of those of pieces left, at most; the share of a length that a round may cover; how fast a
#: weight falls as its length is covered; how far below the best value a filling may be, at first in the first program and at the least, and how fast
#: that falls; the gap at which rounds end; the share of pieces that another program must place; how much dearer a token of the longest piece is at first than one of the shortest.
ROUNDS, AGAIN, STEP, RATE, LOOSE, SLACK, FALL, GAP, WORTH, TILT = 400, 80, 0.1, 1.0, 0.02, 0.0005, 0.99, 0.01, 0.02, 0.1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"

Filling = tuple[tuple[int, int], ...]  # pairs of a length and how many, long ones first
Plan = list[tuple[Filling, int]]


@dataclass
class Cover:
    """A fractional cover of a histogram, its value, and a lower bound of any cover's value from the dual program."""

    fillings: dict[Filling, float]
    value: float
    bound: float


@dataclass
class Packing:
    """Fillings and how many sequences use each; how many pieces the programs placed, of how many; the first program's bounds."""

    plan: Plan
    placed: int
    pieces: int
    value: float
    bound: float


def price(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest weight that fits each room, and a length that a filling of it has, 0 where a smaller room has as much.

    ``weights[l]`` is -inf for no such piece."""
    capacity = len(weights) - 1
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = weights[1 : room + 1] + best[room - 1 :: -1]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], took[room] = value[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, took


def good_fillings(weights: np.ndarray, best: np.ndarray, took: np.ndarray, slack: float) -> list[Filling]:
    """For each length the filling of most weight that has it, of those that come close to the best."""
    capacity = len(weights) - 1
    lengths = np.nonzero(np.isfinite(weights))[0]
    lengths = lengths[weights[lengths] + best[capacity - lengths] >= (1 - slack) * best[capacity]]
    start = np.maximum.accumulate(np.where(took > 0, np.arange(capacity + 1), 0))  # where to look for the next piece
    which, room = np.arange(len(lengths)), start[capacity - lengths]
    rows, items = [which], [lengths]
    while len(which):
        live = took[room] > 0
        which, room = which[live], room[live]
        rows.append(which)
        items.append(took[room])
        room = start[room - took[room]]
    keys, n = np.unique(np.concatenate(rows) * (capacity + 1) + capacity - np.concatenate(items), return_counts=True)
    ends = np.searchsorted(keys, np.arange(1, len(lengths) + 1) * (capacity + 1)).tolist()
    pairs = list(zip((capacity - keys % (capacity + 1)).tolist(), n.tolist(), strict=True))
    return [tuple(pairs[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def cover(histogram: np.ndarray, rounds: int = ROUNDS, gap: float = GAP, seed: int = 1, loose: float = LOOSE) -> Cover:
    """Solve the program by multiplicative weights to the gap, or as far as the rounds lead."""
    capacity = len(histogram) - 1
    lengths = np.nonzero(histogram)[0]
    have, r = histogram.astype(float), np.random.default_rng(seed)
    # prices start from about the lengths, which are a dual solution; a tilt makes fillings of few long pieces the better ones,
    # so that short pieces last, and a little noise tells equal ones apart
    first = lengths / capacity * (1 + TILT * lengths / capacity + 1e-3 * r.random(len(lengths)))
    alone = have[lengths] / (capacity // lengths)  # sequences of one length each
    covered, used, total = np.zeros(len(lengths)), {}, 0.0
    value, scale, bound = float("inf"), 1.0, float((histogram * np.arange(capacity + 1)).sum() / capacity)
    for turn in range(1, rounds + 1):
        weights = np.full(capacity + 1, -np.inf)
        weights[lengths] = first * np.exp(-RATE * covered)
        best, took = price(weights)
        bound = max(bound, float(have[lengths] @ weights[lengths] / best[capacity]))
        found, room = good_fillings(weights, best, took, max(SLACK, loose * FALL**turn)), (STEP * have).tolist()
        for i in r.permutation(len(found)).tolist():
            n = min(room[k] / c for k, c in found[i])
            if n > 1e-9:
                used[found[i]] = used.get(found[i], 0.0) + n
                total += n
                for k, c in found[i]:
                    room[k] -= n * c
        covered += STEP - np.array(room)[lengths] / have[lengths]
        if turn % 10 and turn < rounds:
            continue
        for q in np.quantile(covered, (0, 0.02, 0.1, 0.25, 0.5)):  # what a scale leaves uncovered is added alone
            if q > 0 and (v := total / q + float(np.maximum(0, 1 - covered / q) @ alone)) < value:
                value, scale, kept = v, q, dict(used)
        if value <= bound * (1 + gap):
            break
    return Cover({f: n / scale for f, n in kept.items()} if value < float("inf") else {}, value, bound)


def best_fit(left: np.ndarray, begun: Plan = ()) -> Plan:
    """Best-fit decreasing on counts, with sequences that are begun; those that are filled alike go together."""
    capacity = len(left) - 1
    open_: dict[int, list[list]] = {}  # by room: fillings and how many sequences have them
    rooms: list[int] = []

    def put(filling: dict[int, int], room: int, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append([filling, n])

    for filling, n in begun:
        put(dict(filling), capacity - sum(k * c for k, c in filling), n)
    for k in range(capacity, 0, -1):
        n = int(left[k])
        while n:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                per = capacity // k
                put({k: per}, capacity - per * k, n // per)
                if n % per:
                    put({k: n % per}, capacity - n % per * k, 1)
                break
            room = rooms[i]
            filling, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            per = room // k  # the fullest sequence that fits stays so while it takes more of these
            whole = min(count, n // per)
            add = lambda m, f=filling, k=k: f | {k: f.get(k, 0) + m}
            put(add(per), room - per * k, whole)
            n -= whole * per
            if whole < count and n:
                put(add(n), room - n * k, 1)
                put(filling, room, count - whole - 1)
                n = 0
            else:
                put(filling, room, count - whole)
    return [(tuple(sorted(f.items(), reverse=True)), n) for groups in open_.values() for f, n in groups]


def plan(histogram: np.ndarray) -> Packing:
    """Fillings for all pieces of the histogram: together they hold each once."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).tolist()
    left[0] = 0
    pieces = sum(left)
    chosen: Counter[Filling] = Counter()
    bounds: list[tuple[float, float]] = []
    while (before := sum(left)) > 0:
        solved = cover(np.array(left), AGAIN if bounds else ROUNDS, seed=1 + len(bounds), loose=0.0 if bounds else LOOSE)
        bounds.append((solved.value, solved.bound))
        room = {f: capacity - sum(k * c for k, c in f) for f in solved.fillings}
        down = sorted(solved.fillings.items(), key=lambda e: (-e[1], e[0]))
        up = sorted(solved.fillings.items(), key=lambda e: (room[e[0]], -e[0][0][0], -(e[1] % 1), e[0]))
        rounded = [(f, int(x + 1e-9)) for f, x in down] + [(f, 1) for f, _ in up]
        for most_room in (0, capacity):  # fillings that leave room only where full ones no longer help
            for f, most in rounded:
                n = min(most, *(left[k] // c for k, c in f)) if room[f] <= most_room else 0
                if n > 0:
                    chosen[f] += n
                    for k, c in f:
                        left[k] -= n * c
            if before - sum(left) >= WORTH * before:
                break
        else:
            break
    value, bound = bounds[0] if bounds else (0.0, 0.0)
    return Packing(best_fit(np.array(left), list(chosen.items())), pieces - sum(left), pieces, value, bound)


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, chosen: Plan, capacity: int) -> None:
        first = 0
        rows: list[tuple[int, int, int, int, int]] = []
        seen = np.zeros(capacity + 1, np.int64)
        for filling, n in chosen:
            offset = 0
            for k, c in filling:
                rows.append((k, int(seen[k]), c, first, offset))
                seen[k] += c * n
                offset += c * k
            first += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.sequences = first
        self.key, self.table = (table[:, 0] << 44) + table[:, 1], table

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.key, (length << 44) + rank, side="right") - 1]
        j = rank - row[:, 1]
        return row[:, 3] + j // row[:, 2], row[:, 4] + j % row[:, 2] * length


def cut(df: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every whole text's ids with ``end_id`` after them, as a table in the shared folder.

    ``part`` and ``nth`` number the pieces of one length within a task, from 0.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path, 4).encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(x.as_py() or "") + end
                n = len(raw) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                start = 0
                for piece, stop in enumerate(ends):
                    k = stop - start
                    out.append((doc_id, piece, start, k, zlib.crc32(raw[4 * start : 4 * stop]), part, seen[k]))
                    seen[k] += 1
                    start = stop
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(c)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
    return scratch.table(rows, "pieces")


def pack(df: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all texts into as few sequences of at most ``capacity`` tokens as the method can.

    Returns a row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Only texts of
    more tokens are cut, into pieces of ``capacity`` tokens; the first piece takes the remainder.

    A null text counts as empty and has the end id alone. Null or repeated keys pass through, each row with pieces
    of its own; other columns are not read; an empty table gives an empty result. The driver gets the histogram,
    ``capacity`` rows at most; ranks come from counts for each task and length, so pieces of one length that are a
    third of all stay where they are.
    """
    scratch.bounded(df.sparkSession)
    pieces = cut(df, path, end_id, capacity, key, text)
    spark = df.sparkSession
    counts = scratch.table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[length] = n
    places = spark.sparkContext.broadcast(Places(plan(histogram).plan, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # counts grow with the tasks, so they are merged by key and never broadcast
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.value(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
