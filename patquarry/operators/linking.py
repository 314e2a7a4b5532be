"""Identity of the rows of a file that link to each other, exactly as if they were applied one by one.

Applied in order, a row looks for a stored patent by its identifiers; what it finds it updates, else it founds a patent. So a later row sees
the identifiers that earlier ones brought, kept or overwrote. Each row's patent depends on earlier rows only. From any
guess of all rows' patents the times follow at which every patent holds every identifier, and from these a better guess. A
round of that sets right at least the rows that depend on none that is wrong, so the guess that a round does not change is the one that
order gives. Rounds are as many as the longest chain of rows each of which needs the one before, few in practice; identifiers that many
rows share do not lengthen it. The first guess is made of the lowest patent or row that names each identifier at all, followed for a few steps: where
identifiers are seldom overwritten it is right, and one round shows that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from patquarry.functions.text import blank_to_null
from patquarry.operators import upsert
from patquarry.sources import derived

#: A patent or identifier with more entries than this is dealt out by blocks of so many rows of the file.
HOT = 50_000
#: Later than any row.
NEVER = (1 << 62) - 1
#: A first guess follows chains of so many doublings.
JUMPS = 2
_LEVELS = 40


def _cover(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to before ``high`` as the fewest aligned ranges: an array of ``level, node``."""
    state = F.struct(low.alias("a"), high.alias("b"), F.array().cast("array<struct<level:int,node:long>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        one = lambda x: F.array(F.struct(level.cast("int").alias("level"), x.alias("node")))
        none = F.array().cast("array<struct<level:int,node:long>>")
        more = s["a"] < s["b"]
        left, right = more & odd(s["a"]), more & odd(s["b"])
        out = F.concat(s["out"], F.when(left, one(s["a"])).otherwise(none), F.when(right, one(s["b"] - 1)).otherwise(none))
        a, b = F.when(left, s["a"] + 1).otherwise(s["a"]), F.when(right, s["b"] - 1).otherwise(s["b"])
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.alias("out"))

    return F.array_distinct(F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), state, step, lambda s: s["out"]))


def _events(state: DataFrame, n: int, often: DataFrame | None, hot: int) -> DataFrame:
    """``priority, value, time, kind, pid, until, c0, c1``: what each row of ``state`` asks (kind 1), what its patent holds from then on until its
    next change (kind 2), or both of the same value and context (kind 3).

    ``state``: pid, time (-1 for stored patents), mask (bits of the identifiers that others have too) and x0 to x(n + 2): keys, number and context; nulls are
    filled from before. One shuffle by patents serves all identifiers. A patent in ``often``, of more than ``hot`` rows, is dealt out by blocks of time: blocks give
    their last values and first changes, a row a block.
    """
    xs, ways = [f"x{i}" for i in range(n + 3)], range(n + 1)
    if often is None:
        rows, part = state, ["pid"]
    else:
        part = ["pid", "_block"]
        rows = state.join(F.broadcast(often.withColumn("_hot", F.lit(True))), "pid", "left").withColumn("_block", F.when(F.col("_hot"), F.floor(F.col("time") / hot)).otherwise(F.lit(0).cast("long")))
    inside, back = Window.partitionBy(*part).orderBy("time"), Window.partitionBy(*part).orderBy(F.col("time").desc())
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"f{i}": F.last(x, ignorenulls=True).over(so_far) for i, x in enumerate(xs)} | {f"p{i}": F.last(x, ignorenulls=True).over(before) for i, x in enumerate(xs)})
    new = lambda i: F.col(xs[i]).isNotNull() & ~F.col(f"f{i}").eqNullSafe(F.col(f"p{i}"))
    rows = rows.withColumns({f"new{i}": new(i) for i in range(n)} | {f"new{n}": new(n) | new(n + 1) | new(n + 2)}).drop(*[f"p{i}" for i in range(n + 3)])
    rows = rows.withColumns({f"until{i}": F.last(F.when(F.col(f"new{i}"), F.col("time")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)) for i in ways})
    if often is not None:
        ends = rows.where("_hot").groupBy(*part).agg(*[F.min(F.when(F.col(f"new{i}"), F.col("time"))).alias(f"_n{i}") for i in ways], *[F.max(F.when(F.col(x).isNotNull(), F.struct("time", x)))[x].alias(f"_x{i}") for i, x in enumerate(xs)])
        earlier, later = (Window.partitionBy("pid").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_block"), F.col("_block").desc()))
        ends = ends.select(*part, *[F.last(f"_n{i}", ignorenulls=True).over(later).alias(f"_u{i}") for i in ways], *[F.last(f"_x{i}", ignorenulls=True).over(earlier).alias(f"_f{i}") for i in range(n + 3)])
        rows = rows.join(F.broadcast(ends), part, "left")
        rows = rows.withColumns({f"until{i}": F.coalesce(f"until{i}", f"_u{i}") for i in ways} | {f"f{i}": F.coalesce(f"f{i}", f"_f{i}") for i in range(n + 3)})
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def event(i: int, value: Column, kind: Column, c0: Column, c1: Column) -> Column:
        holds = kind != 1
        return F.struct(F.lit(i).alias("priority"), value.alias("value"), kind.cast("int").alias("kind"), F.when(holds, F.col("pid")).otherwise(none).alias("pid"), F.when(holds, F.coalesce(f"until{i}", F.lit(NEVER))).otherwise(none).alias("until"), c0.alias("c0"), c1.alias("c1"))

    given = lambda i: F.col(xs[i]).isNotNull() & (F.col("mask").bitwiseAND(F.lit(1 << i)) != 0)
    incoming = F.col("time") >= 0
    out = [event(i, F.col(xs[i]), F.when(given(i), F.when(~incoming, 2).when(F.col(f"new{i}"), 3).otherwise(1)), text, text) for i in range(n)]
    asks, begins = incoming & given(n), F.col(f"new{n}") & F.col(f"f{n}").isNotNull() & (F.col(xs[n]).isNull() | given(n))
    own, filled = [F.col(x) for x in xs[n + 1 :]], [F.col(f"f{n + 1}"), F.col(f"f{n + 2}")]
    alike = own[0].eqNullSafe(filled[0]) & own[1].eqNullSafe(filled[1])
    out.append(event(n, F.col(f"f{n}"), F.when(asks & begins & alike, 3).when(asks, 1).when(begins, 2), *[F.when(asks, x).otherwise(y) for x, y in zip(own, filled, strict=True)]))
    out.append(event(n, F.col(f"f{n}"), F.when(asks & begins & ~alike, 2), *filled))
    return rows.select("time", F.inline(F.array(*out))).where("kind is not null")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each question in a group, ordered by time, the patent of the lowest number that holds the identifier then.

    Of a number with a context, patents of an equal context come first; one that is null on either side fits.
    """
    key, heaps = None, {}
    for batch in batches:
        names = ["priority", "value", "block", "time", "kind", "pid", "until", "c0", "c1"]
        out: list[tuple[int, int, int]] = []
        for p, v, block, time, kind, pid, until, a, b in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (p, v, block) != key:
                key, heaps = (p, v, block), {}
            if kind in (0, 2):
                heappush(heaps.setdefault((a, b), []), (pid, until))
                continue
            best = None
            for (x, y), heap in heaps.items():
                if (a is None or x is None or x == a) and (b is None or y is None or y == b):
                    while heap and heap[0][1] < time:
                        heappop(heap)
                    if heap:
                        rank = (a is None or x != a, b is None or y != b, heap[0][0])
                        best = rank if best is None else min(best, rank)
            if best is not None:
                out.append((time, p, best[2]))
            if kind == 3:  # from now on
                heappush(heaps.setdefault((a, b), []), (pid, until))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["row", "priority", "pid"])


def _answers(events: DataFrame, often: DataFrame | None, last: int, hot: int) -> DataFrame:
    """``row, priority, pid`` for the questions among ``events`` that find a patent; ``last`` is the time of the last row.

    Entries of one value meet in a task, those of the values in ``often``, which more than ``hot`` rows ask for, by blocks of time. A patent
    that holds such a value over whole blocks is counted for the aligned ranges of blocks that it covers, where the lowest is kept; the others come to
    the blocks where they begin and end.
    """
    value = ["priority", "value"]
    first = F.lit(0).cast("long")
    columns = [*value, "block", "time", "kind", "pid", "until", "c0", "c1"]
    if often is None:
        events = events.withColumn("block", first).select(*columns)
    else:
        block = F.floor(F.col("time") / hot) + 1  # stored rows are in block 0
        events = events.join(F.broadcast(often.withColumn("_hot", F.lit(True))), value, "left").withColumn("block", F.when(F.col("_hot"), block).otherwise(first))
        split = events.where("_hot and kind != 1").withColumn("_to", F.when(F.col("until") == NEVER, F.lit(last // hot + 2)).otherwise(F.floor(F.col("until") / hot) + 1))
        start = F.lit(-2).cast("long").alias("time")
        ends = split.where((F.col("_to") > F.col("block")) & (F.col("until") != NEVER)).select(*value, F.col("_to").alias("block"), start, F.lit(0).alias("kind"), "pid", "until", "c0", "c1")
        over = split.where(F.col("_to") > F.col("block") + 1).select(*value, "c0", "c1", "pid", F.inline(_cover(F.col("block") + 1, F.col("_to"))))
        lowest = over.groupBy(*value, "c0", "c1", "level", "node").agg(F.min("pid").alias("pid"))
        above = events.where("_hot and kind in (1, 3)").select(*value, "block").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("level")).withColumn("node", F.expr("shiftright(block, level)"))
        whole = above.join(lowest, [*value, "level", "node"]).groupBy(*value, "block", "c0", "c1").agg(F.min("pid").alias("pid"))
        whole = whole.select(*value, "block", start, F.lit(0).alias("kind"), "pid", F.lit(NEVER).alias("until"), "c0", "c1")
        events = events.select(*columns).unionByName(ends).unionByName(whole)
    return events.repartition(*value, "block").sortWithinPartitions(*value, "block", "time", "kind", "pid").mapInArrow(_sweep, "row long, priority long, pid long")


def _jumped(guess: DataFrame, base: int, paths: list[str]) -> DataFrame:
    """``time, pid, mask`` where a row that was guessed to follow another one has that one's guess, so that short chains are guessed to their ends.

    Any guess will do, so a chain of more rows than ``2 ** JUMPS`` is left to the rounds."""
    own = F.col("pid") == F.col("time") + base
    for k in range(JUMPS):
        ahead = guess.where(~own).select(F.col("time").alias("_at"), F.col("pid").alias("_pid"))
        left = guess.where(~own).join(ahead, F.col("pid") - base == F.col("_at"), "left")
        left = left.select("time", F.coalesce("_pid", "pid").alias("pid"), "mask", F.col("_pid").isNotNull().alias("moved"))
        guess, path = derived.stored(guess.where(own).select("time", "pid", "mask", F.lit(False).alias("moved")).unionByName(left), f"jumped-{k}")
        paths.append(path)
        more = guess.where("moved").limit(1).count()
        guess = guess.drop("moved")
        if not more:
            break
    return guess


def resolve(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], number: str, context: Sequence[str], row: str = "row_no", hot: int = HOT) -> tuple[DataFrame, int]:
    """``row, patent_id, found`` for each row of a file, and the rounds it took.

    ``row`` numbers the rows in order, from 0 or more, each once. A row's patent is the lowest of those that hold the first of ``keys`` that
    any holds when the row comes; else one that holds its application ``number`` with the same ``context`` (two columns; null fits all, equal
    ones first); else a new one, whose id is that of the row above the largest stored one. ``found``: whether it was there before the row.

    Blank identifiers name nothing. A table without rows gives none. Rows that share no identifier with anything are new at once; the
    others' decisions are stored each round, and only identifiers are shuffled.
    """
    if len(context) != 2:
        raise ValueError("a context has two columns")
    spark, columns = incoming.sparkSession, [*keys, number, *context]
    tidy = lambda df, *more: df.select(*more, *[blank_to_null(F.col(c).cast("string")).alias(f"x{i}") for i, c in enumerate(columns)])
    xs, n = [f"x{i}" for i in range(len(columns))], len(keys)
    base = (stored.agg(F.max("patent_id")).first()[0] or 0) + 1
    time = F.col(row).cast("long")
    rows, there = tidy(incoming, time.alias("time"), (time + base).alias("pid")), tidy(stored, F.lit(-1).cast("long").alias("time"), F.col("patent_id").cast("long").alias("pid"))
    # a row or patent an identifier, the application number with its context
    ways = F.array(*[F.struct(F.lit(i).alias("priority"), F.col(x).alias("value"), *[(F.col(xs[n + 1 + k]) if i == n else F.lit(None).cast("string")).alias(f"c{k}") for k in (0, 1)]) for i, x in enumerate(xs[: n + 1])])
    named = rows.unionByName(there).select("time", "pid", F.inline(ways)).where("value is not null")
    first = F.min(F.struct("pid", "c0", "c1"))
    values = named.groupBy("priority", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("time") >= 0).alias("asked"), first.alias("first"))
    shared = values.where("n > 1 and asked > 0")
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = derived.stored(df, name)
        paths.append(path)
        return df

    often = kept(values.where(F.col("asked") > hot).select("priority", "value"), "frequent-values")
    often = None if often.isEmpty() else often
    # rows that share no identifier are decided; a first guess for the others is the lowest patent that names the identifier at all
    fits = [F.col(c).isNull() | F.col(f"first.{c}").isNull() | (F.col(c) == F.col(f"first.{c}")) for c in ("c0", "c1")]
    seen = F.when((F.col("first.pid") < F.col("pid")) & fits[0] & fits[1], F.struct("priority", "first.pid"))
    linked = named.join(shared, ["priority", "value"]).groupBy("time", "pid").agg(F.min(seen)["pid"].alias("found"), F.bit_or(F.expr("shiftleft(1, priority)")).alias("mask"))
    linked = kept(linked, "linked")
    held_there = kept(there.join(linked.where("time < 0").select("pid", "mask"), "pid"), "linked-patents")
    guess = _jumped(linked.where("time >= 0").select("time", F.coalesce("found", "pid").alias("pid"), "mask"), base, paths)
    rows = kept(rows.drop("pid").join(guess, "time"), "linked-rows")
    last = rows.agg(F.max("time")).first()[0] or 0
    guess, state, path, rounds = rows.select("time", "pid"), rows, None, 0
    while True:
        many, many_path = derived.stored(guess.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("pid"), "frequent-patents")
        events = _events(state.unionByName(held_there), n, None if many.isEmpty() else many, hot)
        best = _answers(events, often, last, hot).groupBy("row").agg(F.min(F.struct("priority", "pid"))["pid"].alias("found"))
        now = guess.withColumnRenamed("pid", "before").join(best, F.col("time") == F.col("row"), "left")
        now, new_path = derived.stored(now.select("time", F.coalesce("found", F.col("time") + base).alias("pid"), "before"), f"links-{rounds}")
        rounds += 1
        changed = now.where("pid != before").limit(1).count()
        for p in (path, many_path):
            if p:
                derived.delete(spark, p)
        guess, path = now.select("time", "pid"), new_path
        if not changed:
            break
        state = rows.drop("pid").join(guess, "time")
    for p in paths:
        derived.delete(spark, p)
    guess = guess.withColumnRenamed("time", "row")
    all_ = incoming.select(F.col(row).cast("long").alias("row")).join(guess, "row", "left")
    pid = F.coalesce("pid", F.col("row") + base)
    return all_.select(F.col("row").alias(row), pid.alias("patent_id"), (pid != F.col("row") + base).alias("found")), rounds


def apply_file(stored: DataFrame, incoming: DataFrame, found: DataFrame, columns: Sequence[str], row: str = "row_no") -> DataFrame:
    """The patents after a file: ``patent_id``, ``columns`` and ``state`` (``new``, ``updated`` or ``same``); ``found`` is what ``resolve`` gives.

    Of each column the last filled value in the order of rows replaces the stored one; a patent whose values end as they were is ``same``.
    """
    folded = upsert.fold(incoming.join(found.select(row, "patent_id"), row), "patent_id", columns, row)
    old = upsert.differential(stored.select("patent_id", *columns), folded, "patent_id", columns)
    new = folded.join(found.where("not found").select("patent_id"), "patent_id", "left_semi")
    return old.select("patent_id", *columns, F.when(F.col("updated"), "updated").otherwise("same").alias("state")).unionByName(new.select("patent_id", *columns, F.lit("new").alias("state")))
