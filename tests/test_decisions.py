"""Decisions by events, folded in order by one process, by many tasks, and by a stream."""

import random

import pytest

from patquarry.operators.decisions import Exclusions, Suggestions, fold
from patquarry.streaming import decided, incremental


def one_by_one(events, machine):
    """Events sorted by order and action, applied to a plain state a key."""
    out = {}
    rank = lambda e: [(v is not None, v if v is not None else 0) for v in e[1:]]
    for key, _, action, *values in sorted(events, key=rank):
        condition, registers = out.get(key, (machine.conditions[0], (None,) * len(machine.registers)))
        out[key] = machine.step(condition, registers, action, dict(zip(machine.fields, values, strict=True)))
    return {k: (c[0], *r) for k, (c, r) in out.items()}


def made(machine, n, keys, seed=1):
    r = random.Random(seed)
    actions = ("flag", "exclude", "confirm", "keep", "restore", "assign", "odd", None) if machine is Exclusions else ("suggest", "confirm", "reject", "undo", None)
    return [(r.choice(keys), i // 2, r.choice(actions), *[r.choice((None, f"{f} {i}", f"{f} {i}")) for f in machine.fields]) for i in range(n)]


def schema(machine):
    return "k long, at long, action string, " + ", ".join(f"{f} string" for f in machine.fields)


def test_exclusions_keep_and_give_back_topics():
    steps = [("assign", "T1", "pending? no"), ("flag", None, "pending"), ("confirm", None, "excluded"), ("confirm", None, "excluded"), ("restore", None, "none")]
    state = (Exclusions.conditions[0], (None,) * 5)
    seen = []
    for action, topic, _ in steps:
        state = Exclusions.step(*state, action, {"reason": "r", "verdict": "v", "topic": topic})
        seen.append((state[0][0], state[1]))
    assert seen == [("none", (None, None, None, "T1", None)), ("pending", ("r", "v", "ai", "T1", None)), ("excluded", ("r", "v", "ai", None, "T1")), ("excluded", ("r", "v", "ai", None, "T1")), ("none", (None, None, None, "T1", None))]
    for c in Exclusions.conditions:
        for a in ("flag", "exclude", "confirm", "keep", "restore", "assign"):
            after, registers = Exclusions.step(c, ("r", "v", "s", "T" if c[1] else None, "K" if c[2] else None), a, {"reason": None, "verdict": None, "topic": "N"})
            assert after in Exclusions.conditions and after[1] == (registers[3] is not None) and after[2] == (registers[4] is not None)


@pytest.mark.parametrize("machine", [Exclusions, Suggestions])
def test_many_tasks_give_what_one_process_does(spark, machine):
    """A key has half of all events, so its stretches lie in several tasks and are joined; null keys, odd actions and ties occur."""
    events = made(machine, 3000, [7] * 60 + list(range(40)) + [None] * 5)
    df = spark.createDataFrame(events, schema(machine)).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: tuple(r)[1:] for r in fold(df, "k", "at", machine).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == one_by_one(events, machine) and len({s for s, *_ in got.values()}) > 2
    assert fold(df.where("false"), "k", "at", machine).count() == 0


def test_a_stream_gives_what_the_batch_does(spark, tmp_path):
    machine, arrived, out = Exclusions, str(tmp_path / "events"), {}
    events = made(machine, 400, list(range(12)), 5)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch, _):
        out.update({r.k: tuple(r)[1:] for r in batch.collect()})

    try:
        for a, b in ((0, 150), (150, 152), (152, 400)):
            spark.createDataFrame(events[a:b], schema(machine)).coalesce(1).write.mode("append").parquet(arrived)
            stream = incremental.stream_table(spark, arrived, spark.createDataFrame([], schema(machine)))
            query = decided.decide(stream, "k", "at", machine).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
            assert out == one_by_one(events[:b], machine)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.k: tuple(r)[1:] for r in fold(spark.createDataFrame(events, schema(machine)), "k", "at", machine).collect()} == out
