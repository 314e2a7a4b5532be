"""States that events decide, each key's in order: exclusions of patents and decisions on suggested members, from batches and streams alike.

A machine is a small set of conditions and a few registers whose values only move. So what a stretch of events does is known without the state
before it: for each condition it may begin in, the one it ends in, and for each register a value or the register it comes from. Stretches are
made where rows lie, in ranges of (key, order), and a key's stretches, one a task at most, are then joined in order: a key with a third of all
events is folded by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A condition, and the registers' values.
State = tuple[int, tuple]


class Exclusions:
    """Patents that are flagged, excluded and put back.

    ``flag`` makes a patent without a state ``pending``, and renews the reason and verdict of one that is; ``exclude`` excludes it by hand, whatever its
    state; ``confirm`` excludes a pending one, whose source stays; ``keep`` ends a pending state; ``restore`` ends an exclusion; ``assign`` gives a
    topic. An exclusion takes the topic away and keeps it (nothing, if there is none any more); restoring puts it back unless there is a new one.
    Other actions, and those that do not fit the state, change nothing."""

    registers = ("reason", "verdict", "source", "topic", "kept")
    fields = ("reason", "verdict", "topic")
    #: (status, whether there is a topic, whether one is kept)
    conditions = tuple((s, bool(t), bool(k)) for s in ("none", "pending", "excluded") for t in (0, 1) for k in (0, 1) if s == "excluded" or not k)

    @staticmethod
    def step(condition: tuple, registers: tuple, action: str | None, event: dict) -> tuple[tuple, tuple]:
        status, has, has_kept = condition
        reason, verdict, source, topic, kept = registers
        if action == "assign" and event["topic"] is not None:
            return (status, True, has_kept), (reason, verdict, source, event["topic"], kept)
        if action == "flag" and status != "excluded":
            return ("pending", has, False), (event["reason"], event["verdict"], "ai", topic, None)
        if action == "exclude":
            return ("excluded", False, has), (event["reason"], verdict, "manual", None, topic if has else None)
        if action == "confirm" and status == "pending":
            return ("excluded", False, has), (reason, verdict, source, None, topic if has else None)
        if action == "keep" and status == "pending":
            return ("none", has, False), (None, None, None, topic, None)
        if action == "restore" and status == "excluded":
            return ("none", has or has_kept, False), (None, None, None, topic if has else kept, None)
        return condition, registers


class Suggestions:
    """Members of company groups that are suggested and decided on.

    ``suggest`` makes a new member; ``confirm`` and ``reject`` decide on a suggested one by hand; ``undo`` takes the confirmation of a member with
    evidence back to a suggestion. Others change nothing."""

    registers = ("source", "evidence")
    fields = ("evidence",)
    #: (status, whether there is evidence)
    conditions = (("none", False), *((s, e) for s in ("suggested", "confirmed", "rejected") for e in (False, True)))

    @staticmethod
    def step(condition: tuple, registers: tuple, action: str | None, event: dict) -> tuple[tuple, tuple]:
        status, has = condition
        source, evidence = registers
        if action == "suggest" and status == "none":
            return ("suggested", event["evidence"] is not None), ("cli_ai", event["evidence"])
        if action in ("confirm", "reject") and status == "suggested":
            return ("confirmed" if action == "confirm" else "rejected", has), ("manual", evidence)
        if action == "undo" and status == "confirmed" and has:
            return ("suggested", has), ("cli_ai", evidence)
        return condition, registers


class _Register(int):
    """In place of a value: what the register of this number held before the stretch."""


def _events(batch: pa.RecordBatch, fields: tuple) -> Iterator[tuple[object, str, dict]]:
    columns = [batch.column(c).to_pylist() for c in fields]
    for key, action, *values in zip(batch.column(0).to_pylist(), batch.column("action").to_pylist(), *columns, strict=True):
        yield key, action, dict(zip(fields, values, strict=True))


def _stretches(batches: Iterator[pa.RecordBatch], machine: type) -> Iterator[pa.RecordBatch]:
    """For each key of a task its number there and what its events do, as JSON: from every condition for the first, whose events may go on from another
    task's; from the first condition for the others."""
    from pyspark import TaskContext

    part, names = TaskContext.get().partitionId(), None
    unknown = tuple(_Register(i) for i in range(len(machine.registers)))
    key, held, first, out = None, {}, True, []

    def done() -> None:
        out.append((key, json.dumps([[c, machine.conditions.index(e), [[int(v)] if isinstance(v, _Register) else v for v in r]] for c, (e, r) in held.items()])))

    for batch in batches:
        names = [batch.schema.names[0], "part", "stretch"]
        for k, action, event in _events(batch, machine.fields):
            if not held or k != key:
                if held:
                    done()
                    first = False
                key = k
                held = {c: (machine.conditions[c], unknown) for c in (range(len(machine.conditions)) if first else (0,))}
            held = {c: machine.step(*state, action, event) for c, state in held.items()}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.types[0]), pa.array([part] * len(out), pa.int32()), pa.array([s for _, s in out])], names=names)
            out = []
        kind = batch.schema.types[0]
    if held:
        done()
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([part], pa.int32()), pa.array([out[0][1]])], names=names)


def _joined(stretches: list[str], machine: type) -> tuple[tuple, tuple]:
    """The state after stretches in order."""
    condition, registers = 0, (None,) * len(machine.registers)
    for s in stretches:
        after = {c: (e, r) for c, e, r in json.loads(s)}
        condition, values = after[condition]
        registers = tuple(registers[v[0]] if isinstance(v, list) else v for v in values)
    return machine.conditions[condition], registers


def _finish(batches: Iterator[pa.RecordBatch], machine: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_joined(x, machine) for x in batch.column(1).to_pylist()]
        values = [pa.array([r[i] for _, r in rows], pa.string()) for i in range(len(machine.registers))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c, _ in rows], pa.string()), *values], names=[batch.schema.names[0], "status", *machine.registers])


def fold(events: DataFrame, key: str, order: str, machine: type) -> DataFrame:
    """``key, status`` and the machine's registers after all events: one row a key.

    ``events`` has ``key``, ``order``, ``action`` and the machine's ``fields``, as strings. Events of one place in the order follow by action, then by their
    other columns; a null key is a key of its own; a null action changes nothing."""
    rows = events.select(key, order, "action", *machine.fields)
    by = [key, order, "action", *machine.fields]
    kind = rows.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1)
    stretches = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(partial(_stretches, machine=machine), f"{kind}, part int, stretch string")
    lists = stretches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "stretch"))), lambda x: x["stretch"]).alias("s"))
    return lists.mapInArrow(partial(_finish, machine=machine), f"{kind}, status string, " + ", ".join(f"{r} string" for r in machine.registers))


def group_status(members: DataFrame, group: str = "group_id") -> DataFrame:
    """``group, review_status, source``: of decided members (``fold`` with ``Suggestions``, and their group) what their group is: confirmed if one is, else
    suggested if one is, else rejected; by hand once none is suggested. Members without a state do not count."""
    some = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    rows = members.where("status != 'none'").groupBy(group)
    status = F.when(some("confirmed"), "confirmed").when(some("suggested"), "suggested").otherwise("rejected")
    return rows.agg(status.alias("review_status"), F.when(some("suggested"), "cli_ai").otherwise("manual").alias("source"))
