"""The state machines of ``operators.decisions`` over a stream of events, a state a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Machine(StatefulProcessor):
    def __init__(self, machine: type, key: str, order: str) -> None:
        self.machine, self.key, self.order = machine, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "condition int, " + ", ".join(f"{r} string" for r in self.machine.registers))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        m = self.machine
        condition, registers = m.conditions[0], (None,) * len(m.registers)
        if self.state.exists():
            number, *values = self.state.get()
            condition, registers = m.conditions[number], tuple(values)
        place = lambda r: [(r[c] is not None, r[c]) for c in (self.order, "action", *m.fields)]
        for r in sorted(rows, key=lambda r: [(there, v if there else 0) for there, v in place(r)]):
            condition, registers = m.step(condition, registers, r["action"], {f: r[f] for f in m.fields})
        self.state.update((m.conditions.index(condition), *registers))
        yield Row(**{self.key: key[0], "status": condition[0], **dict(zip(m.registers, registers, strict=True))})

    def close(self) -> None:
        pass


def decide(events: DataFrame, key: str, order: str, machine: type) -> DataFrame:
    """A stream of ``key, status`` and registers: the state of every key that a batch has events of, after them.

    Within a batch events count in the order that ``operators.decisions.fold`` has; a batch's events come after those of earlier ones. A batch's
    events of one key are sorted in its task. Needs the state store of RocksDB and the output mode ``update``."""
    rows = events.select(key, order, "action", *machine.fields)
    kind = rows.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1)
    schema = f"{kind}, status string, " + ", ".join(f"{r} string" for r in machine.registers)
    return rows.groupBy(key).transformWithState(_Machine(machine, key, order), schema, "Update", "None")
