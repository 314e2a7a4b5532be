"""Quality rules as a short-circuit cascade: rules are tried in the order of their rejections for their cost.

A rule compares measures of a text. On a sample, every measure is timed and every rule tried, on the executors; the driver sees a row
for each set of rules that fail together. The order is greedy: next comes the rule that rejects the most of the sampled texts that
are left for the time its measures still take (a measure that an earlier rule has taken is free). In the main pass a text
stops at the first rule that rejects it, and no measure is taken before a rule asks for it. A verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: About so many rows are sampled, whatever the size of the table; their verdicts and times only decide the order of rules.
SAMPLE = 4096

#: The characters that count as symbols, and white space (fixed values).
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    base = len(numbers)
    pair = code[:-2] * base + code[1:-1]
    if base >= 1 << 20:  # three codes would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, window, often = np.unique(pair * base + code[2:], return_inverse=True, return_counts=True)
    twice = often[window] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


class Measures:
    """The measures of one text, each taken when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode()
        self.had: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self.had:
            self.had[name] = MEASURES[name](self)
        return self.had[name]

    @property
    def words(self) -> list[bytes]:
        if not hasattr(self, "_words"):
            self._words = self.raw.split()  # bytes split at space and \x09 to \x0d only
        return self._words

    @property
    def lines(self) -> list[bytes]:
        """Lines that have a word."""
        if not hasattr(self, "_lines"):
            self._lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return self._lines


#: Whole-number measures of a text by name.
MEASURES: dict[str, Callable[[Measures], int]] = {
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text) - _count(m.raw, SPACES),
    "n_symbols": lambda m: _count(m.raw, SYMBOLS),
    "n_lines": lambda m: len(m.lines),
    "n_dup_lines": lambda m: len(m.lines) - len(set(m.lines)),
    "n_repeat_words": lambda m: repeated_words(m.words),
    "n_upper": lambda m: _count(m.raw, UPPER),
    "n_lower": lambda m: _count(m.raw, LOWER),
    "n_marks": lambda m: _count(m.raw, b"!?"),
    "n_digits": lambda m: _count(m.raw, b"0123456789"),
}


@dataclass(frozen=True)
class Rule:
    """``fails`` says whether a text is rejected by the measures that ``needs`` names; comparisons are of whole numbers."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Measures], bool]


#: The rules of the base verdict.
BASE = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: All rules; the thresholds follow published heuristics for web text.
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("short_words", ("n_words", "word_chars"), lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", ("n_words", "word_chars"), lambda m: m["word_chars"] > 12 * m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: m["n_dup_lines"] >= 3 and 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("upper_case", ("n_upper", "n_lower"), lambda m: m["n_upper"] > m["n_lower"]),
    Rule("marks", ("n_words", "n_marks"), lambda m: 4 * m["n_marks"] > m["n_words"]),
    Rule("digits", ("word_chars", "n_digits"), lambda m: 10 * m["n_digits"] > 3 * m["word_chars"]),
)


@dataclass(frozen=True)
class Step:
    """A rule's place in the cascade: of the sampled texts that reach it, those it rejects, and its nanoseconds a text there."""

    rule: str
    reached: int
    rejected: int
    cost: float


def greedy(rules: Sequence[Rule], sets: list[tuple[int, int]], cost: dict[str, float], given: Sequence[str] = ()) -> list[Step]:
    """The order of ``rules``: most rejections for the cost first.

    ``sets`` has for each set of failing rules, as bits in the order of ``rules``, its number of texts; ``cost`` the nanoseconds a text of
    each measure; measures in ``given`` are taken anyway and are free. Rules that reject none of what is left come last, cheapest first.
    """
    steps: list[Step] = []
    open_, paid, left = list(range(len(rules))), set(given), list(sets)
    while open_:
        reached = sum(n for _, n in left)

        def price(i: int) -> float:
            return 1.0 + sum(cost.get(x, 0.0) for x in rules[i].needs if x not in paid)  # one for the comparison itself

        def rejects(i: int) -> int:
            return sum(n for bits, n in left if bits >> i & 1)

        best = min(open_, key=lambda i: (-rejects(i) / price(i), price(i), i))
        steps.append(Step(rules[best].name, reached, rejects(best), price(best)))
        open_.remove(best)
        paid.update(rules[best].needs)
        left = [(bits, n) for bits, n in left if not bits >> best & 1]
    return steps


def _probe(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """For each text the set of rules that fail and the nanoseconds of each measure, words and lines being split before."""
    for batch in batches:
        bits, took = [], []
        for text in batch.column(0).to_pylist():
            m, spent = Measures(text), []
            m.words, m.lines  # noqa: B018
            for name in names:
                start = time.perf_counter_ns()
                m[name]
                spent.append(time.perf_counter_ns() - start)
            bits.append(sum(1 << i for i, r in enumerate(rules) if r.fails(m)))
            took.append(spent)
        yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(took, pa.list_(pa.int64()))], names=["bits", "took"])


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, given: Sequence[str] = (), text: str = "text", sample: int = SAMPLE) -> list[Step]:
    """The order of the cascade, from about ``sample`` rows drawn by chance from the whole table.

    At most 62 rules. The driver gets a row for each set of rules that fail together, so ``sample`` rows or so at most.
    """
    if len(rules) > 62:
        raise ValueError("more than 62 rules")
    names = sorted({x for r in rules for x in r.needs})
    share = min(1.0, sample / max(1, df.count()))
    rows = df.where(F.rand(17) < share).select(F.col(text).alias("text"))
    probed = rows.mapInArrow(partial(_probe, rules=tuple(rules), names=tuple(names)), "bits long, took array<long>")
    sets = probed.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("took")[i]).alias(f"t{i}") for i in range(len(names)))).collect()
    n = sum(r.n for r in sets)
    cost = {name: sum(r[f"t{i}"] for r in sets) / max(1, n) for i, name in enumerate(names)}
    return greedy(rules, [(r.bits, r.n) for r in sets], cost, given)


def verdict(m: Measures, rules: Sequence[Rule]) -> tuple[str | None, int]:
    """The first of ``rules`` that rejects a text, if any, and how many were tried."""
    for k, rule in enumerate(rules):
        if rule.fails(m):
            return rule.name, k + 1
    return None, len(rules)


def _judge(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], outputs: Sequence[str]) -> Iterator[pa.RecordBatch]:
    names = ["rejected_by", "n_tried", *outputs]
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            m = Measures(text.as_py())
            first = verdict(m, rules)
            out.append((*first, *(m[name] for name in outputs)))
        if out:
            columns = [pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, outputs: Sequence[str] = (), key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Judge every whole text by ``rules``, in the order that ``estimate`` finds.

    Returns ``doc_id, rejected_by`` (the first rule that rejects the text in that order, which may change from run to run; null if none
    does), ``n_tried`` (rules tried) and the measures of ``outputs``, which are taken of every text.

    A null text is an empty one: no words, all measures 0. Rows without an id and rows that repeat one are judged each; other columns
    are not read. An empty table gives an empty result. Nothing is shuffled but the sample's counts.
    """
    order = {s.rule: k for k, s in enumerate(estimate(df, rules, outputs, text, sample))}
    chosen = tuple(sorted(rules, key=lambda r: order[r.name]))
    schema = ", ".join(["doc_id long", "rejected_by string", "n_tried long", *(f"{x} long" for x in outputs)])
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_judge, rules=chosen, outputs=tuple(outputs)), schema)


def keep(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text no rule rejects; a text stops at its first rejection."""
    order = {s.rule: k for k, s in enumerate(estimate(df, rules, (), text, sample))}
    chosen = tuple(sorted(rules, key=lambda r: order[r.name]))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(Measures(x.as_py()), chosen)[0] is None for x in batch.column(text)], pa.bool_()))

    return df.mapInArrow(passing, df.schema)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's base measures, whether the base rules fail it, and whether all rules keep it; as ``cascade`` otherwise."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return cascade(df, RULES, base, key, text).select("doc_id", *base, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


#: The same rows from SQL: the verdict does not depend on the order of the rules.
ORACLE = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), split as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs
), windows as (
  select r, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as w from split where len(words) > 2
), twice as (
  select r, i from windows qualify count(*) over (partition by r, w) > 1
), inside as (
  select r, count(distinct i + k) as n from twice, (select unnest(range(3)) as k) group by r
), measured as (
  select doc_id, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(n, 0) as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) as n_lower,
    length(regexp_replace(t, '[^!?]', '', 'g')) as n_marks, length(regexp_replace(t, '[^0-9]', '', 'g')) as n_digits
  from split left join inside using (r)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words or n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines or n_upper > n_lower or 4 * n_marks > n_words or 10 * n_digits > 3 * word_chars) as kept
from judged
"""
