"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window over the words of the whole text, so line ends do not part a statement. Templates of like length share windows
of twice that length, half overlapping, so that every statement of a template in a row stands whole in one and words far apart do
not. A block matches a template if it contains ``threshold`` of the template's distinct words or more. The join is exact
and prunes: words are ordered by their document frequency in the whole corpus, rarest first. A template that needs ``r``
of its ``n`` words must share one of its first ``n - r + 1`` with the block (prefix filter); the block must have ``r``
distinct words (length filter); and the words left after the first shared one in both orders must suffice (positional
filter).

Statements of different licenses may differ in one word. So a template also needs, in the block, what tells it from similar templates of other
labels (``turns``): "gnu general" side by side where another has "gnu lesser general", and "lesser" where another has "affero".
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The base phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Statements by which common licenses are granted or named (fixed values); ``label -> texts``.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "agpl": ("licensed under the GNU Affero General Public License", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "apache": (
        "licensed under the Apache License version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied",
    ),
    "artistic": ("licensed under the Artistic License 2.0", "you may redistribute it and or modify it under the same terms as Perl itself"),
    "boost": ("distributed under the Boost Software License version 1.0",),
    "bsd": (
        "licensed under the BSD license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "cc-by": ("licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc": ("licensed under CC BY NC 4.0", "licensed under a Creative Commons Attribution NonCommercial license", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by-nd": ("licensed under CC BY ND 4.0", "licensed under a Creative Commons Attribution NoDerivatives license", "licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"),
    "cc-by-sa": ("licensed under CC BY SA 4.0", "licensed under a Creative Commons Attribution ShareAlike license", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc0": ("dedicated to the public domain under CC0", "no copyright reserved CC0 public domain dedication", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    "cddl": ("subject to the terms of the Common Development and Distribution License",),
    "epl": ("made available under the terms of the Eclipse Public License",),
    "eupl": ("licensed under the European Union Public Licence",),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the GNU Free Documentation License",),
    "gpl-notice": (
        "this work is licensed under the GNU General Public License",
        "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "you should have received a copy of the GNU General Public License along with this program",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("licensed under the GNU Lesser General Public License", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": (
        "released under the MIT License",
        "licensed under the MIT License",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl": ("subject to the terms of the Mozilla Public License", "if a copy of the MPL was not distributed with this file you can obtain one at"),
    "odbl": ("made available under the Open Database License",),
    "ofl": ("this font software is licensed under the SIL Open Font License version 1.1",),
    "proprietary": ("this document contains confidential and proprietary information", "no part of this publication may be reproduced without prior written permission"),
    "reserved-notice": ("copyright all rights reserved by the author",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
}
#: The least stride of windows, which are twice as long.
THRESHOLD, STRIDE = 0.9, 8
#: Templates go to every task, so their number is bounded.
MOST_TEMPLATES = 10_000

#: Bytes of words stay, A-Z become a-z, all other ASCII parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PHRASES = tuple((tuple(p.encode().split()), label) for p, label in PHRASES)


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8: runs of 0-9, a-z (A-Z lower-cased) and of characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def places(tokens: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Every word position at which the phrase's words stand consecutively."""
    found, i, n = [], -1, len(phrase)
    try:
        while True:
            i = tokens.index(phrase[0], i + 1)
            if tuple(tokens[i : i + n]) == phrase:
                found.append(i)
    except ValueError:
        return found


def windows(tokens: list[bytes], stride: int) -> Iterator[list[bytes]]:
    """Windows of twice the stride that overlap by half and reach the end."""
    for start in range(0, max(1, len(tokens) - stride), stride):
        yield tokens[start : start + 2 * stride]


#: Templates of different labels that share so much of the smaller one's words are similar.
SIMILAR = 0.6
#: Pairs of neighboring words, and words, that a template needs beside its share of words.
Turns = tuple[frozenset[tuple[bytes, bytes]], frozenset[bytes]]


def turns(templates: Mapping[str, tuple[str, ...]]) -> dict[tuple[str, tuple[bytes, ...]], Turns]:
    """For each label and template (its words) what tells it from similar templates of other labels.

    Where another has a word between two that are neighbors here ("gnu lesser general" beside "gnu general"), the two are needed side by side;
    where another has another word between the same two ("gnu affero general" beside "gnu lesser general"), this one's word is needed."""
    every = [(label, tuple(words(t))) for label, texts in sorted(templates.items()) for t in texts]
    threes = {own: set(zip(own, own[1:], own[2:], strict=False)) for _, own in every}
    found: dict[tuple[str, tuple[bytes, ...]], Turns] = {}
    for label, own in every:
        mine, beside = frozenset(own), set(zip(own, own[1:], strict=False))
        middle: dict[tuple[bytes, bytes], set[bytes]] = {}
        for x, y, z in threes[own]:
            middle.setdefault((x, z), set()).add(y)
        pairs, needed = set(), set()
        for other_label, other in every:
            theirs = frozenset(other)
            if label == other_label or len(mine & theirs) < SIMILAR * min(len(mine), len(theirs)):
                continue
            for x, w, z in threes[other]:
                if w not in mine:
                    pairs.update({(x, z)} & beside)
                    needed.update(middle.get((x, z), set()) - theirs)
        found[label, own] = frozenset(pairs), frozenset(needed)
    return found


def stride_of(n: int) -> int:
    """The stride for a template of ``n`` words: each run of as many words lies in one of its windows."""
    return max(STRIDE, 1 << (n - 1).bit_length() if n else 0)


class TemplateIndex:
    """Templates in the global order of words, indexed by the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], frequency: Mapping[bytes, int], threshold: float, needs: list[Turns] | None = None) -> None:
        """``needs``: for each template the pairs of neighboring words, and the words, that it needs whatever it shares."""
        vocabulary = frozenset().union(*(t for _, t in templates)) if templates else frozenset()
        self.needs = needs or [(frozenset(), frozenset())] * len(templates)
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.by_word = [], {}
        for label, words_ in templates:
            ordered = sorted(words_, key=self.rank.__getitem__)
            need = max(1, ceil(threshold * len(ordered) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, ordered, frozenset(ordered), need))
            for position, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.by_word.setdefault(w, []).append((k, position))
        self.prefix = frozenset(self.by_word)

    def possible(self, distinct: set[bytes]) -> bool:
        """Whether a whole text's words meet some template; only then can a block of it."""
        hits = self.prefix & distinct
        return any(len(self.templates[k][2] & distinct) >= self.templates[k][3] for k in {k for w in hits for k, _ in self.by_word[w]})

    def matches(self, window: Sequence[bytes]) -> dict[str, float]:
        """Label and containment of every template that a window of words meets."""
        found: dict[str, float] = {}
        block, beside = frozenset(window), None
        hits = block & self.prefix
        if not hits:
            return found
        ordered = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)  # other words match nothing
        tried: set[int] = set()
        for j, w in enumerate(ordered):
            for k, i in self.by_word.get(w, ()):
                if k in tried:
                    continue
                tried.add(k)  # the first shared word of the two orders
                label, template, whole, need = self.templates[k]
                if len(block) < need or 1 + min(len(template) - i - 1, len(ordered) - j - 1) < need:
                    continue
                common = len(whole & block)
                if common >= need:
                    pairs, needed = self.needs[k]
                    if pairs:
                        beside = beside or frozenset(zip(window, window[1:], strict=False))
                    if not needed <= block or pairs and not pairs <= beside:
                        continue
                    found[label] = max(found.get(label, 0.0), common / len(template))
        return found


def _sets(templates: Mapping[str, tuple[str, ...]]) -> dict[int, list[tuple[str, frozenset[bytes], Turns]]]:
    """Label, word set and needs of each template, by the stride of its windows."""
    found: dict[int, list[tuple[str, frozenset[bytes], Turns]]] = {}
    needs = turns(templates) if sum(map(len, templates.values())) <= MOST_TEMPLATES else {}
    for label, t in sorted((label, t) for label, texts in templates.items() for t in texts):
        if tokens := words(t):
            found.setdefault(stride_of(len(tokens)), []).append((label, frozenset(tokens), needs.get((label, tuple(tokens)), (frozenset(), frozenset()))))
    if sum(map(len, found.values())) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return found


def document_frequency(df: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole table each word of a bounded vocabulary stands; a row a word and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(vocabulary.intersection(words(x.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # bounded by the vocabulary


def scan(df: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Find license phrases and template statements in every whole text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. ``n_base`` counts all places
    of the base phrases, ``first_word`` and ``last_word`` are their smallest and largest start; ``labels`` also has
    those of the templates met; ``score`` is 1 with a base phrase, else the best containment found, else 0.

    A null text counts as empty: counts of 0, null places, empty labels. Null and repeated keys pass through, a row for
    each row; other columns are not read; an empty table gives an empty result. Texts are read in overlapping
    windows to their end, whatever their line ends.
    """
    sets = _sets(templates)
    vocabulary = frozenset().union(*(t for some in sets.values() for _, t, _ in some))
    frequency = document_frequency(df, vocabulary, text) if vocabulary else {}
    index = df.sparkSession.sparkContext.broadcast({stride: TemplateIndex([x[:2] for x in some], frequency, threshold, [x[2] for x in some]) for stride, some in sets.items()})
    starts = frozenset(p[0] for p, _ in _PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joins = index.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for x in batch.column(1):
                tokens = words(x.as_py() or "")
                distinct = set(tokens)
                at: list[int] = []
                base: set[str] = set()
                if not starts.isdisjoint(distinct):
                    for phrase, label in _PHRASES:
                        if phrase[0] in distinct and (found := places(tokens, phrase)):
                            at += found
                            base.add(label)
                met: dict[str, float] = {}
                for stride, join in joins.items():
                    if join.possible(distinct):
                        for block in windows(tokens, stride):
                            for label, value in join.matches(block).items():
                                met[label] = max(met.get(label, 0.0), value)
                row = (len(tokens), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(met))), 1.0 if base else max(met.values(), default=0.0))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


#: The base columns of the same rows in SQL: every start of every phrase among the words.
BASE_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x != '') as w from documents
), found as (
  select *, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' and w[i + 2] = 'by') as a,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as b,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'all' and w[i + 2] = 'rights' and w[i + 3] = 'reserved') as c from w
)
select doc_id, len(w)::bigint as n_words, (len(a) + len(b) + len(c))::bigint as n_base, list_min(a || b || c) as first_word, list_max(a || b || c) as last_word,
  array_to_string(list_filter([case when len(a) > 0 then 'cc-by' end, case when len(b) > 0 then 'gpl' end, case when len(c) > 0 then 'reserved' end], lambda x: x is not null), ',') as base_labels
from found
"""
