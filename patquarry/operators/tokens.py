"""Claims packed into chunks by the tokens of the model that will read them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where a claim begins: its number, a point and a letter (a fixed pattern).
CLAIM = re.compile(r"(?:^|\s)(\d{1,3})\.\s+(?=[A-Za-zΑ-Ωα-ω가-힣一-龥])")
#: Between the claims of a chunk.
GAP = "\n\n"


@cache
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def claims(text: str) -> list[tuple[str | None, int, int]]:
    """Number, start and end of each claim, white space around it left out; a text without numbers is one claim, what stands before the first belongs to none."""
    found = list(CLAIM.finditer(text))
    spans = [(m[1], m.start(1), found[i + 1].start(1) if i + 1 < len(found) else len(text)) for i, m in enumerate(found)] or [(None, 0, len(text))]
    out = []
    for number, a, b in spans:
        while a < b and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        if a < b:
            out.append((number, a, b))
    return out


def pack(text: str, path: str, most: int, overlap: int = 0) -> list[tuple[list[str], str, int, int, int]]:
    """Chunks of at most ``most`` tokens: the claims' numbers, the text, its tokens, and where it starts and ends in ``text``.

    Whole claims are packed in order, two line ends between them, as long as their joined text has no more tokens. A longer claim makes chunks of
    its own: each takes as many of its tokens as fit, by the count of its own text, and the next begins ``overlap`` tokens before its end."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the limit")
    tokenizer = _tokenizer(path)
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
    count = lambda x: len(encode(x).ids)
    out, held = [], []

    def flush() -> None:
        if held:
            joined = GAP.join(text[a:b] for _, a, b in held)
            out.append(([n for n, _, _ in held if n], joined, count(joined), held[0][1], held[-1][2]))
            held.clear()

    for number, a, b in claims(text):
        whole = encode(text[a:b])
        if len(whole.ids) <= most:
            if held and count(GAP.join([*(text[x:y] for _, x, y in held), text[a:b]])) > most:
                flush()
            held.append((number, a, b))
            continue
        flush()
        places = [p for p in whole.offsets if p[1] > p[0]]
        at = 0
        while at < len(places):
            end = min(at + most, len(places))
            part = lambda e: text[a + places[at][0] : a + places[e - 1][1]]  # noqa: B023, E731
            piece = part(end)
            n = count(piece)
            while end > at + 1 and n > most:  # a cut may change the tokens at its edges
                end -= 1
                piece = part(end)
                n = count(piece)
            start = a + places[at][0]
            out.append(([number] if number else [], piece, n, start, start + len(piece)))
            if end >= len(places):
                break
            at = max(at + 1, end - overlap)
    flush()
    return out


SCHEMA = "chunk int, claims array<string>, text string, tokens int, start long, `end` long, within boolean"


def chunks(df: DataFrame, key: str, text: str, path: str, most: int = 256, overlap: int = 0) -> DataFrame:
    """``key, chunk, claims, text, tokens, start, end, within`` of every text: see ``pack``; ``within`` marks parts of a longer claim.

    ``path`` is a tokenizer file that all executors can read. A text of null or white space has no chunks; other columns are not read."""
    kind = df.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, value in enumerate(batch.column(1)):
                whole = value.as_py() or ""
                long = [c for c in claims(whole)]
                for k, (numbers, part, n, a, b) in enumerate(pack(whole, path, most, overlap) if long else []):
                    keys.append(i)
                    rows.append((k, numbers, part, n, a, b, not any(x == a for _, x, _ in long) or not any(y == b for _, _, y in long)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            types = [pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, "chunk", "claims", "text", "tokens", "start", "end", "within"])

    return df.select(key, text).mapInArrow(run, f"{kind.replace(':', ' ', 1)}, {SCHEMA}")
