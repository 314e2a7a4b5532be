"""Secret scans: three fixed patterns, and strings that a primed compressor finds new.

A candidate is a whole run of key-like characters, however long, after a word that announces a secret. It is compressed by zstandard
with dictionaries of code and identifiers, once the text around it alone and once with the candidate in its place;
the difference is what the candidate adds, as it stands or in lower case. Words, identifiers and what stands nearby already add few bytes,
random strings nearly their full content, and those are reported. Names are split at case, underscores and the like, and
those of their parts that are words of the dictionary count for nothing.

The dictionary (``dictionary``) has the words of a corpus by document frequency, which text near a secret's name does not count for, those of a
tokenizer's vocabulary, of Python's own documentation, its modules' names and their members, and a fixed text. Copies of the candidate nearby are blanked before, so
a secret that stands twice does not explain itself.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_
from pydoc_data.topics import topics
from string import ascii_lowercase, digits

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from patquarry.llm import scratch

#: The base patterns (fixed values): kind, pattern, group whose length counts, and the least length.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = ("assign", "access", "hex", "novel")
#: Names that announce a secret (a fixed list of this operator).
CONTEXT = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "private_key", "private-key", "client_key", "auth_key", "access_key", "bearer", "authorization", "connection_string", "encryption_key", "signing_key", "ssh-rsa", "ssh-ed25519")
#: Each of those names has one of these.
STEMS = ("pass", "secret", "token", "key", "credential", "bearer", "authorization", "connection_string", "ssh-")
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT)), re.I | re.A)
#: A whole run of key-like characters, over single points inside it; counted from so many characters on.
_CANDIDATE, SHORTEST = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*"), 16
_PART = re.compile("[^._/-]+")
#: How far after a name a candidate may begin, how much text on either side primes the compressor, the least share that
#: a candidate must add of what random characters in its place add, how many times those are drawn, and the least of new bytes.
REACH, AROUND, SHARE, CONTROLS, LEAST = 48, 160, 0.75, 2, 11
#: Words of the dictionary from Python's library, the most frequent ones, and the modules whose members and documentation give them.
WORDS = 8000
MODULES = ("argparse", "asyncio", "base64", "collections", "configparser", "csv", "datetime", "email", "ftplib", "functools", "getpass", "hashlib", "hmac", "http.client", "http.server", "imaplib", "inspect", "io", "json", "logging", "os", "pathlib", "platform", "random", "re", "secrets", "shutil", "smtplib", "socket", "socketserver", "sqlite3", "ssl", "string", "subprocess", "threading", "tempfile", "typing", "unittest", "urllib.parse", "urllib.request", "uuid", "xml.sax", "zipfile")
#: As many characters in a row that stand in a candidate too are a copy of it, which does not explain it.
COPY = 12
#: Longer candidates are measured in pieces of so many characters.
PIECE = 256
#: Text that secrets do not look like: code, identifiers and prose that surround them (a fixed text of this operator).
IDENTIFIERS = (
    "import os import sys from typing import Any, Optional def __init__(self, config: dict) -> None: return self.config.get( class Client: async def await "
    "function const let var export default require module.exports console.log if (error) throw new Error public static void main String args private final int "
    "example.com localhost 127.0.0.1 http:// https:// www. .json .yaml .toml .env application/json content-type text/html charset=utf-8 "
    "username user_name password passwd passphrase secret token api_key apikey access_key access_token refresh_token client_id client_secret auth_token bearer authorization credential "
    "private_key public_key signing_key encryption_key connection_string database_url session_id request_id user_id account_id tenant_id project_id "
    "placeholder changeme change_me your_password_here your-api-key-here your_token_here example_secret test_password dummy_value not_a_real_secret environment variable "
    "get_password set_password reset_password validate_token verify_signature generate_secret rotate_credentials load_configuration parse_arguments read_file write_file "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 xxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXX ******************** ==================== -------------------- ____________________ "
).encode()

#: Words of four letters and more, also inside names.
_LETTERS = re.compile("[A-Z]?[a-z]{3,}|[A-Z]{4,}")
#: The longest word of a corpus that counts; a word of a corpus stands in one text of so many; and where the parts of a name in camel case meet.
LONGEST, RARE, _BORDER = 24, 20_000, re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LONG_HEX = b"x" * 24


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each match of a base pattern that is long enough; leftmost, not overlapping in a kind."""
    found = []
    lower = text.lower() if any(x in text for x in "=:") else ""
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(x in lower for x in ("passw", "secret", "token", "api")):
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        if kind == "hex" and _LONG_HEX not in text.encode("utf-8", "surrogatepass").translate(_HEX):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


def library_words(most: int = WORDS) -> list[str]:
    """Words of Python's documentation and of its modules' names, in lower case, the most frequent ones last."""
    counts: Counter[str] = Counter()
    for name in MODULES:
        module = importlib.import_module(name)
        for member, value in [(name, module), *vars(module).items()]:
            doc = getattr(value, "__doc__", None)
            counts.update(w.lower() for w in _LETTERS.findall(f"{member} {doc if isinstance(doc, str) else ''}"))
            if isinstance(value, type):
                counts.update(w.lower() for a in vars(value) for w in _LETTERS.findall(a))
    for text in topics.values():
        counts.update(w.lower() for w in _LETTERS.findall(text))
    return [w for w, _ in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:most]][::-1]


@lru_cache(maxsize=1)
def _library() -> bytes:
    return " ".join(library_words()).encode() + b" " + IDENTIFIERS  # the nearest are the cheapest


def vocabulary_words(path: str) -> list[str]:
    """Words of four letters and more in a vocabulary file of the tokenizers library, in lower case, those of the smallest ids last."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    found = dict.fromkeys(w.lower() for t in sorted(tokens, key=tokens.get) for w in _LETTERS.findall(t))
    return list(found)[::-1]


def corpus_words(df: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """The ``most`` words that stand in the most texts, two at least and one in ``RARE``, in lower case, the most frequent ones last; ties by the word.

    All texts count, but not what stands in reach of a secret's name, so that no secret explains its copies. Null texts have no words."""
    low = F.lower(F.col(text))
    near = reduce(or_, (low.contains(x) for x in STEMS))  # most texts have none and need no pattern
    shy = F.when(near, F.regexp_replace(F.col(text), f"(?is)(?:{'|'.join(CONTEXT)}).{{0,{REACH}}}[a-z0-9+/_=.-]*", " ")).otherwise(F.col(text))
    found = F.array_distinct(F.transform(F.regexp_extract_all(shy, F.lit(_LETTERS.pattern), F.lit(0)), F.lower))
    counted = df.select(F.explode(found).alias("word")).where(f"length(word) <= {LONGEST}").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.where(f"n > 1 and n * {RARE}L >= {df.count()}L")  # so that few rows of a task reach the driver, however many tasks there are
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()][::-1]


def dictionary(df: DataFrame | None = None, vocabulary: str | None = None, text: str = "text") -> bytes:
    """What primes the compressor: words of a vocabulary file, of a corpus and of Python's library, each once, and the fixed text.

    Its size is bounded by the vocabulary and ``WORDS``, not by the corpus."""
    parts = [vocabulary_words(vocabulary) if vocabulary else [], corpus_words(df, text) if df is not None else [], library_words()]
    last = dict.fromkeys(w for part in parts[::-1] for w in part[::-1])
    return " ".join(list(last)[::-1]).encode() + b" " + IDENTIFIERS


@lru_cache(maxsize=2)
def _compressor(prime: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=19)
    return zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(maxsize=2)
def _known(prime: bytes) -> frozenset[str]:
    """The dictionary's words of four letters and more."""
    return frozenset(w.lower() for w in _LETTERS.findall(prime.decode()))


def _without(text: str, grams: frozenset[str]) -> str:
    """The text with spaces where it repeats ``COPY`` or more characters in a row of a candidate, given by its grams."""
    out, at = [], 0
    for i in range(len(text) - COPY + 1):
        if text[i : i + COPY] in grams:
            out += [text[at : max(at, i)], " " * (i + COPY - max(at, i))]
            at = i + COPY
    return "".join([*out, text[at:]]) if out else text


def unexplained(name: str, prime: bytes) -> str:
    """A name in lower case without the dictionary's words: parts of it, which camel case and all but letters part, that are one word or two side by side."""
    known = _known(prime)

    def blank(m: re.Match) -> str:
        x = m[0].lower()
        return " " if x in known or any(x[:i] in known and x[i:] in known for i in range(4, len(x) - 3)) else m[0]

    return re.sub(" +", " ", re.sub("[A-Za-z]{4,}", blank, _BORDER.sub(" ", name))).lower()


def novelty(text: str, start: int, end: int, prime: bytes | None = None) -> int:
    """Compressed bytes that a candidate adds to the text around it, in which copies of the candidate are blanked: as it stands, in lower
    case, or without the words that the dictionary explains, whichever is least."""
    prime = prime or _library()
    candidate = text[start:end]
    grams = frozenset(candidate[i : i + COPY] for i in range(end - start - COPY + 1))
    more = AROUND + COPY - 1  # a copy across the border is seen as one
    before, after = _without(text[max(0, start - more) : start], grams)[-AROUND:], _without(text[end : end + more], grams)[:AROUND]
    around = f"{after}\n{before}"  # the candidate comes last, after all that may explain it
    size = lambda x: len(_compressor(prime).compress(x.encode("utf-8", "surrogatepass")))
    alone = size(around)
    return min(size(around + x) for x in {candidate, candidate.lower(), unexplained(candidate, prime)}) - alone


def random_like(text: str, seed: int) -> str:
    """Random letters and digits, always the same ones, in place of a text's; the case of letters and all else stay.

    Letters of a text that has none beyond f stay within those."""
    r, lower = random.Random(len(text) + 1_000_000 * seed), ascii_lowercase
    if all(c in "abcdef" for c in text.lower() if c.isalpha()):
        lower = "abcdef"
    kinds = ((str.islower, lower), (str.isupper, lower.upper()), (str.isdigit, digits))
    return "".join(next((r.choice(kind) for is_, kind in kinds if is_(c)), c) for c in text)


def _new(text: str, start: int, end: int, prime: bytes) -> bool:
    """Whether a candidate of at most ``PIECE`` characters adds nearly what random characters of its kind would in its place."""
    added = novelty(text, start, end, prime)
    if added < LEAST:
        return False
    controls = (text[:start] + random_like(text[start:end], seed) + text[end:] for seed in range(CONTROLS))
    return any(added >= SHARE * novelty(c, start, end, prime) for c in controls)


def _pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The candidate, or where it is long pieces that reach its end; the last one overlaps."""
    for at in range(start, max(start + 1, end - PIECE), PIECE):
        yield at, min(end, at + PIECE)
    if end - start > PIECE:
        yield end - PIECE, end


def _any_new(text: str, start: int, end: int, prime: bytes) -> bool:
    """Whether a candidate as a whole, one of its pieces, or one of its long parts between points, hyphens, underscores and slashes is new."""
    if any(_new(text, a, b, prime) for a, b in _pieces(start, end)):
        return True
    for part in _PART.finditer(text, start, end):
        if SHORTEST <= len(part[0]) < end - start and any(_new(text, a, b, prime) for a, b in _pieces(*part.span())):
            return True
    return False


def novel_spans(text: str, prime: bytes | None = None) -> list[tuple[int, int, str]]:
    """Incompressible candidates that follow a name of a secret closely, to their full extent."""
    found, prime = [], prime or _library()
    lower = text.lower()
    if not any(x in lower for x in CONTEXT):
        return found
    ends: dict[int, bool] = {}  # of the runs seen, and whether one is reported
    last, tried = (0, 0), -SHORTEST
    for m in _CONTEXT.finditer(text):
        at, reach = m.end(), m.end() + REACH
        while (c := _CANDIDATE.search(text, at, min(len(text), reach + 1))) is not None:
            start = c.start()
            end = last[1] if last[0] <= start < last[1] else _CANDIDATE.match(text, start).end()
            if end > last[1]:
                last = (start, end)
            at = end
            if end - start < SHORTEST or ends.get(end):
                continue
            if end not in ends:
                ends[end] = _any_new(text, start, end, prime)
            elif start == m.end() and start - tried >= SHORTEST:  # the name stands in a run that is not new as a whole; what follows it may be
                tried = start
                ends[end] = _new(text, start, min(end, start + PIECE), prime)
            if ends[end]:
                found.append((start, end, "novel"))
    return found


def spans(text: str, prime: bytes | None = None) -> list[tuple[int, int, str]]:
    """All spans by start, then by kind; a novel one only where no base span covers it."""
    base = base_spans(text)
    more = [s for s in novel_spans(text, prime) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redacted(text: str, mark: str = "[removed]", prime: bytes | None = None) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for start, end, _ in spans(text, prime):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", prime: bytes | None = None) -> DataFrame:
    """Find secrets in every whole text. ``prime``: the dictionary, by default without a corpus and a vocabulary.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: the base kinds' counts, the hex digest of their
    ``kind:start:end`` list, and the list with the novel spans. Positions are code points, ends exclusive.

    A null text counts as empty: no spans and the digest of the empty string. Null and repeated keys pass through, a
    row for each row; other columns are not read; an empty table gives an empty result. Very long texts are
    scanned whole in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for x in batch.column(1):
                found = spans(x.as_py() or "", prime)
                base = [s for s in found if s[2] != "novel"]
                row = [*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", prime: bytes | None = None) -> DataFrame:
    """``df`` with the secrets in its texts replaced by a mark, and ``n_chars``, where there is such a column, counted anew
    in changed rows. Null texts stay null; all rows and columns stay."""

    scratch.bounded(df.sparkSession)

    @F.pandas_udf("string")
    def clean(x):  # noqa: ANN001, ANN202
        return x.map(lambda t: redacted(t, prime=prime), na_action="ignore")

    out = df.withColumn(text, clean(F.col(text)))
    if n_chars in df.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.char_length(text)).otherwise(F.col(n_chars)).cast(df.schema[n_chars].dataType))
    return out
