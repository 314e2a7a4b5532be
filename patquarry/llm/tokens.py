"""Fast exact encoding with the ``tokenizers`` library inside tasks.

Texts split into chunks that encode independently of their surroundings; a chunk is encoded once by the library's
model and kept in a bounded cache, so the library sees each distinct chunk about once a worker. Whatever the
chunk rules do not cover is encoded whole by the library, so the ids are always the library's.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex

#: White space as the tokenizers library's patterns see it (a fixed value); Python's \\s has four more characters.
SPACE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What parts chunks, of one byte so that plain texts stay so; texts that hold it take the slower way.
_MARK = "\x00"
#: The published split patterns of the two byte-pair vocabularies (fixed values).
WORD_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
BYTE_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: How the vocabulary files state those rules (fixed values): normalizer and pre-tokenizer.
WORD_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
BYTE_RULES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_ODD_FOR_SPLIT = re.compile("[\x1c-\x1f]")
_ODD_SPACE = re.compile("[\t\x0b\x0c\r" + SPACE[4:] + _MARK + "]")
_SPACES = re.compile(f"[{SPACE}]+")
#: Chunks kept for good by a worker, and how many more until those are dropped: these bound its memory.
KEPT, YOUNG = 250_000, 75_000


def rules(spec: dict) -> tuple[dict | None, dict | None]:
    """Normalizer and pre-tokenizer that a vocabulary file asks for."""
    return spec.get("normalizer"), spec.get("pre_tokenizer")


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))
_SPACE = _LETTERS[32]


def as_letters(word: str) -> str:
    """A word with each of its UTF-8 bytes as a letter."""
    if word.isascii() and word.isprintable() and " " not in word:
        return word
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


def lower_nfc(text: str) -> str:
    """NFC, then lower case character by character: a capital sigma has no final form."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "σ".join(x.lower() for x in text.split("Σ")) if "Σ" in text else text.lower()


def split_space(text: str) -> list[str]:
    """Parts between white space of the library's kind."""
    if _ODD_FOR_SPLIT.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()


class Memo(dict):
    """Values by chunk: the first ``KEPT`` stay, later ones go when there are ``YOUNG`` of them."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.young = make, {}

    def __missing__(self, key: str):
        found = self.young.get(key)
        if found is None:
            found = self.make(key)
            if len(self) < KEPT:
                self[key] = found
            else:
                if len(self.young) >= YOUNG:
                    self.young.clear()
                self.young[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes each."""

    def __init__(self, path: str, width: int = 4) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype(f"<u{width}")
        if self.library.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids of {path} need more than {width} bytes")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokenize = self.library.model.tokenize
        if spec["model"].get("end_of_word_suffix") and rules(spec) == WORD_RULES:
            self.encode, self.memo = self._by_words, Memo(lambda chunk: self._ids(WORD_PATTERN.findall(chunk)))
        elif not spec["model"].get("end_of_word_suffix") and rules(spec) == BYTE_RULES and sys.byteorder == "little" and width in (2, 4):
            self.encode, self.memo, self.code = self._by_bytes, Memo(self._byte_ids), "H" if width == 2 else "I"
        elif not spec["model"].get("end_of_word_suffix") and rules(spec) == BYTE_RULES:
            self.encode, self.memo = self._by_bytes, Memo(lambda chunk: self._ids(BYTE_PATTERN.findall(chunk)))
        else:
            self.encode = self.whole

    def _ids(self, words: list[str]) -> bytes:
        return np.array([t.id for w in words for t in self.tokenize(as_letters(w))], self.type).tobytes()

    def _byte_ids(self, chunk: str) -> bytes:
        """As ``_ids`` of the pattern's words. A run of ASCII letters, a space before it or not, is one, and a mark after it another."""
        if chunk.isascii() and chunk:
            space = chunk[0] == " "
            if chunk[space:].isalpha():
                return array(self.code, [t.id for t in self.tokenize(_SPACE + chunk[1:] if space else chunk)]).tobytes()
            if chunk[-1] in ".,;:!?" and chunk[space:-1].isalpha():
                return self.memo[chunk[:-1]] + self.memo[chunk[-1]]
        return self._ids(BYTE_PATTERN.findall(chunk))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _by_words(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, split_space(lower_nfc(text))))

    def _by_bytes(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        # a space followed by other than space opens a chunk; a line end is one; other runs go through the pattern
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith(("\n\n", " ")) or _ODD_SPACE.search(text):
            return b"".join(map(self.memo.__getitem__, BYTE_PATTERN.findall(text)))
        parts = text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n" + _MARK).split(_MARK)
        return b"".join(map(self.memo.__getitem__, parts))


@lru_cache(maxsize=4)
def encoder(path: str, width: int = 4) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path, width)
