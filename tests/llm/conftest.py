import random

import public_tokenizers
import pytest

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

#: Clashing extra columns: the operators must not care.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, shard int, sig string"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null and repeated ids, repeated rows, one very long text and odd characters."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("a", "A")), (4, base + " one more"), (5, None), (6, ""), (7, "   \n\t "), (8, "two words"), (9, "Two  WORDS"), (None, base), (None, "alone"),
        (10, "x " * 60_000), (11, "Σίσυφος ΣΑΣ İ ½ Ⅷ 中文 <|endoftext|> don't  stop\r\n\x1c\x00 end"), (12, prose(2)), (13, prose(2) + " tail"), (14, prose(3)), (7, "other text of a repeated id"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
