"""Scalar functions on text, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Company suffixes that a loose comparison ignores at the end of a name (fixed values).
LOOSE_SUFFIXES = (
    "co ltd", "co", "ltd", "limited", "inc", "incorporated", "llc", "lp", "corp", "corporation", "gmbh", "ag", "ab", "bv", "nv", "sa", "srl", "plc", "pte", "pty", "kk",
    "有限公司", "股份有限公司", "株式会社", "株式會社",
)
#: Offices that are not one country (fixed values).
NON_COUNTRY = ("EP", "WO", "EA", "OA", "AP", "GC", "BX", "IB")


def blank_to_null(c: Column) -> Column:
    """Trimmed of ASCII spaces; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def is_filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """White space runs as one space, none at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def clean_long_text(c: Column) -> Column:
    """Line ends as LF, stripped; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(c, r"\r\n?", "\n")), F.lit(""))


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def split_multi_value(c: Column) -> Column:
    return _parts(c, r"\|")


def primary_value(c: Column) -> Column:
    return F.get(split_multi_value(c), F.lit(0))


def first_part(c: Column) -> Column:
    """The part before the first bar, null if blank, whatever follows."""
    return blank_to_null(F.split_part(c, F.lit("|"), F.lit(1)))


def split_people(c: Column) -> Column:
    return _parts(clean_text(c), r"(?:;|；|\||\n|、|，)+")


def split_classifications(c: Column) -> Column:
    return _parts(c, r"(?:;|；|\||,|，|\n)+")


def split_codes(c: Column) -> Column:
    """Codes between bars in capitals, each once, in order."""
    return F.array_distinct(F.transform(split_multi_value(c), F.upper))


def lookup_key(c: Column) -> Column:
    """The key under which names are compared: lower case, white space collapsed."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))


def loose_key(c: Column) -> Column:
    """A key that only suggests likeness: cut at "doing business as", no punctuation, no company suffixes at the end."""
    text = F.lower(clean_text(c))
    cut = F.get(F.split(text, r"\bd\s*/?\s*b\s*/?\s*a\b", 2), F.lit(0))
    plain = F.trim(F.regexp_replace(F.regexp_replace(cut, r"""[.,()\[\]{}'"`;:/\\&+]""", " "), r"(?U)\s+", " "))
    longest_first = "|".join(sorted(LOOSE_SUFFIXES, key=len, reverse=True))
    bare = F.regexp_replace(plain, rf"(?: (?:{longest_first}))+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), text)


def parse_date(c: Column) -> Column:
    """Eight or six digits (year and month give the first of the month), else year-month-day by -, / or dots."""
    text, digits = strip(c), F.regexp_replace(c, r"\D", "")
    ways = [F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd")), F.when(F.length(digits) == 6, F.try_to_date(F.concat(digits, F.lit("01")), "yyyyMMdd"))]
    ways += [F.try_to_date(text, f"yyyy{s}M{s}d") for s in ("-", "/", ".")]
    return F.coalesce(*ways)


def leading_year(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{4})", 1).try_cast("int")


def digits_to_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[0-9]+$"), F.trim(c)).try_cast("int")


def transform_number(country: Column, number: Column) -> Column:
    """In Taiwan a leading year from 1912 to 2910 becomes the year of the republic in three digits."""
    raw = blank_to_null(number)
    year = F.regexp_extract(raw, r"^(\d{4})", 1).try_cast("int")
    own = F.concat(F.lpad((year - 1911).cast("string"), 3, "0"), F.substring(raw, 5, 1000))
    return F.when((F.upper(F.trim(country)) == "TW") & year.between(1912, 2910), own).otherwise(raw)


def display_number(*columns: Column) -> Column:
    """The first filled number, in the order given."""
    return F.coalesce(*map(blank_to_null, columns))


def classification_level(c: Column, level: Column | int) -> Column:
    """From level 5 on the text before the slash, else the first so many letters and digits."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.when(level >= 5, F.trim(F.substring_index(c, "/", 1))).otherwise(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit(1), level))


def surrogate_family(family: Column, patent_id: Column) -> Column:
    """The family, or a family of its own for a patent without one."""
    return F.coalesce(blank_to_null(family), F.concat(F.lit("P"), patent_id.cast("string")))


def truncate_evidence(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def opaque_ref(c: Column) -> Column:
    return F.md5(lookup_key(c))


def merge_people(**columns: Column) -> Column:
    """Positions of several lists as structs with their sequence from 1; places where all are empty are left out."""
    zipped = F.arrays_zip(*[c.alias(k) for k, c in columns.items()])
    rows = F.transform(zipped, lambda x, i: F.struct((i + 1).alias("sequence"), *[x[k].alias(k) for k in columns]))
    some = lambda x: F.greatest(*[F.coalesce(x[k] != "", F.lit(False)).cast("int") for k in columns], F.lit(0)) == 1
    return F.filter(rows, some)


def resolve_number(country: Column, *numbers: Column) -> Column:
    """The first filled number, as the country writes it, after the two letters of the country; raises without one."""
    first = F.coalesce(*[transform_number(country, n) for n in numbers])
    code = F.upper(F.substring(F.trim(country), 1, 2))
    full = F.when(F.upper(first).startswith(code), first).otherwise(F.concat(code, first))
    return F.when(first.isNull(), F.raise_error(F.lit("a patent without a number"))).otherwise(F.coalesce(full, first))
