"""Claims: splitting, classification and inference along references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from patquarry.operators import chains

#: A claim's number at the start of a segment, and references to claims (fixed patterns).
NUMBERS = r"\s*(\d+)(?:\s*[-–]\s*(\d+))?\s*[.．、]"
HEAD, SPACE = NUMBERS + r"(?=\s*\D)", r"[ \t\x0B\f\r]"
REFERENCE = r"(?i)(?:claims?|权利要求|權利要求)\s*(\d+(?:\s*(?:[-–~,、]|to|至|and|or|或|和)\s*\d+)*)"
CANCELED, RANGE = r"(?i)cancell?ed", r"(?i)[-–~]|to|至"
#: Statuses from the least favourable on (fixed values).
STATUSES = ("not_established", "needs_review", "possibly_established")


#: A range of more numbers than this stands for its ends only.
LONGEST_RANGE = 10_000


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, nth, segment``: parts between bars or line ends; one that starts with no number goes on the one before.

    One split, at the line ends that a number follows: bars become line ends first, and those that stay become spaces, as do the
    spaces around them. What stands before the first number is left out; a null text has no segments."""
    lines = F.regexp_replace(F.col(text), r"\s*\|\s*|\r?\n", "\n")
    parts = F.split(F.concat(F.lit("\n"), lines), "\n(?=" + HEAD.replace(r"\s", SPACE).replace(r"\D", r"[^\d\n]") + ")")
    found = df.select(key, F.posexplode(parts).alias("nth", "segment")).where("nth > 0")
    return found.withColumn("segment", F.regexp_replace(F.trim("segment"), " *\n *", " "))


def references(body: Column) -> Column:
    """Numbers of the claims referred to, in order, each once; two numbers of a range stand for all between. Numbers that are no int are none."""
    tokens = F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1))

    def numbers(token: Column) -> Column:
        n = F.transform(F.regexp_extract_all(token, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
        return F.struct(F.filter(n, lambda x: x.isNotNull()).alias("n"), token.rlike(RANGE).alias("range"))

    def meant(x: Column) -> Column:
        low, high = F.array_min(x["n"]), F.array_max(x["n"])
        return F.when(x["range"] & (F.size(x["n"]) == 2) & (high.cast("long") - low < LONGEST_RANGE), F.sequence(low, high)).otherwise(x["n"])

    return F.array_distinct(F.flatten(F.transform(F.transform(tokens, numbers), meant)))


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a claim: ``number, text, type, parent, parents, multiple_dependent``; only references back name parents.

    A number that is no int stays as its digits and has no parents."""
    rows = segments(df, key, text).withColumn("head", F.regexp_extract("segment", "^" + HEAD, 0))  # the rest of a segment needs no pattern
    get = lambda i: F.regexp_extract("head", NUMBERS, i)
    body = F.when(F.col("head") != "", F.substring("segment", F.length("head") + 1, F.length("segment"))).otherwise("")
    rows = rows.withColumn("first", get(1).try_cast("int")).withColumn("end", get(2)).withColumn("body", body)
    rows = rows.withColumn("refs", references(F.col("body"))).withColumn("back", F.filter("refs", lambda x: x < F.col("first")))
    odd = (F.col("end") != "") | F.col("body").rlike(CANCELED)
    kind = F.when(odd, "unknown").when(F.size("refs") == 0, "independent").when(F.size("back") == 0, "unknown").otherwise("dependent")
    rows = rows.withColumn("type", kind).withColumn("parents", F.when(kind == "dependent", F.col("back")).otherwise(F.array().cast("array<int>")))
    number = F.coalesce(F.col("first").cast("string"), get(1))
    return rows.select(
        key, F.when(F.col("end") != "", F.concat(number, F.lit("-"), F.col("end"))).otherwise(number).alias("number"), F.trim("segment").alias("text"), "type",
        F.when(F.size("parents") == 1, F.get("parents", F.lit(0))).alias("parent"), F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"), (F.size("parents") > 1).alias("multiple_dependent"),
    )


def evaluate(elements: Column) -> Column:
    """A claim's status by its elements: any not met, all met, or else to be reviewed; null without elements."""
    return F.when(F.size(elements) < 1, None).when(F.exists(elements, lambda x: x == "not_met"), STATUSES[0]).when(F.forall(elements, lambda x: x == "met"), STATUSES[2]).otherwise(STATUSES[1])


def infer(claims: DataFrame, key: str) -> DataFrame:
    """Statuses along parents: ``key, number, status, inferred``. The least favourable of a claim and those it depends on
    counts; it is inferred where one of those is not established. A missing parent or a cycle gives a null status. ``claims`` is read once."""
    ranks = F.array(*map(F.lit, STATUSES))
    ranked = claims.select(key, "number", "parent", F.array_position(ranks, F.col("own")).cast("int").alias("rank"))
    out = chains.follow(ranked, [key], "number", "parent", "rank")
    status = F.get(ranks, F.least("rank", "up") - 1)
    return out.select(key, "number", F.when(F.col("ended"), status).alias("status"), (F.col("ended") & (F.col("up") == 1)).alias("inferred"))


def aggregate(understood: DataFrame, analysed: DataFrame, key: str) -> DataFrame:
    """``key, number, status, inferred`` of the claims that were understood: their elements' statuses, and inference along parents.

    ``understood``: the columns of ``parse``; unknown claims are left out. ``analysed``: key, number, elements. A claim without elements
    has only what it infers; one that depends on several takes the last of them."""
    kept = understood.where("type != 'unknown'").join(analysed.select(key, "number", "elements"), [key, "number"], "left")
    last = F.element_at(F.split("parents", ","), -1)
    parent = F.when(F.col("type") == "dependent", F.coalesce(F.col("parent").cast("string"), last))
    return infer(kept.select(key, "number", parent.alias("parent"), evaluate(F.coalesce("elements", F.array().cast("array<string>"))).alias("own")), key)
