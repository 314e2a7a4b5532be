"""A pipeline from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table. All but the last return the columns of ``docs``, whose
every row they decide on; a driver may store each result and hand it to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patquarry.llm import minhash, packing, scratch, secrets, sieve, toxicity

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled rows of ``docs``, scores below one half."""
    network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, network)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose sets of five-word shingles are 0.8 alike or more.

    Rows without an id have no group and stay. Of rows that repeat a kept id one stays for each sequence of words (A-Z lower-cased, whatever the white
    space): that of the smallest text, a null one being the smallest, then of the smallest other columns as JSON. All rows of an id that
    is not kept go. Texts are shuffled only of rows whose id may be dropped or repeated; others stay where they are read.
    """
    decided = minhash.near_duplicates(docs, size=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = scratch.table(decided, "decided-ids")
    odd = decided.where("not kept or n > 1")
    asked, stay = sieve.sifted(docs, sieve.table(odd.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "odd-ids"), "doc_id")
    # the exact answer for what the sieve holds back
    kept = decided.where("kept").select("doc_id", "n").hint("merge")
    held = asked.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(kept, "doc_id")
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), "[ \t\n\x0b\f\r]+", " "))
    again = held.where("n > 1").groupBy("doc_id", F.sha2(words, 256).alias("words")).agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return stay.unionByName(held.where("n = 1").select("row.*")).unionByName(again.select("row.*")).unionByName(asked.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return secrets.redact(docs, prime=secrets.dictionary(docs, public_tokenizers.path("byte_bpe_50k.json")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot state a trained network or the packing; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs, path = scratch.stored(stage(spark, docs, sf_dir), name)
        if last:
            scratch.delete(spark, last)  # the next stage's table is stored whole
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
