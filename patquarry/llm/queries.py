"""Queries over whole tables, one for each operator, and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from patquarry.llm import ann, arrowstream, bpe, licenses, manifest, minhash, packing, periodic, quality, scratch, secrets, sharding, toxicity, vectordup

SHARDS = 40


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    network = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(documents, network)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), SHARDS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return secrets.scan(documents, prime=secrets.dictionary(documents, public_tokenizers.path("byte_bpe_50k.json")))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op7_vectordup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(_embeddings(spark, sf_dir), threshold=0.9)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_embeddings(spark, sf_dir), every=100, k=10)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), size=3, percent=85)


def op10_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.folder(spark, "token-ids")
    return arrowstream.read(arrowstream.write(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.scan(_documents(spark, sf_dir))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return manifest.manifest(documents, manifest.tampered(documents))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_licenses": op2_licenses, "op6_secrets": op6_secrets, "op3_bpe": op3_bpe, "op4_sharding": op4_sharding, "op5_packing": op5_packing, "op7_vectordup": op7_vectordup, "op8_ann": op8_ann, "op9_minhash": op9_minhash, "op10_arrow": op10_arrow, "op11_quality": op11_quality, "op12_periodic": op12_periodic, "op13_manifest": op13_manifest}
ORACLES: dict[str, str] = {"op4_sharding": sharding.ORACLE % {"n": SHARDS}, "op7_vectordup": vectordup.ORACLE, "op9_minhash": minhash.ORACLE, "op11_quality": quality.ORACLE, "op12_periodic": periodic.ORACLE, "op13_manifest": manifest.ORACLE}
