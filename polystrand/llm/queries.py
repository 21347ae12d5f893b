"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, e8, langid, packing, secret_scan, sharding, simhash, token_file, url_rules
from .common import table, tokenizer_path


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda v: v % 50 == 0, k=5)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "kind", F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8.near_duplicates(table(spark, sf_dir, "embeddings"), like=0.98)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_file.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), vocab=50257, end_id=2)
    return token_file.read_tokens(blocks, digest=True)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ann": op1_ann, "op7_embeddings": op7_embeddings, "op2_secrets": op2_secrets, "op5_urls": op5_urls, "op3_simhash": op3_simhash, "op10_langid": op10_langid, "op4_bpe": op4_bpe, "op6_packing": op6_packing, "op8_sharding": op8_sharding, "op9_token_file": op9_token_file}
ORACLES: dict[str, str] = {}
