"""The corpus pipeline: language identification, near-duplicate removal, secret masking and
packing, each stage over all that the one before it kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet
in the shared folder and read again, so a lost executor repeats one stage at most.
Defined cases: an empty table passes through every stage; with no labelled language
nothing can be identified, and every document goes in the first stage; null, empty and
letterless texts go there too; texts of any length are read whole; of equal or similar texts
the least doc_id stays, and rows without a doc_id all stay, until packing gives each its
pieces; rows that repeat doc_id and text are one; extra columns of any name pass through
to packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polystrand.llm import langid, packing, secret_scan, simhash
from polystrand.llm.common import staged, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letter, or no language that is likely enough."""
    return langid.keep_identified(docs, langid.fit(docs, ~langid.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id. Documents link at a
    similarity of 0.8 or more of their five-word shingles: links of SimHash fingerprints are
    verified, and those that are too far apart for it are found by prefixes."""
    return simhash.keep_first(docs, width=5, like=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secret_scan.mask_secrets(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece, as the packing query returns them."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language id", language_id), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", best_fit)]

#: The stages learn, hash and tokenise, which SQL can't express; a brute-force version is
#: in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return docs
