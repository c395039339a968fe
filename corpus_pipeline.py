"""Corpus pipeline: reject toxic documents, keep one of near copies, mask secrets, mix sources, encode.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as
the next one's ``docs``.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalia.llm import bpe, mixing, secrets, simhash, toxicity
from versalia.llm.common import settled
from versalia.llm.queries import TOKENIZER, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``docs``, doesn't predict toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document of the smallest id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` following."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or repeated."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    told = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return told.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_of_copies),
    ("secret scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't state the classifier, the fingerprints or the rounding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; what a stage needed besides its result is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
