"""The registered ``opN_<name>`` queries: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, mixing, oracle, packing, quality, secrets, simhash, toxicity, vectors, warc


TOKENIZER, RANKS, END_OF_TEXT = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 50256
#: A conversation whose texts hold the template's control strings.
PLANTED = r"""
SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep_text=False, decoded="decoded")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = packing.token_ids(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return packing.summary(packing.written(packing.pack(ids, END_OF_TEXT)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "quality.*")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(PLANTED)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_chat(rows))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_mixing, op4_bpe, op5_packing, op6_secrets, op7_vectors, op8_quality, op9_chat, op10_warc)}

ORACLE_SQL = {"op7_vectors": oracle.OP7, "op8_quality": oracle.OP8, "op9_chat": oracle.OP9, "op10_warc": oracle.OP10}
