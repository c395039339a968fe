"""Tokens: maximal white space, words with inner connectors, and single marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"(?s)\p{IsWhite_Space}+|[\p{IsAlphabetic}\p{N}]+(?:['’\-‐‑][\p{IsAlphabetic}\p{N}]+)*|."
#: Marks beyond ASCII that count as punctuation; any other single mark is a symbol.
PUNCTUATION = "“”„«»…—–。！？｡؟।॥、，："


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def kind_of(raw: Column) -> Column:
    """word, space, punct or symbol. The commonest tokens are told apart without a pattern."""
    return (
        F.when(raw.isin(" ", "\n"), "space").when(F.left(raw, F.lit(1)).between("a", "z"), "word").when(raw.isin(".", ","), "punct")
        .when(raw.rlike(r"^[\p{IsAlphabetic}\p{N}]"), "word").when(raw.rlike(r"^\p{IsWhite_Space}"), "space")
        .when(raw.rlike(rf"^[\p{{Punct}}{PUNCTUATION}]$"), "punct").when(raw.isNotNull(), "symbol")
    )


def tokenize(docs: DataFrame, key: str, text: str, outer: bool = False) -> DataFrame:
    """``(key, pos, raw, kind)``; with ``outer``, texts without a token keep one row of nulls.

    Null and empty texts have no token; rows of equal or null keys give their tokens under that key; an empty table
    gives none; other columns are not read.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    return docs.select(F.col(key).alias("key"), explode(tokens_of(F.col(text))).alias("pos", "raw")).withColumn("kind", kind_of(F.col("raw")))


def reconstruct(tokens: DataFrame, text: str = "text") -> DataFrame:
    """``(key, output)``: token texts joined in order of ``pos``, a row per different key (null is one). Null texts add nothing."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", text)))
    return tokens.groupBy("key").agg(F.array_join(F.transform(ordered, lambda t: t[text]), "").alias("output"))
