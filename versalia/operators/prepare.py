"""Lexicons from source records ``(rec_idx, canonical, aliases, score)``, by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import composed, same_spelling

KINDS = ("canonical-map", "protected-forms", "multiword-map", "word-set", "ranked-candidates")


def _different(records: DataFrame, *by: str, **also: Column) -> DataFrame:
    """The different ``(canonical, alias)`` of the records, by more columns if told, before anything is folded; ``alias`` is
    null for the canonical form itself.

    Names are made to depend on the count, as filters on grouping columns would be moved below, to every record.
    """
    itself, aliases = F.array(F.lit(None).cast("string")), F.array_compact(F.coalesce("aliases", F.array().cast("array<string>")))
    given = records.select("rec_idx", "score", "canonical", F.explode(F.concat(itself, aliases)).alias("alias"))
    names = given.groupBy("canonical", "alias", *by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in also.items()))
    return names.select(*by, *also, *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("canonical", "alias")))


def lookup_entries(names: DataFrame) -> DataFrame:
    """``names(canonical, alias, ...)`` with ``(key, value)``: the canonical form where ``alias`` is null; aliases that are
    spelling variants lead to it, others to themselves if they carry case of their own, else nowhere (no row).

    Folding costs most, so names should be brought down to different ones first.
    """
    own = names.filter("alias is null").withColumn("key", F.lower("canonical")).withColumn("value", F.col("canonical"))
    alias = names.filter("alias is not null")
    both = composed(alias.select("*", F.col("canonical").alias("c"), F.col("alias").alias("a")), "c", "a")
    variant = same_spelling(F.col("a"), F.col("c"))
    kept = both.filter((F.lower("alias") != F.col("alias")) | variant).withColumn("key", F.lower("alias")).withColumn("value", F.when(variant, F.col("canonical")).otherwise(F.col("alias")))
    return own.unionByName(kept.drop("c", "a"))


def _last(entries: DataFrame) -> DataFrame:
    """The last record wins; within a record the greatest value."""
    return entries.groupBy("key").agg(F.max_by("value", F.struct("rec_idx", "value")).alias("value"))


def _last_entries(records: DataFrame) -> DataFrame:
    """``(rec_idx, key, value)`` of the last record of each pair of names; no other can win its key."""
    return lookup_entries(_different(records, rec_idx=F.max("rec_idx")))


def build(records: DataFrame, kind: str) -> DataFrame:
    """``(key, value, score, ord)`` of a lexicon kind, from ``records(rec_idx, canonical, aliases, score)``.

    The record of the greatest ``rec_idx`` (any type that has an order) wins a key. Null canonical forms and aliases
    give nothing, repeated records count once, an empty table gives an empty lexicon; other columns are not read.
    """
    records = records.filter("canonical is not null")
    none = [F.lit(None).cast("float").alias("score"), F.lit(0).alias("ord")]
    if kind == "canonical-map":
        return _last(_last_entries(records)).select("key", "value", *none)
    if kind == "multiword-map":
        return _last(_last_entries(records).filter(F.col("key").contains(" ") & F.col("value").contains(" "))).select("key", "value", *none)
    if kind == "protected-forms":
        forms = records.groupBy("canonical").agg(F.max("rec_idx").alias("rec_idx"))
        cased = forms.filter(F.col("canonical").rlike(r"\p{IsLowercase}") & F.col("canonical").rlike(r"\p{IsUppercase}"))
        return _last(cased.select("rec_idx", F.lower("canonical").alias("key"), F.col("canonical").alias("value"))).select("key", "value", *none)
    if kind == "word-set":
        words = records.select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("w")).filter("w is not null").select(F.lower("w").alias("key")).distinct()
        return words.select("key", F.lit(None).cast("string").alias("value"), *none)
    if kind == "ranked-candidates":
        names = _different(records, "score")
        by = Window.partitionBy("key").orderBy((-F.col("score")).asc_nulls_first(), "value")
        entries = lookup_entries(names).withColumn("before", F.lag("value").over(by))
        fresh = entries.filter("before is null or before <> value")  # equal neighbours only
        return fresh.select("key", "value", F.col("score").cast("float").alias("score"), (F.row_number().over(by) - 1).alias("ord"))
    raise ValueError(f"unknown kind: {kind}")
