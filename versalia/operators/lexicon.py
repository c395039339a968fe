"""Lexicons as one long table ``(kind, locale, key, value, score, ord)`` and the lookups on it.

Rows with a null kind, locale or key are never found. Where a key has several values, a locale goes before its
language and a kind before the next; of repeated rows of one kind and locale the value is the one that Spark
meets first, so lexicons should be built by ``prepare`` or merged by :func:`merge`. Empty lexicons find nothing.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, locale string, key string, value string, score float, ord int"
#: Candidates below this score are never chosen.
LEAST_SCORE = 1.0


def _languages(locale: str) -> list[str]:
    return list(dict.fromkeys([locale, locale.split("-")[0]]))


def _first(lexicon: DataFrame, locale: str, kinds: list[str]) -> DataFrame:
    """One value per key: the locale before its language, kinds in order."""
    prio = F.lit(None).cast("int")
    n = 0
    for place in _languages(locale):
        for kind in kinds:
            prio = F.coalesce(prio, F.when((F.col("locale") == place) & (F.col("kind") == kind), F.lit(n)))
            n += 1
    return lexicon.withColumn("_p", prio).filter("_p is not null").groupBy("key").agg(F.min_by("value", "_p").alias("value"))


def canonical(lexicon: DataFrame, locale: str) -> DataFrame:
    return _first(lexicon, locale, ["protected-forms", "canonical-map"]).select(F.col("key").alias("lex_key"), F.col("value").alias("lex_value"))


def phrase_table(lexicon: DataFrame, locale: str) -> DataFrame:
    """Phrases come from multiword maps alone; a canonical-map key with a space in it matches nothing."""
    return _first(lexicon, locale, ["multiword-map"]).filter(F.col("key").contains(" ")).select(F.col("key").alias("phrase"), "value")


def best_candidates(lexicon: DataFrame, locale: str) -> DataFrame:
    """Highest score of at least 1 per key; of equal ones the last in its list."""
    good = lexicon.filter((F.col("kind") == "ranked-candidates") & (F.col("locale") == locale) & (F.col("score") >= LEAST_SCORE))
    return good.groupBy(F.col("key").alias("cand_key")).agg(F.max_by("value", F.struct("score", "ord")).alias("cand_value"))


def contains_word(words: DataFrame, lexicon: DataFrame, locale: str, word: str = "word", missing: bool = False) -> DataFrame:
    """Rows whose ``word`` the word sets of the locale have, or with ``missing`` lack. Null words are in no set;
    repeated rows and all columns are kept."""
    listed = lexicon.filter((F.col("kind") == "word-set") & (F.col("locale") == locale)).select(F.col("key").alias(word))
    return words.join(listed, word, "left_anti" if missing else "left_semi")


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Later lexicons win per (kind, locale, key); lists of candidates are replaced as a whole."""
    union = first.withColumn("_n", F.lit(0))
    for n, other in enumerate(others, 1):
        union = union.unionByName(other.withColumn("_n", F.lit(n)))
    rows = F.struct("value", "score", "ord")
    per = union.groupBy("kind", "locale", "key", "_n").agg(F.sort_array(F.collect_list(rows)).alias("rows"))
    kept = per.groupBy("kind", "locale", "key").agg(F.max_by("rows", "_n").alias("rows"))
    return kept.select("kind", "locale", "key", F.explode("rows").alias("r")).select("kind", "locale", "key", "r.*")
