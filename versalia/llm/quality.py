"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of anything but ASCII white space; a line counts if it has a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, boxed, let

#: Frequent function words of the languages the corpus is written in.
STOP_WORDS = {
    "en": "the and of to in is that it for on was with be by as are this at from or an not have had his her they you we were which",
    "de": "der die das und in zu den von ist mit sich des auf für nicht ein eine dem im es an auch als bei nach wie aus einer",
    "fr": "de la le et les des en un une du que est dans qui par pour au sur pas plus ne se ce avec il elle son sont aux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin sobre",
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; ``value`` names a metric of :func:`metrics`."""

    value: str
    low: float | None = None
    high: float | None = None

    def fails(self, metric: Column) -> Column:
        below = metric < self.low if self.low is not None else F.lit(False)
        return below | (metric > self.high if self.high is not None else F.lit(False))


#: Texts of fewer words, or with more repetition, fail under any table.
BASE = (Rule("n_words", low=50), Rule("repeat_percent", high=50))
RULES = (
    Rule("n_words", high=200_000),
    Rule("mean_word", low=2.5, high=14.0),
    Rule("symbols_per_word", high=0.25),
    Rule("stop_share", low=0.02),
    Rule("dup_line_share", high=0.5),
)


def _words(text: Column) -> Column:
    """The words of a text, without the empty ends that splitting leaves."""
    return let(
        F.split(text, SPACE),
        lambda p: let(
            F.when(p[0] == "", 1).otherwise(0),
            lambda lead: F.slice(p, lead + 1, F.greatest(F.size(p) - lead - F.when(F.element_at(p, -1) == "", 1).otherwise(0), F.lit(0))),
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice; each counts once.

    The places of windows are sorted by a 64-bit hash of the window; within a run of equal hashes, windows that
    equal a neighbour in the order of words are repeats. O(n log n) a text.
    """

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def repeated(hashes: Column) -> Column:
        def met(x: Column, i: Column) -> Column:
            return (F.get(hashes, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(hashes, i + 1)["h"].eqNullSafe(x["h"]))

        def again(x: Column, i: Column, windows: Column) -> Column:
            return (F.get(windows, i - 1)["w"].eqNullSafe(x["w"])) | (F.get(windows, i + 1)["w"].eqNullSafe(x["w"]))

        # few windows are left; only for them the words are put together, so a clash of hashes can't count
        some = F.sort_array(F.transform(F.filter(hashes, met), lambda x: F.struct(window(x["i"]).alias("w"), x["i"].alias("i"))))
        at = let(some, lambda s: F.transform(F.filter(s, lambda x, i: again(x, i, s)), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(F.flatten(at)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 4, 0).otherwise(let(F.sort_array(hashes), repeated))


def metrics(text: Column) -> Column:
    """Struct of the measures that rules name; null text counts as empty."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})

    def of(t: Column) -> Column:
        blank = F.translate(t, " \t\n\x0b\x0c\r", "")
        return let(
            F.struct(
                _words(t).alias("words"),
                F.length(blank).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("lines"),
            ),
            lambda m: F.struct(
                F.size(m["words"]).cast("long").alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
                F.size(m["lines"]).cast("long").alias("n_lines"),
                (F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long").alias("n_dup_lines"),
                _repeat_words(m["words"]).cast("long").alias("n_repeat_words"),
                F.size(F.filter(m["words"], lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            ),
        )

    return of(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``docs`` (all columns kept) with one struct column ``quality``: the measures and the verdict.

    ``quality`` has n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and
    n_stop_words (long), ``base_failed``, ``kept`` and ``failed`` (the names of the failed
    rules). A null or empty text has zeros everywhere and fails. Rows are judged one by one,
    so ties, repeated rows and empty tables need no rule. A column named ``quality`` is replaced.
    """
    m = F.col("m")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    values = {
        "n_words": m["n_words"],
        "repeat_percent": share(100 * m["n_repeat_words"], m["n_words"]),
        "mean_word": share(m["word_chars"], m["n_words"]),
        "symbols_per_word": share(m["n_symbols"], m["n_words"]),
        "stop_share": share(m["n_stop_words"], m["n_words"]),
        "dup_line_share": share(m["n_dup_lines"], m["n_lines"]),
    }
    failed = lambda table: F.filter(F.array(*(F.when(r.fails(values[r.value]), F.lit(r.value)) for r in table)), lambda x: x.isNotNull())
    told = docs.select(boxed(docs), metrics(F.col(f"`{text}`")).alias("m")).select("row", "m", failed(base).alias("b"), failed(rules).alias("f"))
    verdict = F.struct("m.*", (F.size("b") > 0).alias("base_failed"), (F.size("b") + F.size("f") == 0).alias("kept"), F.concat("b", "f").alias("failed"))
    kept = [c for c in docs.columns if c.lower() != "quality"]
    return told.select(*(F.col(f"row.`{c}`") for c in kept), verdict.alias("quality"))
