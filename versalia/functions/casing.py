"""Locale-aware case functions and word classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import Profile

TURKIC = ("tr", "az")
HYPHENS = "-‐‑"


#: Accents above, before which Lithuanian keeps the dot of i and j.
ABOVE = "[\u0300-\u0314\u033D-\u0344\u0346\u034A-\u034C\u0350-\u0352\u0357\u035B]"


def lower(word: Column, language: str) -> Column:
    if language == "lt":
        for c, dotted in (("Ì", "i\u0307\u0300"), ("Í", "i\u0307\u0301"), ("Ĩ", "i\u0307\u0303")):
            word = F.replace(word, F.lit(c), F.lit(dotted))
        return F.lower(F.regexp_replace(word, f"([IJĮ])(?={ABOVE})", "$1\u0307"))
    return F.lower(F.translate(F.replace(word, F.lit("I\u0307"), F.lit("i")), "İI", "iı")) if language in TURKIC else F.lower(word)


def upper(word: Column, language: str) -> Column:
    return F.upper(F.replace(word, F.lit("i"), F.lit("İ"))) if language in TURKIC else F.upper(word)


def capitalize(word: Column, language: str) -> Column:
    """The first character in title form, the rest lower."""
    low = lower(word, language)
    first, rest = F.left(low, F.lit(1)), F.substr(low, F.lit(2))
    if language == "lt":
        rest = F.regexp_replace(rest, "^\u0307", "")
    if language in TURKIC:
        return F.when(first == "i", F.concat(F.lit("İ"), rest)).otherwise(F.concat(F.initcap(first), rest))
    plain = F.when(first == "ß", F.concat(F.lit("Ss"), rest)).otherwise(F.concat(F.initcap(first), rest))
    return F.when(low.startswith("ij"), F.concat(F.lit("IJ"), F.substr(low, F.lit(3)))).otherwise(plain) if language == "nl" else plain


def upper_first(word: Column, language: str) -> Column:
    return F.concat(upper(F.left(word, F.lit(1)), language), F.substr(word, F.lit(2)))


def titlecase(word: Column, language: str, profile: Profile) -> Column:
    """Each part between hyphens capitalized; a lone letter or elided article before an apostrophe is a part of its own.

    Only the first apostrophe between hyphens is looked at.
    """

    def part(x: Column) -> Column:
        head, mark, tail = (F.regexp_extract(x, r"(?s)^([^'’]+)(['’])(.+)$", i) for i in (1, 2, 3))
        split = F.concat(capitalize(head, language), mark, capitalize(tail, language))
        lone = (F.length(F.regexp_replace(head, r"\P{IsAlphabetic}", "")) == 1) & ~F.regexp_extract(lower(tail, language), "^[^'’]*", 0).isin(*profile.contraction_tails or [""])
        out = F.when(lone, split).otherwise(capitalize(x, language))
        if profile.elisions:
            elided = F.concat(lower(head, language), mark, capitalize(tail, language))
            out = F.when(lower(head, language).isin(*profile.elisions), elided).otherwise(out)
        return F.when(x.rlike("['’]"), out).otherwise(capitalize(x, language))

    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(f"[^{HYPHENS}]+|[{HYPHENS}]"), 0), part), "")


def acronym(word: Column) -> Column:
    """At least two letters, all of them upper."""
    letters = F.regexp_replace(word, r"\P{IsAlphabetic}", "")
    return (F.length(letters) >= 2) & ~letters.rlike(r"\P{IsUppercase}")


def mixed_case(word: Column) -> Column:
    return word.rlike(r"\p{IsLowercase}") & word.rlike(r"\p{IsAlphabetic}.*\p{IsUppercase}")


def simple_capitalized(word: Column) -> Column:
    return word.rlike(r"^\p{IsUppercase}.*\p{IsAlphabetic}") & ~F.substr(word, F.lit(2)).rlike(r"\p{IsUppercase}")


def single_letter(word: Column) -> Column:
    return word.rlike(r"^\p{IsAlphabetic}$")
