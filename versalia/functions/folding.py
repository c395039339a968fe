"""Folded forms of names: composed, lower case, letters and digits only, diacritics stripped or spelled out."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What letters with diacritics become, each line a replacement and its letters; and those spelled out instead.
STRIPPED = """
a àáâãäåāăą
c çćč
d ďđð
e èéêëēėęě
g ğģ
i ìíîïīįı
k ķ
l łļľ
n ñńņň
o òóôõöøōő
r ř
s śşšș
t ťț
u ùúûüūůűų
y ýÿ
z źżž
ss ß
ae æ
oe œ
th þ
"""
SPELLED = """
ae ä
oe öø
ue ü
aa å
"""


def _table(text: str) -> dict[str, str]:
    return {c: base for base, letters in map(str.split, text.strip().split("\n")) for c in letters}


def folded(name: Column, spell: bool) -> Column:
    """The folded form of a composed name, by built-in functions. Case is lowered letter by letter: a last sigma is like any."""
    table = _table(STRIPPED) | (_table(SPELLED) if spell else {})
    out = F.regexp_replace(F.lower(F.translate(name, "Σ", "σ")), r"[^\p{IsAlphabetic}\p{N}]", "")
    for c, base in table.items():
        if len(base) > 1:
            out = F.replace(out, F.lit(c), F.lit(base))
    single = {c: base for c, base in table.items() if len(base) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


@cache
def composable() -> str:
    """A pattern that finds what composing may change: marks, vowels and finals of Hangul, and characters that stand for others."""
    others = [c for c in map(chr, (*range(0x300, 0xD800), *range(0xE000, 0x30000))) if not unicodedata.combining(c) and unicodedata.normalize("NFC", c) != c]
    return r"[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}" + "".join(f"\\x{{{ord(c):X}}}" for c in others) + "]"


def _ascii(*names: Column) -> Column:
    """Whether all are of ASCII characters alone: a byte each."""
    return F.least(*(F.octet_length(x) == F.length(x) for x in (names[0], *names)))


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the strings in ``columns`` in NFC. Spark has no function for it, so rows that it may change go through Python; no others do."""

    @F.pandas_udf("string")
    def nfc(s):
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    import pandas as pd

    nfc.func.__annotations__ = {"s": pd.Series, "return": pd.Series}
    # nothing before U+0300 composes, and the pattern takes long
    odd = reduce(or_, (F.coalesce(F.col(c).rlike(r"[^\x00-\x{2FF}]") & F.col(c).rlike(composable()), F.lit(False)) for c in columns))
    return df.filter(~odd).unionByName(df.filter(odd).withColumns({c: nfc(c) for c in columns}))


def same_spelling(a: Column, b: Column) -> Column:
    """Whether composed names are equal when diacritics are stripped or spelled out on either side.

    Names that differ by case alone are, and ASCII names have no diacritics; the others are folded.
    """
    left, right = [folded(a, s) for s in (False, True)], [folded(b, s) for s in (False, True)]
    plain = [F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (a, b)]
    return F.when(F.lower(F.translate(a, "Σ", "σ")) == F.lower(F.translate(b, "Σ", "σ")), True).when(_ascii(a, b), plain[0] == plain[1]).otherwise(F.arrays_overlap(F.array(*left), F.array(*right)))
