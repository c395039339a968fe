"""Locale-aware case functions of single words, for workers that meet each word once. ``casing`` has them as expressions."""

from __future__ import annotations

import unicodedata

from .profiles import Profile

TURKIC = ("tr", "az")
HYPHENS, APOSTROPHES = "-‐‑", "'’"
DOT_ABOVE = "̇"
#: Lithuanian keeps the dot of i and j below an accent. Fixed values.
_ACCENTED = {"Ì": "i̇̀", "Í": "i̇́", "Ĩ": "i̇̃"}
_DOTTED, _ABOVE = "IJĮ", 230


def lower(word: str, language: str) -> str:
    if language in TURKIC:
        word = word.replace("I" + DOT_ABOVE, "i").replace("İ", "i").replace("I", "ı")
    elif language == "lt" and not word.islower():
        out = []
        for c, after in zip(word, word[1:] + " ", strict=True):
            out.append(_ACCENTED.get(c) or (c.lower() + DOT_ABOVE if c in _DOTTED and unicodedata.combining(after) == _ABOVE else c))
        word = "".join(out)
    return word.lower()


def upper(text: str, language: str) -> str:
    if language in TURKIC:
        return text.replace("i", "İ").upper()
    if language == "lt":
        return "".join(c for c, before in zip(text, " " + text, strict=False) if c != DOT_ABOVE or before not in "ijįIJĮ").upper()
    if language == "el":
        plain = unicodedata.normalize("NFD", text)
        return unicodedata.normalize("NFC", "".join(c for c in plain if c not in "́̀͂̓̔ͅ")).upper() if plain != text else text.upper()
    return text.upper()


def capitalize(word: str, language: str) -> str:
    """The first character in title form, the rest lower."""
    low = lower(word, language)
    if language in TURKIC and low[:1] == "i":
        return "İ" + low[1:]
    if language == "nl" and low[:2] == "ij":
        return "IJ" + low[2:]
    if language == "lt" and low[1:2] == DOT_ABOVE:
        return low[0].upper() + low[2:]
    return low[:1].title() + low[1:]


def upper_first(word: str, language: str) -> str:
    """The first grapheme in upper case, the rest as it is."""
    n = 1
    while n < len(word) and (unicodedata.combining(word[n]) or unicodedata.category(word[n]) in ("Mn", "Me", "Mc") or word[n] == "‍"):
        n += 1
    return upper(word[:n], language) + word[n:]


def titlecase(word: str, language: str, profile: Profile) -> str:
    """Each part capitalized. Hyphens part, and so do apostrophes after a lone letter or an elided article; the article stays lower."""
    out, part = "", ""
    for k, c in enumerate(word):
        if c in APOSTROPHES:
            elided = part.lower() in profile.elisions
            tail = word[k + 1 :]
            ends = [x for x in map(tail.find, HYPHENS + APOSTROPHES) if x >= 0]
            lone = sum(map(str.isalpha, part)) == 1 and tail[: min(ends, default=len(tail))].lower() not in profile.contraction_tails
            if elided or lone:
                out += (lower(part, language) if elided else capitalize(part, language)) + c
                part = ""
                continue
        elif c in HYPHENS:
            out += capitalize(part, language) + c
            part = ""
            continue
        part += c
    return out + capitalize(part, language)
