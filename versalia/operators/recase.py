"""Recasing in one pass: each text is read, decided and written by one worker, and nothing is shuffled.

Texts don't depend on each other, so a batch of them is one array of token numbers. What the decisions need
(sentences, neighbours, separators, segments, edges) are array operations over all texts of the batch, and what
depends on the word alone (classes, cased forms, lexicon values) is computed once for each different
word that a worker meets. ``relational`` states the same as joins and windows; tests hold the two
together, and lexicons too large to send to workers go by it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from string import punctuation
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.profiles import BUILTIN_AMBIGUOUS, BUILTIN_FORMS, BUILTIN_PHRASES, GERMAN_AMBIGUOUS, GERMAN_ARTICLES, GERMAN_NOUN_ENDS, profile
from ..options import CaseMode, CaseOptions, GermanMode, SeparatorStyle
from . import lexicon as L
from . import relational
from .tokens import PUNCTUATION

#: Characters of texts that are decided at once; a longer text is a batch of its own.
AT_ONCE = 1 << 18
#: Different tokens, and characters of them, that a worker remembers over all languages; beyond it starts anew.
REMEMBERED, REMEMBERED_CHARS = 200_000, 1 << 22
#: Rows that are sent to a worker at once: texts are long, and the session's default is 10,000.
BATCH_ROWS = 1000
#: Rows and characters of a lexicon that are sent to every worker. Larger ones are first cut to the words that occur.
SENT_ROWS, SENT_CHARS = 400_000, 1 << 24
#: Names of rules; numbers are places in this list, 0 is no rule.
RULES = ["", "CanonicalLexicon", "AcronymPreserved", "MixedCasePreserved", "ProperNounPreserved", "GermanNoun", "SentenceStart", "TitleEdge", "Capitalized", "SmallWord", "AlwaysCapitalized", "Lowercased", "WhitespaceCollapsed", "SubtitleSeparator", "MultiwordLexicon"]
NUMBER = {name: n for n, name in enumerate(RULES)}
RANKS = [relational.RANK.get(name, 0) for name in RULES]

MARKS = {*punctuation, *PUNCTUATION}
_LATIN = "0-9A-Za-zªµºÀ-ÖØ-öø-ÿ²³¹¼-¾"
_LATIN_TOKENS = re.compile(rf"(?s)[\t-\r \x85\xa0]+|[{_LATIN}]+(?:['\-][{_LATIN}]+)*|.")


def token_finder() -> Callable[[str], list[str]]:
    """Cuts a text into its tokens. Texts of the first 256 code points have a pattern without property classes."""
    import regex

    others = regex.compile(r"(?s)\p{White_Space}+|[\p{Alphabetic}\p{N}]+(?:['’\-‐‑][\p{Alphabetic}\p{N}]+)*|.").findall
    latin = _LATIN_TOKENS.findall

    def found(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return others(text)
        return latin(text)

    return found


# what is known of a token, a bit each
(WORD, SPACE, PUNCT, SYMBOL, ALPHA, CAPS, UP, STARTS_UP, STARTS_NUM, LONG, SMALL, ACRONYM, MIXED, SIMPLE, SINGLE, TITLE_ABBR, NUMERIC_ABBR, TRAILING_ABBR, DIGITS, ONE, TERMINAL, WIDE, ELLIPSIS,
 DOT, SEPARATOR, COLON, HYPHEN, LINE, KNOWN, UNSURE, ALWAYS, NOUN, ARTICLE, ADVERB, CASED, OPENS, BEST, AS_BLANK, AS_FEED) = (1 << k for k in range(39))
# forms of a token, by place
RAW, LOW, CAP, SHOWN, EDGE, FORM, GERMAN, LIFTED = range(8)
FORMS = 8
#: Tokens that every table begins with: the mark between texts, nothing, a space, a line feed, the rewritten separator.
FIXED = 5
NOTHING, BLANK, FEED, REWRITTEN = (k * FORMS for k in range(1, FIXED))


def _checksum(key: str) -> int:
    return crc32(key.encode())


class Entries:
    """Strings by strings, in arrays in order of the keys' checksums: every worker has a lexicon in memory, and a dict takes several times as much."""

    def __init__(self, entries: dict[str, str | None]) -> None:
        import pyarrow as pa

        keys = sorted(entries, key=_checksum)
        self.sums = array("I", map(_checksum, keys))
        self.keys, self.values = pa.array(keys, pa.string()), pa.array([entries[k] for k in keys], pa.string())

    def __len__(self) -> int:
        return len(self.sums)

    def place(self, key: str) -> int | None:
        told = _checksum(key)
        n = bisect_left(self.sums, told)
        while n < len(self.sums) and self.sums[n] == told:
            if self.keys[n].as_py() == key:
                return n
            n += 1
        return None

    def __contains__(self, key: str) -> bool:
        return self.place(key) is not None

    def get(self, key: str) -> str | None:
        n = self.place(key)
        return None if n is None else self.values[n].as_py()


class Dictionary:
    """A lexicon in the form that workers look things up in, for one locale."""

    def __init__(self, forms: dict[str, str], phrases: dict[str, str], best: dict[str, str]) -> None:
        self.forms, self.phrases, self.best = Entries(forms), Entries(phrases), Entries(best)
        self.openers = Entries(dict.fromkeys(k.split(" ")[0] for k in phrases))
        self.longest = max((k.count(" ") + 1 for k in phrases), default=0)


NO_WORDS = Dictionary({}, {}, {})


class Table(dict):
    """Numbers of tokens, with what is known of each; for one worker, options and lexicon.

    ``text`` has ``FORMS`` strings a token. ``flags`` and ``sizes`` are arrays that follow it when they are asked for.
    """

    def __init__(self, options: CaseOptions, lexicon: Dictionary) -> None:
        import numpy as np
        import regex

        self.options, self.lexicon, self.lang = options, lexicon, options.language
        self.title = options.mode is CaseMode.TITLE
        self.profile = p = profile(self.lang)
        known = options.preserve_known_proper_nouns
        self.known = known
        self.has_phrases = known and bool(BUILTIN_PHRASES or lexicon.phrases)
        self.openers = {k.split(" ")[0] for k in BUILTIN_PHRASES} if known else set()
        self.longest = max(lexicon.longest, *(k.count(" ") + 1 for k in BUILTIN_PHRASES)) if known else 0
        self.nouns = self.lang == "de" and options.german_mode >= GermanMode.BALANCED
        self.best = bool(lexicon.best) and self.nouns and options.german_mode is GermanMode.AGGRESSIVE
        self.chars = 0
        self.searched = known and bool(lexicon.forms or lexicon.phrases)
        #: bits of single words, by their lower-case form
        self.listed: dict[str, int] = {}
        always = ["i", "i'm", "i'll", "i've", "i'd"] if self.lang == "en" and not self.title else []
        lists = [(SMALL, (*p.stop, *p.particles)), (TITLE_ABBR, p.title), (NUMERIC_ABBR, p.numeric), (TRAILING_ABBR, p.trailing), (ALWAYS, (*always, *(x.replace("'", "’") for x in always[1:])))]
        lists += [(OPENS, self.openers), (KNOWN, BUILTIN_FORMS if known else ()), (UNSURE, [x for x in BUILTIN_AMBIGUOUS if known and x not in lexicon.forms])]
        lists += [(ARTICLE, GERMAN_ARTICLES), (ADVERB, GERMAN_AMBIGUOUS)] if self.nouns else []
        for bit, words in lists:
            for w in words:
                self.listed[w] = self.listed.get(w, 0) | bit
        has = lambda pattern: regex.compile(pattern).search
        self.lower, self.upper = has(r"\p{Lowercase}"), has(r"\p{Uppercase}")
        self.starts_num, self.space, self.is_word = has(r"^\p{N}"), has(r"^\p{White_Space}"), has(r"^[\p{Alphabetic}\p{N}]")
        self.letters = regex.compile(r"\P{Alphabetic}").sub
        self.mixed, self.simple = has(r"(?s)\p{Alphabetic}.*\p{Uppercase}"), has(r"(?s)^\p{Uppercase}.*\p{Alphabetic}")
        fixed = ["", "", " ", "\n", options.separators.value or ""]
        self.text = [x for x in fixed for _ in range(FORMS)]
        self.bits = [0] * len(fixed)
        self._flags, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    @property
    def flags(self):
        import numpy as np

        if len(self._flags) < len(self.bits):
            self._flags = np.append(self._flags, np.array(self.bits[len(self._flags) :], np.int64))
        return self._flags

    @property
    def sizes(self):
        """Bytes of each string in ``text``."""
        import numpy as np

        if len(self._sizes) < len(self.text):
            new = self.text[len(self._sizes) :]
            self._sizes = np.append(self._sizes, np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in new), np.int32, len(new)))
        return self._sizes

    def __missing__(self, raw: str) -> int:
        n = self[raw] = len(self.bits)
        bits, forms = self.described(raw)
        self.bits.append(bits)
        self.text += forms
        self.chars += len(raw)
        return n

    def phrase(self, key: str) -> str | None:
        return self.lexicon.phrases.get(key) if key in self.lexicon.phrases else BUILTIN_PHRASES.get(key)

    def opens(self, low: str) -> bool:
        return low in self.openers or (self.searched and low in self.lexicon.openers)

    def classes(self, raw: str) -> int:
        """Bits that follow from the characters of a word. Most words are letters of one case, with or without a capital."""
        if raw.isalpha():
            if raw.islower():
                return WORD | ALPHA | (SINGLE | ONE if len(raw) == 1 else 0)
            if raw[0].isupper() and raw[1:].islower():
                return WORD | ALPHA | UP | STARTS_UP | SIMPLE
        elif raw.isascii() and raw.isdigit():
            return WORD | STARTS_NUM | DIGITS | ONE * (len(raw) == 1)
        letters = self.letters("", raw)
        alpha, up, small = bool(letters), bool(self.upper(raw)), bool(self.lower(raw))
        bits = WORD | ALPHA * alpha | CAPS * (alpha and not small) | UP * up | STARTS_UP * bool(self.upper(raw[0])) | STARTS_NUM * bool(self.starts_num(raw))
        bits |= LONG * (alpha and not small and len(letters) >= 5) | ACRONYM * (len(letters) >= 2 and all(map(self.upper, letters)))
        bits |= MIXED * (small and bool(self.mixed(raw))) | SIMPLE * (bool(self.simple(raw)) and not self.upper(raw[1:]))
        return bits | (ONE | SINGLE * alpha if len(raw) == 1 else 0)

    def described(self, raw: str) -> tuple[int, list[str]]:
        """Bits and forms of a token."""
        if not self.is_word(raw):
            if self.space(raw):
                return SPACE | LINE * ("\n" in raw) | AS_BLANK * (raw == " ") | AS_FEED * (raw == "\n"), [raw] * FORMS
            bits = PUNCT if raw in MARKS else SYMBOL
            if bits == PUNCT:
                bits |= TERMINAL * (raw in relational.TERMINALS) | WIDE * (raw in relational.WIDE_TERMINALS) | ELLIPSIS * (raw == "…") | DOT * (raw == ".")
                bits |= SEPARATOR * (raw in relational.SEPARATORS) | COLON * (raw == ":") | HYPHEN * (raw == "-")
            return bits, [raw] * FORMS
        lang, low = self.lang, W.lower(raw, self.lang)
        bits = self.classes(raw) | self.listed.get(low, 0) | CASED * (raw != low)
        if self.searched:
            bits |= KNOWN * (low in self.lexicon.forms) | OPENS * (low in self.lexicon.openers)
        capital = W.capitalize(raw, lang)
        low, capital = raw if low == raw else low, raw if capital == raw else capital  # one string for equal ones
        forms = [raw, low, capital, raw, raw, raw, raw, raw]
        if self.title:
            forms[SHOWN] = capital if raw.isalnum() else W.titlecase(raw, lang, self.profile)
            forms[EDGE] = W.upper_first(forms[SHOWN], lang)
        if bits & KNOWN:
            forms[FORM] = self.lexicon.forms.get(low) if low in self.lexicon.forms else BUILTIN_FORMS[low]
            bits |= OPENS * self.opens(W.lower(forms[FORM], lang))
        if self.nouns:
            bits |= ADVERB * (len(low.encode()) <= 2) | NOUN * low.endswith(GERMAN_NOUN_ENDS)
            bits |= BEST * (self.best and low in self.lexicon.best)
            forms[GERMAN] = self.lexicon.best.get(low) if bits & BEST else capital
            forms[LIFTED] = W.upper_first(forms[GERMAN], lang)
        return bits, forms


@dataclass
class Decided:
    """A batch of texts after the decisions, an entry per token; texts lie between marks (token 0)."""

    tokens: object
    flags: object
    marks: object  # places of the marks: text k lies between marks k and k + 1
    out: object  # place of each token's text in the table
    rule: object
    start: object  # first token of the phrase or separator that a token belongs to, else its own place
    phrases: dict[int, str]
    boundary: object
    sentence: object
    first: object  # first word of its sentence
    shouting: object
    title_like: object
    separators: object  # places of subtitle separators


def decide(table: Table, texts: list[list[int]]) -> Decided:
    """The decisions for texts given as numbers of their tokens."""
    import numpy as np

    o, lang = table.options, table.lang
    title = o.mode is CaseMode.TITLE
    flat: list[int] = [0]
    for ids in texts:
        flat += ids
        flat.append(0)
    t = np.array(flat, np.int32)
    f = table.flags[t]  # all tokens are in the table by now
    n = len(t)
    marks = np.flatnonzero(t == 0)
    is_ = lambda bits, x=None: ((f if x is None else x) & bits) != 0
    at = np.flatnonzero(is_(WORD))
    near = lambda places, by: f[np.clip(places + by, 0, n - 1)] * ((places + by >= 0) & (places + by < n))

    # sentence boundaries, at terminal marks only
    ends = np.flatnonzero(is_(TERMINAL))
    here, p1, n1 = f[ends], near(ends, -1), near(ends, 1)
    following = np.searchsorted(at, ends)
    word_next = np.append(at, n)[following]
    same = word_next < marks[np.searchsorted(marks, ends)]
    ahead = np.where(same, f[np.minimum(word_next, n - 1)], 0)
    next_up, next_number = is_(STARTS_UP, ahead), is_(STARTS_NUM, ahead) & ~is_(STARTS_UP, ahead)
    dot, dots = is_(DOT, here), is_(DOT, n1)
    stop = np.select([is_(TITLE_ABBR, p1), is_(NUMERIC_ABBR, p1), is_(TRAILING_ABBR, p1)], [False, ~next_number, next_up], ~is_(SINGLE, p1))
    bounds = np.select(
        [is_(WIDE, here), is_(ELLIPSIS, here) | (dot & (is_(DOT, p1) | dots)), dot & is_(WORD, n1), dot & is_(WORD, p1)],
        [True, ~dots & next_up, False, stop], True,
    ).astype(bool)
    boundary = np.zeros(n, bool)
    boundary[ends[bounds]] = True
    opens = t == 0
    opens[1:] |= boundary[:-1]
    sentence = np.cumsum(opens, dtype=np.int32) - 1
    many = int(sentence[-1]) + 1

    # words: what they are in their sentence
    wf, ws = f[at], sentence[at]
    count = lambda mask: np.bincount(ws[mask], minlength=many)
    alpha, caps, up, small = is_(ALPHA, wf), is_(CAPS, wf), is_(UP, wf), is_(SMALL, wf)
    n_alpha, n_caps = count(alpha), count(alpha & caps)
    loud = (n_caps > 0) & ((n_caps == n_alpha) | ((count(alpha & (caps | small)) == n_alpha) & (count(alpha & is_(LONG, wf)) > 0)))
    lead = np.flatnonzero(alpha)
    rest = alpha.copy()
    rest[lead[np.diff(ws[lead], prepend=-1) != 0]] = False
    titled = (count(rest & ~(up | small)) == 0) & (count(rest & up) >= 2)
    shouting, title_like = loud[ws], titled[ws]
    first = np.diff(ws, prepend=-1) != 0

    # separators
    seps = np.flatnonzero(is_(SEPARATOR))
    here, p1, n1 = f[seps], near(seps, -1), near(seps, 1)
    left, right = np.where(is_(SPACE, p1), near(seps, -2), p1), np.where(is_(SPACE, n1), near(seps, 2), n1)
    both = lambda bits: is_(bits, left) & is_(bits, right)
    spaced, attached = is_(SPACE, p1) & is_(SPACE, n1), ~is_(HYPHEN, here) & is_(WORD, p1) & is_(WORD, n1)
    good = both(WORD) & ~both(DIGITS) & ~both(ONE) & np.where(is_(COLON, here), is_(SPACE, n1), spaced | attached)
    seps = seps[good]

    cap = first.copy()
    if o.capitalize_after_subtitle and o.mode is not CaseMode.SENTENCE and len(seps):
        cap[np.searchsorted(at, seps)] = True  # a word stands after a separator
    text_of = np.searchsorted(marks, at)
    plain = ~shouting & ~title_like
    segment = np.cumsum(is_(PUNCT | SYMBOL), dtype=np.int32)[at] if lang == "de" or table.has_phrases else None

    # the cascade: later lines come first
    form = np.full(len(at), LOW, np.int32)
    rule = np.full(len(at), NUMBER["SmallWord" if title else "Lowercased"], np.int8)

    def take(mask, which, name: str) -> None:
        form[mask] = which[mask] if isinstance(which, np.ndarray) else which
        rule[mask] = NUMBER[name]

    edge = (np.diff(text_of, prepend=-1) != 0) | (np.diff(text_of, append=-1) != 0) if title else None
    if title:
        take(~small, SHOWN, "Capitalized")
        take(edge, EDGE, "TitleEdge")
        take(cap, EDGE, "SentenceStart")
    else:
        if lang == "en":
            take(is_(ALWAYS, wf), CAP, "AlwaysCapitalized")
        take(cap, CAP, "SentenceStart")
    if lang == "de" and o.german_mode >= GermanMode.BALANCED:
        follows = np.zeros(len(at), bool)
        follows[1:] = is_(ARTICLE, wf[:-1]) & (segment[1:] == segment[:-1]) & (text_of[1:] == text_of[:-1])
        noun = is_(BEST, wf) | (~is_(ADVERB, wf) & (is_(NOUN, wf) | follows))
        take(noun, np.where(cap | edge if title else cap, LIFTED, GERMAN).astype(np.int32), "GermanNoun")
    if o.preserve_existing_capitals and not title:
        take(up & ~cap & plain & is_(SIMPLE, wf), RAW, "ProperNounPreserved")
    if o.preserve_mixed_case:
        take(up & is_(MIXED, wf), RAW, "MixedCasePreserved")
    if o.preserve_acronyms:
        take(up & ~shouting & is_(ACRONYM, wf), RAW, "AcronymPreserved")
    if o.preserve_known_proper_nouns:
        sure = True if title else is_(CASED, wf) & plain
        take(is_(KNOWN, wf) & (~is_(UNSURE, wf) | sure), FORM, "CanonicalLexicon")

    out = t * FORMS
    out[at] += form
    rules = np.zeros(n, np.int8)
    rules[at] = rule
    start = np.arange(n, dtype=np.int32)
    spaces = np.flatnonzero(is_(SPACE))
    if o.normalize_whitespace and len(spaces):
        outside = (t[spaces - 1] == 0) | (t[spaces + 1] == 0)
        inner = BLANK if o.mode.flattens_lines else np.where(is_(LINE, f[spaces]), FEED, BLANK)
        out[spaces] = np.where(outside, NOTHING, inner)
    if o.separators is not SeparatorStyle.PRESERVE and len(seps):
        out[seps] = REWRITTEN
        rules[seps] = NUMBER["SubtitleSeparator"]
        for by in (1, -1):
            beside = seps[is_(SPACE, near(seps, by))] + by
            out[beside] = NOTHING
            rules[beside] = NUMBER["SubtitleSeparator"]
            start[beside] = beside - by
    if len(spaces):
        to, sf = out[spaces], f[spaces]
        changed = (rules[spaces] == 0) & np.select([to == BLANK, to == FEED], [~is_(AS_BLANK, sf), ~is_(AS_FEED, sf)], to == NOTHING)
        rules[spaces[changed]] = NUMBER["WhitespaceCollapsed"]

    phrases: dict[int, str] = {}
    if table.has_phrases:
        _phrases(table, np.flatnonzero(is_(OPENS, wf)), at, segment, text_of, cap, out, rules, start, phrases)
    return Decided(t, f, marks, out, rules, start, phrases, boundary, sentence, (at, first), shouting, title_like, seps)


def _phrases(table: Table, openers, at, segment, text_of, cap, out, rules, start, phrases: dict[int, str]) -> None:
    """Known phrases of up to 4 words within a segment, longest first, from left to right, written over their tokens."""
    text, lang, done = table.text, table.lang, -1
    key = lambda w: W.lower(text[out[at[w]]], lang)
    for w in openers.tolist():
        if w <= done:
            continue
        last = w
        while last + 1 < len(at) and last - w < min(4, table.longest) - 1 and segment[last + 1] == segment[w] and text_of[last + 1] == text_of[w]:
            last += 1
        keys = [key(k) for k in range(w, last + 1)]
        for size in range(len(keys), 1, -1):
            value = table.phrase(" ".join(keys[:size]))
            if value is not None:
                a, z = int(at[w]), int(at[w + size - 1])
                phrases[a] = W.upper_first(value, lang) if cap[w] else value
                out[a : z + 1] = NOTHING
                rules[a : z + 1] = NUMBER["MultiwordLexicon"]
                start[a : z + 1] = a
                done = w + size - 1
                break


def written(table: Table, d: Decided) -> list[str]:
    """The texts after the decisions."""
    parts = list(map(table.text.__getitem__, d.out.tolist()))
    for place, value in d.phrases.items():
        parts[place] = value
    marks = d.marks.tolist()
    return ["".join(parts[a + 1 : z]) for a, z in zip(marks, marks[1:], strict=False)]


def ranks(d: Decided):
    """The greatest rank of a rule in each text."""
    import numpy as np

    return np.maximum.reduceat(np.array(RANKS, np.int8)[d.rule], d.marks[:-1]) if len(d.marks) > 1 else np.zeros(0, np.int8)


def span_arrays(table: Table, d: Decided) -> dict:
    """Spans of a batch, an array a column; ``text`` says which text a span is of. In order of place."""
    import numpy as np

    raw, shown = table.sizes[d.tokens * FORMS].astype(np.int64), table.sizes[d.out].astype(np.int64)
    for place, value in d.phrases.items():
        shown[place] = len(value.encode())
    src, out = np.cumsum(raw), np.cumsum(shown)
    of = np.searchsorted(d.marks, np.arange(len(raw)))
    base = np.append(0, d.marks[:-1]) if len(d.marks) else d.marks
    src, out = src - src[base][of], out - out[base][of]
    some = np.flatnonzero(d.rule)
    order = some[np.lexsort((some, d.start[some]))]
    heads = np.flatnonzero(np.diff(d.start[order], prepend=-1) != 0)
    group = lambda op, x: op.reduceat(x[order], heads) if len(heads) else x[:0]
    text = table.text
    a = list(map(text.__getitem__, (d.tokens[order] * FORMS).tolist()))
    b = list(map(text.__getitem__, d.out[order].tolist()))
    for k in np.flatnonzero(np.isin(order, list(d.phrases))) if d.phrases else ():
        b[k] = d.phrases[int(order[k])]
    cuts = [*heads.tolist(), len(order)]
    changed = np.fromiter((a[x] != b[x] if z - x == 1 else "".join(a[x:z]) != "".join(b[x:z]) for x, z in zip(cuts, cuts[1:], strict=False)), bool, len(heads))
    rule = group(np.maximum, d.rule)
    shown_ = (rule != NUMBER["SubtitleSeparator"]) | changed
    made = {
        "text": of[order[heads]] - 1, "src_start": group(np.minimum, src - raw), "src_end": group(np.maximum, src), "out_start": group(np.minimum, out - shown),
        "out_end": group(np.maximum, out), "rule": rule, "changed": changed,
    }
    return {k: v[shown_] for k, v in made.items()}


def dictionary(lexicon: DataFrame, locale: str, best: bool) -> Dictionary | None:
    """The lexicon for one locale, collected if it is of a size that every worker can hold; else None."""
    tables = [L.canonical(lexicon, locale).toDF("k", "v"), L.phrase_table(lexicon, locale).toDF("k", "v")]
    tables.append(L.best_candidates(lexicon, "de").toDF("k", "v") if best else tables[0].limit(0))
    both = None
    for n, x in enumerate(tables):
        both = x.withColumn("n", F.lit(n)) if both is None else both.union(x.withColumn("n", F.lit(n)))
    size = both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("k") + F.length("v")).alias("chars")).first()
    if size["n"] > SENT_ROWS or (size["chars"] or 0) > SENT_CHARS:
        return None
    made: list[dict[str, str]] = [{}, {}, {}]
    for r in both.collect():
        made[r["n"]][r["k"]] = r["v"]
    return Dictionary(*made)


def met_words(docs: DataFrame, text: str, language: str) -> DataFrame:
    """``(key)``: the different lower-case words of the texts, cut down within each batch before they are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        find, word = token_finder(), regex.compile(r"^[\p{Alphabetic}\p{N}]").search
        for batch in batches:
            seen: set[str] = set()
            for x in batch.column(0):
                seen.update(find(x.as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array({W.lower(x, language) for x in seen if word(x)}, pa.string())], ["key"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key string").distinct()


def few_splits(docs: DataFrame) -> DataFrame:
    """``docs``; rows of an input of few splits, that would leave most cores idle, are dealt out. Large inputs stay where they are."""
    plan = docs._jdf.queryExecution()
    if docs.isStreaming or plan.executedPlan().nodeName() == "AdaptiveSparkPlan":  # counting would run its shuffles
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * plan.toRdd().getNumPartitions() <= cores else docs


def small_batches(spark: SparkSession) -> None:
    """Workers get at most ``BATCH_ROWS`` rows at a time; a smaller number of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _each(docs: DataFrame, text: str, language: str | None, options: CaseOptions, lexicon: Dictionary, schema: str, make: Callable) -> DataFrame:
    """``make(batch, rows, table, decided)`` for the texts of each language in each batch: ``rows`` are their places in it."""
    sent = docs.sparkSession.sparkContext.broadcast((options, lexicon))

    def run(batches: Iterator) -> Iterator:
        options, lexicon = sent.value
        find, tables = token_finder(), {}

        def table_of(lang: str | None) -> Table:
            lang = options.locale if lang is None else lang
            if sum(map(len, tables.values())) > REMEMBERED or sum(t.chars for t in tables.values()) > REMEMBERED_CHARS:
                tables.clear()
            if lang not in tables:
                tables[lang] = Table(replace(options, locale=lang), lexicon)
            return tables[lang]

        for batch in batches:
            texts = batch.column(text)
            langs = batch.column(language).to_pylist() if language else [None] * len(texts)
            places: dict[str | None, list[int]] = {}
            for k, x in enumerate(langs):
                places.setdefault(x, []).append(k)
            for lang, rows in places.items():
                held, size, first = [], 0, 0
                table = table_of(lang)
                for n, k in enumerate(rows, 1):
                    x = texts[k].as_py() or ""
                    held.append(list(map(table.__getitem__, find(x))))
                    size += len(x)
                    if size >= AT_ONCE or n == len(rows):
                        yield make(batch, rows[first:n], table, decide(table, held))
                        held, size, first = [], 0, n
                        table = table_of(lang)

    small_batches(docs.sparkSession)
    return few_splits(docs).mapInArrow(run, schema)


def _plain(docs: DataFrame, key: str, text: str, language: Column | None) -> DataFrame:
    shown = [F.col(key).alias("key"), F.col(text).cast("string").alias("text")]
    return docs.select(*shown, *([language.alias("language")] if language is not None else []))


def _key_type(docs: DataFrame) -> str:
    return docs.schema["key"].dataType.simpleString()


def _sendable(docs: DataFrame, text: str, options: CaseOptions, lexicon: DataFrame | None) -> Dictionary | None:
    """What workers need of the lexicon; None if that is too much to send."""
    if lexicon is None:
        return NO_WORDS
    best = options.language == "de" and options.german_mode is GermanMode.AGGRESSIVE
    found = dictionary(lexicon, options.locale, best)
    if found is None:  # entries of words that occur; phrases are kept by their first word
        words = met_words(docs, text, options.language)
        found = dictionary(lexicon.join(words.withColumnRenamed("key", "met"), F.split("key", " ")[0] == F.col("met"), "left_semi"), options.locale, best)
    return found


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts under keys of their own, which hold the given ones, so that repeated and null keys stay apart."""
    return docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(key).alias("key")).alias("key"), F.col(text).alias("text"))


def recase(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", lexicon: DataFrame | None = None, language: Column | None = None) -> DataFrame:
    """``(key, output, confidence, n_words)``: one row per row of ``docs``, whatever its key.

    Null and empty texts give an empty output and are Solid; null and repeated keys are kept; an empty table
    gives an empty result; other columns are not read. ``language``, a column, takes the place of the options'
    locale row by row (null: that locale).
    """
    words = _sendable(docs, text, options, lexicon)
    if words is None:
        found = relational.recase(_numbered(docs, key, text), options, "key", "text", lexicon)
        return found.withColumn("key", F.col("key.key"))
    plain = _plain(docs, key, text, language)

    def make(batch, rows, table, d):
        import pyarrow as pa

        shown = pa.DictionaryArray.from_arrays(pa.array(ranks(d)), relational.CONFIDENCE).cast(pa.string())
        n_words = _sums(d, d.first[0])
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(written(table, d), pa.string()), shown, pa.array(n_words)], ["key", "output", "confidence", "n_words"])

    return _each(plain, "text", "language" if language is not None else None, options, words, f"key {_key_type(plain)}, output string, confidence string, n_words long", make)


def _sums(d: Decided, places):
    """How many of the ``places`` each text has."""
    import numpy as np

    return np.bincount(np.searchsorted(d.marks, places) - 1, minlength=len(d.marks) - 1).astype(np.int64)


_SPAN = "src_start long, src_end long, out_start long, out_end long, rule string, confidence string, changed boolean"


def _span_columns(s: dict) -> list:
    import numpy as np
    import pyarrow as pa

    named = lambda codes, names: pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int8)), names).cast(pa.string())
    levels = np.array(RANKS, np.int8)[s["rule"]]
    return [*(pa.array(s[c]) for c in ("src_start", "src_end", "out_start", "out_end")), named(s["rule"], RULES), named(levels, relational.CONFIDENCE), pa.array(s["changed"])]


def spans(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", lexicon: DataFrame | None = None, language: Column | None = None) -> DataFrame:
    """``(key, src_start, src_end, out_start, out_end, rule, confidence, changed)``: UTF-8 byte ranges of every decision.

    Words always have a span; a phrase and a rewritten separator with the spaces around it are one;
    white space has one only where it changed. Null and empty texts have none; rows of equal or null
    keys have their spans under that key; an empty table gives an empty result.
    """
    words = _sendable(docs, text, options, lexicon)
    if words is None:
        return relational.spans(_numbered(docs, key, text), options, "key", "text", lexicon).withColumn("key", F.col("key.key"))
    plain = _plain(docs, key, text, language)

    def make(batch, rows, table, d):
        import numpy as np
        import pyarrow as pa

        s = span_arrays(table, d)
        keys = batch.column("key").take(pa.array(np.array(rows, np.int64)[s["text"]]))
        return pa.RecordBatch.from_arrays([keys, *_span_columns(s)], ["key", *(x.split(" ")[0] for x in _SPAN.split(", "))])

    return _each(plain, "text", "language" if language is not None else None, options, words, f"key {_key_type(plain)}, {_SPAN}", make)


def analyze(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", lexicon: DataFrame | None = None, language: Column | None = None) -> DataFrame:
    """``(key, output, confidence, spans)``: the text with all its decisions, in order, in one row; as :func:`recase` and :func:`spans`."""
    words = _sendable(docs, text, options, lexicon)
    names = [x.split(" ")[0] for x in _SPAN.split(", ")]
    if words is None:
        numbered = _numbered(docs, key, text)
        told = relational.spans(numbered, options, "key", "text", lexicon).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("spans"))
        met = relational.recase(numbered, options, "key", "text", lexicon).join(told, "key", "left")
        nothing = F.expr(f"cast(array() as array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>)")
        return met.select("key.key", "output", "confidence", F.coalesce("spans", nothing).alias("spans"))
    plain = _plain(docs, key, text, language)

    def make(batch, rows, table, d):
        import numpy as np
        import pyarrow as pa

        s = span_arrays(table, d)
        ends = np.append(0, np.cumsum(np.bincount(s["text"], minlength=len(rows)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(_span_columns(s), names))
        shown = pa.DictionaryArray.from_arrays(pa.array(ranks(d)), relational.CONFIDENCE).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(written(table, d), pa.string()), shown, lists], ["key", "output", "confidence", "spans"])

    kinds = _SPAN.replace(" ", ":").replace(",:", ",")
    return _each(plain, "text", "language" if language is not None else None, options, words, f"key {_key_type(plain)}, output string, confidence string, spans array<struct<{kinds}>>", make)


def words(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", language: Column | None = None) -> DataFrame:
    """``(key, raw, lower, text, rule, starts, edge, after_separator, previous)``: a row per word of every text.

    ``starts``: first of its sentence; ``edge``: first or last of its text; ``previous``: the lower-case word before it
    with white space alone between them, else null. Words of a phrase have the phrase at its first word and empty
    texts at the others. Null and empty texts give no row; keys may repeat or be null.
    """
    plain = _plain(docs, key, text, language)

    def make(batch, rows, table, d):
        import numpy as np
        import pyarrow as pa

        at, first = d.first
        of = np.searchsorted(d.marks, at) - 1
        shown = list(map(table.text.__getitem__, d.out[at].tolist()))
        for k in np.flatnonzero(np.isin(at, list(d.phrases))) if d.phrases else ():
            shown[k] = d.phrases[int(at[k])]
        raw = d.tokens[at] * FORMS
        low = list(map(table.text.__getitem__, (raw + LOW).tolist()))
        segment = np.cumsum((d.flags & (PUNCT | SYMBOL)) != 0)[at]
        joined = np.zeros(len(at), bool)
        joined[1:] = (segment[1:] == segment[:-1]) & (of[1:] == of[:-1])
        after = np.zeros(len(at), bool)
        after[np.searchsorted(at, d.separators)] = True
        edge = (np.diff(of, prepend=-1) != 0) | (np.diff(of, append=-1) != 0)
        columns = [
            batch.column("key").take(pa.array(np.array(rows, np.int64)[of])), pa.array(list(map(table.text.__getitem__, raw.tolist())), pa.string()), pa.array(low, pa.string()), pa.array(shown, pa.string()),
            pa.DictionaryArray.from_arrays(pa.array(d.rule[at]), RULES).cast(pa.string()), pa.array(first), pa.array(edge), pa.array(after), pa.array(np.array([None, *low[:-1]], object)[: len(low)], pa.string(), mask=~joined),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "raw", "lower", "text", "rule", "starts", "edge", "after_separator", "previous"])

    kinds = "raw string, lower string, text string, rule string, starts boolean, edge boolean, after_separator boolean, previous string"
    return _each(plain, "text", "language" if language is not None else None, options, NO_WORDS, f"key {_key_type(plain)}, {kinds}", make)


_FACTS = ("n_tokens", "n_word", "n_space", "n_punct", "n_symbol", "n_bytes", "sum_end", "n_boundary", "n_starts", "last_sentence", "n_shouting", "n_title_like")


def facts(docs: DataFrame, options: CaseOptions = CaseOptions(), key: str = "doc_id", text: str = "text", language: Column | None = None) -> DataFrame:
    """``(key, ...)``: counts of a text's tokens by kind, its bytes and the sum of the tokens' end offsets, sentence
    boundaries, sentence starts, the number of the last token's sentence, and starts of shouted and title-like sentences.
    One row per row; null and empty texts have zeros and a null ``last_sentence``."""
    plain = _plain(docs, key, text, language)

    def make(batch, rows, table, d):
        import numpy as np
        import pyarrow as pa

        raw = table.sizes[d.tokens * FORMS].astype(np.int64)
        end = np.cumsum(raw)
        marks, of = d.marks, np.searchsorted(d.marks, np.arange(len(raw))) - 1
        base = end[marks[:-1]]
        inside = d.tokens != 0
        sums = np.bincount(of[inside], minlength=len(rows)) if inside.any() else np.zeros(len(rows), np.int64)
        ends = np.add.reduceat(np.where(inside, end, 0), marks[:-1]) - sums * base
        at, first = d.first
        starts = at[first]
        last = np.where(sums > 0, d.sentence[marks[1:] - 1] - d.sentence[marks[:-1]], 0)
        kinds = [_sums(d, np.flatnonzero(d.flags & k)) for k in (WORD, SPACE, PUNCT, SYMBOL)]
        columns = [sums, *kinds, end[marks[1:]] - base, ends, _sums(d, np.flatnonzero(d.boundary)), _sums(d, starts)]
        last_sentence = pa.array(last.astype(np.int64), mask=sums == 0)
        loud = [_sums(d, at[first & x]) for x in (d.shouting, d.title_like)]
        made = [*(pa.array(c.astype(np.int64)) for c in columns), last_sentence, *(pa.array(c) for c in loud)]
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), *made], ["key", *_FACTS])

    return _each(plain, "text", "language" if language is not None else None, options, NO_WORDS, f"key {_key_type(plain)}, " + ", ".join(f"{c} long" for c in _FACTS), make)


def sentence_case(docs: DataFrame, locale: str, **names) -> DataFrame:
    return recase(docs, CaseOptions(locale=locale), **names)


def sentence_case_title(docs: DataFrame, locale: str, **names) -> DataFrame:
    return recase(docs, CaseOptions(locale=locale, mode=CaseMode.SENTENCE_TITLE), **names)


def sentence_case_analyze(docs: DataFrame, locale: str, **names) -> DataFrame:
    return analyze(docs, CaseOptions(locale=locale), **names)
