"""DuckDB SQL that states the recasing queries independently of the plans that run them."""

from __future__ import annotations

from ..functions.profiles import BUILTIN_FORMS, BUILTIN_PHRASES, GERMAN_AMBIGUOUS, GERMAN_ARTICLES, GERMAN_NOUN_ENDS, profile

TOKEN = r"(?s)\s+|[\p{L}\p{N}]+(?:[''’\-‐‑][\p{L}\p{N}]+)*|."


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words or ["\x00"]) + ")"


def tokens(docs: str) -> str:
    """CTEs ``docs(key, text)`` and ``k``: tokens with kind and lower form."""
    return rf"""
WITH docs AS ({docs}),
tok AS (SELECT key, u.pos, u.raw FROM docs, unnest(regexp_extract_all(text, '{TOKEN}')) WITH ORDINALITY AS u(raw, pos)),
k AS (SELECT *, lower(raw) AS low, CASE WHEN regexp_matches(raw, '^[\p{{L}}\p{{N}}]') THEN 'word' WHEN regexp_matches(raw, '^\s') THEN 'space'
  WHEN regexp_matches(raw, '^[[:punct:]“”„«»…—–。！？｡؟।॥、，：]$') THEN 'punct' ELSE 'symbol' END AS kind FROM tok)"""


def contexts(docs: str, lang: str) -> str:
    p = profile(lang)
    small = _list([*p.stop, *p.particles])
    return tokens(docs) + rf""",
n AS (SELECT *, lag(raw) OVER w AS p1, lag(kind) OVER w AS p1k, lead(raw) OVER w AS n1, lead(kind) OVER w AS n1k,
  lag(raw, 2) OVER w AS p2, lag(kind, 2) OVER w AS p2k, lead(raw, 2) OVER w AS n2, lead(kind, 2) OVER w AS n2k,
  first_value(CASE WHEN kind = 'word' THEN raw END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nw
  FROM k WINDOW w AS (PARTITION BY key ORDER BY pos)),
sides AS (SELECT *, CASE WHEN p1k = 'space' THEN p2 ELSE p1 END AS l, CASE WHEN p1k = 'space' THEN p2k ELSE p1k END AS lk,
  CASE WHEN n1k = 'space' THEN n2 ELSE n1 END AS r, CASE WHEN n1k = 'space' THEN n2k ELSE n1k END AS rk FROM n),
b AS (SELECT *, coalesce(kind = 'punct' AND raw IN (':', '-', '–', '—') AND lk = 'word' AND rk = 'word'
    AND NOT (regexp_full_match(l, '[0-9]+') AND regexp_full_match(r, '[0-9]+')) AND NOT (length(l) = 1 AND length(r) = 1)
    AND CASE WHEN raw = ':' THEN n1k = 'space' ELSE (p1k = 'space' AND n1k = 'space') OR (raw <> '-' AND p1k = 'word' AND n1k = 'word') END, false) AS sep,
  CASE WHEN kind <> 'punct' OR raw NOT IN ('.', '!', '?', '…') THEN false
  WHEN raw = '…' OR (raw = '.' AND (coalesce(p1, '') = '.' OR coalesce(n1, '') = '.')) THEN CASE WHEN coalesce(n1, '') = '.' THEN false ELSE coalesce(regexp_matches(nw, '^\p{{Lu}}'), false) END
  WHEN raw = '.' AND coalesce(n1k, '') = 'word' THEN false
  WHEN raw = '.' AND coalesce(p1k, '') = 'word' THEN CASE WHEN lower(p1) IN {_list(p.title)} THEN false
    WHEN lower(p1) IN {_list(p.numeric)} THEN NOT coalesce(regexp_matches(nw, '^\p{{N}}'), false)
    WHEN lower(p1) IN {_list(p.trailing)} THEN coalesce(regexp_matches(nw, '^\p{{Lu}}'), false)
    ELSE NOT regexp_matches(p1, '^\p{{L}}$') END
  ELSE true END AS boundary FROM sides),
s AS (SELECT *, coalesce(sum(boundary::int) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent,
  coalesce(lag(sep) OVER (PARTITION BY key ORDER BY pos), false) AS sep_before, coalesce(lead(sep) OVER (PARTITION BY key ORDER BY pos), false) AS sep_after,
  coalesce(last_value(CASE WHEN kind = 'word' THEN 'w' WHEN sep THEN 's' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'w') = 's' AS after_sep,
  sum((kind IN ('punct', 'symbol'))::int) OVER (PARTITION BY key ORDER BY pos) AS seg,
  kind = 'word' AND regexp_matches(raw, '\p{{L}}') AS alpha, kind = 'word' AND regexp_matches(raw, '\p{{L}}') AND NOT regexp_matches(raw, '\p{{Ll}}') AS caps,
  regexp_matches(raw, '\p{{Lu}}') AS up, low IN {small} AS small, length(regexp_replace(raw, '\P{{L}}', '', 'g')) >= 5 AS long FROM b),
a AS (SELECT *, coalesce(bool_or(caps) FILTER (alpha) OVER g, false) AND (coalesce(bool_and(caps) FILTER (alpha) OVER g, true)
    OR (coalesce(bool_and(caps OR small) FILTER (alpha) OVER g, true) AND coalesce(bool_or(caps AND long) FILTER (alpha) OVER g, false))) AS shouting,
  min(pos) FILTER (alpha) OVER g AS fa, min(pos) FILTER (kind = 'word') OVER g AS fw,
  min(pos) FILTER (kind = 'word') OVER (PARTITION BY key) AS ew, max(pos) FILTER (kind = 'word') OVER (PARTITION BY key) AS lw,
  min(pos) FILTER (kind <> 'space') OVER (PARTITION BY key) AS fm, max(pos) FILTER (kind <> 'space') OVER (PARTITION BY key) AS lm,
  lag(CASE WHEN kind = 'word' THEN low END IGNORE NULLS) OVER (PARTITION BY key, seg ORDER BY pos) AS pw
  FROM s WINDOW g AS (PARTITION BY key, sent)),
t AS (SELECT *, coalesce(bool_and(up OR small) FILTER (alpha AND pos > fa) OVER g, true) AND coalesce(count(*) FILTER (alpha AND pos > fa AND up) OVER g, 0) >= 2 AS title_like,
  kind = 'word' AND pos = fw AS starts FROM a WINDOW g AS (PARTITION BY key, sent))"""


CAP = "CASE WHEN left(low, 1) = 'ß' THEN 'Ss' || substr(low, 2) ELSE upper(left(low, 1)) || substr(low, 2) END"
ACRONYM = r"(length(regexp_replace(raw, '\P{L}', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(raw, '\P{L}', '', 'g'), '\P{Lu}'))"
MIXED = r"(regexp_matches(raw, '\p{Ll}') AND regexp_matches(raw, '\p{L}.*\p{Lu}'))"
SIMPLE = r"(regexp_matches(raw, '^\p{Lu}.*\p{L}') AND NOT regexp_matches(substr(raw, 2), '\p{Lu}'))"
#: Tables that :func:`cascade` joins, if nothing else is given: forms, phrases of two words, best candidates, all by lower-case key.
NONE = "SELECT NULL::VARCHAR AS key, NULL::VARCHAR AS value WHERE false"


def cascade(docs: str, lang: str, title: bool = False, balanced: bool = False, subtitle: bool = False, separator: str | None = None, lexicon: str = NONE, phrases: str = NONE, best: str = NONE) -> str:
    """CTE ``c``: tokens with text and rule; ``ph``, the first token of the phrase that a token is in.

    ``subtitle`` has lines joined and words after separators capitalized. Known phrases must not overlap.
    """
    sure = "true" if title else "(raw <> low AND NOT shouting AND NOT title_like)"
    forms = "CASE " + " ".join(f"WHEN low = '{k}'{' AND ' + sure if k in ('rust', 'latex') else ''} THEN '{v}'" for k, v in BUILTIN_FORMS.items()) + " END"
    form = f"coalesce(lex, {forms})"
    noun = f"low NOT IN {_list(GERMAN_AMBIGUOUS)} AND strlen(low) > 2 AND (regexp_matches(low, '({'|'.join(GERMAN_NOUN_ENDS)})$') OR coalesce(pw IN {_list(GERMAN_ARTICLES)}, false))"
    cap = "(starts OR after_sep)" if subtitle or title else "starts"
    if title:
        words = array = "array_to_string(list_transform(regexp_extract_all(raw, '[^-‐‑]+|[-‐‑]'), lambda x: CASE WHEN left(lower(x), 1) = 'ß' THEN 'Ss' ELSE upper(left(lower(x), 1)) END || substr(lower(x), 2)), '')"
        rest = [(cap, array, "SentenceStart"), ("pos IN (ew, lw)", array, "TitleEdge"), ("NOT small", words, "Capitalized"), ("true", "low", "SmallWord")]
    else:
        lifted = f"CASE WHEN {cap} THEN upper(left(best, 1)) || substr(best, 2) ELSE best END"
        german = [("best IS NOT NULL", lifted, "GermanNoun"), (noun, CAP, "GermanNoun")] if balanced else []
        rest = [(f"NOT {cap} AND NOT shouting AND NOT title_like AND {SIMPLE}", "raw", "ProperNounPreserved"), *german, (cap, CAP, "SentenceStart")]
        rest += [("replace(low, '’', '''') IN ('i', 'i''m', 'i''ll', 'i''ve', 'i''d')", CAP, "AlwaysCapitalized")] if lang == "en" else []
        rest += [("true", "low", "Lowercased")]
    rules = [(f"{form} IS NOT NULL", form, "CanonicalLexicon"), (f"NOT shouting AND {ACRONYM}", "raw", "AcronymPreserved"), (MIXED, "raw", "MixedCasePreserved"), *rest]
    space = "' '" if title or subtitle else r"CASE WHEN contains(raw, chr(10)) THEN chr(10) ELSE ' ' END"
    text = " ".join(f"WHEN {w} THEN {x}" for w, x, _ in rules)
    rule = " ".join(f"WHEN {w} THEN '{r}'" for w, _, r in rules)
    joined, mark = "false", "raw"
    if separator is not None:
        joined, mark = "sep_before OR sep_after", f"CASE WHEN sep THEN '{separator}' ELSE raw END"
    known = []
    for phrase, value in BUILTIN_PHRASES.items():
        parts = phrase.split(" ")
        test = " AND ".join([f"low = '{parts[0]}'", *(f"g{i} = 'space' AND w{i} = '{x}'" for i, x in enumerate(parts[1:], 1))])
        known.append(f"WHEN {test} THEN {{'value': '{value}', 'size': {2 * len(parts) - 1}}}")
    return contexts(docs, lang) + f""",
lex AS ({lexicon}), pairs AS ({phrases}), ranked AS ({best}),
x AS (SELECT t.*, lex.value AS lex, ranked.value AS best, {cap} AS cap, lead(low, 2) OVER w AS w1, lead(kind, 1) OVER w AS g1, lead(low, 4) OVER w AS w2, lead(kind, 3) OVER w AS g2
  FROM t LEFT JOIN lex ON kind = 'word' AND lex.key = low LEFT JOIN ranked ON kind = 'word' AND ranked.key = low WINDOW w AS (PARTITION BY t.key ORDER BY pos)),
y AS (SELECT x.*, CASE WHEN kind = 'word' THEN CASE WHEN pairs.value IS NOT NULL THEN {{'value': pairs.value, 'size': 3}} {' '.join(known)} END END AS m
  FROM x LEFT JOIN pairs ON kind = 'word' AND g1 = 'space' AND pairs.key = low || ' ' || w1),
z AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN {{'pos': pos, 'size': m.size}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos) AS held FROM y),
p AS (SELECT *, CASE WHEN pos < held.pos + held.size THEN held.pos END AS ph FROM z),
q AS (SELECT key, pos, kind, raw, ph, m.value AS phrase, cap, sep, sep_before, sep_after, CASE WHEN kind = 'space' THEN CASE WHEN pos < coalesce(fm, 1e9) OR pos > lm OR {joined} THEN '' ELSE {space} END
    WHEN kind <> 'word' THEN {mark} ELSE CASE {text} END END AS text,
  CASE WHEN kind = 'word' THEN CASE {rule} END END AS rule FROM p),
c AS (SELECT key, pos, kind, raw, ph, sep, sep_before, sep_after,
  CASE WHEN ph IS NULL THEN text WHEN pos > ph THEN '' WHEN cap THEN upper(left(phrase, 1)) || substr(phrase, 2) ELSE phrase END AS text,
  CASE WHEN ph IS NOT NULL THEN 'MultiwordLexicon' WHEN rule IS NOT NULL THEN rule WHEN {joined if separator is not None else 'false'} OR (sep AND {str(separator is not None).lower()}) THEN 'SubtitleSeparator'
    WHEN kind = 'space' AND text <> raw THEN 'WhitespaceCollapsed' END AS rule FROM q)"""


LEVEL = "CASE WHEN rule IN ('AcronymPreserved', 'ProperNounPreserved', 'GermanNoun') THEN 2 WHEN rule = 'Capitalized' THEN 1 ELSE 0 END"
NAMED = "CASE {} WHEN 2 THEN 'Heuristic' WHEN 1 THEN 'Unverified' ELSE 'Solid' END"


def output(docs: str, lang: str, **options) -> str:
    return cascade(docs, lang, **options) + f"""
SELECT d.key AS doc_id, coalesce(string_agg(c.text, '' ORDER BY c.pos), '') AS output,
  {NAMED.format(f'coalesce(max({LEVEL}), 0)')} AS confidence,
  count(*) FILTER (c.kind = 'word') AS n_words
FROM docs d LEFT JOIN c ON c.key = d.key GROUP BY d.key"""


def spans(docs: str, lang: str, **options) -> str:
    """``(key, src_start, src_end, out_start, out_end, rule, confidence, changed)`` of every decision."""
    rewritten = options.get("separator") is not None
    group = "CASE WHEN kind = 'space' AND sep_after THEN pos + 1 WHEN kind = 'space' AND sep_before THEN pos - 1 ELSE coalesce(ph, pos) END" if rewritten else "coalesce(ph, pos)"
    return cascade(docs, lang, **options) + f""",
e AS (SELECT *, sum(strlen(raw)) OVER w AS src_end, sum(strlen(text)) OVER w AS out_end, {group} AS g FROM c WINDOW w AS (PARTITION BY key ORDER BY pos)),
f AS (SELECT key, min(src_end - strlen(raw)) AS src_start, max(src_end) AS src_end, min(out_end - strlen(text)) AS out_start, max(out_end) AS out_end, max(rule) AS rule,
  string_agg(raw, '' ORDER BY pos) <> string_agg(text, '' ORDER BY pos) AS changed FROM e WHERE rule IS NOT NULL GROUP BY key, g)
SELECT key, src_start, src_end, out_start, out_end, rule, {NAMED.format(LEVEL)} AS confidence, changed FROM f WHERE rule <> 'SubtitleSeparator' OR changed"""
