"""DuckDB SQL that reads the sample payloads of the sources; where SQL can't read the format, the records written out by hand."""

from __future__ import annotations

from ..sources.samples import DOCUMENTS, LINES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(_quoted, LINES[name]))}]) AS line)"


def _json(name: str, path: str = "$[*]") -> str:
    """Items of a document as column ``x``."""
    return f"(SELECT unnest(json_extract({_quoted(DOCUMENTS[name])}::JSON, '{path}')) AS x)"


def _shown(canonical: str, aliases: str, score: str, rows: str) -> str:
    """Records with a name; aliases distinct and sorted, without it."""
    return f"""SELECT canonical, array_to_string(list_sort(list_distinct(list_filter(coalesce(a, []), lambda y: y IS NOT NULL AND y <> '' AND y <> canonical))), '|') AS aliases, round(score, 4) AS score
FROM (SELECT {canonical} AS canonical, {aliases} AS a, ({score})::DOUBLE AS score FROM {rows}) WHERE canonical <> ''"""


def _values(*records: tuple[str, str, float]) -> str:
    rows = ", ".join(f"({_quoted(c)}, {_quoted(a)}, {s}::DOUBLE)" for c, a, s in records)
    return f"SELECT * FROM (VALUES {rows}) AS t(canonical, aliases, score)"


_MIXED = "CASE WHEN regexp_matches({0}, '\\p{{Ll}}') AND regexp_matches({0}, '\\p{{Lu}}') THEN 2.0 ELSE 1.2 END"
_TEXTS = "json_extract_string({}, '{}')"
_FIELDS = f"(SELECT list_transform(string_split(line, chr(9)), lambda y: {{}}) AS c FROM {{}} WHERE trim(line) <> '' AND line NOT LIKE '#%')"

_GEO = f"""CASE c[7] WHEN 'P' THEN 3.0 WHEN 'A' THEN 2.6 WHEN 'S' THEN 2.2 WHEN 'L' THEN 1.8 WHEN 'T' THEN 1.8 ELSE 1.2 END
 + CASE WHEN c[8] = 'PPLC' THEN 1.0 WHEN c[8] IN ('PPLA', 'PPLA2', 'PPLA3', 'PPLA4') THEN 0.6 WHEN c[8] = 'PPL' THEN 0.3 ELSE 0 END + CASE WHEN c[15]::DOUBLE > 0 THEN log10(c[15]::DOUBLE) / 10 ELSE 0 END"""
_UD = """CASE c[4] WHEN 'PROPN' THEN 3.0 ELSE 2.0 END + CASE WHEN contains(c[6], 'Case=Nom') THEN 0.4 ELSE 0 END + CASE WHEN contains(c[6], 'Number=Sing') THEN 0.1 ELSE 0 END
 + CASE WHEN contains(c[6], 'Gender=') THEN 0.1 ELSE 0 END + CASE WHEN c[8] IN ('nsubj', 'obj', 'obl', 'nmod', 'root', 'appos') THEN 0.3 ELSE 0 END + CASE WHEN contains(c[10], 'NE=') THEN 0.5 ELSE 0 END"""
_ud_rows = _FIELDS.format("trim(y)", _lines("ud-german-gsd"))
_wiktionary = f"""
WITH e AS (SELECT row_number() OVER () AS n, line::JSON AS j FROM {_lines('wiktionary')} WHERE line <> ''),
d AS (SELECT n, j, coalesce(j->>'word', '') AS w, lower(coalesce(j->>'pos', '')) AS pos FROM e WHERE lower(j->>'lang_code') = 'de'),
f AS (SELECT n, unnest([w] || coalesce(list_transform(list_filter(json_extract(j, '$.forms[*]'), lambda x: NOT coalesce(list_has_any(json_extract_string(x, '$.tags[*]'), ['inflection-template', 'table-tags', 'class', 'romanization']), false)), lambda x: x->>'form'), [])) AS s FROM d),
u AS (SELECT DISTINCT n, s FROM f WHERE regexp_matches(s, '[\\p{{L}}\\p{{N}}]')),
r AS (SELECT s, CASE WHEN pos IN ('name', 'proper noun', 'proper-noun') THEN 2.4 WHEN pos = 'noun' THEN 2.0 WHEN pos IN ('adj', 'adjective') THEN 1.6 WHEN pos = 'verb' THEN 1.5 WHEN pos IN ('adv', 'adverb') THEN 1.2 ELSE 1.0 END
  + CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 0.2 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY n ORDER BY s) = 1 THEN 0.15 ELSE 0 END AS score FROM u JOIN d USING (n))
SELECT s AS canonical, '' AS aliases, round(max(score)::DOUBLE, 4) AS score FROM r GROUP BY s"""
_ror_names = "list_filter(json_extract(x, '$.names[*]'), lambda y: NOT list_contains(json_extract_string(y, '$.types[*]'), 'acronym'))"
_cldr = f"""SELECT DISTINCT name AS canonical, '' AS aliases, 2.0::DOUBLE AS score FROM (SELECT DISTINCT k.key AS code, k.value->>'$' AS name FROM
 (SELECT unnest(json_extract({_quoted(DOCUMENTS['cldr'])}::JSON, '$.main.*.localeDisplayNames.*')) AS names) t, json_each(t.names) k) WHERE name <> '' AND name <> code AND regexp_matches(name, '\\p{{L}}')"""

SOURCE_SQL = {
    "geonames": _shown("c[2]", "list_transform([c[3]] || string_split(c[4], ','), lambda y: trim(y))", _GEO, _FIELDS.format("y", _lines("geonames"))),
    "ud-german-gsd": f"SELECT canonical, array_to_string(CASE WHEN c[2] = c[3] THEN [c[2]] ELSE [c[2], c[3]] END, '|') AS aliases, round(score::DOUBLE, 4) AS score FROM (SELECT c, CASE c[4] WHEN 'PROPN' THEN c[2] ELSE upper(left(c[3], 1)) || substr(c[3], 2) END AS canonical, {_UD} AS score FROM {_ud_rows}) WHERE c[4] IN ('NOUN', 'PROPN') AND NOT regexp_matches(c[1], '[-.]')",
    "wiktionary": _wiktionary,
    "ror": _shown(f"CASE WHEN json_exists(x, '$.names') THEN (list_filter({_ror_names}, lambda y: list_contains(json_extract_string(y, '$.types[*]'), 'ror_display')))[1]->>'value' ELSE x->>'name' END",
                  f"CASE WHEN json_exists(x, '$.names') THEN list_transform({_ror_names}, lambda y: y->>'value') ELSE json_extract_string(x, '$.aliases[*]') || json_extract_string(x, '$.labels[*].label') END", "1.8", _json("ror")),
    "cldr": _cldr,
    "natural-earth": _shown("coalesce(p->>'NAME', p->>'name')", "CASE WHEN p->>'NAME' IS NOT NULL THEN [p->>'NAME_LONG', p->>'ADMIN'] ELSE [p->>'nameascii', p->>'namealt'] END",
                            "CASE WHEN p->>'NAME' IS NOT NULL THEN 2.8 WHEN json_type(p->'pop_max') NOT IN ('VARCHAR') AND (p->>'pop_max')::DOUBLE > 0 THEN 2.0 + log10((p->>'pop_max')::DOUBLE) / 10 ELSE 2.0 END",
                            f"(SELECT x->'properties' AS p FROM {_json('natural-earth', '$.features[*]')} WHERE trim(coalesce(x->'properties'->>'NAME', x->'properties'->>'name')) <> '')"),
    "getty": _shown("coalesce(x->>'_label', json_extract_string(x, '$.identified_by[0].content'))", "json_extract_string(x, '$.identified_by[*].content')", "1.5", _json("getty")),
    "openstreetmap": _shown("coalesce(x->>'name', trim(string_split(x->>'display_name', ',')[1]))", "[x->>'display_name'] || json_extract_string(x, '$.namedetails.*')",
                            "1.0 + coalesce((x->>'importance')::DOUBLE, 0) + coalesce((x->>'place_rank')::DOUBLE / 100, 0)", _json("openstreetmap")),
    "musicbrainz": _shown("coalesce(x->>'name', x->>'title')", "[x->>'sort-name', x->>'disambiguation'] || json_extract_string(x, '$.aliases[*].name')", _MIXED.format("coalesce(x->>'name', x->>'title')"),
                          " UNION ALL ".join(f"SELECT x FROM {_json('musicbrainz', f'$.{k}[*]')}" for k in ("artists", "releases", "works")).join("()")),
    "wikidata": _values(("Northwick Dam", "NWD|Northwick Dam|barrage de Northwick", 1.5), ("Itäsaari", "", 1.0)),
    "gnd": _values(("Wendel, Ruth van", 'R. Wendel|RW|Ruth "Ru" W.|Ruth van Wendel', 2.0), ("Odo", "Одо", 1.0), ("Lakowo", "Lakow", 1.8), ("Gilde", "", 1.2)),
    "dbpedia": _values(("Marrow Lane", "Marrow|marrow ln", 12.5), ("Plain", "", 1.0)),
    "discogs": _values(("Marrow Lane", "Marrowlane", 2.0), ("Tin Orchard", "Lead Orchard|Odo & Vesna Krill|TinOrchard", 2.0), ("vellum tapes", "", 1.2)),
    "gleif": _values(("Brightwater Mills plc", "Brightwater", 2.0), ("KVARN AB", "Kvarn", 1.4)),
    "orcid": _values(("Mirela Oduya", "M. Oduya-Hall", 1.5)),
}
