"""DuckDB SQL for the corpus queries that SQL can state."""

from __future__ import annotations

from . import quality

W = r"[^\x20\x09-\x0D]+"


def _bounds() -> str:
    values = {"n_words": "n_words", "mean_word": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_share": "n_stop / n_words", "dup_line_share": "n_dup_lines / n_lines"}
    tests = []
    for r in quality.RULES:
        tests += [f"{values[r.value]} >= {r.low}"] if r.low is not None else []
        tests += [f"{values[r.value]} <= {r.high}"] if r.high is not None else []
    return " AND ".join(tests)


_STOP = ", ".join("'" + w + "'" for w in sorted({w for x in quality.STOP_WORDS.values() for w in x.split()}))

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
h AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines FROM d),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(p.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM l LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_bounds()} AS kept FROM b"""

OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(k)),
e AS (SELECT *, length('### : </turn>') + length(regexp_replace(role, '[\\#:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#]', 'xx', 'g')) + len(string_split(text, '</')) - 1 + 0 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to FROM f"""

OP7 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""
