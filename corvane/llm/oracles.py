"""SQL twins of operators whose result SQL can state, by another way than the operator's."""

from __future__ import annotations

from corvane.llm.language_id import PROFILE

#: CRC-32 of a decimal number's digits.
CRC32 = """list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) """

_CODE = "(CASE WHEN {0} = ' ' THEN 0 ELSE unicode({0}) END)::BIGINT"
_AT = lambda k: _CODE.format(f"substr(p, i + {k}, 1)")

OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, lang, doc_id IS NOT NULL AND xor({CRC32.format('coalesce(doc_id, 0)')}, 4294967295) % 3 = 1 AS held_out FROM documents),
w AS (SELECT rid, ' ' || unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) || ' ' AS p FROM d),
g AS (SELECT rid, p, unnest(range(1, length(p) + 1)) AS i FROM w),
c AS MATERIALIZED (SELECT rid, code, count(*) AS n FROM (
  SELECT rid, {_AT(0)} AS code FROM g WHERE substr(p, i, 1) <> ' '
  UNION ALL SELECT rid, ({_AT(0)} << 21) + {_AT(1)} + (1::BIGINT << 62) FROM g WHERE i < length(p)
  UNION ALL SELECT rid, ({_AT(0)} << 42) + ({_AT(1)} << 21) + {_AT(2)} FROM g WHERE i < length(p) - 1) GROUP BY 1, 2),
own AS (SELECT * FROM (SELECT rid, code, row_number() OVER (PARTITION BY rid ORDER BY n DESC, code) - 1 AS rank FROM c) WHERE rank < {PROFILE}),
prof AS (SELECT * FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS rank FROM
  (SELECT lang, code, sum(n) AS n FROM c JOIN d USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2)) WHERE rank < {PROFILE}),
dist AS (SELECT rid, l.lang, sum(coalesce(abs(p.rank - o.rank), {PROFILE})) AS distance, count(*) AS n
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof p ON p.lang = l.lang AND p.code = o.code GROUP BY 1, 2),
best AS (SELECT rid, arg_min(lang, (distance, lang)) AS lang_pred, 1 - min(distance)::DOUBLE / ({PROFILE} * any_value(n)) AS score FROM dist GROUP BY 1)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(greatest(0, least(1, score)), 0)::DOUBLE AS score FROM d LEFT JOIN best USING (rid)"""

OP9_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN text IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingles
  FROM (SELECT doc_id, w, w AS text FROM d)),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS common
    FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2) WHERE 100 * common >= 85 * (n + m - common)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, t.b FROM reach r JOIN pairs t ON t.a = r.b)
SELECT doc_id, coalesce(len(shingles), 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) ON a = doc_id"""
