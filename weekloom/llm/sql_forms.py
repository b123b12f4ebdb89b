"""DuckDB SQL of the text operators that SQL can express over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def prefix_trie(every: int = 100, heads: int = 6) -> str:
    return rf"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {every} AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
      lambda c, d: list_reduce(list_prepend(xor(c, d), list_transform(range(8), lambda k: 0::UBIGINT)),
        lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))) % {heads} AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)),
rebuilt AS (
  SELECT c.conv_id, o.i, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, o.i - c.h + (SELECT count(*) FROM ordered b WHERE b.conv_id = c.base AND b.i <= c.h), o.role, o.text
  FROM convs c JOIN ordered o USING (conv_id) WHERE o.i > c.h),
whole AS (
  SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.i) FILTER (WHERE r.i IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
paths AS (
  SELECT conv_id, d, len(turns) AS n, md5(turns[1:d]::VARCHAR || d) AS node, md5(turns[1:d - 1]::VARCHAR || (d - 1)) AS up,
    CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    CASE WHEN d > 0 THEN max(up) END AS up, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n) AS ids
  FROM paths GROUP BY node, d),
families AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
known AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f USING (node)),
below AS (
  SELECT a.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.saved) AS saved_tokens
  FROM (SELECT DISTINCT a.node, b.node AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d) a
  JOIN known k ON k.node = a.lower GROUP BY a.node)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM known k JOIN below b USING (node) LEFT JOIN nodes p ON p.node = k.up"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan(templates: list[tuple], phrases: list[tuple[str, str]]) -> str:
    words = ", ".join(f"({k}, {_text(label)}, {band}, {needed}, {len(own)}, {_text(w)})" for k, label, band, needed, own in templates for w in own)
    bands = ", ".join(f"({band})" for band in sorted({t[2] for t in templates}))
    listed = ", ".join(f"([{', '.join(map(_text, p.split(' ')))}], {_text(label)})" for p, label in phrases)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM texts),
places AS (
  SELECT r, p, label FROM (SELECT t.r, t.ws, f.phrase, f.label, unnest(range(len(t.ws))) AS p FROM texts t, (VALUES {listed}) AS f(phrase, label))
  WHERE ws[p + 1:p + len(phrase)] = phrase),
base AS (SELECT r, count(*) AS n, min(p) AS lo, max(p) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY r),
templates(template, label, band, needed, size, w) AS (VALUES {words}),
blocks AS (
  SELECT r, band, unnest(CASE WHEN p >= band THEN [p // band, p // band - 1] ELSE [0] END) AS block, w
  FROM words, (VALUES {bands}) AS b(band)),
matches AS (
  SELECT r, label, count(DISTINCT w) / any_value(size) AS share FROM blocks JOIN templates USING (band, w)
  GROUP BY r, block, template, label HAVING count(DISTINCT w) >= any_value(needed)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM matches GROUP BY r)
SELECT t.doc_id, len(t.ws) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.best, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN base b USING (r) LEFT JOIN more m USING (r)"""


def collocations(min_count: int = 100, longest: int = 5, top: int = 2000) -> str:
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, {longest + 1})) AS k))),
counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {min_count}),
cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM counts WHERE k > 1),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, h.a AS l, t.a AS r, n.n, (1000::HUGEINT * x.a * n.n) // (h.a::HUGEINT * t.a) AS score
  FROM cuts x JOIN counts h ON h.lang = x.lang AND h.phrase = array_to_string(x.ws[1:x.c], ' ')
  JOIN counts t ON t.lang = x.lang AND t.phrase = array_to_string(x.ws[x.c + 1:], ' ') JOIN totals n ON n.lang = x.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
spans AS (SELECT lang, a, k, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS s FROM counts WHERE k > 2),
inner_parts AS (
  SELECT lang, array_to_string(ws[b:b + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, ws, s, unnest(range(1, k - s + 2)) AS b FROM spans) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100 * p.longer < 100 * b.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= {top}"""
