"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
s AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s WHERE len(w) >= k)
),
h AS (SELECT DISTINCT doc_id, p.k, i, item_id FROM p JOIN g ON g.k = p.k AND g.gram = p.gram),
c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, k, i FROM h)) GROUP BY doc_id
),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_QUALITY = r"""
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
  FROM (SELECT doc_id, i, w[i : i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
),
t AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM r WHERE n > 1) GROUP BY doc_id
),
f AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(text, '\p{Lu}{3,}')) AS capitals
  FROM d LEFT JOIN t USING (doc_id)
),
q AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR 10 * capitals > 3 * n_words OR 2 * n_dup_lines > n_lines
         OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 12) AS rejected
  FROM f
)"""

ORACLES["op4_quality_rules"] = f"""
WITH {_QUALITY}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM q
"""

ORACLES["op11_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(s) WHERE len(w) >= s),
g AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f FROM e GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE s > 1 AND f >= 10),
k AS (
  SELECT c.lang, c.phrase, c.s, c.a, k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM c) AS c
  JOIN g AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN g AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.s], ' ')
),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, inner_phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i : i + 1], ' ') AS inner_phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE s = 3)
  ) GROUP BY ALL
),
f AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.inner_phrase = b.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < 50 * a
)
SELECT f.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000
"""
