"""DuckDB SQL of the llm queries that SQL can express, over the same whole tables."""

from __future__ import annotations

#: Rules and limits as in quality_rules, written out once more.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w) s),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) s WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) o GROUP BY doc_id),
b AS (SELECT w.doc_id, w.text, CAST(len(w) AS BIGINT) AS n_words,
             CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
             CAST(COALESCE(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols * 100 > n_words * 10
           OR length(regexp_replace(text, '[^A-Z]', '', 'g')) * 100 > length(text) * 50
           OR n_dup_lines * 100 > n_lines * 50 OR word_chars < 2 * n_words OR word_chars > 16 * n_words) AS kept
FROM f"""

_WORDS = (r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) s),
windows AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM d, (SELECT DISTINCT size FROM p) z WHERE len(w) >= size) s),
hits AS (SELECT n.doc_id, n.i, n.size, p.item FROM windows n JOIN p ON p.size = n.size AND p.k = n.k),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, i, unnest(range(0, size)) AS j FROM hits) h
              GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(h.n, 0) AS n_hit, COALESCE(i.n, 0) AS n_items,
       sha256(COALESCE(i.names, '')) AS items_sha256, COALESCE(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""
