"""DuckDB SQL of the operators that SQL can express, for comparison on small tables.

The statements say what the results are, by windows, groups and joins over the plain texts; they share
nothing with the operators but the fixed thresholds.
"""

from __future__ import annotations

from .quality import MAX_COVERED_PERCENT, MAX_LONGEST_PERCENT, MAX_REPEAT_PERCENT, MIN_REPEAT, MIN_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of 200 bytes, as 400 hexadecimal digits, each counted once for every document that has the text.
SUFFIX_DEDUP = """
WITH texts AS MATERIALIZED (SELECT coalesce(text, '') AS t, count(*) AS copies, row_number() OVER () AS k FROM documents GROUP BY 1),
hexed AS MATERIALIZED (SELECT k, copies, hex(encode(t)) AS h, strlen(t) AS n FROM texts),
starts AS MATERIALIZED (SELECT k, copies, unnest(range(n - 199)) AS place, unnest(list_transform(range(n - 199), lambda i: md5_number(substr(h, 2 * i + 1, 400)))) AS w
                        FROM hexed WHERE n >= 200),
twice AS (SELECT w FROM starts GROUP BY w HAVING sum(copies) > 1),
hits AS (SELECT k, place, CASE WHEN place <= lag(place) OVER (PARTITION BY k ORDER BY place) + 200 THEN 0 ELSE 1 END AS fresh FROM starts SEMI JOIN twice USING (w)),
runs AS (SELECT k, min(place) AS a, max(place) + 200 AS b
         FROM (SELECT k, place, sum(fresh) OVER (PARTITION BY k ORDER BY place) AS run FROM hits) GROUP BY k, run),
gaps AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
               string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
        FROM gaps JOIN hexed USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM documents JOIN texts ON t = coalesce(text, '') JOIN hexed USING (k) LEFT JOIN cut USING (k)
"""

#: Five hexadecimal digits are four of base32.
WARC = """
WITH records AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
dealt AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id, sha1(payload) AS digest FROM records)
SELECT page_id, url, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM dealt
"""

#: Sets that are equal are one node; links by counting the shingles in common, components by reachability.
JACCARD = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3
             THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS s FROM worded),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
common AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS shared
           FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (na + nb - shared)),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN nodes USING (s) LEFT JOIN lowest USING (node)
"""

#: Repeats from MIN_REPEAT words: windows of that many words that are found twice, joined while both sides go on.
QUALITY = rf"""
WITH texts AS MATERIALIZED (SELECT coalesce(text, '') AS t, row_number() OVER () AS k FROM documents GROUP BY 1),
worded AS MATERIALIZED (SELECT t, k, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM texts),
three AS (SELECT k, place, count(*) OVER (PARTITION BY k, x) AS times
          FROM (SELECT k, unnest(range(1, len(w) - 1)) AS place, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM worded WHERE len(w) >= 3)),
repeated AS (SELECT k, count(DISTINCT place + d) AS n_repeat_words FROM three, (SELECT unnest(range(3)) AS d) WHERE times > 1 GROUP BY k),
ten AS (SELECT k, place, md5_number(x) AS x FROM (
          SELECT k, unnest(range(1, len(w) - {MIN_REPEAT - 2})) AS place, unnest(list_transform(range(1, len(w) - {MIN_REPEAT - 2}), lambda i: array_to_string(w[i:i + {MIN_REPEAT - 1}], ' '))) AS x
          FROM worded WHERE len(w) >= {MIN_REPEAT})),
found AS MATERIALIZED (SELECT k, place, x FROM ten QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
covered AS (SELECT k, count(DISTINCT place + d) AS n_covered_words FROM found, (SELECT unnest(range({MIN_REPEAT})) AS d) GROUP BY k),
pairs AS (SELECT a.k, b.place - a.place AS apart, a.place - row_number() OVER (PARTITION BY a.k, b.place - a.place ORDER BY a.place) AS run
          FROM found a JOIN found b ON a.k = b.k AND a.x = b.x AND a.place < b.place),
longest AS (SELECT k, max(pairs) + {MIN_REPEAT - 1} AS longest_repeat FROM (SELECT k, count(*) AS pairs FROM pairs GROUP BY k, apart, run) GROUP BY k),
counted AS (SELECT t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   coalesce(n_covered_words, 0) AS n_covered_words, coalesce(longest_repeat, 0) AS longest_repeat
            FROM worded LEFT JOIN repeated USING (k) LEFT JOIN covered USING (k) LEFT JOIN longest USING (k)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, longest_repeat, base_failed,
       NOT base_failed AND 100 * n_covered_words <= {MAX_COVERED_PERCENT} * n_words AND 100 * longest_repeat <= {MAX_LONGEST_PERCENT} * n_words AS kept
FROM documents JOIN judged ON judged.t = coalesce(text, '')
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
