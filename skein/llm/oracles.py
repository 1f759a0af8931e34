"""DuckDB SQL for the queries that it can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE f.top <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
    FILTER (WHERE f.top IS NULL OR f.top = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
""",
    "op7_quality_cascade": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i:i + 4] AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), hits AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM hits, (SELECT unnest(range(5)) AS o) GROUP BY doc_id
), measures AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN repeats USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols > 0.3 * n_words OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 25 * greatest(n_words, 1)
      OR 2 * n_dup_lines > n_lines OR n_upper > 0.7 * n_words OR n_digits > 0.7 * word_chars AS rejected
  FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM judged
""",
    "op9_suffix_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (
  SELECT doc_id, i, array_slice(b, i, i + 49) AS s
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)
), lost AS (
  SELECT doc_id, i FROM starts JOIN (SELECT s, min(doc_id) AS first FROM starts GROUP BY s) USING (s) WHERE first < doc_id
), edges AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER w > 50, true) AS fresh FROM lost WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS z, lag(max(i) + 49, 1, 0) OVER (PARTITION BY doc_id ORDER BY min(i)) AS before
  FROM numbered GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(CASE WHEN a - 1 > before THEN hex(array_slice(b, before + 1, a - 1)) ELSE '' END, '' ORDER BY a) AS h
  FROM runs JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b WHEN last < octet_length(b)
    THEN unhex(h || hex(array_slice(b, last + 1, octet_length(b)))) ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op10_cover_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)
), lost AS (
  SELECT doc_id, i FROM starts JOIN (SELECT s, min(doc_id) AS first FROM starts GROUP BY s) USING (s)
  WHERE first < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d
), marked AS (
  SELECT w.doc_id, word, pos,
    coalesce(pos - max(i) OVER (PARTITION BY w.doc_id ORDER BY pos) < 50, false) AS gone
  FROM words w LEFT JOIN lost l ON l.doc_id = w.doc_id AND l.i = w.pos
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t
  FROM marked GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op6_chosen_path_join": r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT coalesce(text, '') AS t, min(doc_id) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents GROUP BY 1
), shingles AS MATERIALIZED (
  SELECT DISTINCT id, ws[i:i + 4] AS s
  FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM texts WHERE len(ws) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (
  SELECT a.id, b.id AS id2, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2
), half AS MATERIALIZED (
  SELECT c.id, c.id2 FROM common c JOIN sizes x ON x.id = c.id JOIN sizes y ON y.id = c.id2
  WHERE c.n >= 0.8 * (x.n + y.n - c.n) - 1e-6
), links AS MATERIALIZED (SELECT id, id2 FROM half UNION ALL SELECT id2, id FROM half),
reach AS (
  SELECT id, id AS root FROM texts WHERE len(ws) > 0
  UNION
  SELECT l.id2, r.root FROM reach r JOIN links l ON l.id = r.id WHERE r.root < l.id2
), classes AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
counts AS (SELECT id, count(*) AS n_links FROM links GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN texts t ON t.t = coalesce(d.text, '') LEFT JOIN classes c ON c.id = t.id LEFT JOIN counts n ON n.id = t.id
""",
}


# The crc32 of the decimal id goes bit by bit: each digit, then eight shifts (-1).
PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
             string_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END),
         4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
built AS (
  SELECT v.c, 0 AS part, pos, r, t FROM convs v JOIN turns b ON b.c = v.base AND pos < h
  UNION ALL SELECT v.c, 1, pos, r, t FROM convs v JOIN turns o ON o.c = v.c AND pos >= h),
paths AS (
  SELECT c, coalesce(list({'r': r, 't': t} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS p
  FROM convs LEFT JOIN built USING (c) GROUP BY c),
members AS (SELECT c, len(p) AS m, d, p[1:d] AS node FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, min(c) AS conv, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m = d) AS ends
  FROM members GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
valued AS (
  SELECT nodes.*, coalesce(k, 0) AS n_children,
         CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(node[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children USING (node, d)),
subtrees AS (
  SELECT node[1:e] AS node, e AS d, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM valued) GROUP BY 1, 2)
SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN subtrees s ON s.node = v.node AND s.d = v.d
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.node = v.node[1:v.d - 1]
"""
SQL["op11_prefix_trie"] = PREFIX_TRIE
