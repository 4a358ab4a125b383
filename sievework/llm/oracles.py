"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

LEDGER = rf"""
base AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents),
worded AS (SELECT *, regexp_extract_all(body, '{_WORD}') AS ws FROM base),
placed AS (SELECT row_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM worded),
windows AS (
  SELECT row_no, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS win,
         lead(w, 4) OVER o IS NOT NULL AS whole
  FROM placed WINDOW o AS (PARTITION BY row_no ORDER BY i)
),
twice AS (SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, win) AS n FROM windows WHERE whole) WHERE n > 1),
repeated AS (
  SELECT row_no, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY row_no
),
lines AS (
  SELECT row_no, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM worded
),
measured AS (
  SELECT row_no, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(body, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(body, '[\x00-\x7F]', '', 'g'))::BIGINT AS n_high,
         length(regexp_replace(body, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM worded JOIN lines USING (row_no) LEFT JOIN repeated USING (row_no)
),
bits AS (
  SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, 2 * n_dup_lines > n_lines,
             n_letters >= 20 AND 2 * n_upper > n_letters, 5 * n_exclaims > n_words, word_chars > 25 * n_words,
             2 * (n_letters + n_high) < word_chars, n_lines >= 10 AND 2 * n_words < 3 * n_lines] AS f,
         ['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'capitals', 'exclamations', 'long_words', 'no_letters',
          'list_of_lines'] AS names
  FROM measured
)"""

RULE_LEDGER = rf"""
WITH {LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] OR f[2] AS base_failed,
       len(list_filter(f, lambda x: x)) = 0 AS kept,
       coalesce(list_sum(list_transform(range(1, 10), lambda i: CASE WHEN f[i] THEN 1 << (i - 1) ELSE 0 END)), 0)::BIGINT AS failed,
       CASE WHEN len(list_filter(f, lambda x: x)) = 1 THEN names[list_position(f, true)] END AS only_rule
FROM bits
"""

RULE_ABLATIONS = rf"""
WITH {LEDGER},
each AS (SELECT f, unnest(names) AS rule, unnest(f) AS hit, len(list_filter(f, lambda x: x)) AS n FROM bits)
SELECT rule, count(*) FILTER (hit) AS n_failed, count(*) FILTER (hit AND n = 1) AS n_only,
       count(*) FILTER (n = 0 OR (hit AND n = 1)) AS n_kept_without
FROM each GROUP BY rule
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM worded
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
),
linked AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

FILL_IN_MIDDLE = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
drawn AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, [('0x' || substr(k, 8 * i + 1, 8))::UBIGINT::BIGINT FOR i IN range(4)] AS h FROM hashed
),
cut AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
pieces AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""

REPEATED_PHRASES = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
),
windows AS (
  SELECT row_no, doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest([md5(array_to_string(ws[j:j + 49], ' ')) FOR j IN range(1, len(ws) - 48)]) AS win
  FROM worded WHERE len(ws) >= 50
),
firsts AS (SELECT win, min(doc_id) AS owner FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT row_no, i + k AS i
  FROM windows JOIN firsts USING (win), (SELECT unnest(range(50)) AS k) WHERE owner < doc_id
),
lost AS (SELECT row_no, list(i) AS places FROM gone GROUP BY row_no)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN ws WHEN len(places) = len(ws) THEN []
         ELSE list_where(ws, [NOT list_contains(places, j) FOR j IN range(1, len(ws) + 1)]) END, ' ')) AS kept_sha256
FROM worded LEFT JOIN lost USING (row_no)
"""

#: crc32 of the id's decimal digits, bit by bit: a digit's code is mixed in, then eight shifts (-1) follow.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
    [4294967295::BIGINT] || flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

PREFIX_TRIE = f"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT DISTINCT conv_id FROM numbered),
cuts AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS src, {_CRC32} % 6 AS h FROM convs),
joined AS (
  SELECT c, 0 AS own, i, role, text FROM cuts JOIN numbered ON numbered.conv_id = src WHERE i <= h
  UNION ALL SELECT c, 1, i, role, text FROM cuts JOIN numbered ON numbered.conv_id = c WHERE i > h
),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, md5(role || chr(1) || text) AS k, length(text) AS n FROM joined),
starts AS (
  SELECT c, 0 AS d, 0 AS n, '' AS p FROM cuts
  UNION ALL SELECT c, d, n, array_to_string(list(k) OVER (PARTITION BY c ORDER BY d), '') FROM turns
),
lens AS (SELECT c, max(d) AS len FROM starts GROUP BY c),
nodes AS (
  SELECT p, min(c) AS conv_id, any_value(d) AS depth, any_value(n) AS n, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN d = len THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM starts JOIN lens USING (c) GROUP BY p
),
family AS (SELECT p, left(p, greatest(length(p) - 32, 0)) AS up, depth FROM nodes),
kids AS (SELECT up, count(*) AS k FROM family WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.p),
under AS (
  SELECT left(x.p, 32 * s.s) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM full_nodes x, LATERAL (SELECT unnest(range(depth + 1)) AS s) s GROUP BY 1
)
SELECT x.conv_id, x.depth::BIGINT AS depth, CASE WHEN x.depth > 0 THEN a.conv_id END AS parent_conv_id, x.n_convs, x.n_children, n_leaves,
       saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN under USING (p) JOIN family f ON f.p = x.p JOIN nodes a ON a.p = f.up
"""
