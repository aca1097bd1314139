"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

OP2 = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS v FROM places JOIN docs USING (r)),
again AS (SELECT v FROM windows GROUP BY v HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN again USING (v)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""

OP9 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (n + m - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""


#: CRC-32 of a text, byte by byte over the table of its polynomial.
_CRC = r"""crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
{0}_bytes AS (SELECT x, list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::INT, 2))::BIGINT) AS b FROM (SELECT DISTINCT x FROM {0})),
{0}_crc AS (SELECT x, xor(4294967295, list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c & 255, v) + 1)::INT]), 4294967295::BIGINT)) AS h FROM {0}_bytes, crc)"""

OP12 = (
    r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
own AS (SELECT r, unnest(w) AS x FROM docs),
other AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
every AS (SELECT x FROM own UNION ALL SELECT x FROM other),
"""
    + _CRC.format("every")
    + r""",
s AS (SELECT h % 10000 AS k, count(*) AS s FROM own JOIN every_crc USING (x) GROUP BY k),
t AS (SELECT h % 10000 AS k, count(*) AS t FROM other JOIN every_crc USING (x) GROUP BY k),
gains AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
sums AS (SELECT r, sum(gain)::BIGINT AS weight FROM own JOIN every_crc USING (x) JOIN gains ON k = h % 10000 GROUP BY r),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END::BIGINT AS rank FROM placed"""
)

OP13 = (
    r"""WITH own AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ids AS (SELECT doc_id::VARCHAR AS x FROM own WHERE doc_id IS NOT NULL),
"""
    + _CRC.format("ids")
    + r""",
placed AS (SELECT r, doc_id, w, h % 10 = 0 AS hit, (h // 10) % nullif(len(w), 0) AS a, h // 10 AS g FROM own LEFT JOIN ids_crc ON x = doc_id::VARCHAR),
docs AS (SELECT r, doc_id, CASE WHEN hit AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END)::BIGINT]) ELSE w END AS w FROM placed),
places AS (SELECT r, unnest(range(1, len(w) - 4)) AS i FROM docs),
six AS (SELECT r, i, array_to_string(w[i:i + 5], ' ') AS v FROM places JOIN docs USING (r)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS p FROM six a JOIN six b ON a.r = b.r AND a.v = b.v AND a.i < b.i),
marked AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM pairs),
equal AS (SELECT r, p, min(i) - 1 AS start, count(*) + 5 + p AS length FROM marked GROUP BY r, p, k),
runs AS (SELECT r, start, length, min(p) AS period FROM equal WHERE length >= 12 AND length >= 2 * p GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) + 1 AS i FROM runs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256, len(w)::BIGINT AS n_words
FROM docs LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
)
