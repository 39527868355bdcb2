"""The queries of this package in SQL, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op1_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, md5(CAST(doc_id AS VARCHAR)) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS round, source, source_size, weight, FALSE AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         capped OR weight * (total - given) >= 3 * source_size * open_weight
  FROM (SELECT *, sum(source_size) OVER () AS total,
               coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS given,
               sum(CASE WHEN NOT capped THEN weight END) OVER () AS open_weight
        FROM rounds)
  WHERE round < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size, total, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(weight * (total - given) AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target
  FROM (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
               CAST(coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS given,
               sum(CASE WHEN NOT capped THEN weight END) OVER () AS open_weight
        FROM rounds WHERE round = (SELECT max(round) FROM rounds))),
q AS (
  SELECT d.doc_id, d.h, d.size, t.total, turn, CAST(turn * t.source_size + sum(d.size) OVER (
           PARTITION BY d.source, turn ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS DOUBLE) / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, range(3) r(turn) WHERE d.size > 0),
k AS (
  SELECT doc_id, count(*) AS copies FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, turn, size ROWS UNBOUNDED PRECEDING) AS words FROM q)
  WHERE words <= total GROUP BY doc_id)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken, CAST(coalesce(k.copies, 0) AS BIGINT) AS copies
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.doc_id = k.doc_id
"""

SQL["op10_shards"] = """
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),
walk AS (
  SELECT doc_id, shards, CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS state,
         CAST(-1 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS jump
  FROM ids, (VALUES (40), (41)) n(shards)
  UNION ALL
  SELECT doc_id, shards, state, jump, CAST(floor(CAST(jump + 1 AS DOUBLE)
           * (CAST(2147483648.0 AS DOUBLE) / CAST((state // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, shards, jump, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state
        FROM walk WHERE jump < shards)),
place AS (
  SELECT doc_id, max(CASE WHEN shards = 40 THEN bucket END) AS shard, max(CASE WHEN shards = 41 THEN bucket END) AS grown
  FROM walk GROUP BY doc_id),
poly AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
    FROM range(256) r(b))),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(0, size - 16), lambda i: CAST(('0x' || substr(bytes, 2 * i + 1, 2)) AS BIGINT))),
           lambda x, y: xor(x // 256, crcs[CAST(xor(x, y) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM d, poly)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(CAST(c.doc_id AS VARCHAR)), c.doc_id, size, text_crc32) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN place ON c.doc_id = place.doc_id
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))),
hits AS (SELECT doc_id, i, win.m, item_id FROM runs JOIN win ON runs.s = win.s AND runs.m = win.m),
places AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(places.n, 0) > 0 AND 20 * coalesce(places.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

# The kinds in their order: pattern, the group whose length counts, its least length.
_SECRET_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", 0, 0),
]

SQL["op3_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS found, "
    f"regexp_extract_all(t, '{pattern}', {group}) AS vals, regexp_split_to_array(t, '{pattern}') AS pieces FROM d "
    f"WHERE regexp_matches(t, '{pattern}')"
    for rank, (kind, pattern, group, least) in enumerate(_SECRET_KINDS))}),
m AS (
  SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM k)),
s AS (
  SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || (start + len(found[i])) AS span
  FROM m WHERE len(vals[i]) >= least),
g AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

SQL["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s) m ON w.s = m.s WHERE m.least < w.doc_id),
o AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (
  SELECT e.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

SQL["op8_top_products"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h, payload_bytes) AS newest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM b
"""

SQL["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, p, lines[p] AS line, translate(trim(lines[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM d)),
k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE len(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, p, line, coalesce(k.last <> l.doc_id, FALSE) AS gone FROM l LEFT JOIN k ON l.key = k.key)
GROUP BY doc_id
"""

SQL["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.m, c.phrase, a, k, l.n AS l, r.n AS r,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
most AS (SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT b.* FROM b LEFT JOIN most USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, rank, phrase, a, l, r, t.n AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN t USING (lang)
WHERE rank <= 2000
"""
