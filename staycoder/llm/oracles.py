"""DuckDB SQL of the numbered operators' queries, where SQL can express them on whole tables."""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Windows of 200 bytes are stretches of 400 hexadecimal digits.
OP1 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(range(len(h) // 2 - 199)) AS p, h FROM d WHERE len(h) >= 400
), k AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM w
), r AS (
  SELECT doc_id, p FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)
), edges AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r
), numbered AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Five hexadecimal digits of a SHA-1 are four signs of base 32.
OP6 = """
WITH d AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), s AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS x FROM d
), t AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) // CAST(power(32, 3 - i % 4) AS INTEGER)) % 32 + 1 AS BIGINT), 1)), '')
    AS payload_digest FROM s
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

# In which of the 120 orders what happens to a document depends on the set of its failures only.
OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents
), c AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
    min(doc_id) OVER (PARTITION BY t) AS least
  FROM d
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * caps > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN c.doc_id > least OR (c.doc_id IS NULL AND least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM c LEFT JOIN marks m ON c.doc_id = m.doc_id
), n AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), grow(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT filter_order || x FROM grow, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS letter, substr(filter_order, 1, i - 1) AS earlier
  FROM grow, (SELECT unnest(range(1, 6)) AS i) WHERE length(filter_order) = 5
), happens AS (
  SELECT part, filter_order, step, letter, n, good, toxic,
    contains(fails, letter) AS has, fails = letter AS sole,
    len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone
  FROM n, steps
), sums AS (
  SELECT part, filter_order, step, letter,
    CAST(sum(CASE WHEN NOT gone AND NOT has THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND has THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND has THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN sole THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND has THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND has THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM happens GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""
# crc32 is a fold over the digits with the 256-entry table of the reflected polynomial 0xEDB88320 (3988292384).
OP13 = """
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
), t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, b: xor(s // 256, crc[CAST(xor(s % 256, b) AS BIGINT) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t), bits
), rebuilt AS (
  SELECT v.c, b.pos, b.role, b.text FROM convs v JOIN t b ON b.c = v.c - v.c % 100 AND b.pos <= v.h
  UNION ALL
  SELECT t.c, t.pos + 5, role, text FROM t JOIN convs v ON v.c = t.c WHERE t.pos > v.h
), members AS (
  SELECT c, row_number() OVER s AS depth, length(text) AS n,
    string_agg(md5(length(role) || ':' || role || text), '') OVER s AS prefix
  FROM rebuilt WINDOW s AS (PARTITION BY c ORDER BY pos)
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
), ends AS (
  SELECT prefix, string_agg(c, ',' ORDER BY c) AS ids
  FROM members m JOIN (SELECT c, max(depth) AS depth FROM members GROUP BY c) l USING (c, depth) GROUP BY prefix
), nodes AS (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n FROM members GROUP BY prefix, depth
), children AS (
  SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), subtree AS (
  SELECT a.prefix, count(*) FILTER (WHERE k.prefix IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.n) AS saved_tokens
  FROM nodes d JOIN members a ON a.c = d.conv_id AND a.depth <= d.depth LEFT JOIN children k ON k.prefix = d.prefix
  GROUP BY a.prefix
)
SELECT d.conv_id, d.depth, p.conv_id AS parent_conv_id, d.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes d JOIN subtree s USING (prefix) LEFT JOIN children k USING (prefix) LEFT JOIN ends e USING (prefix)
LEFT JOIN nodes p ON d.depth > 0 AND p.prefix = left(d.prefix, 32 * (d.depth - 1))
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w
), n AS (
  SELECT doc_id, count(x) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM s l JOIN s r USING (x) WHERE l.doc_id <> r.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach(doc_id, least) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.least < links.b
)
SELECT doc_id, n AS n_shingles, least AS component_id
FROM n JOIN (SELECT doc_id, min(least) AS least FROM reach GROUP BY doc_id) USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op5_exact_topk": OP5,
    "op6_warc": OP6,
    "op7_jaccard_join": OP7,
    "op12_filter_audit": OP12,
    "op13_conversation_trie": OP13,
}
