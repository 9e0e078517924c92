"""SQL of the queries that SQL can express in full."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

DECONTAMINATION = rf"""
WITH document_words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), starts AS (
  SELECT item_id, w, least(len(w), 10) AS size,
         unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
  FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run FROM starts
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM document_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), found AS (
  SELECT p.doc_id, v.item_id, p.i, p.size
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run FROM places) p
  JOIN windows v ON v.size = p.size AND v.run = p.run
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM document_words
), terms AS (
  SELECT run, unnest(w) AS word, unnest(range(size)) AS spot, size
  FROM (SELECT DISTINCT size, array_to_string(w[i:i + size - 1], ' ') AS run, w[i:i + size - 1] AS w
        FROM starts)
), ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY run ORDER BY c, spot) AS rank,
         count(*) OVER (PARTITION BY run) AS known
  FROM terms t JOIN (SELECT word, count(*) AS c FROM words GROUP BY word) USING (word)
), candidates AS (
  SELECT DISTINCT doc_id, run, place - spot AS start
  FROM ranked JOIN words USING (word) WHERE rank = 1 AND known = size
), beside AS (
  SELECT c.doc_id, c.run, c.start
  FROM candidates c JOIN ranked r ON r.run = c.run
  JOIN words p ON p.doc_id = c.doc_id AND p.word = r.word
    AND p.place BETWEEN c.start + r.spot - 2 AND c.start + r.spot + 2
  GROUP BY c.doc_id, c.run, c.start, r.size HAVING count(DISTINCT r.spot) = r.size
), near AS (SELECT doc_id, count(DISTINCT run) AS n_near FROM beside GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM document_words d LEFT JOIN hits h ON h.doc_id = d.doc_id
LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN near n ON n.doc_id = d.doc_id
"""

JACCARD = rf"""
WITH RECURSIVE document_words AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])
  END AS s FROM document_words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (m + n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY ALL
"""

SHARDING = """
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END
  FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, length(h) // 2 + 16 AS size,
         xor(list_reduce(
           list_concat([4294967295::BIGINT],
             [('0x' || substr(h, i, 2))::BIGINT FOR i IN range(1, length(h), 2)]),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS text_crc32
  FROM bytes, crc_table
), walk AS (
  SELECT DISTINCT doc_id, 1 AS step, 0::BIGINT AS nxt, 0::BIGINT AS s40, 0::BIGINT AS s41
  FROM documents
  UNION ALL
  SELECT doc_id, step + 1, floor((nxt + 1) * 2147483648 /
           ((('0x' || substr(md5(doc_id || ':' || step), 1, 8))::BIGINT >> 1) + 1))::BIGINT,
         CASE WHEN nxt < 40 THEN nxt ELSE s40 END, CASE WHEN nxt < 41 THEN nxt ELSE s41 END
  FROM walk WHERE nxt < 41
), shards AS (
  SELECT doc_id, max(s40)::INTEGER AS shard, max(s41)::INTEGER AS grown_shard
  FROM walk GROUP BY doc_id
), placed AS (
  SELECT s.*, shard, grown_shard,
         ('0x' || substr(md5(concat_ws(':', s.doc_id, size, text_crc32)), 1, 8))::BIGINT % 256
           AS block
  FROM sized s JOIN shards h ON h.doc_id = s.doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1
         AS slot, grown_shard
FROM placed
"""

SEARCH = rf"""
WITH postings AS (
  SELECT number, doc_id, t, count(*) AS tf, any_value(n) AS n
  FROM (
    SELECT number, doc_id, len(w) AS n, unnest(w) AS t FROM (
      SELECT row_number() OVER () AS number, doc_id,
             regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents)
  ) GROUP BY ALL
), totals AS (
  SELECT count(*) AS texts, sum(n)::BIGINT AS terms
  FROM (SELECT number, any_value(n) AS n FROM postings GROUP BY number)
), weights AS (
  SELECT t, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY t, texts
), asked AS (
  SELECT item_id, t, count(*) AS repeats FROM (
    SELECT item_id,
           unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, number,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * texts) // terms))))
           ::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN postings USING (t), totals
  GROUP BY item_id, doc_id, number
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER
           AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

CONVERSATION_TRIE = """
WITH RECURSIVE bits AS (
  SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END
  FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said) AS w,
         hex(encode(conv_id::VARCHAR)) AS h
  FROM turns GROUP BY conv_id
), headed AS (
  SELECT conv_id, w, xor(list_reduce(
           list_concat([4294967295::BIGINT],
             [('0x' || substr(h, i, 2))::BIGINT FOR i IN range(1, length(h), 2)]),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS n
  FROM own, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(s.w, [])[1:c.n], c.w[c.n + 1:]) AS w
  FROM headed c LEFT JOIN headed s ON s.conv_id = c.conv_id - c.conv_id % 5
), paths AS (
  SELECT conv_id, w[1:d] AS k, d, len(w) = d AS ends
  FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM rebuilt)
), members AS (
  SELECT k, d, min(conv_id) AS node, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(k[d].text)) END AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), ''))
           AS ends_sha256
  FROM paths GROUP BY k, d
), family AS (
  SELECT m.*, p.node AS parent
  FROM members m LEFT JOIN members p ON p.d = m.d - 1 AND p.k = m.k[1:m.d - 1]
), children AS (
  SELECT parent, d - 1 AS d, count(*) AS n FROM family WHERE d > 0 GROUP BY ALL
), weighed AS (
  SELECT f.*, coalesce(c.n, 0) AS n_children, (f.n_convs - 1) * f.bytes AS saved
  FROM family f LEFT JOIN children c ON c.parent = f.node AND c.d = f.d
), above AS (
  SELECT p.conv_id, m.node, m.d FROM paths p JOIN members m ON m.d = p.d AND m.k = p.k
), sums AS (
  SELECT a.node, a.d, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.saved) AS saved
  FROM weighed w JOIN above a ON a.conv_id = w.node AND a.d <= w.d GROUP BY ALL
)
SELECT w.node AS conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs,
       w.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM weighed w JOIN sums s ON s.node = w.node AND s.d = w.d
"""

ORACLES = {
    "op5_benchmark_decontamination": DECONTAMINATION,
    "op6_ngram_jaccard_join": JACCARD,
    "op8_sharding": SHARDING,
    "op11_ranked_lexical_search": SEARCH,
    "op12_conversation_prefix_trie": CONVERSATION_TRIE,
}
