"""DuckDB SQL of those operators whose results SQL can express."""

from __future__ import annotations

from .sharding import SALTS


def _nibble_table() -> list[int]:
    """CRC-32 of four bits, by the reflected polynomial."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: Pairs of vectors with a cosine of 0.9 or more, and what each vector reaches over them.
EMBEDDING_LINKS = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reached(a, b) AS (
  SELECT a, b FROM linked
  UNION
  SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a), counted AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN counted c ON e.vec_id = c.a
"""

#: Documents whose sets of 3-word shingles are similar by 0.85 or more, and what each reaches over them.
NEAR_COPIES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS item
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))
), reached(a, b) AS (
  SELECT a, b FROM linked
  UNION
  SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

#: Rendezvous hashing over shards 0 to 39 and one more, slots by the salt of id, checksum and size and then by them; CRC-32 by half bytes.
SHARDS = rf"""
WITH scored AS (
  SELECT k, shard, -1.0::DOUBLE / ln((('0x' || substr(md5(k || '/' || shard), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) AS score
  FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM documents), range(41) t(shard)
), best AS (
  SELECT k, arg_min(shard, (-score, shard)) FILTER (shard < 40) AS shard, arg_min(shard, (-score, shard)) AS grown
  FROM scored GROUP BY k
), sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(
        string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), ''), lambda x: strpos('123456789ABCDEF', x)::UBIGINT),
      lambda c, n: xor(xor(c, n) >> 4, list_extract({_nibble_table()}, (xor(c, n) & 15)::INT + 1)::UBIGINT)), 4294967295)::BIGINT AS text_crc32
  FROM documents
), placed AS (
  SELECT s.*, b.shard, b.grown, ('0x' || substr(md5(concat_ws('/', s.k, s.text_crc32, s.size)), 1, 4))::BIGINT % {SALTS} AS salt FROM sized s JOIN best b USING (k)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM placed
"""

#: Digests of the turns; each escaped character of a rendered turn counts twice.
CHATS = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
), sized AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>\[\]]', '', 'g'))
    + length('<s>[role][/role]</s>') AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Gains of buckets, weights of documents, noise, and ranks of the drawn ones; CRC-32 once for each distinct word.
RESAMPLED = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), own AS (SELECT r, unnest(w) AS f FROM worded), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), hashed AS (
  SELECT f, (xor(list_reduce([4294967295::UBIGINT] || list_transform(
      string_split(regexp_replace(hex(encode(f)), '(.)(.)', '\2\1', 'g'), ''), lambda x: strpos('123456789ABCDEF', x)::UBIGINT),
    lambda c, n: xor(xor(c, n) >> 4, list_extract({_nibble_table()}, (xor(c, n) & 15)::INT + 1)::UBIGINT)), 4294967295) % 10000)::INT AS bucket
  FROM (SELECT f FROM own UNION SELECT f FROM wanted)
), s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (f) GROUP BY bucket), gains AS (
  SELECT b AS bucket, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
    / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) b(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), summed AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM own JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE + 0.5)
    / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN summed USING (r)
), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS k FROM scored WHERE n_features >= 20)
SELECT c.doc_id, c.n_features, c.weight, c.score,
  CASE WHEN k <= (SELECT count(*) * 10 // 100 FROM ranked) THEN k END::BIGINT AS rank
FROM scored c LEFT JOIN ranked USING (r)
"""

ORACLE_SQL = {
    "op2_embedding_dedup": EMBEDDING_LINKS,
    "op3_minhash_dedup": NEAR_COPIES,
    "op4_sharding": SHARDS,
    "op9_chat_formatting": CHATS,
    "op13_importance_resampling": RESAMPLED,
}
