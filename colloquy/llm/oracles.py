"""DuckDB SQL for the registered queries that SQL can express."""

ORACLES = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < owner THEN owner END AS refers_to
FROM m
""",
    # crc32 byte by byte, from a table that its polynomial gives; once for each distinct feature.
    "op12_resample": """
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, 0 AS step, i::BIGINT AS c FROM range(256) AS r(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8
), texts AS (
  SELECT 0 AS part, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), split AS (
  SELECT part, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), listed AS (
  SELECT part, r, doc_id, len(w) AS n_words,
    w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f
  FROM split
), used AS (
  SELECT part, r, f, count(*) AS n FROM (SELECT part, r, unnest(f) AS f FROM listed) GROUP BY ALL
), names AS (
  SELECT DISTINCT f, hex(encode(f)) AS h FROM used
), hashed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM names, crc
), counts AS (
  SELECT b, coalesce(sum(n) FILTER (part = 0), 0) AS s, coalesce(sum(n) FILTER (part = 1), 0) AS t
  FROM used JOIN hashed USING (f) GROUP BY b
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts
), gains AS (
  SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts, totals
), summed AS (
  SELECT r, sum(n * gain) AS total FROM used JOIN hashed USING (f) JOIN gains USING (b) WHERE part = 0 GROUP BY r
), weighed AS (
  SELECT doc_id, n_words, len(f)::BIGINT AS n_features,
    CASE WHEN len(f) = 0 THEN 0
      ELSE (total - ((total % len(f)) + len(f)) % len(f)) // len(f) END::BIGINT AS weight,
    ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM listed LEFT JOIN summed USING (r) WHERE part = 0
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
FROM placed
""",
}
