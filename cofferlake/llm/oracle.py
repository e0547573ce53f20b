"""SQL for DuckDB that gives the rows of queries which SQL can express."""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM b
"""

#: Every string of 50 bytes with the least doc_id that holds it; starts of removed strings make runs, the rest is kept.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(n_bytes - 49)) AS i FROM d WHERE n_bytes >= 50)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)) GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)
"""

#: Sets of three-word shingles, links at 85 percent, and the least doc_id that links lead to.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(len(words) - 2), lambda i: array_to_string(words[i + 1 : i + 3], ' ')) WHEN len(words) > 0 THEN ['=' || array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM sides UNION SELECT r.node, l.b FROM reach r JOIN sides l ON l.a = r.seen),
least AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: ``crc`` holds the remainders of all bytes; CRC32_SQL gives the checksum of a list of bytes.
CRC_TABLE_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
CRC32_SQL = "xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

#: Each row's least draw at root, region and rack, in the layout of 16 shards and in that with one more.
SHARDS_SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {CRC32_SQL.format(text="coalesce(text, '')")} AS text_crc32 FROM documents, crc),
shards AS (SELECT range AS shard, CASE WHEN range < 16 THEN 'r' || range // 8 ELSE 'g16' END AS region, CASE WHEN range < 16 THEN 'r' || range // 8 || '/k' || range // 4 ELSE 'g16/g16k' END AS rack FROM range(17)),
nodes AS (SELECT '' AS node, region AS child, CAST(count(*) AS DOUBLE) AS weight FROM shards GROUP BY region UNION ALL SELECT region, rack, count(*) FROM shards GROUP BY region, rack UNION ALL SELECT rack, CAST(shard AS VARCHAR), 1 FROM shards),
ids AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
draws AS (SELECT key, node, child, -ln((CAST('0x' || substr(md5(key || '|' || child), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS draw FROM ids, nodes),
steps AS (SELECT key, node, arg_min(child, draw) AS next, arg_min(child, draw) FILTER (child <> 'g16') AS old FROM draws GROUP BY key, node),
places AS (SELECT a.key, CAST(c.old AS INT) AS shard, CAST(f.next AS INT) AS grown_shard FROM steps a JOIN steps b ON b.key = a.key AND b.node = a.old JOIN steps c ON c.key = a.key AND c.node = b.old
  JOIN steps e ON e.key = a.key AND e.node = a.next JOIN steps f ON f.key = a.key AND f.node = e.next WHERE a.node = '')
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY round, cell, doc_order, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // 65536 AS round, 0 AS cell, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || text_crc32 || '/' || size) AS doc_order FROM d) JOIN places ON key = coalesce(CAST(doc_id AS VARCHAR), '')
"""

#: ``f`` holds, from the last row back, the cost from each state (start, after system, user, assistant); the walk forward takes the least letter that keeps it.
REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_SQL.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d)),
r AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN shown = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
w AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS fits, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cut FROM r),
back AS (
  SELECT conv_id, n AS i, [0, 6, 3, 0] AS f FROM (SELECT DISTINCT conv_id, n FROM w)
  UNION ALL
  SELECT conv_id, i, [least(g[1], 3 + g[3], 6 + g[4]), least(g[2], 3 + g[3], 6 + g[4]), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])] FROM (
    SELECT b.conv_id, b.i - 1 AS i, [
      least(4 + f[1], CASE WHEN fits THEN 3 + cut + f[3] END, CASE WHEN fits AND initial = 's' THEN cut + f[2] END, CASE WHEN fits AND initial = 'u' THEN cut + f[3] END),
      least(4 + f[2], CASE WHEN fits THEN 3 + cut + f[3] END, CASE WHEN fits AND initial = 'u' THEN cut + f[3] END),
      least(4 + f[3], CASE WHEN fits THEN 3 + cut + f[4] END, CASE WHEN fits AND initial = 'a' THEN cut + f[4] END),
      least(4 + f[4], CASE WHEN fits THEN 3 + cut + f[3] END, CASE WHEN fits AND initial = 'u' THEN cut + f[3] END)] AS g
    FROM back b JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i)),
steps AS (SELECT b.conv_id, b.i, b.f, a.f AS after, w.role, w.text, w.initial, w.fits, w.cut FROM back b LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 LEFT JOIN back a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i + 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS s, '' AS audit, '' AS said FROM steps WHERE i = 0
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE put END, audit || edit,
    said || CASE WHEN edit = 'D' THEN '' ELSE CASE WHEN said = '' THEN '' ELSE chr(10) END || CASE WHEN edit = 'K' THEN role WHEN put = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT k.*, t.role, t.text, t.initial, p.put,
      CASE WHEN t.after IS NULL OR (4 + t.after[k.s] <> t.f[k.s] AND 3 + t.f[p.put] = t.f[k.s]) THEN 'I' WHEN 4 + t.after[k.s] = t.f[k.s] THEN 'D'
        WHEN t.fits AND ((t.initial = 's' AND k.s = 1 AND t.cut + t.after[2] = t.f[k.s]) OR (t.initial = 'u' AND k.s <> 3 AND t.cut + t.after[3] = t.f[k.s]) OR (t.initial = 'a' AND k.s = 3 AND t.cut + t.after[4] = t.f[k.s])) THEN 'K' ELSE 'R' END AS edit
    FROM walk k JOIN steps t ON t.conv_id IS NOT DISTINCT FROM k.conv_id AND t.i = k.i, LATERAL (SELECT CASE WHEN k.s = 3 THEN 4 ELSE 3 END AS put) p WHERE t.after IS NOT NULL OR k.s IN (2, 3))),
done AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said FROM walk GROUP BY conv_id),
first AS (SELECT conv_id, f[1] AS cost FROM back WHERE i = 0),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM w) GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN first x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""
