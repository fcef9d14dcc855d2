"""Oracle SQL: fetch outcomes, integrity and manifests."""

from threadlake.plans.oracle import query, view

view("v_attempts", """
SELECT CAST(l_orderkey AS VARCHAR) AS file_key, CAST(l_orderkey % 97 AS VARCHAR) AS thread_nr,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
       l_returnflag <> 'R' AS dl_success,
       CASE WHEN l_returnflag <> 'R' THEN l_linestatus = 'F' END AS md5_match,
       CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS bytes_received,
       CAST(floor(l_extendedprice) AS BIGINT) AS content_length
FROM lineitem""")

view("v_resolved", """
SELECT a.file_key, CAST(max(a.n) AS BIGINT) AS n_attempts,
       arg_max(a.dl_success, a.n) AS dl_success,
       arg_max(a.md5_match, a.n) FILTER (WHERE a.md5_match IS NOT NULL) AS md5_match
FROM v_attempts a JOIN (
  SELECT file_key, min(n) FILTER (WHERE md5_match) AS first_match, max(n) AS n_max
  FROM v_attempts WHERE n <= 2 GROUP BY 1) s ON s.file_key = a.file_key
WHERE a.n <= least(COALESCE(s.first_match, 2), s.n_max)
GROUP BY a.file_key""", "v_attempts")

view("v_manifest", """
SELECT doc_id AS seq, md5_hex, path FROM v_media
UNION ALL
SELECT doc_id + 1000000000, md5_hex, path FROM v_media WHERE doc_id % 10 = 0""", "v_media")

view("v_decisions", """
SELECT m.doc_id, m.md5_hex, m.path, m.doc_id % 2 = 0 AS keep, md5(d.text || '#') AS actual_md5_hex
FROM v_media m JOIN documents d ON d.doc_id = m.doc_id WHERE m.doc_id % 7 = 0""", "v_media")

query("resolve_attempts", "SELECT file_key, n_attempts, dl_success, md5_match FROM v_resolved", "v_resolved")

query("short_reads", """
SELECT file_key, CAST(n AS BIGINT) AS n, bytes_received, content_length,
       bytes_received < content_length AS short_read,
       dl_success AND NOT (bytes_received < content_length) AS dl_success,
       CASE WHEN dl_success AND NOT (bytes_received < content_length) THEN md5_match END AS md5_match
FROM v_attempts""", "v_attempts")

query("route_outcomes", """
SELECT file_key, dl_success, md5_match,
       COALESCE(dl_success, false) AS to_report,
       COALESCE(dl_success, false) AND COALESCE(md5_match, false) AS to_index,
       COALESCE(dl_success, false) AND NOT COALESCE(md5_match, true) AS to_quarantine
FROM v_resolved""", "v_resolved")

query("progress", """
SELECT CAST(CAST(file_key AS BIGINT) % 97 AS VARCHAR) AS thread_nr, COUNT(*) AS n_processed,
       COUNT(*) FILTER (WHERE COALESCE(dl_success, false)) AS n_fetched,
       COUNT(*) FILTER (WHERE COALESCE(dl_success AND md5_match, false)) AS n_verified
FROM v_resolved GROUP BY 1""", "v_resolved")

query("integrity_report", """
WITH f AS (SELECT CAST(CAST(file_key AS BIGINT) % 97 AS VARCHAR) AS thread_nr, file_key
           FROM v_resolved WHERE dl_success AND NOT md5_match)
SELECT DISTINCT thread_nr, '0' AS line_key, 'Failed MD5s of Thread No. ' || thread_nr || ':' AS line FROM f
UNION ALL
SELECT thread_nr, '1' || file_key, file_key FROM f""", "v_resolved")

query("failure_text", """
WITH f AS (SELECT CAST(CAST(file_key AS BIGINT) % 97 AS VARCHAR) AS thread_nr, file_key
           FROM v_resolved WHERE dl_success AND NOT md5_match)
SELECT DISTINCT thread_nr AS thread, 'Failed MD5s of Thread No. ' || thread_nr || ':' AS line FROM f
UNION ALL
SELECT thread_nr, file_key FROM f""", "v_resolved")

query("integrity", """
SELECT m.doc_id, m.path,
       CASE WHEN m.doc_id % 7 = 0 THEN to_base64(unhex(md5(d.text || '#'))) ELSE m.md5_b64 END AS declared_b64,
       m.md5_hex AS actual_hex,
       from_base64(CASE WHEN m.doc_id % 7 = 0 THEN to_base64(unhex(md5(d.text || '#'))) ELSE m.md5_b64 END)
         = unhex(m.md5_hex) AS md5_match
FROM v_media m JOIN documents d ON d.doc_id = m.doc_id""", "v_media")

query("skip_existing", """
SELECT doc_id, path FROM v_media r WHERE doc_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM v_index i WHERE i.path = r.path)""", "v_media", "v_index")

query("manifest_parse", """
SELECT seq, md5_hex, path FROM v_manifest""", "v_manifest")

query("manifest_lines", """
SELECT m.doc_id,
       lower(hex(from_base64(m.md5_b64))) || ' *' || regexp_extract(m.path, '^([^/]*)/', 1) || '/'
       || CAST(m.doc_id + 1500000000000 AS VARCHAR) || '.' || m.ext AS line
FROM v_media m JOIN v_resolved r ON r.file_key = CAST(m.doc_id AS VARCHAR)
WHERE COALESCE(r.dl_success, false)""", "v_media", "v_resolved")

query("manifest_append", """
SELECT lower(hex(from_base64(m.md5_b64))) AS md5_hex,
       regexp_extract(m.path, '^([^/]*)/', 1) || '/' || CAST(m.doc_id + 1500000000000 AS VARCHAR) || '.' || m.ext AS path
FROM v_media m JOIN v_resolved r ON r.file_key = CAST(m.doc_id AS VARCHAR)
WHERE COALESCE(r.dl_success, false)""", "v_media", "v_resolved")

query("manifest_merge", """
SELECT doc_id, regexp_extract(path, '^([^/]*)/', 1) AS rel_dir, md5_hex, regexp_extract(path, '/(.*)$', 1) AS path,
       md5_hex || ' *' || path AS line
FROM v_media""", "v_media")

query("quarantine_apply", """
WITH hit AS (
  SELECT f.seq, d.keep, d.actual_md5_hex
  FROM (SELECT md5_hex, path, min(seq) AS seq FROM v_manifest GROUP BY 1, 2) f
  JOIN v_decisions d ON d.md5_hex = f.md5_hex AND d.path = f.path)
SELECT m.seq, CASE WHEN h.keep THEN h.actual_md5_hex ELSE m.md5_hex END AS md5_hex, m.path
FROM v_manifest m LEFT JOIN hit h ON h.seq = m.seq
WHERE COALESCE(h.keep, true)""", "v_manifest", "v_decisions")

query("quarantine_kept", """
SELECT md5_hex, path, md5_hex || ' *' || path AS line FROM v_decisions WHERE keep""", "v_decisions")

query("quarantine_listing", """
SELECT regexp_extract(path, '^([^/]*)/', 1) AS thread_nr, doc_id AS seq, path,
       CAST(row_number() OVER (PARTITION BY regexp_extract(path, '^([^/]*)/', 1) ORDER BY doc_id) - 1 AS BIGINT) AS idx,
       '(' || CAST(row_number() OVER (PARTITION BY regexp_extract(path, '^([^/]*)/', 1) ORDER BY doc_id) - 1 AS VARCHAR)
       || ') ' || regexp_extract(path, '/([^/]*)$', 1) AS line
FROM v_decisions""", "v_decisions")
