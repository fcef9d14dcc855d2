"""Oracle SQL: scalar functions and predicates."""

from threadlake.plans.oracle import half_even_div, query, view

SANITIZE = "trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}} _()\\-]', '_', 'g'))"


def sanitize(x: str) -> str:
    return SANITIZE.format(x=x)


def size_text_sql(b: str) -> str:
    return (f"CASE WHEN {b} < 1048576 THEN CAST({b} // 1024 AS VARCHAR) || ' KB' "
            f"ELSE CAST(({b} * 100 // 1048576) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(({b} * 100 // 1048576) % 100 AS VARCHAR), 2, '0') || ' MB' END")


def size_text_mb_sql(t: str) -> str:
    pat = "'^([0-9]+(?:\\.[0-9]+)?) (KB|MB)$'"
    amount = f"regexp_extract({t}, {pat}, 1)"
    unit = f"regexp_extract({t}, {pat}, 2)"
    milli = f"CAST(CAST({amount} AS DECIMAL(20,3)) * 1000 AS BIGINT)"
    kb = f"CAST({half_even_div(f'{milli} * 100', 1024000)} / 100.0 AS DECIMAL(12,2))"
    mb = f"CASE WHEN regexp_matches({amount}, '^[0-9]+(\\.[0-9]{{1,2}}0*)?$') THEN CAST({amount} AS DECIMAL(12,2)) END"
    return (f"CASE WHEN NOT regexp_matches({t}, {pat}) THEN NULL "
            f"WHEN {unit} = 'KB' THEN {kb} ELSE {mb} END")


view("v_names", """
SELECT doc_id, lang, source, n_chars, text,
       CAST(doc_id + 1500000000000 AS VARCHAR) AS name_4ch,
       CASE doc_id % 4
         WHEN 0 THEN CAST(n_chars AS VARCHAR) || '_' || source || '_' || lang
         WHEN 1 THEN lang || '-' || CAST(n_chars AS VARCHAR) || '-' || source
         WHEN 2 THEN 'by_' || source || '_' || lang
         ELSE CAST(doc_id AS VARCHAR) || '.' || lang || '_' || source END AS orig_name
FROM documents""")

view("v_urls", """
SELECT page_id, CASE page_id % 5
  WHEN 0 THEN 'https://boards.4chan.org/gif/thread/' || CAST(page_id AS VARCHAR)
  WHEN 1 THEN 'https://i.4cdn.org/wsg/' || CAST(page_id + 1500000000000 AS VARCHAR) || '.webm'
  WHEN 2 THEN '//is2.4chan.org/gif/' || CAST(page_id + 1500000000000 AS VARCHAR) || '.jpg'
  WHEN 3 THEN 'https://boards.4channel.org/3/thread/' || CAST(page_id AS VARCHAR)
  ELSE url END AS url
FROM pages""")

THREAD_RE = "'^https?://boards\\.(4chan|4channel)\\.org/[a-z]+/thread/\\d+'"
FILE_RE = "'^(https?:)?//[a-z0-9]+\\.(4cdn|4chan)\\.org/[a-z]+/(\\d+)\\.[\\w\\d]+'"
HOST_RE = "'^(https?:)?//[a-z0-9]+\\.(4cdn|4chan)\\.org/'"

query("size_bucket", "SELECT doc_id, size_bytes, size_mb FROM v_media", "v_media")

query("size_text", f"""
SELECT doc_id, size_text, {size_text_mb_sql('size_text')} AS size_mb
FROM (SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN {size_text_sql('size_bytes')}
        WHEN 1 THEN CAST(size_bytes // 1024 AS VARCHAR) || '.' || CAST((size_bytes * 10 // 1024) % 10 AS VARCHAR) || ' KB'
        WHEN 2 THEN CAST(size_bytes AS VARCHAR) || ' B'
        ELSE CAST(size_bytes // 1048576 AS VARCHAR) || '.' || lpad(CAST((size_bytes * 1000 // 1048576) % 1000 AS VARCHAR), 3, '0') || ' MB'
      END AS size_text FROM v_media) t""", "v_media")

query("size_rejects", f"""
SELECT doc_id, size_text, CASE WHEN size_text LIKE '% B' THEN 'unknown_unit' ELSE 'odd_size' END AS reason
FROM (SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN {size_text_sql('size_bytes')}
        WHEN 1 THEN CAST(size_bytes // 1024 AS VARCHAR) || '.' || CAST((size_bytes * 10 // 1024) % 10 AS VARCHAR) || ' KB'
        WHEN 2 THEN CAST(size_bytes AS VARCHAR) || ' B'
        ELSE CAST(size_bytes // 1048576 AS VARCHAR) || '.' || lpad(CAST((size_bytes * 1000 // 1048576) % 1000 AS VARCHAR), 3, '0') || ' MB'
      END AS size_text FROM v_media) t
WHERE size_text LIKE '% B' OR (size_text LIKE '% MB' AND NOT regexp_matches(size_text, '^[0-9]+\\.[0-9][0-9](0*) MB$'))""", "v_media")

query("digest_convert", """
SELECT doc_id, md5_hex, md5_b64, lower(hex(from_base64(md5_b64))) AS hex_from_b64,
       substr(md5_b64, 1, 21) || 'f==' AS loose_b64,
       lower(hex(from_base64(substr(md5_b64, 1, 21) || 'f=='))) AS hex_from_loose
FROM v_media""", "v_media")

query("sanitize_name", f"SELECT doc_id, {sanitize('text')} AS sanitized FROM documents")

query("stored_name", f"""
SELECT doc_id,
       CASE WHEN doc_id % 2 = 0 THEN name_4ch || '_' || orig_name ELSE name_4ch END
       || '_' || {sanitize("source || ': ' || lang || '?'")} AS stored_name
FROM v_names""", "v_names")

ARTIST_RES = [
    "by(?:-|_)((\\w+)(?:-|_)(?:.$)?)",
    "^([-_A-Za-z0-9]+?)(?:_|-)\\d{4,}(?:_|-)",
    "^\\d{4,}_([-_A-Za-z0-9]+)_",
    "^\\d{4,}-([-_A-Za-z0-9]+)-",
    "\\d{4,}\\.([-_A-Za-z0-9]+)_",
]
_first = (f"flatten(list_transform(range(1, len(regexp_extract_all(orig_name, '{ARTIST_RES[0]}', 1)) + 1), "
          f"lambda i: [regexp_extract_all(orig_name, '{ARTIST_RES[0]}', 1)[i], "
          f"regexp_extract_all(orig_name, '{ARTIST_RES[0]}', 2)[i]]))")
_all = " || ".join([_first] + [f"regexp_extract_all(orig_name, '{r}', 1)" for r in ARTIST_RES[1:]])
query("artist_names", f"""
SELECT doc_id, orig_name, array_to_string(a, '|') AS artists, CAST(len(a) AS BIGINT) AS n_artists
FROM (SELECT doc_id, orig_name, {_all} AS a FROM v_names) t""", "v_names")

query("path_parts", """
SELECT doc_id, raw_path, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
       regexp_extract(path, '[^/]*$', 0) AS base,
       regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]*$', '') AS name,
       CASE WHEN contains(regexp_extract(path, '[^/]*$', 0), '.')
            THEN regexp_extract(regexp_extract(path, '[^/]*$', 0), '\\.([^.]*)$', 1) END AS ext
FROM (SELECT doc_id, raw_path,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_path, '\\\\', '/', 'g'),
          '/{2,}', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '/\\.$', ''), '^/+', '') AS path
      FROM (SELECT doc_id, CASE doc_id % 4
              WHEN 0 THEN path
              WHEN 1 THEN replace(path, '/', '\\')
              WHEN 2 THEN './' || regexp_extract(path, '^([^/]*)/', 1) || '//' || CAST(doc_id AS VARCHAR) || '.' || ext
              ELSE regexp_extract(path, '^([^/]*)/', 1) || '/./' || CAST(doc_id AS VARCHAR) || '.tar.' || ext
            END AS raw_path FROM v_media) r) p""", "v_media")

LINE_SPLIT = "'\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
query("indent_lines", f"""
SELECT conv_id, turn, CAST(i AS BIGINT) AS line_no,
       '> ' || repeat(' ', CAST(5 * (turn % 4) AS INTEGER)) || parts[i] AS line,
       '  ' || repeat(' ', CAST(5 * (turn % 4) AS INTEGER)) || '__________' AS rule
FROM (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT conv_id, turn,
              CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS parts
            FROM (SELECT conv_id, turn, string_split_regex(text, {LINE_SPLIT}) AS p FROM conversations) a) b) c""")

query("file_text_parts", f"""
SELECT doc_id, file_text,
       CASE WHEN regexp_matches(file_text, '^File: .+ \\(([0-9\\.]+ [KMB]{{1,2}}), (\\d+x\\d+)\\)')
            THEN regexp_extract(file_text, '^File: .+ \\(([0-9\\.]+ [KMB]{{1,2}}), (\\d+x\\d+)\\)', 1) END AS size_text,
       CASE WHEN regexp_matches(file_text, '^File: .+ \\(([0-9\\.]+ [KMB]{{1,2}}), (\\d+x\\d+)\\)')
            THEN regexp_extract(file_text, '^File: .+ \\(([0-9\\.]+ [KMB]{{1,2}}), (\\d+x\\d+)\\)', 2) END AS res
FROM (SELECT doc_id, 'File: ' || CAST(doc_id + 1500000000000 AS VARCHAR) || '.' || ext || ' ('
             || {size_text_sql('size_bytes')} || ', '
             || CASE WHEN ext = 'pdf' THEN 'PDF'
                     ELSE CAST(doc_id % 900 + 100 AS VARCHAR) || 'x' || CAST(size_bytes % 700 + 100 AS VARCHAR) END
             || ')' AS file_text FROM v_media) t""", "v_media")

query("url_classify", f"""
SELECT page_id, url, COALESCE(regexp_matches(url, {THREAD_RE}), false) AS is_thread_url,
       COALESCE(regexp_matches(url, {FILE_RE}), false) AS is_file_url
FROM v_urls""", "v_urls")

query("url_key", f"""
SELECT page_id, url, regexp_replace(url, {HOST_RE}, '') AS file_key,
       'https://i.4cdn.org/' || regexp_replace(url, {HOST_RE}, '') AS canonical_url
FROM v_urls WHERE regexp_matches(url, {FILE_RE})""", "v_urls")

query("valid_folder", """
SELECT doc_id, folder, NOT regexp_matches(trim(folder), '[:?*"<>|]') AS valid
FROM (SELECT doc_id, CASE doc_id % 5
        WHEN 0 THEN source WHEN 1 THEN source || ':x' WHEN 2 THEN ' ' || source || ' '
        WHEN 3 THEN source || '/' || lang ELSE lang || '?' END AS folder FROM documents) d""")

query("source_requests", """
SELECT conv_id, turn,
       list_bool_or(list_transform(['sauce','source','src','name','more','link','full'],
                                   lambda w: contains(lower(text), w))) AS is_request
FROM conversations""")

query("media_filter", """
SELECT doc_id, path, regexp_extract(path, '\\.([^.]*)$', 1) AS ext, size_mb
FROM (SELECT doc_id, size_mb, CASE doc_id % 6
        WHEN 0 THEN 'site_files/' || path
        WHEN 1 THEN regexp_replace(path, '\\.([a-z]+)$', '.JPG')
        WHEN 2 THEN 'x-Dateien/' || path
        WHEN 3 THEN path || '_files'
        ELSE path END AS path FROM v_media) m
WHERE regexp_extract(path, '\\.([^.]*)$', 1) IN ('webm','gif','jpg','png')
  AND NOT (contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '.git')
        OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '_files')
        OR contains(regexp_extract(path, '^(.*)/[^/]*$', 1), '-Dateien'))""", "v_media")
