"""Oracle SQL: thread bindings, extraction (read off the bindings), reply graph, report."""

from threadlake.plans.oracle import query, view
from threadlake.plans.sql_scalars import size_text_sql

NL = "chr(10)"


def nr(turn: str) -> str:
    return f"CAST(10000000 + conv_id * 100 + {turn} AS VARCHAR)"


view("v_posts", f"""
SELECT thread_nr, post_nr, pos, utc, quotes, body, conv_id, board, subject,
       array_to_string(list_transform(quotes, lambda x: '>>' || x)
                       || CASE WHEN body <> '' THEN [body] ELSE []::VARCHAR[] END, {NL}) AS post_msg
FROM (SELECT {nr('0')} AS thread_nr, {nr('turn')} AS post_nr, CAST(turn AS INTEGER) AS pos,
             CAST(1500000000 + conv_id * 1000 + turn * 7 AS VARCHAR) AS utc,
             CASE WHEN conv_id % 5 = 0 AND turn IN (2, 3) THEN []::VARCHAR[]
                  ELSE list_filter([CASE WHEN turn >= 1 THEN {nr('(turn - 1) // 2')} END,
                                    CASE WHEN turn > 0 AND turn % 3 = 0 THEN {nr('0')} END,
                                    CASE WHEN turn = 7 THEN {nr('99')} END], lambda x: x IS NOT NULL) END AS quotes,
             CASE WHEN conv_id % 5 = 0 AND turn IN (2, 3) THEN ''
                  ELSE regexp_replace(regexp_replace(text, '\\n+', {NL}, 'g'), '^\\n|\\n$', '', 'g') END AS body,
             conv_id,
             ['gif','wsg','v','a'][conv_id % 4 + 1] AS board,
             CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'Thread about ' || role END AS subject
      FROM conversations) c""")

view("v_post_files", f"""
SELECT p.thread_nr, p.post_nr, p.pos, m.doc_id, p.board, m.ext, m.size_bytes, m.md5_b64, n.name_4ch, n.orig_name,
       m.doc_id % 13 = 0 AS deleted, m.doc_id % 11 = 0 AS spoiler, m.doc_id % 3 = 0 AS titled,
       p.board || '/' || n.name_4ch || '.' || m.ext AS file_key,
       {size_text_sql('m.size_bytes')} AS file_size,
       CASE WHEN m.ext = 'pdf' THEN 'PDF'
            ELSE CAST(m.doc_id % 900 + 100 AS VARCHAR) || 'x' || CAST(m.size_bytes % 700 + 100 AS VARCHAR) END AS file_res
FROM v_posts p JOIN v_media m ON m.doc_id = p.conv_id * 8 + p.pos
JOIN v_names n ON n.doc_id = m.doc_id
WHERE p.pos % 2 = 0""", "v_posts", "v_media", "v_names")

view("v_files", """
SELECT thread_nr, post_nr, pos, file_key, 'https://i.4cdn.org/' || file_key AS file_url,
       name_4ch AS file_name_4ch, ext AS file_ext,
       CASE WHEN spoiler THEN orig_name || '.' || ext ELSE orig_name END AS file_name_orig,
       file_size, file_res, 'https://i.4cdn.org/' || board || '/' || name_4ch || 's.jpg' AS file_thumb_url,
       md5_b64 AS file_md5_b64, false AS to_download, false AS downloaded
FROM v_post_files WHERE NOT deleted AND ext <> 'pdf'""", "v_post_files")

view("v_threads", """
SELECT thread_nr, subject, utc, post_msg AS op_post_msg, conv_id, board,
       board || '_' || CAST(conv_id AS VARCHAR) AS folder_name
FROM v_posts WHERE pos = 0""", "v_posts")

view("v_quotes", """
SELECT thread_nr, post_nr, pos, CAST(i - 1 AS INTEGER) AS quote_pos, quotes[i] AS quoted_nr
FROM (SELECT thread_nr, post_nr, pos, quotes, unnest(range(1, len(quotes) + 1)) AS i FROM v_posts) q""", "v_posts")

view("v_links", """
SELECT q.thread_nr, q.quoted_nr AS post_nr, q.post_nr AS backlink_nr, q.pos, q.quote_pos
FROM v_quotes q JOIN v_posts t ON t.thread_nr = q.thread_nr AND t.post_nr = q.quoted_nr""", "v_quotes", "v_posts")

ORD = "lpad(CAST(length(CAST({n} AS VARCHAR)) AS VARCHAR), 2, '0') || CAST({n} AS VARCHAR)"
SEG = ORD.replace("{n}", "{p}") + " || " + ORD.replace("{n}", "{q}")

view("v_edges", f"""
SELECT l.thread_nr, l.post_nr AS parent_nr, l.backlink_nr AS node_nr,
       {SEG.format(p='l.pos', q='l.quote_pos')} AS seg,
       p.post_msg <> '' AS has_msg, f.post_nr IS NOT NULL AS has_file
FROM v_links l JOIN v_posts p ON p.thread_nr = l.thread_nr AND p.post_nr = l.backlink_nr
LEFT JOIN v_files f ON f.thread_nr = l.thread_nr AND f.post_nr = l.backlink_nr""", "v_links", "v_posts", "v_files")

view("v_tree", """
SELECT * FROM (
  WITH RECURSIVE t(thread_nr, root_nr, level, path, node_nr, has_msg, has_file) AS (
    SELECT e.thread_nr, r.post_nr, 1, e.seg, e.node_nr, e.has_msg, e.has_file
    FROM v_files r JOIN v_edges e ON e.thread_nr = r.thread_nr AND e.parent_nr = r.post_nr
    UNION ALL
    SELECT t.thread_nr, t.root_nr, t.level + 1, t.path || '/' || e.seg, e.node_nr, e.has_msg, e.has_file
    FROM t JOIN v_edges e ON e.thread_nr = t.thread_nr AND e.parent_nr = t.node_nr
    WHERE t.level + 1 <= 3 AND (t.has_msg OR NOT t.has_file))
  SELECT thread_nr, root_nr, CAST(level AS INTEGER) AS level, path, node_nr, has_msg AS shown FROM t) x""",
     "v_files", "v_edges")

query("scan_pages", """
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes,
       COALESCE(regexp_matches(url, '^https?://boards\\.(4chan|4channel)\\.org/[a-z]+/thread/\\d+'), false) AS is_thread_url
FROM pages""")

query("extract_threads", """
SELECT conv_id * 100000 AS page_id, thread_nr, subject, utc, op_post_msg FROM v_threads""", "v_threads")

query("extract_posts", """
SELECT p.conv_id * 100000 + p.pos // 1000 AS page_id, p.thread_nr, p.post_nr, p.pos, p.utc, p.post_msg,
       array_to_string(p.quotes, ',') AS quotes,
       EXISTS (SELECT 1 FROM v_post_files f WHERE f.post_nr = p.post_nr) AS has_file_block
FROM v_posts p""", "v_posts", "v_post_files")

query("extract_files", """
SELECT thread_nr, post_nr, file_key, file_url, file_name_4ch, file_ext, file_name_orig, file_size, file_res,
       file_thumb_url, file_md5_b64, to_download, downloaded FROM v_files""", "v_files")

query("extract_quotes", "SELECT thread_nr, post_nr, pos, quote_pos, quoted_nr FROM v_quotes", "v_quotes")

query("html_text", "SELECT post_nr, post_msg FROM v_posts", "v_posts")

query("posts_with_files", "SELECT thread_nr, post_nr, file_key FROM v_files", "v_files")

query("extract_requests", """
SELECT 'f' || post_nr AS file_id, orig_name || '.' || ext AS name, file_size AS size_text, md5_b64
FROM v_post_files WHERE NOT deleted""", "v_post_files")

query("backlinks", "SELECT thread_nr, post_nr, backlink_nr, pos, quote_pos FROM v_links", "v_links")

query("dangling_quotes", """
SELECT q.thread_nr, q.quoted_nr, q.post_nr, q.pos, q.quote_pos FROM v_quotes q
WHERE NOT EXISTS (SELECT 1 FROM v_posts t WHERE t.thread_nr = q.thread_nr AND t.post_nr = q.quoted_nr)""",
      "v_quotes", "v_posts")

query("reply_tree", "SELECT * FROM v_tree", "v_tree")

LINE_SPLIT = "'\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def lines_of(msg: str) -> str:
    return (f"(CASE WHEN string_split_regex({msg}, {LINE_SPLIT})[-1] = '' "
            f"THEN string_split_regex({msg}, {LINE_SPLIT})[1:-2] ELSE string_split_regex({msg}, {LINE_SPLIT}) END)")


query("relevant_replies", f"""
WITH l1 AS (
  SELECT r.thread_nr, r.post_nr AS root_nr, l.backlink_nr, {SEG.format(p='l.pos', q='l.quote_pos')} AS seg, p.post_msg
  FROM v_files r JOIN v_links l ON l.thread_nr = r.thread_nr AND l.post_nr = r.post_nr
  JOIN v_posts p ON p.thread_nr = l.thread_nr AND p.post_nr = l.backlink_nr
  WHERE p.post_msg <> ''),
l2 AS (
  SELECT a.thread_nr, a.root_nr, a.seg AS pseg, {SEG.format(p='l.pos', q='l.quote_pos')} AS seg,
         {lines_of('p.post_msg')} AS ls
  FROM l1 a JOIN v_links l ON l.thread_nr = a.thread_nr AND l.post_nr = a.backlink_nr
  JOIN v_posts p ON p.thread_nr = l.thread_nr AND p.post_nr = l.backlink_nr
  WHERE list_bool_or(list_transform(['sauce','source','src','name','more','link','full'],
                                    lambda w: contains(lower(a.post_msg), w))))
SELECT r.thread_nr, r.post_nr AS root_nr, '0' AS key, p.post_msg AS line
FROM v_files r JOIN v_posts p ON p.thread_nr = r.thread_nr AND p.post_nr = r.post_nr WHERE p.post_msg <> ''
UNION ALL
SELECT thread_nr, root_nr, '1' || seg, '> ' || repeat(' ', 5) || post_msg FROM l1
UNION ALL
SELECT thread_nr, root_nr, '1' || pseg || '/' || seg || '#' || lpad(CAST(length(CAST(i - 1 AS VARCHAR)) AS VARCHAR), 2, '0') || CAST(i - 1 AS VARCHAR),
       '> ' || repeat(' ', 10) || ls[i]
FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l2) z""", "v_files", "v_links", "v_posts")

REPORT = f"""
WITH f AS (SELECT v.*, t.folder_name FROM v_files v JOIN v_threads t ON t.thread_nr = v.thread_nr),
fk AS (SELECT *, '1' || lpad(CAST(length(CAST(pos AS VARCHAR)) AS VARCHAR), 2, '0') || CAST(pos AS VARCHAR) AS k FROM f),
tl AS (
  SELECT x.thread_nr, x.root_nr, x.level, x.path, p.post_msg FROM v_tree x
  JOIN v_posts p ON p.thread_nr = x.thread_nr AND p.post_nr = x.node_nr WHERE x.shown),
tlines AS (
  SELECT thread_nr, root_nr, path || '#' || lpad(CAST(length(CAST(0 AS VARCHAR)) AS VARCHAR), 2, '0') || CAST(0 AS VARCHAR) AS key,
         '  ' || repeat(' ', CAST(5 * level AS INTEGER)) || '__________' AS line FROM tl
  UNION ALL
  SELECT thread_nr, root_nr, path || '#' || lpad(CAST(length(CAST(i AS VARCHAR)) AS VARCHAR), 2, '0') || CAST(i AS VARCHAR),
         '> ' || repeat(' ', CAST(5 * level AS INTEGER)) || ls[i]
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT *, {lines_of('post_msg')} AS ls FROM tl) a) b)
SELECT thread_nr, folder_name, '0' AS key,
       'Thread No. ' || thread_nr || ': "' || subject || '", UTC_' || utc || {NL} || chr(9) || 'Saved to: '
       || folder_name || {NL} || 'OP: "' || op_post_msg || '"' || {NL} AS line
FROM v_threads WHERE thread_nr IN (SELECT thread_nr FROM v_files)
UNION ALL
SELECT thread_nr, folder_name, k || 'a',
       'File: "' || file_name_4ch || '_' || file_name_orig || '.' || file_ext || '", ' || file_size || ', ' || file_res
       || ', MD5_b64: "' || file_md5_b64 || '", Original filename: "' || file_name_orig || '"' || {NL}
       || 'Messages and Backlinks (indented):'
FROM fk
UNION ALL
SELECT fk.thread_nr, fk.folder_name, fk.k || 'b', CASE WHEN p.post_msg = '' THEN 'No post message!' ELSE p.post_msg END
FROM fk JOIN v_posts p ON p.thread_nr = fk.thread_nr AND p.post_nr = fk.post_nr
UNION ALL
SELECT fk.thread_nr, fk.folder_name, fk.k || 'c' || tlines.key, tlines.line
FROM tlines JOIN fk ON fk.thread_nr = tlines.thread_nr AND fk.post_nr = tlines.root_nr
UNION ALL
SELECT thread_nr, folder_name, k || 'z', {NL} FROM fk"""
query("thread_report", REPORT, "v_files", "v_threads", "v_tree", "v_posts")
query("report_text", f"SELECT folder_name AS folder, unnest(string_split(line, chr(10))) AS line FROM ({REPORT}) r", "v_files", "v_threads", "v_tree", "v_posts")

query("file_rejects", """
SELECT thread_nr, post_nr, 'file_line_unparsed' AS reason FROM v_post_files
WHERE NOT deleted AND ext = 'pdf'""", "v_post_files")

query("page_rejects", """
SELECT page_id, url, CASE WHEN html IS NULL OR NOT contains(html, '<div class="thread"') THEN 'no_thread_block'
                          ELSE 'no_thread_number' END AS reason
FROM pages
WHERE html IS NULL OR NOT contains(html, '<div class="thread"')
   OR (NOT regexp_matches(html, '<div class="post op"[^>]*>(.|\n)*?</blockquote>')
       AND regexp_extract(html, '<div class="thread" id="t([^"]*)"', 1) = '')""")
