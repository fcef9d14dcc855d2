"""Oracle SQL: curation log and index maintenance."""

from threadlake.plans.oracle import query, view
from threadlake.plans.sql_scalars import FILE_RE, HOST_RE, sanitize, size_text_mb_sql

view("v_events", """
SELECT e.user_id AS session_id, e.event_id AS seq,
  CASE WHEN e.event_type IN ('view', 'click') THEN
         ['https://i.4cdn.org/', 'https://is2.4chan.org/', '//i.4cdn.org/'][e.event_id % 3 + 1]
         || ['gif','wsg','v','a'][e.user_id % 4 + 1] || '/' || CAST(e.doc_id + 1500000000000 AS VARCHAR)
         || '.' || COALESCE(m.ext, 'jpg')
       WHEN e.event_type = 'signup' AND e.k % 10 = 0 THEN 'rename_thread'
       WHEN e.event_type = 'signup' THEN ' tag:' || CAST(e.k AS VARCHAR) || '? '
       WHEN e.event_type = 'error' THEN 'remove_file'
       ELSE ['add_anyway', 'toggle_use_orig_fn', 'reset_filename', 'reset_to_4ch_fn'][e.event_id % 4 + 1] END AS value,
  CASE WHEN e.event_type = 'signup' AND e.k % 10 = 0
       THEN CASE WHEN e.k % 20 = 0 THEN 'folder:' ELSE 'folder_' END || CAST(e.k AS VARCHAR) END AS payload,
  e.ts
FROM (SELECT *, user_id * 8 + k % 7 AS doc_id
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e0) e
LEFT JOIN v_media m ON m.doc_id = e.doc_id""", "v_media")

view("v_sessions", """
SELECT DISTINCT user_id AS session_id, CAST(10000000 + user_id * 100 AS VARCHAR) AS thread_nr,
       user_id % 2 = 0 AS unique_only FROM events""")

view("v_fold_files", f"""
SELECT f.*, NOT EXISTS (
  SELECT 1 FROM v_index i WHERE i.ext IN ('webm','gif','jpg','png') AND i.ext = f.file_ext
    AND i.size_mb = {size_text_mb_sql('f.file_size')} AND i.md5_b64 = f.file_md5_b64)
  AND {size_text_mb_sql('f.file_size')} IS NOT NULL AS is_new0,
  {size_text_mb_sql('f.file_size')} IS NULL AS size_unknown
FROM v_files f""", "v_files", "v_index")

view("v_drop", """
SELECT session_id, seq, value, payload, ts FROM (
  SELECT *, lag(value) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM v_events) x
WHERE prev IS NULL OR prev <> value""", "v_events")


def fold_sql(events: str) -> str:
    return f"""
WITH cl AS (
  SELECT *, CASE WHEN regexp_matches(value, {FILE_RE}) THEN 'url'
                 WHEN trim(value) = 'rename_thread' THEN 'rename'
                 WHEN trim(value) = 'toggle_use_orig_fn' THEN 'toggle'
                 WHEN trim(value) = 'reset_filename' THEN 'reset'
                 WHEN trim(value) = 'reset_to_4ch_fn' THEN 'reset4ch'
                 WHEN trim(value) = 'add_anyway' THEN 'add'
                 WHEN trim(value) = 'remove_file' THEN 'remove' ELSE 'text' END AS kind
  FROM ({events}) e),
rs AS (
  SELECT *, CASE WHEN kind = 'url' THEN regexp_replace(value, {HOST_RE}, '') END AS file_key,
         sum(CASE WHEN kind = 'url' THEN 1 ELSE 0 END) OVER w AS epoch,
         sum(CASE WHEN kind = 'toggle' THEN 1 ELSE 0 END) OVER w AS tog,
         sum(CASE WHEN kind IN ('url', 'reset', 'reset4ch') THEN 1 ELSE 0 END) OVER w AS sub
  FROM cl WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
urls AS (
  SELECT r.session_id, r.epoch, r.file_key, s.thread_nr, s.unique_only, f.file_name_4ch, f.file_name_orig,
         CASE WHEN f.size_unknown THEN NULL ELSE f.is_new0 END AS is_new
  FROM rs r JOIN v_sessions s ON s.session_id = r.session_id
  JOIN v_fold_files f ON f.thread_nr = s.thread_nr AND f.file_key = r.file_key
  WHERE r.kind = 'url'),
ep AS (SELECT * FROM urls u WHERE epoch = (SELECT max(epoch) FROM urls u2
                                           WHERE u2.session_id = u.session_id AND u2.file_key = u.file_key)),
rws AS (SELECT r.* FROM rs r JOIN ep ON ep.session_id = r.session_id AND ep.epoch = r.epoch),
rem AS (SELECT session_id, epoch, min(seq) AS remove_seq FROM rws WHERE kind = 'remove' GROUP BY 1, 2),
live AS (SELECT r.* FROM rws r LEFT JOIN rem ON rem.session_id = r.session_id AND rem.epoch = r.epoch
         WHERE rem.remove_seq IS NULL OR r.seq < rem.remove_seq),
base AS (SELECT session_id, epoch, arg_max(kind, seq) AS base_kind, arg_max(tog, seq) AS base_tog, max(sub) AS last_sub
         FROM live WHERE kind IN ('url', 'reset', 'reset4ch') GROUP BY 1, 2),
added AS (SELECT session_id, epoch, bool_or(kind = 'add') AS added FROM live GROUP BY 1, 2),
suf AS (SELECT l.session_id, l.epoch, string_agg('_' || {sanitize('trim(l.value)')}, '' ORDER BY l.seq) AS suffix
        FROM live l JOIN base b ON b.session_id = l.session_id AND b.epoch = l.epoch
        WHERE l.kind = 'text' AND l.sub = b.last_sub GROUP BY 1, 2),
fin AS (
  SELECT ep.*, rem.remove_seq IS NOT NULL AS removed,
         (CASE WHEN b.base_kind = 'reset4ch' THEN ep.file_name_4ch
               WHEN b.base_tog % 2 = 1 THEN ep.file_name_4ch || '_' || ep.file_name_orig
               ELSE ep.file_name_4ch END) || COALESCE(suf.suffix, '') AS name,
         rem.remove_seq IS NULL AND (NOT COALESCE(ep.unique_only, false) OR COALESCE(ep.is_new, true)
                                     OR COALESCE(a.added, false)) AS selected
  FROM ep LEFT JOIN rem ON rem.session_id = ep.session_id AND rem.epoch = ep.epoch
  LEFT JOIN base b ON b.session_id = ep.session_id AND b.epoch = ep.epoch
  LEFT JOIN added a ON a.session_id = ep.session_id AND a.epoch = ep.epoch
  LEFT JOIN suf ON suf.session_id = ep.session_id AND suf.epoch = ep.epoch)
SELECT session_id, thread_nr, file_key, CASE WHEN selected THEN name END AS dl_filename,
       CASE WHEN unique_only THEN COALESCE(is_new, true) END AS is_unique, selected AS to_download, removed
FROM fin"""


view("v_fold", fold_sql("SELECT * FROM v_drop"), "v_drop", "v_sessions", "v_fold_files")

query("drop_repeats", "SELECT session_id, seq, value FROM v_drop", "v_drop")
query("curation_fold", "SELECT * FROM v_fold", "v_fold")
query("selected_files", "SELECT session_id, file_key FROM v_fold WHERE to_download", "v_fold")

query("curation_counts", f"""
SELECT c.session_id, c.n_url_events, c.n_remove_events,
       CAST(COALESCE(s.n_files, 0) AS BIGINT) AS n_files, CAST(COALESCE(s.n_selected, 0) AS BIGINT) AS n_selected
FROM (SELECT session_id, COUNT(*) FILTER (WHERE regexp_matches(value, {FILE_RE})) AS n_url_events,
             COUNT(*) FILTER (WHERE NOT regexp_matches(value, {FILE_RE}) AND trim(value) = 'remove_file') AS n_remove_events
      FROM v_drop GROUP BY 1) c
LEFT JOIN (SELECT session_id, COUNT(*) AS n_files, COUNT(*) FILTER (WHERE to_download) AS n_selected
           FROM v_fold GROUP BY 1) s ON s.session_id = c.session_id""", "v_drop", "v_fold")

view("v_threads_u", "SELECT thread_nr, board, conv_id % 2 = 0 AS unique_only, conv_id FROM v_threads", "v_threads")

view("v_select_all", """
SELECT f.thread_nr, f.file_key, f.file_name_4ch || '_' || f.file_name_orig AS dl_filename, true AS to_download
FROM v_fold_files f JOIN v_threads_u t ON t.thread_nr = f.thread_nr
WHERE NOT t.unique_only OR f.size_unknown OR f.is_new0""", "v_fold_files", "v_threads_u")

query("select_all", "SELECT * FROM v_select_all", "v_select_all")

query("selection_join", f"""
SELECT d.session_id, d.seq, regexp_replace(d.value, {HOST_RE}, '') AS file_key, f.post_nr, f.post_nr IS NOT NULL AS known
FROM v_drop d JOIN v_sessions s ON s.session_id = d.session_id
LEFT JOIN v_files f ON f.thread_nr = s.thread_nr AND f.file_key = regexp_replace(d.value, {HOST_RE}, '')
WHERE regexp_matches(d.value, {FILE_RE})""", "v_drop", "v_sessions", "v_files")

HALF = "(SELECT CAST(max(event_id) / 2 AS BIGINT) FROM events)"
view("v_fold_prior", fold_sql(f"SELECT * FROM v_drop WHERE seq < {HALF}"), "v_drop", "v_sessions", "v_fold_files")
view("v_fold_new", fold_sql(f"SELECT * FROM v_drop WHERE seq >= {HALF}"), "v_drop", "v_sessions", "v_fold_files")
query("selection_resume", """
SELECT * FROM v_fold_prior p
WHERE NOT EXISTS (SELECT 1 FROM v_fold_new n WHERE n.session_id = p.session_id AND n.file_key = p.file_key)
UNION ALL SELECT * FROM v_fold_new""", "v_fold_prior", "v_fold_new")

query("resume_pending", """
SELECT t.board, t.thread_nr FROM v_threads_u t
WHERE NOT t.conv_id % 3 = 0
  AND EXISTS (SELECT 1 FROM v_select_all s WHERE s.thread_nr = t.thread_nr)""", "v_threads_u", "v_select_all")

query("index_upsert", """
SELECT ext, size_mb, md5_b64, path FROM v_index WHERE ext IN ('webm','gif','jpg','png')
UNION ALL
SELECT m.ext, m.size_mb, m.md5_b64, m.path FROM v_media m
JOIN v_resolved r ON r.file_key = CAST(m.doc_id AS VARCHAR)
WHERE m.doc_id % 3 = 0 AND r.dl_success AND r.md5_match AND m.ext IN ('webm','gif','jpg','png')""",
      "v_index", "v_media", "v_resolved")

query("curation_stream", "SELECT * FROM v_fold", "v_fold")
query("fold_continue", "SELECT * FROM v_fold", "v_fold")

query("session_folders", f"""
WITH d AS (SELECT * FROM v_drop),
ren AS (SELECT session_id, arg_max(trim(payload), seq) AS renamed FROM d
        WHERE NOT regexp_matches(d.value, {FILE_RE}) AND trim(d.value) = 'rename_thread'
          AND payload IS NOT NULL AND NOT regexp_matches(trim(payload), '[:?*"<>|]')
        GROUP BY 1),
base AS (SELECT session_id, max(ts) AS last_ts,
                ['gif','wsg','v','a'][session_id % 4 + 1] || '_' || CAST(session_id AS VARCHAR) AS folder0
         FROM d GROUP BY 1)
SELECT b.session_id, COALESCE(r.renamed, b.folder0) AS folder_name,
       {sanitize('COALESCE(r.renamed, b.folder0)')} || '_' || strftime(b.last_ts, '%Y-%m-%d') || '.txt' AS report_file
FROM base b LEFT JOIN ren r ON r.session_id = b.session_id""", "v_drop")

query("request_lookup", f"""
WITH r AS (
  SELECT 'f' || post_nr AS file_id, orig_name || '.' || ext AS name, file_size AS size_text, md5_b64
  FROM v_post_files WHERE NOT deleted),
c AS (
  SELECT file_id,
         CASE WHEN contains(trim(name), '.') THEN regexp_extract(trim(name), '\\.([^.]*)$', 1) END AS ext,
         {size_text_mb_sql('size_text')} AS size_mb, md5_b64 FROM r)
SELECT c.file_id, c.ext, c.size_mb, c.md5_b64, CAST(COALESCE(s.n_copies, 0) AS BIGINT) AS n_copies, s.first_path,
       CASE WHEN c.ext IS NOT NULL AND c.size_mb IS NOT NULL AND c.md5_b64 IS NOT NULL
            THEN COALESCE(s.n_copies, 0) = 0 END AS is_new
FROM c LEFT JOIN (
  SELECT ext, size_mb, md5_b64, COUNT(*) AS n_copies, MIN(path) AS first_path
  FROM v_index WHERE ext IN ('webm','gif','jpg','png') GROUP BY 1, 2, 3) s
ON c.ext = s.ext AND c.size_mb = s.size_mb AND c.md5_b64 = s.md5_b64""", "v_post_files", "v_index")

query("unknown_urls", f"""
SELECT d.session_id, d.seq, regexp_replace(d.value, {HOST_RE}, '') AS file_key
FROM v_drop d JOIN v_sessions s ON s.session_id = d.session_id
WHERE regexp_matches(d.value, {FILE_RE})
  AND NOT EXISTS (SELECT 1 FROM v_files f WHERE f.thread_nr = s.thread_nr
                  AND f.file_key = regexp_replace(d.value, {HOST_RE}, ''))""", "v_drop", "v_sessions", "v_files")

query("fetch_outcomes", """
SELECT f.session_id, f.thread_nr, f.file_key, f.dl_filename, r.n_attempts, r.dl_success, r.md5_match,
       COALESCE(r.dl_success, false) AS to_report,
       COALESCE(r.dl_success, false) AND COALESCE(r.md5_match, false) AS to_index,
       COALESCE(r.dl_success, false) AND NOT COALESCE(r.md5_match, true) AS to_quarantine,
       CASE WHEN COALESCE(r.dl_success, false)
            THEN lower(hex(from_base64(ff.file_md5_b64))) || ' *' || t.folder_name || '/' || f.dl_filename
                 || '.' || ff.file_ext END AS manifest_line
FROM v_fold f
JOIN v_fold_files ff ON ff.thread_nr = f.thread_nr AND ff.file_key = f.file_key
JOIN v_threads t ON t.thread_nr = f.thread_nr
LEFT JOIN v_resolved r ON r.file_key = CAST(CAST(ff.file_name_4ch AS BIGINT) - 1500000000000 AS VARCHAR)
WHERE f.to_download""", "v_fold", "v_fold_files", "v_threads", "v_resolved")

query("live_novelty", """
SELECT thread_nr, file_key, CASE WHEN size_unknown THEN NULL ELSE is_new0 END AS is_new
FROM v_fold_files""", "v_fold_files")

query("index_upkeep", """
SELECT ext, size_mb, md5_b64, path FROM v_media WHERE ext IN ('webm','gif','jpg','png')""", "v_media")

query("stream_dedupe", """
SELECT DISTINCT ext, size_mb, md5_b64 FROM v_media WHERE ext IN ('webm','gif','jpg','png')""", "v_media")

query("run_state", """
SELECT board, thread_nr, CASE WHEN conv_id % 3 = 0 THEN 'done' ELSE 'curate' END AS stage, conv_id % 3 = 0 AS done
FROM v_threads""", "v_threads")
