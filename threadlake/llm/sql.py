"""SQL of the queries that DuckDB can check."""

from __future__ import annotations

from threadlake.llm.quality import NO_LABEL, RULES, STOP_WORDS, STOP_WORDS_FROM

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for own in STOP_WORDS.values() for w in own}))
_LABELS = ", ".join(f"'{x}'" for x in (*NO_LABEL, *STOP_WORDS))
_LEAST_STOPS = next(r.least for r in RULES if r.metric == "stop_word_ratio")
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, lower(regexp_extract(coalesce(lang, ''), '^[A-Za-z]*', 0)) AS label FROM documents),
words AS (
  SELECT doc_id, t, label, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANK}, '')) > 0) AS l
  FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM words, unnest(generate_series(1, len(w) - 2)) AS u(i) WHERE len(w) >= 3),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n, length(translate(t, {_BLANK}, '')) AS chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS symbols,
         len(l) AS lines, len(l) - len(list_distinct(l)) AS dup, coalesce(c.n, 0) AS rep,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS stops,
         label IN ({_LABELS}) AND 2 * length(regexp_replace(t, '\\P{{Latin}}+', '', 'g')) >= length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS listed
  FROM words LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n < 50 OR 100 * rep > 50 * n AS failed FROM base)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND chars >= 1.5 * n AND chars <= 25 * n AND 10 * symbols <= chars
       AND 10 * dup <= 7 * lines AND NOT (n >= {STOP_WORDS_FROM} AND listed AND stops < {_LEAST_STOPS} * n) AS kept
FROM judged
"""
