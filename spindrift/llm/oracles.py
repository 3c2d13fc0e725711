"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM d),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
repeated AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN repeated USING (r, g)) GROUP BY r),
lines AS (
  SELECT r, line, len(list_filter(string_split_regex(line, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (
  SELECT r, line, n,
    length(regexp_replace(line, '[^#*$%&|<>!]+', '', 'g')) >= n
    OR (n < 4 AND NOT regexp_matches(rtrim(line, ' '), '[.!?:;…。]["''”’)\]]*$'))
    OR (length(regexp_replace(line, '[^|»›]+', '', 'g')) >= 3 AND length(regexp_replace(line, '[^|»›]+', '', 'g')) * 3 >= n)
    OR (n <= 20 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '(all rights reserved|copyright|licensed under|terms of use|terms of service|privacy policy|cookie|subscribe|sign up|click here|javascript)')) AS fails
  FROM lines WHERE n > 0),
by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (fails) AS n_failed_lines,
    coalesce(sum(n) FILTER (fails), 0) AS lost_words FROM judged GROUP BY r),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words * 2 <= n_words AS kept,
  n_lines, n_failed_lines, lost_words
FROM measured
"""

OP9 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT DISTINCT host, path, rule, v FROM best) b USING (host, path)
"""

OP8 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, coalesce(text, '') AS t FROM conversations),
cut AS (SELECT r, conv, turn, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split(t, chr(10)) AS ls FROM m)),
leveled AS (
  SELECT r, conv, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+', '') AS body FROM cut),
lines AS (
  SELECT *, lead(level) OVER w AS next_level, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS opens
  FROM leveled WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM lines),
contents AS (
  SELECT r, any_value(conv) AS conv, any_value(turn) AS turn, count(*) FILTER (level > 0) AS n_quoted, max(level) AS quote_depth,
    regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(next_level, 0) > 0 AND
      regexp_matches(body, '(wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t]*$'))), ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS content
  FROM lines GROUP BY r),
raw AS (
  SELECT r, conv, turn, level, body AS p FROM runs
  UNION ALL SELECT r, conv, turn, level, string_agg(body, ' ' ORDER BY i) FROM runs GROUP BY r, conv, turn, level, run),
passages AS (
  SELECT DISTINCT r, conv, turn, level, trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS p FROM raw),
own AS (
  SELECT conv, turn, p FROM passages WHERE level = 0 AND p <> ''
  UNION ALL SELECT conv, turn, trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') FROM contents WHERE content <> ''),
firsts AS (SELECT conv, p, min(turn) AS origin FROM own GROUP BY conv, p),
scored AS (
  SELECT q.conv, q.turn, origin, min(level) AS level, sum(len(string_split(q.p, ' '))) AS words
  FROM passages q JOIN firsts f ON q.conv = f.conv AND q.p = f.p AND origin < q.turn WHERE level > 0 AND q.p <> '' GROUP BY ALL),
links AS (SELECT conv, turn, arg_max(origin, [-level, words, origin]) AS origin FROM scored GROUP BY conv, turn),
placed AS (
  SELECT m.r, m.conv, m.turn, m.role, origin, max(m.turn) OVER (PARTITION BY m.conv ORDER BY m.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
  FROM m LEFT JOIN links USING (conv, turn)),
opened AS (
  SELECT *, coalesce(origin, previous) AS reply_to, CASE WHEN previous IS NULL OR coalesce(origin, previous) <> previous THEN turn END AS o FROM placed),
turns AS (SELECT DISTINCT conv, turn, reply_to FROM opened),
led AS (
  SELECT conv, turn, turn AS root, 0::BIGINT AS depth FROM turns WHERE reply_to IS NULL
  UNION ALL SELECT t.conv, t.turn, led.root, led.depth + 1 FROM led JOIN turns t ON t.conv = led.conv AND t.reply_to = led.turn)
SELECT c.conv AS conv_id, c.turn, role, content, n_quoted, quote_depth, origin IS NOT NULL AS linked, reply_to,
  max(o) OVER (PARTITION BY c.conv ORDER BY c.turn) AS branch, root, depth
FROM opened JOIN contents c USING (r) JOIN led ON led.conv = c.conv AND led.turn = c.turn
"""

ORACLES: dict[str, str] = {"op8_chat_format": OP8, "op4_quality_rules": OP4, "op9_url_filter": OP9}
