"""DuckDB SQL with the same results as queries, where SQL can express them."""

from __future__ import annotations

from glossloom.llm.queries import URL_CHANGES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


# the template's own characters of a part: <|im_start|>, \n, <|im_end|>\n; escapes add one for each backslash, control string and line feed of a role
_ESCAPED = "length(regexp_replace(replace({}, chr(92), chr(92) || chr(92)), '(<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|system\\|>|<\\|user\\|>|<\\|assistant\\|>)', '\\1' || chr(92) || chr(92), 'g'))"

OP1 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, 24 + {_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format("text")} AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

OP4 = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (s)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce((SELECT string_agg(x.v, ' ' ORDER BY x.p) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p) x WHERE NOT coalesce(list_contains(ps, x.p), false)), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, {_low("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM x),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""

OP7 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM b),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, i FROM win JOIN b USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_CHANGES = ", ".join(f"('{lst}', '{kind}', '{value}', '{action}', DATE '2024-01-01' + {days})" for lst, kind, value, action, days in URL_CHANGES)

# op6 the other way round: an entry's state is that of its last change at or before the fetch; a removal wins at one moment.
OP6 = f"""
WITH ch(list, kind, value, action, since) AS (VALUES {_CHANGES}),
p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 730)::INT AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
hit AS (SELECT p.page_id, p.url, fetched, list, kind, value, arg_max(action, (since, action)) AS state FROM p JOIN ch ON since <= fetched AND host <> '' AND
  CASE kind WHEN 'url' THEN lower(p.url) = value WHEN 'host' THEN host = value WHEN 'domain' THEN '.' || host LIKE '%.' || value ELSE starts_with(host || path || '/', value) END GROUP BY ALL),
good AS (SELECT page_id, count(*) AS n, list_sort(list_distinct(list(list))) AS ls FROM hit WHERE state = 'add' GROUP BY page_id)
SELECT page_id, url, fetched, coalesce(n, 0)::BIGINT AS n_entries, coalesce(array_to_string(ls, ','), '') AS lists, n IS NOT NULL AS blocked FROM p LEFT JOIN good USING (page_id)
"""

ORACLES = {"op1_chat_format": OP1, "op4_substring_dedup": OP4, "op5_line_dedup": OP5, "op6_url_filters": OP6, "op7_benchmark_decontamination": OP7}
