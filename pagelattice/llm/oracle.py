"""The same results as SQL, where SQL can express them.

Token ids, trained scores, suffix arrays, the walk around a ring and rolling hashes are not said in
SQL; those queries are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pagelattice.llm import chat, url_rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_lower(column)}, '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INK = r"[^\x20\x09-\x0D]+"

_DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', _ALNUM)} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS gram
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM d, (SELECT DISTINCT k FROM g) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT p.doc_id, p.i, p.k, g.item FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM h, unnest(range(i, i + k)) AS t(place) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""

_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _INK)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON x = a.doc_id JOIN n AS b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.x
"""


def _rule_sql(column: str) -> str:
    cases = []
    for rule in sorted(url_rules.RULES, key=lambda r: -r.weight):
        host, slash, path = rule.name.partition("/")
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}')"
        cases.append(f"WHEN {fits} THEN '{rule.name if column == 'rule' else rule.verdict}'")
    if column == "verdict":
        cases += [f"WHEN path LIKE '%{rule.glob[1:]}' THEN '{rule.verdict}'" for rule in url_rules.OWN_RULES]
        return f"CASE {' '.join(cases)} ELSE 'allow' END"
    return f"CASE {' '.join(cases)} END"


_URL_RULES = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
SELECT page_id, host, path, {_rule_sql('rule')} AS rule, {_rule_sql('verdict')} AS verdict FROM p
"""

_ROOM = chat.BUDGET - chat.HISTORY - chat.SYSTEM
_CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]{{1,6}}|[^\s\p{{L}}\p{{N}}]')) + 3 AS tokens,
  length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 16 AS size,
  row_number() OVER w - 1 AS n, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]{{1,6}}|[^\s\p{{L}}\p{{N}}]')) + 3) OVER (w ROWS UNBOUNDED PRECEDING) AS high
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, high - tokens AS low,
  CASE WHEN (high - tokens) // {_ROOM} = (high - 1) // {_ROOM} THEN 2 * ((high - tokens) // {_ROOM}) ELSE 2 * ((high - tokens) // {_ROOM}) + 1 END AS cell FROM t),
k AS (SELECT conv_id, cell, min(low) AS head, min(n) AS first FROM p GROUP BY ALL),
x AS (SELECT k.conv_id, sum(p.size) AS size FROM k JOIN p ON k.conv_id = p.conv_id
  WHERE (p.n = 0 AND p.role = 'system' AND k.first > 0)
     OR (NOT (p.n = 0 AND p.role = 'system') AND p.tokens <= {chat.HISTORY} AND p.high <= k.head AND p.low >= k.head - {chat.HISTORY}) GROUP BY 1)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(p.size) + coalesce(any_value(x.size), 0) AS BIGINT) AS formatted_chars
FROM p LEFT JOIN x ON p.conv_id = x.conv_id GROUP BY p.conv_id
"""

_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_INK}') AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
  concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN labels AS l ON d.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l AS a, l AS b, l AS c, l AS e, l AS g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
r AS (SELECT part, fails, n, good, bad, filter_order,
  coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda q: instr(filter_order, q))), 6) AS leaves FROM m, o),
v AS (SELECT part, substr(filter_order, leaves, 1) AS x, sum(n) AS shapley FROM r WHERE leaves < 6 GROUP BY ALL),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS x,
    coalesce(sum(n) FILTER (WHERE leaves > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE leaves = step), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE leaves < step AND contains(fails, substr(filter_order, CAST(step AS INTEGER), 1))), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = substr(filter_order, CAST(step AS INTEGER), 1)), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE leaves = step), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE leaves = step), 0) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT c.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM c LEFT JOIN v ON c.part = v.part AND c.x = v.x
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": _DECONTAMINATION,
    "op7_near_duplicates": _NEAR_DUPLICATES,
    "op8_url_rules": _URL_RULES,
    "op9_chat_windows": _CHAT,
    "op13_filter_audit": _AUDIT,
}
