"""The same queries as SQL for an independent engine, written over the same tables."""

from __future__ import annotations

# Derived inputs as common table expressions.
VIEWS = {
    "assets_v": r"""
SELECT doc_id AS asset_id,
 'https://' || source || '.example.com/static/' || CAST(doc_id AS STRING) ||
 CASE doc_id % 6 WHEN 0 THEN '.css' WHEN 1 THEN '.js' WHEN 2 THEN '.png' WHEN 3 THEN '.woff2' WHEN 4 THEN '.pdf' ELSE '' END AS url,
 CASE doc_id % 6 WHEN 0 THEN 'text/css' WHEN 1 THEN 'application/javascript' WHEN 2 THEN 'image/png'
  WHEN 3 THEN 'font/woff2' WHEN 4 THEN 'application/pdf' ELSE 'text/css; charset=utf-8' END AS content_type,
 '/* ' || text || ' */' || chr(10) || 'a{background:url("/img/' || CAST(doc_id AS STRING) || '.png")} // ' || lang || ' note' || chr(10) AS body
FROM documents""",
    "state_prev_v": r"""
SELECT url, CASE WHEN page_id % 3 = 0 THEN md5('old' || html) ELSE md5(html) END AS etag,
 CASE WHEN page_id % 4 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified, 'text/html' AS content_type,
 'p/' || CAST(page_id AS STRING) || '.html' AS local_path,
 TIMESTAMP '2024-01-01 00:00:00' AS ts
FROM pages WHERE page_id % 5 <> 0""",
    "hosts_v": r"""SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages""",
    "rules_v": r"""SELECT 0 AS rule_order, TRUE AS allow, '/fr/8' AS path
 UNION ALL SELECT 1, FALSE, '/fr' UNION ALL SELECT 2, FALSE, '/en/1'""",
    "edges_v": r"""
SELECT 'https://s.example.com/p/' || CAST(page_id AS STRING) AS src,
 'https://s.example.com/p/' || CAST(dst AS STRING) AS dst
FROM (
 SELECT page_id, page_id * 2 + 1 AS dst FROM pages
 UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages
 UNION ALL SELECT page_id, page_id % 7 FROM pages) e""",
    "rich_pages_v": r"""
SELECT page_id, url,
 replace(replace(html, '</head>',
  '<link rel="stylesheet" href="/s/' || CAST(page_id % 9 AS STRING) || '.css" crossorigin="anonymous">' ||
  '<link rel="preload" href="/f/a.woff2" as="font"><link rel="shortcut icon" href="/favicon.ico">' ||
  '<style>@import "/s/base.css";</style><script src="/j/app.js"></script>' ||
  '<script>window._next={}</script><script>var R="React"</script></head>'),
 '<article>',
  '<img src="/i/' || CAST(page_id AS STRING) || '.png" srcset="/i/a.png 1x, /i/b.png 2x">' ||
  '<img src="/_next/image?url=%2Fi%2Fhero.png&amp;w=640&amp;q=75">' ||
  '<source srcset="/v/a.webp 1x, /v/b.webp 2x"><div style="opacity: 0; transform: scale(0.9); background: url(/bg/' ||
  CAST(page_id % 4 AS STRING) || '.jpg)"></div><article>') AS html
FROM pages""",
    "page_assets_v": r"""
SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*') || unnest([
 '/s/' || (page_id % 9) || '.css', '/i/' || page_id || '.png', '/s/base.css', '/v/a.webp', '/bg/' || (page_id % 4) || '.jpg']) AS url
FROM pages WHERE page_id % 2 = 0""",
    "hrefs_v": r"""
SELECT page_id, src, CAST(i - 1 AS INTEGER) AS form, f[i] AS href FROM (
 SELECT page_id, url AS src, ['/a/' || page_id || '?x=1#frag', 'https://other.example.com/p/' || page_id,
  '//cdn.example.com/x/' || page_id, 'sub/page' || page_id, '?p=' || page_id, './b/../c.html',
  '../up/' || page_id || '.css', '', 'mailto:a@b.org', '#top', 'javascript:void(0)', 'tel:1',
  'data:image/png;base64,AA', '/_next/image?url=%2Fi%2F' || page_id || '.png&w=64&q=75'] AS f,
  unnest(range(1, 15)) AS i FROM pages)""",
    "resolved_v": r"""
SELECT page_id, form, src, CASE form
  WHEN 0 THEN o || '/a/' || page_id || '?x=1'
  WHEN 2 THEN 'https:' || href
  WHEN 3 THEN o || folder || href
  WHEN 4 THEN o || p || href
  WHEN 5 THEN o || folder || 'c.html'
  WHEN 6 THEN o || regexp_replace(folder, '[^/]+/$', '') || substr(href, 4)
  WHEN 7 THEN regexp_replace(src, '#.*', '')
  WHEN 9 THEN regexp_replace(src, '#.*', '')
  WHEN 13 THEN o || href
  ELSE href END AS url
FROM (SELECT *, regexp_extract(src, '^https?://[^/?#]*') AS o,
  regexp_extract(src, '^https?://[^/?#]*([^?#]*)', 1) AS p,
  regexp_replace(regexp_extract(src, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM hrefs_v)""",
    "css_v": r"""
SELECT doc_id, 'https://' || source || '.example.com' AS site,
 'https://' || source || '.example.com/css/' || doc_id || '.css' AS url,
 '@font-face{src:url("/f/' || doc_id || '.woff2")} a{background:url(../img/' || doc_id ||
 '.png)} b{background:url(data:image/gif;base64,AA)} /* ' || text || ' */' AS body, text
FROM documents""",
    "texts_v": r"""
SELECT url AS source, html AS text, 'text/html' AS content_type FROM pages
UNION ALL SELECT 'doc:' || doc_id, text, 'text/plain' FROM documents
UNION ALL SELECT 'conv:' || conv_id || '/' || turn, text, 'text/plain' FROM conversations""",
    "leaky_texts_v": r"""
SELECT 'doc:' || doc_id AS source, text || chr(10) || 'id ' || 'AK' || 'IA' || upper(left(sha256(CAST(doc_id AS STRING)), 16)) ||
 ' then ' || 'AI' || 'za' || left(sha256(CAST(doc_id AS STRING)), 35) || ' ' || 'xo' || 'xb-' ||
 left(sha256(CAST(doc_id AS STRING)), 12) || chr(10) || '-----BEGIN ' || 'RSA ' || 'PRIVATE KEY-----' || chr(10) ||
 'pass' || 'word = ' || sha256(CAST(doc_id AS STRING)) || ' ' || chr(10) || 'tok' || 'en:' || sha256(CAST(doc_id AS STRING)) ||
 chr(10) || 'end é' AS text
FROM documents""",
    "patterns_v": r"""
SELECT 'aws_key' AS type, '(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}' AS p
UNION ALL SELECT 'google_api', 'AIza[0-9A-Za-z\\-_]{35}'
UNION ALL SELECT 'slack_token', 'xox[baprs]-([0-9a-zA-Z]{10,48})'
UNION ALL SELECT 'private_key', '-----BEGIN [A-Z ]+ PRIVATE KEY-----'
UNION ALL SELECT 'generic_secret', '(?i)(api[_-]?key|auth|secret|token|password|pwd)[\s=:"'']{0,5}[a-zA-Z0-9\-_]{20,}'""",
    "email_rows_v": r"""
SELECT DISTINCT source, email FROM (
 SELECT source, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM texts_v)
WHERE NOT regexp_matches(lower(email), '\.png|\.jpg|\.gif|\.svg|\.webp')""",
    "html_comments_v": r"""
SELECT source, comment FROM (SELECT url AS source,
 regexp_replace(unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)), '^\s+|\s+$', '', 'g') AS comment FROM pages)
WHERE length(comment) > 3""",
    "code_comments_v": r"""
SELECT source, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS comment FROM (
 SELECT url AS source, regexp_replace(unnest(list_concat(regexp_extract_all(body, '//(.*?)\n', 1),
  regexp_extract_all(body, '(?s)/\*(.*?)\*/', 1))), '^\s+|\s+$', '', 'g') AS c
 FROM assets_v WHERE content_type LIKE '%javascript%' OR content_type LIKE '%css%')
WHERE length(c) > 5 AND NOT regexp_matches(lower(c), 'copyright|license|webpack')""",
    "paths_v": r"""
SELECT *, CASE WHEN p IN ('', '/') THEN 'index.html'
  WHEN regexp_matches(p, '(?:^|/)\.*[^./][^/]*\.[^./]*$') THEN ltrim(p, '/')
  WHEN p LIKE '%/' THEN ltrim(p, '/') || 'index.html' ELSE ltrim(p, '/') || '.html' END AS local_path
FROM (SELECT page_id, url, html, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM pages)""",
    "up_v": r"""
SELECT page_id, url, local_path, repeat('../', length(local_path) - length(replace(local_path, '/', ''))) AS up FROM paths_v""",
    "links_v": r"""
SELECT DISTINCT page_id, src, regexp_extract(src, '^https?://[^/?#]*') || regexp_replace(href, '[?#].*', '') AS dst FROM (
 SELECT page_id, url AS src, replace(unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)), '&amp;', '&') AS href FROM pages)""",
    "captured_v": r"""SELECT 'https://s.example.com/p/' || page_id AS url FROM pages""",
    "refs_v": r"""
SELECT page_id, kind, ref, regexp_extract(url, '^https?://[^/?#]*') ||
  CASE WHEN ref LIKE '/_next/image%' THEN '/i/hero.png' ELSE ref END AS url FROM (
 SELECT page_id, url, 'stylesheet' AS kind, unnest(regexp_extract_all(html, '<link[^>]*rel="stylesheet"[^>]*href="([^"]*)"', 1)) AS ref FROM rich_pages_v
 UNION ALL SELECT page_id, url, 'icon', unnest(regexp_extract_all(html, '<link[^>]*rel="[^"]*icon"[^>]*href="([^"]*)"', 1)) FROM rich_pages_v
 UNION ALL SELECT page_id, url, 'img', replace(unnest(regexp_extract_all(html, '<img[^>]*src="([^"]*)"', 1)), '&amp;', '&') FROM rich_pages_v
 UNION ALL SELECT page_id, url, 'srcset', unnest(regexp_extract_all(html, '<source[^>]*srcset="([^" ]*)', 1)) FROM rich_pages_v
 UNION ALL SELECT page_id, url, 'import', unnest(regexp_extract_all(html, '@import\s+"([^"]+)"', 1)) FROM rich_pages_v
 UNION ALL SELECT page_id, url, 'inline', unnest(regexp_extract_all(html, 'style="[^"]*url\(([^)]*)\)', 1)) FROM rich_pages_v)""",
    "held_v": r"""
SELECT url, ltrim(regexp_extract(url, '^https?://[^/?#]*(.*)', 1), '/') AS local_path FROM page_assets_v""",
    "robots_v": r"""
SELECT host, length(host) AS n, length(host) % 5 <> 0 AS usable,
 CASE length(host) % 4 WHEN 0 THEN CAST(length(host) % 7 AS DOUBLE) WHEN 2 THEN 1.5 END AS d FROM hosts_v""",
}


_NEEDS = {
    "resolved_v": ["hrefs_v"],
    "email_rows_v": ["texts_v"],
    "code_comments_v": ["assets_v"],
    "up_v": ["paths_v"],
    "refs_v": ["rich_pages_v"],
    "held_v": ["page_assets_v"],
    "robots_v": ["hosts_v"],
}


def _with(sql: str, *views: str) -> str:
    ordered: list[str] = []

    def add(view: str) -> None:
        for need in _NEEDS.get(view, []):
            add(need)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        add(view)
    heads = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered)
    return f"WITH RECURSIVE {heads} {sql.strip()}" if heads else sql.strip()


def _digest(expression: str, name: str) -> str:
    return f"md5({expression}) AS {name}_md5, CAST(length({expression}) AS BIGINT) AS {name}_len"


_STATE = "url, etag, last_modified, content_type, local_path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"

# Matches with their positions: text is cut at the matches, lengths are added up.
_SECRETS = r"""
, hits AS (SELECT source, type, text, p, regexp_extract_all(text, p) AS m FROM {view}, patterns_v),
cut AS (SELECT source, type, text, m, regexp_split_to_array(text, p) AS g FROM hits WHERE len(m) > 0),
pos AS (SELECT source, type, text, m, unnest(range(1, len(m) + 1)) AS i, g FROM cut),
spans AS (SELECT source, type, text, m[i] AS v,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM pos)
SELECT source, type, left(v, 5) || '...' || right(v, 3) AS value, sha256(v) AS value_sha256, CAST(s AS BIGINT) AS start,
 regexp_replace(substr(masked, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(least(s, 20) AS BIGINT)) || left(v, 5) || '...' || right(v, 3)
  || substr(masked, CAST(s + length(v) + 1 AS BIGINT), 20), '^\s+|\s+$', '', 'g') AS snippet
FROM (SELECT spans.*, k.masked FROM spans JOIN masks k ON k.source = spans.source AND k.type = spans.type)"""

_MASKS = r"""
, masks AS (SELECT source, type, list_aggregate(list_transform(range(1, len(g) + 1),
   lambda i: g[i] || coalesce(repeat('*', length(m[i])), '')), 'string_agg', '') AS masked
 FROM (SELECT source, type, regexp_extract_all(text, p) AS m, regexp_split_to_array(text, p) AS g FROM {view}, patterns_v)
 WHERE len(m) > 0)"""


def _secrets(view: str) -> str:
    return (_MASKS + _SECRETS).replace("{view}", view)


_COUNTS = r"""
, f AS (
 SELECT 'secret' AS kind, type, source, CAST(NULL AS STRING) AS value FROM (
  SELECT source, type, unnest(regexp_extract_all(text, p)) AS v FROM all_v, patterns_v)
 UNION ALL SELECT 'email', 'email', source, email FROM (SELECT DISTINCT source, email FROM (
  SELECT source, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM all_v)
  WHERE NOT regexp_matches(lower(email), '\.png|\.jpg|\.gif|\.svg|\.webp'))
 UNION ALL SELECT 'comment', 'HTML', source, comment FROM html_comments_v
 UNION ALL SELECT 'comment', 'JS/CSS', source, comment FROM code_comments_v)"""
_ALL_TEXTS = ", all_v AS (SELECT source, text FROM texts_v UNION ALL SELECT url, body FROM assets_v WHERE asset_id % 6 NOT IN (2, 3))"
_ALL_VIEWS = ("texts_v", "assets_v", "patterns_v", "html_comments_v", "code_comments_v")

_BFS = r"""
, walk AS (
 SELECT 'https://s.example.com/p/0' AS url, CAST(0 AS BIGINT) AS depth
 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges_v e ON e.src = w.url WHERE w.depth < {limit} {ok})"""

_STYLE = (
    '<style>[style*="opacity"] { opacity: 1 !important; } '
    ".transform-gpu { transform: scale(1) !important; } "
    "[data-nimg] { opacity: 1 !important; }</style>"
)

# Rewritten pages, built from the known insertions of rich_pages_v.
_REVEAL = (
    "replace(replace({h}, 'opacity: 0;', 'opacity:1;'), 'transform: scale(0.9)', 'transform:scale(1)')"
)
_NO_SCRIPTS = (
    "replace(replace(replace({h}, '<script src=\"/j/app.js\"></script>', ''),"
    " '<script>window._next={}</script>', ''), '<script>var R=\"React\"</script>', '')"
)
_NO_PRELOAD = "replace({h}, '<link rel=\"preload\" href=\"/f/a.woff2\" as=\"font\">', '')"
_NO_ATTRIBUTES = (
    "replace(replace({h}, ' crossorigin=\"anonymous\"', ''), ' srcset=\"/i/a.png 1x, /i/b.png 2x\"', '')"
)
_APPEND = "replace({h}, '</head>', '" + _STYLE + "</head>')"
_LINKS = (
    "regexp_replace(regexp_replace({h}, '(<a href=)\"/([^\".]*)\"', '\\1\"' || up || '\\2.html\"', 'g'),"
    " '(<a href=)\"/([^\"]*\\.[^\"]*)\"', '\\1\"' || up || '\\2\"', 'g')"
)


_ASSETS = (
    "replace(replace(replace(replace(replace(replace(replace({h},"
    " 'href=\"/s/' || (page_id % 9) || '.css\"', 'href=\"' || a1 || '\"'),"
    " 'href=\"/favicon.ico\"', 'href=\"' || o || '/favicon.ico\"'),"
    " '@import \"/s/base.css\"', '@import \"' || a2 || '\"'),"
    " '<img src=\"/i/' || page_id || '.png\"', '<img src=\"' || a3 || '\"'),"
    " 'src=\"/_next/image?url=%2Fi%2Fhero.png&amp;w=640&amp;q=75\"', 'src=\"' || up || 'i/hero.png\"'),"
    " '<source srcset=\"/v/a.webp 1x, /v/b.webp 2x\"', '<source srcset=\"' || a4 || '\"'),"
    " 'url(/bg/' || (page_id % 4) || '.jpg)', 'url(' || a5 || ')')"
)
_PAGE_ASSETS = f"""
, placed AS (SELECT r.page_id, r.url, r.html, u.up, u.local_path, regexp_extract(r.url, '^https?://[^/?#]*') AS o
 FROM rich_pages_v r JOIN up_v u USING (page_id)),
known AS (SELECT p.*, k1.url IS NOT NULL AS h1, k2.url IS NOT NULL AS h2, k3.url IS NOT NULL AS h3,
  k4.url IS NOT NULL AS h4, k5.url IS NOT NULL AS h5 FROM placed p
 LEFT JOIN held_v k1 ON k1.url = o || '/s/' || (page_id % 9) || '.css'
 LEFT JOIN held_v k2 ON k2.url = o || '/s/base.css'
 LEFT JOIN held_v k3 ON k3.url = o || '/i/' || page_id || '.png'
 LEFT JOIN held_v k4 ON k4.url = o || '/v/a.webp'
 LEFT JOIN held_v k5 ON k5.url = o || '/bg/' || (page_id % 4) || '.jpg'),
ready AS (SELECT *,
  CASE WHEN h1 THEN up ELSE o || '/' END || 's/' || (page_id % 9) || '.css' AS a1,
  CASE WHEN h2 THEN up ELSE o || '/' END || 's/base.css' AS a2,
  CASE WHEN h3 THEN up ELSE o || '/' END || 'i/' || page_id || '.png' AS a3,
  CASE WHEN h4 THEN up ELSE o || '/' END || 'v/a.webp' AS a4,
  CASE WHEN h5 THEN up ELSE o || '/' END || 'bg/' || (page_id % 4) || '.jpg' AS a5 FROM known)"""


def _nest(*steps: str) -> str:
    html = "html"
    for step in steps:
        html = step.replace("{h}", html)
    return html


_CSS_NEW = (
    "replace(replace(body, '/f/' || doc_id || '.woff2', 'data:font/woff2;base64,' || base64(encode(text))),"
    " CASE WHEN doc_id % 2 = 0 THEN '../img/' || doc_id || '.png' ELSE chr(0) END, '../img/' || doc_id || '.png')"
)

# Pages that a run reaches from one page of each host under the hosts' robots files.
_REACHED = r"""
, e AS (SELECT DISTINCT regexp_replace(src, '[?#].*', '') AS src, dst FROM links_v),
ok AS (SELECT u.url, NOT coalesce(usable AND (p LIKE '/fr%' OR (p LIKE '/en%' AND p NOT LIKE '/en/1%')), FALSE) AS allowed FROM (
 SELECT url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM (
  SELECT dst AS url FROM e UNION SELECT regexp_replace(url, '[?#].*', '') FROM pages)) AS u LEFT JOIN robots_v AS r ON u.host = r.host),
walk AS (
 SELECT min(regexp_replace(url, '[?#].*', '')) AS url FROM pages GROUP BY regexp_extract(url, '^https?://([^/?#]*)', 1)
 UNION SELECT e.dst FROM walk w JOIN e ON e.src = w.url JOIN ok o ON o.url = w.url WHERE o.allowed),
reached AS (SELECT p.* FROM pages p JOIN walk w ON w.url = regexp_replace(p.url, '[?#].*', '') JOIN ok o ON o.url = w.url WHERE o.allowed),
fresh AS (SELECT r.* FROM reached r LEFT JOIN state_prev_v s ON s.url = r.url WHERE s.url IS NULL OR s.etag <> md5(r.html))"""

def _payload(text):
    return f"CAST(strlen({text}) AS BIGINT) AS payload_bytes, sha256({text}) AS payload_sha256"


_RECORDS = f"SELECT url AS target_uri, 'response' AS warc_type, '200 OK' AS status_line, {_payload('html')} FROM pages"

ORACLE: dict[str, str] = {
    "scan_pages": f"SELECT page_id, url, {_digest('html', 'html')} FROM pages",
    "scan_only_html": _with(
        "SELECT url, content_type FROM (SELECT url, 'text/html; charset=utf-8' AS content_type FROM pages"
        " UNION ALL SELECT url, content_type FROM assets_v) WHERE content_type LIKE '%text/html%'",
        "assets_v",
    ),
    "save_and_load_state": _with(f"SELECT {_STATE} FROM state_prev_v", "state_prev_v"),
    "write_warc": _RECORDS,
    "warc_records": _RECORDS,
    "filter_asset_types": _with(
        "SELECT asset_id, url, 'css' AS category FROM assets_v WHERE asset_id % 6 IN (0, 5)",
        "assets_v",
    ),
    "filter_url_patterns": _with(
        r"SELECT asset_id, url FROM assets_v WHERE NOT regexp_matches(url, '\.png$|src11\.')"
        r" AND regexp_matches(url, 'src1[0-9]*\.|/static/[0-9]*7\b')",
        "assets_v",
    ),
    "filter_size": _with(
        "SELECT asset_id, url FROM assets_v WHERE strlen(body) BETWEEN 1024 AND 4096", "assets_v"
    ),
    "filter_same_site": _with(
        "SELECT page_id, form, url FROM resolved_v WHERE NOT regexp_matches(url, '^https?://')"
        " OR regexp_extract(url, '^https?://([^/?#]*)', 1) = regexp_extract(src, '^https?://([^/?#]*)', 1)",
        "resolved_v",
    ),
    "filter_crawlable_href": _with(
        "SELECT page_id, form, href FROM hrefs_v WHERE form NOT IN (8, 9, 10, 11)", "hrefs_v"
    ),
    "filter_data_uri": _with("SELECT page_id, form, href FROM hrefs_v WHERE form NOT IN (7, 12)", "hrefs_v"),
    "filter_email_noise": "SELECT doc_id, source || '@example.org' AS email FROM documents WHERE doc_id % 3 <> 0",
    "filter_comment_noise": r"""
SELECT doc_id, c AS comment, length(c) > 3 AS html_keeps,
 length(c) > 5 AND NOT regexp_matches(lower(c), 'copyright|license|webpack') AS code_keeps
FROM (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN 'Copyright ' WHEN 1 THEN 'sourceMappingURL ' ELSE '' END || lang || '  ' ||
 CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END) AS c FROM documents)""",
    "unvisited": _with("SELECT dst AS key FROM edges_v EXCEPT SELECT url FROM captured_v", "edges_v", "captured_v"),
    "resolve_asset_paths": _with(
        "SELECT r.page_id, kind, ref, CASE WHEN h.url IS NULL THEN r.url ELSE up || h.local_path END AS new_ref"
        " FROM refs_v r JOIN up_v u ON u.page_id = r.page_id LEFT JOIN held_v h ON h.url = r.url",
        "refs_v", "up_v", "held_v",
    ),
    "conditional_headers": _with(
        "SELECT p.url, etag AS if_none_match, last_modified AS if_modified_since"
        " FROM pages p LEFT JOIN state_prev_v s ON s.url = p.url",
        "state_prev_v",
    ),
    "robots_allowed": r"""
SELECT page_id, url, NOT ((regexp_matches(p, '^/fr') AND NOT regexp_matches(p, '^/fr/8')) OR regexp_matches(p, '^/en/1')) AS allowed
FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM pages)""",
    "snapshot_diff": _with(
        "SELECT coalesce(n.url, s.url) AS url, CASE WHEN s.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'removed'"
        " WHEN n.etag = s.etag THEN 'unchanged' ELSE 'changed' END AS status"
        " FROM (SELECT url, md5(html) AS etag FROM pages) n"
        " FULL OUTER JOIN (SELECT url, etag FROM state_prev_v UNION ALL SELECT url || '#gone', etag FROM state_prev_v) s ON s.url = n.url",
        "state_prev_v",
    ),
    "changed_captures": "SELECT url, md5(html) AS etag FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0",
    "seed_assets": _with(
        "SELECT 'https://' || host || path AS url, category, substr(path, 2) AS local_path FROM hosts_v,"
        " (SELECT '/assets/logo.png' AS path, 'image' AS category UNION ALL SELECT '/assets/hero.jpg', 'image'"
        " UNION ALL SELECT '/favicon.ico', 'image' UNION ALL SELECT '/site.css', 'css')"
        " WHERE NOT (path = '/favicon.ico' AND host LIKE '%blog.%')",
        "hosts_v",
    ),
    "inline_css_fonts": _with(
        "SELECT url AS css_url, '/f/' || doc_id || '.woff2' AS ref, md5(u) AS data_uri_md5,"
        " CAST(length(u) AS BIGINT) AS data_uri_len"
        " FROM (SELECT *, 'data:font/woff2;base64,' || base64(encode(text)) AS u FROM css_v)",
        "css_v",
    ),
    "findings_summary": _with(
        _ALL_TEXTS + _COUNTS + " SELECT count(*) FILTER (kind = 'secret') AS secrets,"
        " count(DISTINCT value) FILTER (kind = 'email') AS emails,"
        " count(*) FILTER (kind = 'comment') AS comments FROM f",
        *_ALL_VIEWS,
    ),
    "findings_by_site": _with(
        _ALL_TEXTS + _COUNTS + " SELECT CASE WHEN source LIKE 'http%' THEN regexp_extract(source, '^https?://([^/?#]*)', 1)"
        " ELSE '' END AS site, kind, type,"
        " CASE kind WHEN 'email' THEN count(DISTINCT value) ELSE count(*) END AS n FROM f GROUP BY 1, 2, 3",
        *_ALL_VIEWS,
    ),
    "distinct_emails": _with("SELECT DISTINCT email FROM email_rows_v", "email_rows_v"),
    "crawl_listing": _with(
        r"""
SELECT DISTINCT 'pages' AS section, regexp_replace(url, '\?[^#]*', '') AS url, CAST(NULL AS STRING) AS local_path FROM pages
UNION ALL SELECT 'assets', url, local_path FROM held_v
UNION ALL SELECT DISTINCT 'skipped', url, NULL FROM (SELECT url, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM pages)
WHERE (p LIKE '/fr%' AND p NOT LIKE '/fr/8%') OR p LIKE '/en/1%'""",
        "held_v",
    ),
    "crawl_summary": _with(
        r"""
SELECT 'pages' AS section, count(DISTINCT regexp_replace(url, '\?[^#]*', '')) AS n FROM pages
UNION ALL SELECT 'assets', count(*) FROM held_v
UNION ALL SELECT 'skipped', count(DISTINCT url) FROM (SELECT url, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM pages)
WHERE (p LIKE '/fr%' AND p NOT LIKE '/fr/8%') OR p LIKE '/en/1%'""",
        "held_v",
    ),
    "robots_report": _with(
        "SELECT host, CASE WHEN usable THEN d END AS crawl_delay, CAST(CASE WHEN usable THEN 4 ELSE 0 END AS BIGINT) AS disallowed,"
        " CASE WHEN usable THEN '/ | /fr # french | /en | /de' ELSE '' END AS first_paths FROM robots_v",
        "robots_v",
    ),
    "crawl_delay": _with("SELECT host, CASE WHEN usable THEN d END AS crawl_delay FROM robots_v", "robots_v"),
    "effective_delay": _with(
        "SELECT host, greatest(CAST(0.3 AS DOUBLE), coalesce(CASE WHEN usable THEN d END, 0)) AS delay FROM robots_v",
        "robots_v",
    ),
    "parse_rules": _with(
        "SELECT host, rule_order, allow, path FROM robots_v, (SELECT CAST(0 AS BIGINT) AS rule_order, FALSE AS allow, '/fr' AS path"
        " UNION ALL SELECT 1, TRUE, '/en/1' UNION ALL SELECT 2, FALSE, '/en' UNION ALL SELECT 3, TRUE, '') WHERE usable",
        "robots_v",
    ),
    "first_n_per_site": _with(
        "SELECT host, rule_order, path FROM robots_v, (SELECT CAST(0 AS BIGINT) AS rule_order, '/fr' AS path"
        " UNION ALL SELECT 1, '/en/1') WHERE usable",
        "robots_v",
    ),
    "upsert_state": _with(
        "SELECT url, md5(html) AS etag, CAST(NULL AS STRING) AS last_modified, 'text/html' AS content_type, local_path,"
        " '2024-02-01 00:00:00' AS ts FROM paths_v",
        "paths_v",
    ),
    "dedupe_urls": r"SELECT regexp_replace(url, '\?[^#]*', '') AS key, min(url) AS url FROM pages GROUP BY 1",
    "top_comments": _with(
        " SELECT type, source, comment AS content, length(comment) AS length FROM ("
        "SELECT 'HTML' AS type, source, comment FROM html_comments_v UNION ALL SELECT 'JS/CSS', source, comment FROM code_comments_v)"
        " ORDER BY length DESC, source, content LIMIT 50",
        "html_comments_v", "code_comments_v",
    ),
    "sorted_emails": _with("SELECT DISTINCT email FROM email_rows_v ORDER BY email", "email_rows_v"),
    "sorted_urls": "SELECT DISTINCT url FROM pages ORDER BY url",
    "sitemap": _with(
        "SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS site, url,"
        " CASE WHEN f LIKE '%.html' THEN f ELSE f || '.html' END AS file, local_path"
        " FROM (SELECT *, regexp_extract(url, '[^/]*$') AS f FROM paths_v) ORDER BY site, url",
        "paths_v",
    ),
    "all_findings": _with(
        _ALL_TEXTS + r"""
, f AS (
 SELECT 'secret' AS kind, type, left(v, 5) || '...' || right(v, 3) AS value, source FROM (
  SELECT source, type, unnest(regexp_extract_all(text, p)) AS v FROM all_v, patterns_v)
 UNION ALL SELECT 'email', 'email', email, source FROM (SELECT DISTINCT source, email FROM (
  SELECT source, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM all_v)
  WHERE NOT regexp_matches(lower(email), '\.png|\.jpg|\.gif|\.svg|\.webp'))
 UNION ALL SELECT 'comment', 'HTML', comment, source FROM html_comments_v
 UNION ALL SELECT 'comment', 'JS/CSS', comment, source FROM code_comments_v)
SELECT kind, type, source, md5(value) AS value_md5, CAST(length(value) AS BIGINT) AS value_len FROM f""",
        *_ALL_VIEWS,
    ),
    "asset_refs": _with("SELECT DISTINCT page_id, kind, ref, url FROM refs_v", "refs_v"),
    "dangling_links": _with(
        r"""
, k AS (SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS key FROM pages),
l AS (SELECT src, dst FROM links_v UNION ALL SELECT url, regexp_replace(url, '[?#].*', '') FROM pages WHERE page_id % 2 = 0)
SELECT src, dst FROM l WHERE dst NOT IN (SELECT key FROM k)""",
        "links_v",
    ),
    "normalize_url": _with("SELECT page_id, form, url FROM resolved_v", "resolved_v"),
    "page_key": r"""
SELECT page_id, url, regexp_replace(url, '\?[^#]*', '') AS key, regexp_replace(url, '[?#].*', '') AS captured FROM pages""",
    "asset_category": _with(
        "SELECT asset_id, url, CASE asset_id % 6 WHEN 0 THEN 'css' WHEN 1 THEN 'js' WHEN 2 THEN 'image' WHEN 3 THEN 'font'"
        " WHEN 4 THEN 'doc' ELSE 'css' END AS category FROM assets_v",
        "assets_v",
    ),
    "file_extension": _with(
        "SELECT asset_id, CASE asset_id % 6 WHEN 0 THEN '.css' WHEN 1 THEN '.js' WHEN 2 THEN '.png' WHEN 3 THEN '.woff2'"
        " WHEN 4 THEN '' ELSE '.css' END AS extension FROM assets_v",
        "assets_v",
    ),
    "local_path": _with(
        r"""
, u AS (SELECT url FROM pages UNION SELECT dst FROM links_v),
q AS (SELECT url, regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1) AS p FROM u)
SELECT url, CASE WHEN p IN ('', '/') THEN 'index.html' WHEN regexp_matches(p, '(?:^|/)\.*[^./][^/]*\.[^./]*$') THEN ltrim(p, '/')
 WHEN p LIKE '%/' THEN ltrim(p, '/') || 'index.html' ELSE ltrim(p, '/') || '.html' END AS local_path FROM q""",
        "links_v",
    ),
    "image_proxy_path": _with(
        "SELECT page_id, form, CASE WHEN form = 13 THEN 'i/' || page_id || '_w64.png' END AS path FROM hrefs_v", "hrefs_v"
    ),
    "unwrap_image_proxy": _with(
        "SELECT page_id, form, CASE WHEN form = 13 THEN 'https://s.example.com/i/' || page_id || '.png' ELSE href END AS url FROM hrefs_v",
        "hrefs_v",
    ),
    "first_srcset": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/i/' || page_id || '.png,'"
    " ELSE '/_next/image?url=%2Fa' || page_id || '.png' END AS first FROM pages",
    "relative_path": _with(
        "SELECT page_id, repeat('../', CAST(length(up) / 3 - 1 AS BIGINT)) || 'x.css' AS sibling, up || 's/a.css' AS cousin FROM up_v",
        "up_v",
    ),
    "site_key": "SELECT page_id, replace(replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'www.', ''), '.', '_') || '_offline' AS site_key FROM pages",
    "redact": "SELECT doc_id, left(text, 5) || '...' || right(text, 3) AS redacted FROM documents",
    "font_mime": "SELECT doc_id AS asset_id, CASE WHEN doc_id % 6 = 3 THEN 'font/woff2' END AS mime FROM documents",
    "strip_text": r"""
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS text_len
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
    "extract_links": _with("SELECT page_id, src, dst FROM links_v", "links_v"),
    "extract_stylesheets": _with("SELECT DISTINCT page_id, ref, url FROM refs_v WHERE kind = 'stylesheet'", "refs_v"),
    "extract_media": _with(
        "SELECT DISTINCT page_id, kind, ref, url FROM refs_v WHERE kind IN ('img', 'source', 'srcset')", "refs_v"
    ),
    "extract_icons": _with("SELECT DISTINCT page_id, ref, url FROM refs_v WHERE kind = 'icon'", "refs_v"),
    "extract_inline_urls": _with("SELECT DISTINCT page_id, ref, url FROM refs_v WHERE kind = 'inline'", "refs_v"),
    "extract_css_imports": _with("SELECT DISTINCT page_id, ref, url FROM refs_v WHERE kind = 'import'", "refs_v"),
    "extract_css_urls": _with(
        r"""
SELECT DISTINCT css_url, ref, site || replace(ref, '../', '/') AS url FROM (
 SELECT url AS css_url, site, unnest(regexp_extract_all(body, 'url\(["'']?([^"'')\s]+)["'']?\)', 1)) AS ref FROM css_v)
WHERE ref NOT LIKE 'data:%'""",
        "css_v",
    ),
    "scan_emails": _with("SELECT source, email FROM email_rows_v", "email_rows_v"),
    "scan_secrets": _with(_secrets("texts_v"), "texts_v", "patterns_v"),
    "scan_secrets_all_types": _with(_secrets("leaky_texts_v"), "leaky_texts_v", "patterns_v"),
    "scan_html_comments": _with("SELECT source, comment FROM html_comments_v", "html_comments_v"),
    "scan_js_css_comments": _with("SELECT source, comment FROM code_comments_v", "code_comments_v"),
    "decode_body": f"SELECT doc_id, {_digest('text', 'text')} FROM documents WHERE strlen(text) > 0 OR doc_id % 3 = 0",
    "drop_scripts": _with(
        f"SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_NO_SCRIPTS)} AS h FROM rich_pages_v)",
        "rich_pages_v",
    ),
    "drop_preloads": _with(
        f"SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_NO_PRELOAD)} AS h FROM rich_pages_v)",
        "rich_pages_v",
    ),
    "drop_attributes": _with(
        f"SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_NO_ATTRIBUTES)} AS h FROM rich_pages_v)",
        "rich_pages_v",
    ),
    "reveal_hidden": _with(
        f"SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_REVEAL, _APPEND)} AS h FROM rich_pages_v)",
        "rich_pages_v",
    ),
    "rewrite_links": _with(
        f"SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_LINKS)} AS h"
        " FROM pages JOIN up_v USING (page_id, url))",
        "up_v",
    ),
    "rewrite_assets": _with(
        _PAGE_ASSETS + f" SELECT page_id, url, {_digest('h', 'html')} FROM (SELECT page_id, url, {_nest(_ASSETS)} AS h FROM ready)",
        "rich_pages_v", "up_v", "held_v",
    ),
    "rewrite_css": _with(
        f"SELECT url, {_digest('b', 'body')} FROM (SELECT url, {_CSS_NEW} AS b FROM css_v)", "css_v"
    ),
    "clean_pages": _with(
        _PAGE_ASSETS + f" SELECT page_id, url, local_path, {_digest('h', 'html')} FROM (SELECT page_id, url, local_path,"
        f" {_nest(_NO_SCRIPTS, _NO_PRELOAD, _ASSETS, _NO_ATTRIBUTES, _REVEAL, _LINKS, _APPEND)} AS h FROM ready)",
        "rich_pages_v", "up_v", "held_v",
    ),
    "skipped_urls": r"""
SELECT DISTINCT url FROM (SELECT url, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM pages)
WHERE (p LIKE '/fr%' AND p NOT LIKE '/fr/8%') OR p LIKE '/en/1%'""",
    "stream_state": _with(
        "SELECT p.url, md5(html) AS etag,"
        " CASE WHEN s.etag = md5(html) THEN s.last_modified END AS last_modified, 'text/html' AS content_type,"
        " CASE WHEN s.etag = md5(html) THEN s.local_path ELSE p.local_path END AS local_path,"
        " CASE WHEN s.etag = md5(html) THEN '2024-01-01' ELSE '2024-02-01' END || ' 00:00:00' AS ts"
        " FROM paths_v p LEFT JOIN state_prev_v s ON s.url = p.url",
        "paths_v", "state_prev_v",
    ),
    "stream_findings": _with(
        ", page_texts AS (SELECT * FROM texts_v WHERE content_type = 'text/html')"
        " SELECT 'secret' AS kind, type, left(v, 5) || '...' || right(v, 3) AS value, source FROM ("
        " SELECT source, type, unnest(regexp_extract_all(text, p)) AS v FROM page_texts, patterns_v)"
        " UNION ALL SELECT 'email', 'email', email, source FROM email_rows_v WHERE source LIKE 'http%'"
        " UNION ALL SELECT 'comment', 'HTML', comment, source FROM html_comments_v",
        "texts_v", "patterns_v", "email_rows_v", "html_comments_v",
    ),
    "stream_dedupe": r"SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS key FROM pages",
    "crawl_order": _with(
        _BFS.replace("{limit}", "(SELECT count(*) FROM pages)").replace("{ok}", "") + " SELECT url, min(depth) AS depth FROM walk GROUP BY url",
        "edges_v",
    ),
    "crawl_order_with_rules": _with(
        _BFS.replace("{limit}", "(SELECT count(*) FROM pages)").replace(
            "{ok}", "AND (w.url NOT LIKE '%/p/3%' OR w.url LIKE '%/p/30%')"
        )
        + " SELECT url, min(depth) AS depth, url NOT LIKE '%/p/3%' OR url LIKE '%/p/30%' AS allowed FROM walk GROUP BY url",
        "edges_v",
    ),
    "crawl_sites": _with(
        r"""
, e AS (SELECT DISTINCT regexp_replace(src, '[?#].*', '') AS src, dst FROM links_v),
ok AS (SELECT url, NOT ((p LIKE '/fr%' AND p NOT LIKE '/fr/8%') OR p LIKE '/en/1%') AS allowed FROM (
 SELECT url, regexp_extract(url, '^https?://[^/?#]*(.*)', 1) AS p FROM (
  SELECT dst AS url FROM e UNION SELECT regexp_replace(url, '[?#].*', '') FROM pages))),
walk AS (
 SELECT min(regexp_replace(url, '[?#].*', '')) AS url, CAST(0 AS BIGINT) AS depth FROM pages GROUP BY regexp_extract(url, '^https?://([^/?#]*)', 1)
 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url JOIN ok o ON o.url = w.url
 WHERE w.depth < (SELECT count(*) FROM pages) AND o.allowed)
SELECT walk.url, min(depth) AS depth FROM walk JOIN ok ON ok.url = walk.url WHERE ok.allowed GROUP BY walk.url""",
        "links_v",
    ),
    "mirror_state": _with(
        _REACHED + " SELECT url, md5(html) AS etag, 'text/html' AS content_type, '2024-02-01 00:00:00' AS ts FROM fresh"
        " UNION ALL SELECT url, etag, content_type, '2024-01-01 00:00:00' FROM state_prev_v WHERE url NOT IN (SELECT url FROM fresh)"
        " UNION ALL SELECT url, md5(body), content_type, '2024-02-01 00:00:00' FROM assets_v",
        "assets_v", "links_v", "robots_v", "state_prev_v",
    ),
    "mirror_archive": _with(
        _REACHED + f" SELECT url AS target_uri, {_payload('html')} FROM pages WHERE url IN (SELECT url FROM fresh)"
        f" UNION ALL SELECT url, {_payload('body')} FROM assets_v",
        "assets_v", "links_v", "robots_v", "state_prev_v",
    ),
}

ORACLE["mirror_pages"] = _with(
    _REACHED + _PAGE_ASSETS + f" SELECT page_id, url, local_path, {_digest('h', 'html')} FROM (SELECT page_id, url, local_path,"
    f" {_nest(_NO_SCRIPTS, _NO_PRELOAD, _ASSETS, _NO_ATTRIBUTES, _REVEAL, _LINKS, _APPEND)} AS h FROM ready) WHERE url IN (SELECT url FROM reached)",
    "rich_pages_v", "up_v", "held_v", "links_v", "robots_v", "state_prev_v",
)
ORACLE["mirror_findings"] = _with(
    _REACHED + ORACLE["all_findings"][ORACLE["all_findings"].index(_ALL_TEXTS.strip()):] + " WHERE source IN (SELECT url FROM fresh UNION ALL SELECT url FROM assets_v)",
    *_ALL_VIEWS, "links_v", "robots_v", "state_prev_v",
)
