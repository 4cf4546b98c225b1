"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from tesserae.llm.urls import LISTED_LABEL, RULES

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_components(k: int, percent: int, source: str = "documents") -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{WORD}') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {shingle}) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""


def url_filter() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    decoded = "(string_split({0}, '%')[1] || array_to_string(list_transform(string_split({0}, '%')[2:], lambda s: CASE WHEN regexp_matches(s, '^[0-9A-Fa-f]{{2}}') THEN CASE WHEN regexp_matches(chr(CAST('0x' || substr(s, 1, 2) AS INTEGER)), '^[A-Za-z0-9._~-]$') THEN chr(CAST('0x' || substr(s, 1, 2) AS INTEGER)) ELSE '%' || upper(substr(s, 1, 2)) END || substr(s, 3) ELSE '%' || s END), ''))"
    canonical = rf"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') || regexp_replace({decoded.format('path')}, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END"
    return rf"""
WITH x AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q FROM x),
o AS (SELECT * EXCLUDE (q), array_to_string(list_sort(list_filter(string_split({decoded.format("q")}, '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS query FROM p),
u AS (SELECT *, {canonical} AS canon FROM o),
l AS (SELECT DISTINCT canon FROM u WHERE list_contains(string_split(host, '.'), '{LISTED_LABEL}')),
r(rhost, rpath, rverdict) AS (VALUES {rules}),
m AS (SELECT u.page_id, u.host, u.path, u.canon, r.rhost || r.rpath AS rule, r.rverdict,
  row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC, r.rhost || r.rpath DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.rverdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN l ON l.canon = m.canon WHERE m.k = 1"""
