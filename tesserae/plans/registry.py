"""Registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, evaluation, fusion, keyword, stats, sync, vector
from tesserae.plans import adapters as A
from tesserae.sources import pages as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ACCENTS = "strip_accents(lower({}))"
TERMS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
CHUNKS = "c AS (SELECT 'p' || CAST(doc_id // 10 AS VARCHAR) AS url, doc_id, text, greatest(1, length(text) // 4) AS tokens FROM documents)"
QUESTIONS = """q AS (SELECT b.item_id AS id, b.text AS evidence, 'p' || CAST(coalesce((SELECT min(doc_id) FROM documents d
  WHERE contains(lower(d.text), lower(b.text))), 0) // 10 AS VARCHAR) AS expected_url, CASE WHEN b.item_id % 4 = 0 THEN 'fourth' ELSE '' END AS grp,
  CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS origin FROM benchmark b)"""
RAW = """raw AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '---' || chr(10) || 'title: Page ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'source: "' || source || '"'
  || chr(10) || 'note: a:b:c' || chr(10) || 'lang: ' || upper(lang) || chr(10) || '---' || chr(10) || text END AS raw FROM documents)"""
VERSION = "'sha256:' || sha256(text)"
TALKS = r"""t AS (SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"""


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return put


def bm25_sql(k: int, text: str = "text", depth: str = "") -> str:
    """CTEs that end in bm(query_id, rank, doc_id, score)."""
    return rf"""w AS (SELECT doc_id, {TERMS.format(text)} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
tf AS (SELECT doc_id, len(w) AS dl, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM w) GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, n),
sc AS (SELECT qt.query_id, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), n GROUP BY 1, 2),
bm AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc QUALIFY rank <= {k})"""


COSINE = """cs AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
co AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM cs QUALIFY rank <= {k})"""


@register("kw_bm25_top5", f"WITH {bm25_sql(5)} SELECT * FROM bm")
def kw_bm25_top5(spark, d):
    return keyword.bm25(A.table(spark, d, "documents"), A.queries(spark, d), ["doc_id"], ["text"], 5)


@register("kw_bm25_heading_top5", f"""WITH {bm25_sql(5, "coalesce(lang || ' > ' || source || ' ', '') || coalesce(text, '')")} SELECT * FROM bm""")
def kw_bm25_heading_top5(spark, d):
    docs = A.table(spark, d, "documents").withColumn("heading_path", F.concat_ws(" > ", "lang", "source"))
    return keyword.bm25(docs, A.queries(spark, d), ["doc_id"], ["heading_path", "text"], 5)


@register("kw_match_terms", f"""SELECT item_id AS query_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' OR ') AS terms
FROM (SELECT item_id, {TERMS.format("text")} AS w FROM benchmark)""")
def kw_match_terms(spark, d):
    return A.queries(spark, d).select("query_id", F.array_join(T.query_terms(F.col("text")), " OR ").alias("terms"))


@register("vec_cosine_top5", f"WITH {COSINE.format(k=5)} SELECT * FROM co")
def vec_cosine_top5(spark, d):
    return vector.nearest(A.table(spark, d, "embeddings"), A.vector_queries(spark, d), "vec_id", 5)


@register("fus_rrf_top5", f"""WITH {bm25_sql(50)}, {COSINE.format(k=50)},
u AS (SELECT query_id, rank, doc_id FROM bm UNION ALL SELECT query_id // 100, rank, vec_id FROM co),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM u GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f QUALIFY rank <= 5""")
def fus_rrf_top5(spark, d):
    """Keyword and vector candidates; query i is paired with vector 100 * i and documents with vectors of the same id."""
    k = fusion.candidates(5)
    words = keyword.bm25(A.table(spark, d, "documents"), A.queries(spark, d), ["doc_id"], ["text"], k)
    near = vector.nearest(A.table(spark, d, "embeddings"), A.vector_queries(spark, d), "vec_id", k)
    near = near.select(F.floor(F.col("query_id") / 100).alias("query_id"), "rank", F.col("vec_id").alias("doc_id"))
    return fusion.fuse([words, near], ["doc_id"], 5)


def ranked(spark, d):
    """The first 50 documents of each question, with their page, text and tokens."""
    top = keyword.bm25(A.table(spark, d, "documents"), A.queries(spark, d), ["doc_id"], ["text"], evaluation.DEPTH)
    return top.join(A.chunks(spark, d), "doc_id")


RANKED = f"""WITH {CHUNKS}, {QUESTIONS}, {bm25_sql(50)},
r AS (SELECT query_id, rank, url, text, tokens FROM bm JOIN c USING (doc_id)),
s AS (SELECT q.id, any_value(q.grp) AS grp, any_value(q.origin) AS origin, min(CASE WHEN r.url = q.expected_url THEN r.rank END) AS page_rank,
  min(CASE WHEN r.url = q.expected_url AND contains(lower(r.text), lower(q.evidence)) THEN r.rank END) AS section_rank FROM q LEFT JOIN r ON r.query_id = q.id GROUP BY q.id)"""


@register("ev_question_ranks", f'{RANKED} SELECT id, grp AS "group", origin, page_rank, section_rank FROM s')
def ev_question_ranks(spark, d):
    return evaluation.question_ranks(A.questions(spark, d), ranked(spark, d))


@register("ev_recall", f"""{RANKED}, l AS (SELECT s.*, unnest([{{'kind': 0, 'questions': 'all'}}, {{'kind': 1, 'questions': 'origin: ' || origin}},
  CASE WHEN grp = '' THEN {{'kind': 2, 'questions': 'general'}} ELSE {{'kind': 3, 'questions': 'group: ' || grp}} END]) AS l FROM s)
SELECT l.kind AS kind, l.questions AS questions, count(*) AS count, {", ".join(f"count(*) FILTER ({x}_rank <= {k}) AS {x}_{k}" for x in ("page", "section") for k in (1, 3, 5))} FROM l GROUP BY 1, 2""")
def ev_recall(spark, d):
    return evaluation.recall(ev_question_ranks(spark, d))


@register("ev_tokens_returned", f"""{RANKED}, k AS (SELECT q.id, {", ".join(f"coalesce(sum(tokens) FILTER (rank <= {k}), 0) AS t{k}" for k in (1, 3, 5))} FROM q LEFT JOIN r ON r.query_id = q.id GROUP BY q.id)
SELECT {", ".join(f"CAST(round_even(avg(t{k}), 0) AS BIGINT) AS tokens_{k}" for k in (1, 3, 5))} FROM k""")
def ev_tokens_returned(spark, d):
    return evaluation.tokens_returned(A.questions(spark, d), ranked(spark, d))


@register("ev_unreachable", f"WITH {CHUNKS}, {QUESTIONS} SELECT id FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.url = q.expected_url AND contains(lower(c.text), lower(q.evidence)))")
def ev_unreachable(spark, d):
    return evaluation.unreachable(A.questions(spark, d), A.chunks(spark, d))


@register("ev_rank_changes", f"""{RANKED}, o AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE page_rank + id % 2 END AS p, CASE WHEN id % 5 = 0 THEN 2 ELSE section_rank END AS s FROM s WHERE id % 7 <> 0)
SELECT s.id, {", ".join(f"CASE WHEN o.{x[0]} IS NOT DISTINCT FROM s.{x}_rank THEN '' WHEN s.{x}_rank IS NULL THEN 'lost' WHEN o.{x[0]} IS NULL THEN 'found' WHEN s.{x}_rank < o.{x[0]} THEN 'better' ELSE 'worse' END AS {x}_change" for x in ("page", "section"))}
FROM s LEFT JOIN o USING (id)""")
def ev_rank_changes(spark, d):
    now = ev_question_ranks(spark, d)
    old = now.where("id % 7 <> 0").select("id", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE page_rank + id % 2 END").alias("page_rank"), F.expr("CASE WHEN id % 5 = 0 THEN 2 ELSE section_rank END").alias("section_rank"))
    return evaluation.rank_changes(now, old)


PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@register("src_md_url", rf"""WITH e AS (SELECT page_id, url, lower(regexp_extract(regexp_extract({PATH}, '[^/]*$'), '\.[^.]*$')) AS x FROM pages)
SELECT page_id, x AS extension, CASE WHEN x = '.md' THEN url WHEN x = '' THEN regexp_replace(url, '/+$', '') || '.md' END AS md_url FROM e""")
def src_md_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.file_extension(T.url_path(F.col("url"))).alias("extension"), T.md_url(F.col("url")).alias("md_url"))


@register("src_link_list", r"""SELECT page_id, 1 AS pos, 'Page ' || page_id AS title, url FROM pages""")
def src_link_list(spark, d):
    """Each page as a page list of its own: a heading, its link, and a line that isn't one."""
    text = F.concat(F.lit("# Docs\n - [ Page "), F.col("page_id").cast("string"), F.lit(" ]("), F.col("url"), F.lit("): notes\n> "), F.col("url"))
    return source.link_list(A.table(spark, d, "pages").select("page_id", text.alias("text")))


@register("src_front_matter", f"""WITH {RAW}, x AS (SELECT d.doc_id, d.doc_id % 5 <> 0 AS has, d.lang, d.source, d.text FROM documents d)
SELECT doc_id, CASE WHEN has THEN 4 ELSE 0 END AS fields, CASE WHEN has THEN 'Page ' || doc_id END AS title, CASE WHEN has THEN upper(lang) END AS lang,
CASE WHEN has THEN source END AS source, CASE WHEN has THEN 'a:b:c' END AS note, sha256(text) AS body_hash FROM x""")
def src_front_matter(spark, d):
    rows = A.raw_pages(spark, d).withColumn("p", source.front_matter(F.col("raw")))
    return rows.select("doc_id", F.size("p.front_matter").alias("fields"), *(F.col("p.front_matter")[k].alias(k) for k in ("title", "lang", "source", "note")), F.sha2("p.body", 256).alias("body_hash"))


def versions(spark, d):
    """Two versions of the documents: known without every 11th and with every 7th altered, fetched without every 13th."""
    docs = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", "text")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    fetched = docs.where("doc_id % 13 <> 0").select("url", sync.version_hash(none, F.col("text")).alias("version_hash"))
    known = docs.where("doc_id % 11 <> 0").select("url", sync.version_hash(none, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("version_hash"))
    return fetched, known


KNOWN = f"""fetched AS (SELECT CAST(doc_id AS VARCHAR) AS url, {VERSION} AS version_hash FROM documents WHERE doc_id % 13 <> 0),
known AS (SELECT CAST(doc_id AS VARCHAR) AS url, 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS version_hash FROM documents WHERE doc_id % 11 <> 0)"""


@register("sync_status", f"""WITH {KNOWN} SELECT f.url, f.version_hash, CASE WHEN k.url IS NULL THEN 'added' WHEN k.version_hash = f.version_hash THEN 'unchanged' ELSE 'changed' END AS status FROM fetched f LEFT JOIN known k USING (url)""")
def sync_status(spark, d):
    return sync.statuses(*versions(spark, d))


@register("sync_counts", f"""WITH {KNOWN}, s AS (SELECT CASE WHEN k.url IS NULL THEN 'added' WHEN k.version_hash = f.version_hash THEN 'rechunked' ELSE 'changed' END AS status FROM fetched f LEFT JOIN known k USING (url))
SELECT status, count(*) AS n FROM s GROUP BY 1""")
def sync_counts(spark, d):
    return sync.counts(sync.statuses(*versions(spark, d), settings_changed=True))


@register("sync_prune", f"WITH {KNOWN} SELECT * FROM known WHERE url IN (SELECT url FROM fetched)")
def sync_prune(spark, d):
    fetched, known = versions(spark, d)
    return sync.pruned(known, fetched, spark.createDataFrame([], "url string, error string"))


@register("sync_upsert", f"WITH {KNOWN} SELECT * FROM fetched UNION ALL SELECT * FROM known WHERE url NOT IN (SELECT url FROM fetched)")
def sync_upsert(spark, d):
    fetched, known = versions(spark, d)
    return sync.upsert(known, fetched)


def nested(pattern_of: list[str], column: str) -> str:
    sql = column
    for p in pattern_of:
        sql = f"regexp_replace({sql}, '{p}', '', 'g')"
    return sql


@register("md_strip_prose", "SELECT page_id, " + nested(["<!--.*?-->", r"(?i)<svg\b.*?</svg>", T.TAG_PATTERN.replace("'", "''"), T.ICON_PATTERN], "html") + " AS prose FROM pages")
def md_strip_prose(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.strip_prose(F.col("html")).alias("prose"))


@register("md_fence_flags", """WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST(count(*) + 2 * count(*) FILTER (i % 3 = 0) AS INTEGER) AS n_lines, CAST(3 * count(*) FILTER (i % 3 = 0) AS INTEGER) AS n_code FROM f GROUP BY doc_id""")
def md_fence_flags(spark, d):
    flags = T.fence_flags(F.split("text", "\n"))
    return A.fenced(spark, d).select("doc_id", flags.alias("f")).select("doc_id", F.size("f").alias("n_lines"), F.size(F.filter("f", lambda x: x)).alias("n_code"))


@register("md_collapse_blank_lines", r"SELECT doc_id, sha256(regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def md_collapse_blank_lines(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(T.collapse_blank_lines(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))), 256).alias("h"))


@register("chk_tokens_and_hash", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, sha256(text) AS content_hash FROM documents")
def chk_tokens_and_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.content_hash(F.col("text")).alias("content_hash"))


@register("chk_anchors", r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS section, role || CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1
  THEN '_' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) ELSE '' END AS anchor FROM conversations""")
def chk_anchors(spark, d):
    """Anchors of the headings of each talk, from the chunker's chunks of one section each."""
    rows = A.talk_lines(spark, d).select(F.col("conv_id").cast("string").alias("url"), F.lit("").alias("title"), F.col("markdown").alias("body"))
    found = chunking.chunk_pages(rows, chunking.Settings(max_tokens=1 << 28))
    return found.select(F.col("url").cast("long").alias("conv_id"), (F.col("ord") + 1).alias("section"), "anchor")


@register("chk_sections", r"""SELECT CAST(conv_id AS VARCHAR) AS url, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, 'Talk ' || conv_id || ' > ' || role AS path,
  sha256(regexp_replace(regexp_replace('## ' || role || chr(10) || chr(10) || regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS content_hash FROM conversations""")
def chk_sections(spark, d):
    rows = A.talk_lines(spark, d).select(F.col("conv_id").cast("string").alias("url"), F.lit("").alias("title"), F.col("markdown").alias("body"))
    found = chunking.chunk_pages(rows, chunking.Settings(max_tokens=1 << 28))
    return found.select("url", "ord", F.array_join("heading_path", " > ").alias("path"), "content_hash")


def packed_pages(spark, d, settings=chunking.Settings()):
    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    return chunking.chunk_pages(rows, settings)


PACKED = r"""WITH RECURSIVE b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '^\s+', ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS bl FROM documents),
r(doc_id, i, cur, parts) AS (SELECT doc_id, 1, '', []::VARCHAR[] FROM b UNION ALL SELECT r.doc_id, i + 1,
  CASE WHEN cur = '' OR (greatest(1, length(cur) // 4) >= 100 AND (length(cur) + 2 + length(bl[i])) // 4 > 600) THEN bl[i] ELSE cur || chr(10) || chr(10) || bl[i] END,
  CASE WHEN cur <> '' AND greatest(1, length(cur) // 4) >= 100 AND (length(cur) + 2 + length(bl[i])) // 4 > 600 THEN list_append(parts, cur) ELSE parts END
  FROM r JOIN b USING (doc_id) WHERE i <= len(bl)),
e AS (SELECT r.doc_id, CASE WHEN len(parts) > 0 AND length(cur) // 4 < 100 THEN list_append(parts[:-2], parts[-1] || chr(10) || chr(10) || cur) ELSE list_append(parts, cur) END AS parts
  FROM r JOIN b USING (doc_id) WHERE i = len(bl) + 1 AND cur <> ''),
u AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS k FROM e)
SELECT CAST(doc_id AS VARCHAR) AS url, CAST(k AS INTEGER) AS ord, CAST(k AS INTEGER) AS part, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, sha256(text) AS content_hash FROM u"""


@register("chk_packed_parts", PACKED)
def chk_packed_parts(spark, d):
    """Documents as pages of paragraphs, in parts of 600 tokens."""
    return packed_pages(spark, d).select("url", "ord", "part", "tokens", "content_hash")


@register("chk_split_tabs")
def chk_split_tabs(spark, d):
    """Documents as pages with a tab for every second line and a note for every fifth, split at tabs."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit('=== "Tab '), i.cast("string"), F.lit('"\n\n    '), x)).when(i % 5 == 4, F.concat(F.lit('!!! note "Mind"\n    '), x)).otherwise(x))
    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("title"), F.array_join(lines, "\n\n").alias("body"))
    return chunking.chunk_pages(rows, chunking.Settings(200, 20, True)).select("url", "ord", F.array_join("heading_path", " > ").alias("path"), "part", "tokens", "content_hash")


@register("chk_slugs", r"""SELECT DISTINCT s AS heading, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(s, 'ß', ''))), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '') AS slug FROM (SELECT 'About ' || source || ', in ' || lang || ': eth_call' AS s FROM documents)""")
def chk_slugs(spark, d):
    rows = A.table(spark, d, "documents").select(F.concat(F.lit("About "), F.col("source"), F.lit(", in "), F.col("lang"), F.lit(": eth_call")).alias("heading")).distinct()
    return rows.select("heading", chunking.slugs("heading").alias("slug"))


@register("qa_chunk_stats", f"""WITH {CHUNKS}, v AS (SELECT list_sort(list(tokens)) AS x, count(*) AS n FROM c),
e AS (SELECT x, n, i, least(greatest((i * (n + 1)) // 20, 1), n - 1) AS j FROM v, (VALUES (1), (10), (19)) t(i)),
f AS (SELECT i, (x[j] * (20 - (i * (n + 1) - 20 * j)) + x[j + 1] * (i * (n + 1) - 20 * j)) / 20 AS q FROM e)
SELECT count(DISTINCT url) AS pages, count(*) AS chunks, round(count(*) / count(DISTINCT url), 1) AS chunks_per_page, (SELECT q FROM f WHERE i = 10) AS median, (SELECT q FROM f WHERE i = 1) AS p5,
(SELECT q FROM f WHERE i = 19) AS p95, CAST(max(tokens) AS INTEGER) AS largest, count(*) FILTER (tokens < 50) AS under_50, count(*) FILTER (doc_id % 9 = 0) AS continued FROM c""")
def qa_chunk_stats(spark, d):
    return stats.chunk_stats(A.chunks(spark, d).withColumn("part", F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)))


@register("qa_leftover_markup", """WITH p AS (SELECT chr(10) || html AS p FROM pages) SELECT unnest(['termynal', 'admonition', 'tab', 'div', 'svg', 'mark']) AS markup,
unnest([count(*) FILTER (contains(p, '<span data-ty')), count(*) FILTER (contains(p, chr(10) || '!!! ')), count(*) FILTER (contains(p, chr(10) || '=== "')), count(*) FILTER (contains(p, '<div')), count(*) FILTER (contains(p, '<svg')), count(*) FILTER (contains(p, chr(57344)))]) AS n FROM p""")
def qa_leftover_markup(spark, d):
    return stats.leftovers(A.table(spark, d, "pages").select(F.col("html").alias("text")))


@register("vf_question_checks", f"""WITH {TALKS}, f AS (SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations c),
s AS (SELECT * FROM f WHERE role = 'user' AND k = 1), a AS (SELECT t.conv_id, t.markdown, chr(10) || s.text || chr(10) AS section, s.conv_id IS NOT NULL AS has, substr(s.text, 1, 4) AS e FROM t LEFT JOIN s USING (conv_id)),
n AS (SELECT *, (length(lower(section)) - length(replace(lower(section), lower(e), ''))) / length(e) AS i, (length(lower(markdown)) - length(replace(lower(markdown), lower(e), ''))) / length(e) AS w FROM a)
SELECT conv_id AS id, CASE WHEN NOT has THEN 'heading missing' WHEN conv_id % 10 = 0 THEN 'page missing' WHEN i = 0 THEN 'evidence not in section' WHEN w > i THEN 'evidence elsewhere' ELSE '' END AS problem FROM n WHERE length(e) > 0 AND NOT contains(e, chr(10))""")
def vf_question_checks(spark, d):
    """A question for each talk's first user turn: its first four characters, once in the section and nowhere else."""
    talks = A.talk_lines(spark, d)
    first = A.table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    asked = first.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 10 == 0, "none").otherwise(F.col("conv_id").cast("string")).alias("url"), F.lit("user").alias("heading"), F.substring("text", 1, 4).alias("evidence"))
    asked = asked.where("length(evidence) > 0 and not contains(evidence, '\n')")
    return stats.question_checks(asked, talks.select(F.col("conv_id").cast("string").alias("url"), "markdown"))


@register("vf_page_urls", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://x.example/' || lang || '/' WHEN 1 THEN 'https://x.example/' || lang || '/' || source || '/' ELSE 'https://x.example/' END AS url FROM documents""")
def vf_page_urls(spark, d):
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(lang, '/index.md') WHEN 1 THEN concat(lang, '/', source, '.md') ELSE 'index.md' END")
    return A.table(spark, d, "documents").select("doc_id", T.page_url(F.lit("https://x.example/"), path).alias("url"))
