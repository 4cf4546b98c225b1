"""Queries on markup, chunks, links and stores that are made from the tables, so that SQL knows what must come out.

Pages are made of documents' plain lines (`adapters.plain_lines`): a line becomes a piece of markup by its number, so what the
library makes of the whole page is known piece by piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, keyword, markup, runs, stats, vector
from tesserae.plans import adapters as A
from tesserae.plans.registry import PATH, TERMS, nested, register
from tesserae.session import cut, shared_root
from tesserae.sources import pages as source
from tesserae.sources.store import Store

#: pl(doc_id, l) and e(doc_id, url, x, i, n): plain lines as lists, and one by one with number and count.
PLAIN = rf"""pl AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{A.NOT_PLAIN}', '', 'g'), ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM documents) WHERE t <> ''),
e AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS url, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM pl)"""
WHOLE = 1 << 28  # more tokens than any page has
EACH = chunking.Settings(0, 1)  # every block is a part


def whole_sql(piece: str, before: str = "", behind: str = "", between: str = r"\n\n", closed: str = "false") -> str:
    """The hash of each page whose pieces are `piece`; a page whose last piece is a `closed` one keeps the blank line behind it."""
    return f"""WITH {PLAIN} SELECT url, sha256(E'{before}' || string_agg({piece}, E'{between}' ORDER BY i) || E'{behind}\\n' || CASE WHEN arg_max({closed}, i) THEN chr(10) ELSE '' END) AS h FROM e GROUP BY url"""


def chunks_sql(text: str, path: str = "'Top'", anchor: str = "''", ord_: str = "i", part: str = "0", rows: str = "e") -> str:
    """A chunk for each row, with what it is made of."""
    return f"""SELECT url, CAST({ord_} AS INTEGER) AS ord, {path} AS path, {anchor} AS anchor, CAST({part} AS INTEGER) AS part, CAST(greatest(1, length({text}) // 4) AS INTEGER) AS tokens, sha256({text}) AS content_hash FROM {rows}"""


def cleaned(pages):
    return pages.select("url", F.sha2(markup.clean_markup("body"), 256).alias("h"))


def chunked(pages, settings):
    return chunking.chunk_pages(pages, settings).select("url", "ord", F.array_join("heading_path", " > ").alias("path"), "anchor", "part", "tokens", "content_hash")


def by_number(i, n: int, *makes):
    """makes[i % n], the last for what is left."""
    out = None
    for k, make in enumerate(makes[:-1]):
        out = F.when(i % n == k, make) if out is None else out.when(i % n == k, make)
    return out.otherwise(makes[-1])


def text_of(*parts):
    """Strings and columns, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@register("md_widgets", whole_sql("CASE i % 2 WHEN 0 THEN '$ ' || x ELSE x || ' & more' END", r"Before\n```text\n", r"\n```\nAfter", r"\n"))
def md_widgets(spark, d):
    """Terminal widgets: what is typed and what is shown in turn, entities, indentation, and text behind the widget's end."""
    line = lambda x, i: by_number(i, 2, text_of('<span data-ty="input">', x, "</span>"), text_of("    <span data-ty>", x, " &amp; more</span>"))
    rows = A.plain_lines(spark, d).select(F.col("doc_id").cast("string").alias("url"), F.concat(F.lit('Before\n<div id="termynal" data-termynal>\n'), F.array_join(F.transform("lines", line), "\n\n"), F.lit("\n</div> lost\nAfter")).alias("body"))
    return cleaned(rows)


@register("md_notes", whole_sql(r"CASE i % 3 WHEN 1 THEN '**Warning: Mind ' || i || E'**\n\n' || x || E'\n  deeper' WHEN 2 THEN E'**Tip:**\n\n' || x ELSE x END", closed="i % 3 <> 0"))
def md_notes(spark, d):
    """Notes with and without a title, open, folded, and with another word behind their kind."""
    return cleaned(A.generated(spark, d, lambda x, i: by_number(i, 3, x, text_of('!!! warning "Mind ', i, '"\n\n    ', x, "\n      deeper"), text_of("??? TIP extra\n    ", x))))


@register("md_tabs", whole_sql(r"""CASE i % 4 WHEN 1 THEN '**Tab: T' || i || E'**\n\n' || x || E'\n\n**Tab: T' || i || E' › Sub**\n\ninner ' || x WHEN 3 THEN '**Tab: T' || i || E'**\n\n**Note:**\n\n**Tab: T' || i || E' › Sub**\n\ninner ' || x ELSE x END""", closed="i % 2 = 1"))
def md_tabs(spark, d):
    """Tabs within tabs, one of them with a note between."""
    direct = lambda x, i: text_of('=== "T', i, '"\n\n    ', x, '\n\n    ===+ " Sub "\n\n        inner ', x)
    within = lambda x, i: text_of('=== "T', i, '"\n\n    !!! note\n\n        === "Sub"\n\n            inner ', x)
    return cleaned(A.generated(spark, d, lambda x, i: by_number(i, 4, x, direct(x, i), x, within(x, i))))


@register("md_html", whole_sql(r"CASE i % 4 WHEN 0 THEN x || ', Vec<T> and `<b>kept</b>` stay' WHEN 1 THEN E'open\nback' WHEN 2 THEN x ELSE E'```\n<b>' || x || E'</b>\n```' END"))
def md_html(spark, d):
    """Tags, comments and drawings over several lines, icons; code spans and fences stay."""
    return cleaned(A.generated(spark, d, lambda x, i: by_number(i, 4, text_of("<b>", x, "</b>, Vec<T> and `<b>kept</b>` stay"), text_of("open <!-- gone\n", x, "\n-->back"), text_of('<svg width="1">\n<path/>\n</svg>', x, " :octicons-gear-16:"), text_of("```\n<b>", x, "</b>\n```"))))


@register("md_clean_markup", "SELECT page_id, regexp_replace(regexp_replace(" + nested(["<!--.*?-->", r"(?i)<svg\b.*?</svg>", T.TAG_PATTERN.replace("'", "''"), T.ICON_PATTERN], "html") + r", '^\s+', ''), '\s+$', '') || chr(10) AS markdown FROM pages")
def md_clean_markup(spark, d):
    """Pages of one line each, without fences and code spans: prose only."""
    return A.table(spark, d, "pages").select("page_id", markup.clean_markup("html").alias("markdown"))


@register("md_indents", f"WITH {PLAIN} SELECT url, CAST(i AS INTEGER) AS i, CAST(i % 5 AS INTEGER) AS indent FROM e")
def md_indents(spark, d):
    """Leading spaces of lines, before a tab for every second one."""
    rows = A.plain_lines(spark, d).select(F.col("doc_id").cast("string").alias("url"), F.posexplode_outer("lines").alias("i", "x"))
    return rows.select("url", "i", T.indent_of(F.concat(F.repeat(F.lit(" "), F.col("i") % 5), F.when(F.col("i") % 2 == 0, "\t ").otherwise(""), "x")).alias("indent"))


@register("chk_guides", f"WITH {PLAIN} " + chunks_sql("x", "'Guide ' || i", "CASE WHEN i > 0 THEN 'guide-' || i ELSE '' END"))
def chk_guides(spark, d):
    """A first-level heading for each line; what stands before the first, and a guide without text, are in no chunk."""
    return chunked(A.generated(spark, d, lambda x, i: text_of("# `Guide` ", i, " #\n\n", x), "lost\n\n", "\n\n# Empty\n"), chunking.Settings(WHOLE))


@register("chk_subsections", f"WITH {PLAIN} " + chunks_sql(r"'### Part ' || i || E'\n\n' || x", "'Top > Long > Part ' || i", "'part-' || i"))
def chk_subsections(spark, d):
    """A section that is too long, cut at its third-level headings; fourth-level ones and fences don't cut."""
    return chunked(A.generated(spark, d, lambda x, i: text_of("### Part ", i, "\n\n", x), "# Top\n\n## Long\n\n"), EACH)


@register("chk_repeated_parts", f"""WITH {PLAIN} """ + chunks_sql(r"'## Same' || E'\n\n' || x || E'\n\n#### deeper\n\n```\n## code\n```'", "'Top > Same'", "CASE WHEN i > 0 THEN 'same_' || i ELSE 'same' END"))
def chk_repeated_parts(spark, d):
    """Sections of one heading: anchors are numbered, parts aren't; headings of other levels and in fences stay in the text."""
    return chunked(A.generated(spark, d, lambda x, i: text_of("## Same\n\n", x, "\n\n#### deeper\n\n```\n## code\n```")), chunking.Settings(WHOLE))


@register("chk_blocks", f"WITH {PLAIN} " + chunks_sql(r"CASE i % 3 WHEN 0 THEN x WHEN 1 THEN E'```\n' || x || E'\n\n' || x || E'\n```' ELSE E'**Label**\n\n' || x END", part="i"))
def chk_blocks(spark, d):
    """Each block a part: paragraphs, whole fences, labels with what follows them."""
    return chunked(A.generated(spark, d, lambda x, i: by_number(i, 3, x, text_of("```\n", x, "\n\n", x, "\n```"), text_of("**Label**\n\n", x))), EACH)


def tabbed(spark, d):
    """Lines in turn outside of tabs and in a tab of two paragraphs."""
    return A.generated(spark, d, lambda x, i: by_number(i, 2, x, text_of('=== "T', i, '"\n\n    ', x, "\n\n    ", x, " again")))


@register("chk_tab_units", f"""WITH {PLAIN}, u AS (SELECT url, i // 2 * 3 AS o, i // 2 AS part, 'Top' AS path, x AS text FROM e WHERE i % 2 = 0
UNION ALL SELECT url, i // 2 * 3 + 1, 0, 'Top > Tab: T' || i, '**Tab: T' || i || E'**\\n\\n' || x FROM e WHERE i % 2 = 1
UNION ALL SELECT url, i // 2 * 3 + 2, 1, 'Top > Tab: T' || i, '**Tab: T' || i || E' (continued)**\\n\\n' || x || ' again' FROM e WHERE i % 2 = 1) """ + chunks_sql("text", "path", "''", "o", "part", "u"))
def chk_tab_units(spark, d):
    """Each block a part, split at tabs: parts are numbered by path, and one within a tab repeats its label."""
    return chunked(tabbed(spark, d), chunking.Settings(0, 1, True))


@register("chk_short_runs", f"""WITH {PLAIN}, u AS (SELECT CAST(doc_id AS VARCHAR) AS url, l, unnest(range(greatest(1, len(l) // 2))) AS j FROM pl),
v AS (SELECT url, j, CASE WHEN len(l) = 1 THEN 'Top' ELSE 'Top > Tab: T' || (2 * j + 1) END AS path, CASE WHEN len(l) = 1 THEN l[1] ELSE l[2 * j + 1] || E'\\n\\n**Tab: T' || (2 * j + 1) || E'**\\n\\n' || l[2 * j + 2]
  || E'\\n\\n' || l[2 * j + 2] || ' again' || CASE WHEN len(l) = 2 * j + 3 THEN E'\\n\\n' || l[2 * j + 3] ELSE '' END END AS text FROM u) """ + chunks_sql("text", "path", "''", "j", "0", "v"))
def chk_short_runs(spark, d):
    """What stands outside of tabs is too short to be alone: it goes to the tab behind it, at the end to the one before."""
    return chunked(tabbed(spark, d), chunking.Settings(0, WHOLE, True))


@register("src_ordered_links", rf"""WITH x AS (SELECT url, page_id AS pos, 'Page ' || page_id AS title FROM pages UNION ALL SELECT url, page_id + 1000000000, 'again' FROM pages),
f AS (SELECT url, min(pos) AS pos, arg_min(title, pos) AS title FROM x GROUP BY url),
e AS (SELECT *, lower(regexp_extract(regexp_extract({PATH}, '[^/]*$'), '\.[^.]*$')) AS x FROM f)
SELECT url, pos, title, CASE WHEN x = '.md' THEN url WHEN x = '' THEN regexp_replace(url, '/+$', '') || '.md' END AS md_url FROM e""")
def src_ordered_links(spark, d):
    """A page list that names each page twice."""
    rows = A.table(spark, d, "pages").select(F.col("page_id").alias("pos"), text_of("Page ", F.col("page_id")).alias("title"), "url")
    return source.ordered_links(rows.unionByName(rows.select((F.col("pos") + 1000000000).alias("pos"), F.lit("again").alias("title"), "url")))


@register("src_parsed_pages", """SELECT CASE doc_id % 3 WHEN 0 THEN 'https://c.example/' || doc_id ELSE 'https://l.example/' || doc_id END AS url, sha256(text) AS outcome
FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'https://l.example/' || doc_id, 'failed' FROM documents WHERE doc_id % 10 = 0""")
def src_parsed_pages(spark, d):
    """Fetched pages: the URL is the page's own, if its front matter has one that isn't empty, else the link; failures apart."""
    own = F.when(F.col("doc_id") % 3 == 0, text_of("url: https://c.example/", F.col("doc_id"), "\n")).when(F.col("doc_id") % 3 == 1, "url: \n").otherwise("")
    failed = F.col("doc_id") % 10 == 0
    raw = F.when(~failed, F.concat(F.lit("---\ntitle: x\n"), own, F.lit("---\n"), F.col("text")))
    fetched = A.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), text_of("https://l.example/", F.col("doc_id")).alias("link_url"), F.lit("").alias("md_url"), raw.alias("raw"), F.when(failed, "failed").alias("error"))
    pages, failures = source.parsed(fetched)
    return pages.select("url", F.sha2("body", 256).alias("outcome")).unionByName(failures.select("url", F.col("error").alias("outcome")))


@register("st_integers", """SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN CAST('1' || doc_id AS INTEGER) WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN CAST(-doc_id AS INTEGER) ELSE CAST(doc_id AS INTEGER) END AS n FROM documents""")
def st_integers(spark, d):
    n = F.col("doc_id")
    return A.table(spark, d, "documents").select("doc_id", T.try_int(by_number(n, 6, text_of(" ", n, " "), text_of("+", n), text_of("1_", n), text_of(n, "x"), F.lit(""), text_of("-", n))).alias("n"))


ALTERED = "' altered'"


@register("st_sync", rf"""WITH {PLAIN}, s AS (SELECT doc_id, array_to_string(l, chr(10)) AS t, doc_id % 5 = 0 AS own, doc_id % 7 = 0 AS altered, doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 <> 0) AS untouched FROM pl WHERE doc_id % 13 <> 0),
k AS (SELECT *, CASE WHEN untouched AND altered THEN t || {ALTERED} ELSE t END AS body, E'---\ntitle: Page ' || doc_id || E'\nword_count: 1_' || doc_id || CASE WHEN own THEN E'\nversion_hash: v1' ELSE '' END || E'\n---\n' AS head FROM s)
SELECT 'u' || doc_id AS url, 'Page ' || doc_id AS title, CAST('1' || doc_id AS INTEGER) AS word_count, CASE WHEN own THEN 'v1' ELSE 'sha256:' || sha256(head || body) END AS version_hash, untouched, 0 AS ord, 'Page ' || doc_id AS path,
CAST(greatest(1, length(body) // 4) AS INTEGER) AS tokens, sha256(body) AS content_hash FROM k""")
def st_sync(spark, d):
    """A store after two syncs: pages are added, altered, left alone (the version is theirs, or the content's hash) and removed."""
    n, text = F.col("doc_id"), F.array_join("lines", "\n")
    head = F.concat(text_of("---\ntitle: Page ", n, "\nword_count: 1_", n), F.when(n % 5 == 0, "\nversion_hash: v1").otherwise(""), F.lit("\n---\n"))

    def fetched(rows, body):
        return rows.select(n.alias("pos"), text_of("u", n).alias("link_url"), text_of("u", n, ".md").alias("md_url"), F.concat(head, body).alias("raw"), F.lit(None).cast("string").alias("error"))

    docs = A.plain_lines(spark, d)
    store, settings = Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}"), chunking.Settings(WHOLE)
    store.sync(fetched(docs.where(n % 11 != 0), F.when(n % 7 == 0, F.concat(text, F.expr(ALTERED))).otherwise(text)), settings)
    before = cut(store.table("pages").select("url", F.col("fetched_at").alias("_at")), "before")
    store.sync(fetched(docs.where(n % 13 != 0), text), settings)
    pages = store.table("pages").join(before, "url", "left").withColumn("untouched", F.coalesce(F.col("fetched_at") == F.col("_at"), F.lit(False)))
    return pages.join(store.table("chunks"), "url").select("url", "title", "word_count", "version_hash", "untouched", "ord", F.array_join("heading_path", " > ").alias("path"), "tokens", "content_hash")


@register("vec_embedded_text", r"SELECT doc_id, sha256(text) AS plain, sha256(lang || ' > ' || source || E'\n\n' || text) AS with_path FROM documents")
def vec_embedded_text(spark, d):
    path = F.array("lang", "source")
    return A.table(spark, d, "documents").select("doc_id", *(F.sha2(vector.embedded_text(path, F.col("text"), w), 256).alias(name) for name, w in (("plain", False), ("with_path", True))))


@register("vec_cache", """WITH t AS (SELECT sha256(text) AS text_hash, min(doc_id) AS d, length(any_value(text)) AS n FROM documents GROUP BY 1)
SELECT CASE WHEN d % 3 = 1 THEN 'other' ELSE 'm' END AS model, text_hash, CASE WHEN d % 3 = 2 THEN CAST(n AS DOUBLE) ELSE -1 END AS first FROM t UNION ALL SELECT 'm', text_hash, CAST(n AS DOUBLE) FROM t WHERE d % 3 = 1""")
def vec_cache(spark, d):
    """A cache that has a third of the texts under the model, a third under another one; only what the model lacks is encoded."""
    docs = A.table(spark, d, "documents")
    known = docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("d")).where("d % 3 <> 2")
    cache = known.select(F.when(F.col("d") % 3 == 1, "other").otherwise("m").alias("model"), "text_hash", F.array(F.lit(-1.0).cast("float")).alias("vector"))
    encode = lambda batches: (b.map(lambda t: [float(len(t))]) for b in batches)
    return vector.refresh_vectors(cache, docs, "m", encode).select("model", "text_hash", F.col("vector")[0].cast("double").alias("first"))


def seed(spark, d):
    n = F.col("item_id")
    of = lambda *xs: by_number(n, 3, *(F.lit(x) for x in xs))
    return A.table(spark, d, "benchmark").select("item_id", text_of(of("a", "b", "z"), n).alias("id"), F.col("text").alias("question"), text_of("https://x.example/", n).alias("url"), text_of("About `eth_call` ", n).alias("heading"), of("how", "why", "what").alias("style"), F.substring("text", 1, 5).alias("evidence"))


@register("vf_question_rows", """SELECT ['a', 'b', 'z'][item_id % 3 + 1] || item_id AS id, text AS question, 'https://x.example/' || item_id AS expected_url, 'About `eth_call` ' || item_id AS expected_section, 'https://x.example/' || item_id || '#about-eth_call-' || item_id AS expected_anchor,
['how', 'why', 'what'][item_id % 3 + 1] AS style, ['Area A', 'Area B', NULL][item_id % 3 + 1] AS area, substr(text, 1, 5) AS evidence, 'seed' AS origin, CASE WHEN item_id % 4 = 0 THEN 'fourth' ELSE '' END AS "group", item_id % 5 <> 0 AS verified FROM benchmark""")
def vf_question_rows(spark, d):
    rows = seed(spark, d)
    groups = rows.where("item_id % 4 = 0").select("id", F.lit("fourth").alias("group"))
    problems = rows.select("id", F.when(F.col("item_id") % 5 == 0, "page missing").otherwise("").alias("problem"))
    return runs.question_rows(rows, groups, {"a": "Area A", "b": "Area B"}, problems)


@register("vf_unknown_ids", "SELECT 'q' || item_id AS id FROM benchmark WHERE item_id % 4 = 0")
def vf_unknown_ids(spark, d):
    """Groups that name questions which aren't there."""
    rows = seed(spark, d)
    groups = rows.select(F.when(F.col("item_id") % 4 == 0, text_of("q", F.col("item_id"))).otherwise(F.col("id")).alias("id"), F.lit("g").alias("group"))
    return stats.unknown_ids(groups, rows)


@register("src_fetch", """SELECT item_id AS pos, 'https://l.example/' || item_id AS link_url, CASE WHEN item_id % 10 <> 0 THEN text END AS raw, item_id % 10 = 0 AS failed FROM benchmark""")
def src_fetch(spark, d):
    """Pages by the page source, a row a link, from URLs that hold their content; every tenth can't be read, which is a row too.

    Links are a driver's list, here one of the benchmark's items.
    """
    where = F.when(F.col("item_id") % 10 == 0, "data:broken").otherwise(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8"))))
    links = A.table(spark, d, "benchmark").select("item_id", text_of("https://l.example/", F.col("item_id")), where).collect()
    return source.fetch(spark, [tuple(r) for r in links]).select("pos", "link_url", "raw", F.col("error").isNotNull().alias("failed"))


@register("src_questions", """WITH q AS (SELECT item_id, 'q' || item_id AS id, text AS question, 'https://x.example/' || item_id AS expected_url, 'A "quoted", heading' AS expected_section, item_id % 2 = 0 AS verified FROM benchmark)
SELECT id, question, expected_url, expected_section, CASE WHEN item_id % 3 = 0 THEN text END AS evidence, verified, kind FROM q JOIN benchmark USING (item_id), (VALUES ('jsonl'), ('csv')) k(kind)""")
def src_questions(spark, d):
    """Questions written as JSON lines and as CSV, and read back from either."""
    n, folder = F.col("item_id"), f"{shared_root(spark)}/questions-{uuid.uuid4().hex}"
    rows = A.table(spark, d, "benchmark").select(text_of("q", n).alias("id"), F.col("text").alias("question"), text_of("https://x.example/", n).alias("expected_url"), F.lit('A "quoted", heading').alias("expected_section"), F.when(n % 3 == 0, F.col("text")).alias("evidence"), (n % 2 == 0).alias("verified"))
    runs.write_questions(rows, folder)
    tables = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/csv")
    both = runs.load_questions(spark, f"{folder}/jsonl").select(*rows.columns).withColumn("kind", F.lit("jsonl"))
    return both.unionByName(tables.withColumn("kind", F.lit("csv")))


@register("kw_postings", f"""WITH w AS (SELECT doc_id, {TERMS.format("text")} AS w FROM documents), t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
p AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM t GROUP BY doc_id, term UNION ALL SELECT doc_id, len(w), '', NULL FROM w)
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(dl) AS BIGINT) AS dl FROM p GROUP BY term""")
def kw_postings(spark, d):
    """The index's terms with their documents, occurrences and the lengths of those documents; the empty term stands for all."""
    rows = keyword.postings(A.table(spark, d, "documents"), ["doc_id"], ["text"])
    return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("term") != "", F.col("tf"))).cast("long").alias("tf"), F.sum("dl").cast("long").alias("dl"))


@register("st_rechunk", f"WITH {PLAIN} SELECT *, false AS recorded FROM (" + chunks_sql(r"'## Part ' || i || E'\n\n' || x", "'Page > Part ' || i", "'part-' || i") + ") WHERE CAST(url AS BIGINT) % 10 <> 0")
def st_rechunk(spark, d):
    """Chunks made anew from stored pages under other settings, after a sync that didn't record its own, as every tenth page failed."""
    pages = A.generated(spark, d, lambda x, i: text_of("## Part ", i, "\n\n", x), "---\ntitle: Page\n---\n")
    failed = F.col("url").cast("long") % 10 == 0
    fetched = pages.select(F.col("url").cast("long").alias("pos"), F.col("url").alias("link_url"), F.col("url").alias("md_url"), F.when(~failed, F.col("body")).alias("raw"), F.when(failed, "failed").alias("error"))
    store = Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}")
    store.sync(fetched, chunking.Settings(1 << 20))
    recorded = store.meta("signature") is not None
    store.rechunk(chunking.Settings(WHOLE))
    store.check_settings(chunking.Settings(WHOLE))
    rows = store.table("chunks").select("url", "ord", F.array_join("heading_path", " > ").alias("path"), "anchor", "part", "tokens", "content_hash")
    return rows.withColumn("recorded", F.lit(recorded))
