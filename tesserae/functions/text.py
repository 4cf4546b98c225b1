"""Column builders for text: tokens, folding, URLs, lines and fences. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters that they are without them, by Unicode's decomposition."""
    marked = [c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(marked), "".join(unicodedata.normalize("NFKD", c)[0] for c in marked)


def fold(c: Column) -> Column:
    """Lower case, without accents on Latin letters and without combining marks."""
    return F.regexp_replace(F.translate(F.lower(c), *accent_table()), r"\p{Mn}", "")


def terms(c: Column) -> Column:
    """Runs of letters and digits of the folded text; an underscore divides words."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(c: Column) -> Column:
    """Different terms of a query in order of first use."""
    return F.array_distinct(terms(c))


def file_extension(path: Column) -> Column:
    """Lower-cased extension, with its dot, of a path's last segment; empty for folders."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def md_url(url: Column) -> Column:
    """Where a page's Markdown is: its own URL if it is Markdown, null for any other file type, else the URL with .md."""
    extension = file_extension(url_path(url))
    return F.when(extension == ".md", url).when(extension == "", F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".md")))


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def indent_of(line: Column) -> Column:
    """Leading spaces; tabs don't count."""
    return F.length(F.regexp_extract(line, "^ *", 0))


# Tags that are removed from prose, and the families of icon shortcodes.
TAGS = "a abbr b br button center code dd del details div dl dt em figcaption figure form h[1-6] hr i iframe img input ins kbd label li mark ol option p pre s section select small source span strong sub summary sup table tbody td textarea tfoot th thead tr u ul video".split()
ICONS = "octicons material fontawesome simple custom".split()
TAG_PATTERN = "(?i)</?(?:" + "|".join(TAGS) + r")(?:\s[^<>]*)?/?>"
ICON_PATTERN = ":(?:" + "|".join(ICONS) + r")-[A-Za-z0-9_-]+:"


def strip_prose(c: Column) -> Column:
    """One line of prose without comments, drawings, known tags and icon shortcodes; other angle brackets stay."""
    for pattern in ("<!--.*?-->", r"(?i)<svg\b.*?</svg>", TAG_PATTERN, ICON_PATTERN):
        c = F.regexp_replace(c, pattern, "")
    return c


def fence_spans(lines: Column) -> Column:
    """array<struct<first, last>>: the fenced code blocks of an array of lines, by the numbers of their first and last line.

    A fence opens with three or more backticks or tildes behind white space and closes with as many or more of the same and nothing
    after them; both lines belong to it, and an open one runs to the end. Only lines that begin like a fence are gone through.
    """
    pattern = r"(?U)^\s*(`{3,}|~{3,})"
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, pattern, 1).alias("mark"), F.regexp_replace(x, pattern, "").rlike(r"(?U)^\s*$").alias("bare")))
    none = F.array().cast("array<struct<first: int, last: int>>")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("since"), none.alias("spans"))

    def step(state: Column, row: Column) -> Column:
        opens = state["open"] == ""
        closes = ~opens & row["bare"] & (F.substring(row["mark"], 1, 1) == F.substring(state["open"], 1, 1)) & (F.length(row["mark"]) >= F.length(state["open"]))
        spans = F.when(closes, F.concat(state["spans"], F.array(F.struct(state["since"].alias("first"), row["i"].alias("last"))))).otherwise(state["spans"])
        return F.struct(F.when(opens, row["mark"]).when(closes, "").otherwise(state["open"]).alias("open"), F.when(opens, row["i"]).otherwise(state["since"]).alias("since"), spans.alias("spans"))

    end = F.size(lines) - 1
    return F.aggregate(F.filter(rows, lambda r: r["mark"] != ""), start, step, lambda s: F.when(s["open"] == "", s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(s["since"].alias("first"), end.alias("last"))))))


def fence_flags(lines: Column) -> Column:
    """For each line of an array, whether it belongs to a fenced code block (`fence_spans`)."""
    spans = F.transform(F.array(fence_spans(lines)), lambda s: F.transform(lines, lambda _, i: F.exists(s, lambda x: (x["first"] <= i) & (i <= x["last"]))))
    return F.element_at(spans, 1)


def prose(text: Column) -> Column:
    """Lines outside fences, each after a line end."""
    lines = F.split(text, "\n")
    kept = F.filter(F.arrays_zip(lines.alias("line"), fence_flags(lines).alias("code")), lambda x: ~x["code"])
    return F.concat(F.lit("\n"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def plain_heading(c: Column) -> Column:
    return trim(F.regexp_replace(c, "`([^`]*)`", "$1"))


def ascii_slug(c: Column) -> Column:
    """The anchor of a heading of ASCII and Latin letters; operators.chunking.slug covers all of Unicode."""
    text = F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*", "")
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9])", "")
    text = F.regexp_replace(F.translate(F.lower(text), *accent_table()), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(trim(text), r"[-\s]+", "-")


def try_int(c: Column) -> Column:
    """An integer as Python reads it, null for anything else."""
    return F.regexp_replace(trim(c), r"(?<=[0-9])_(?=[0-9])", "").try_cast("int")


def page_url(base: Column, doc_path: Column) -> Column:
    """A page's URL from its path in the docs: no .md, `index` is its folder, a closing slash."""
    path = F.regexp_replace(doc_path, r"\.md$", "")
    path = F.regexp_replace(path, r"(^|/)index$", "$1")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.when(path == "", "").otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text without overlap, in any case."""
    text, part = F.lower(text), F.lower(part)
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)
