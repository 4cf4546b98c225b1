"""URL filters: rules and listed URLs behind a blocked Bloom filter and an exact hash join, in DataFrame functions only.

Both kinds of entry are keys: a rule is its host and path as one string, a listed URL its canonical form. A page's keys are every
suffix of its host with every path prefix of a length that rules have, and its own canonical URL. A key's hash picks one block
of eight 64-bit words and one bit in each; the filter is a table of blocks, at most FILTER_BLOCKS, which is broadcast. Keys that
pass are joined exactly, so false positives go. Verdicts are found for each different URL, not for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import hot_keys, join_hot, small_side

WORDS, BITS_PER_KEY, FILTER_BLOCKS = 8, 16, 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def rest_of(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def decoded(text: Column) -> Column:
    """Percent-encoded letters, digits, `-`, `.`, `_` and `~` as they are, other codes in capitals."""
    parts = F.split(text, "%")

    def one(p: Column) -> Column:
        code = F.substring(p, 1, 2)
        letter = F.char(F.conv(code, 16, 10).cast("int"))
        shown = F.when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(shown, F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))


def canonical(url: Column) -> Column:
    """Host without user, default port and `www.`; path decoded and without closing slashes; query decoded, its parts sorted and
    without those for tracking; no scheme and no fragment."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":(80|443)?$", ""), r"^www\.", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(decoded(query), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, F.regexp_replace(decoded(path_of(url)), "/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def places(blocks: int) -> list[Column]:
    """Of `key`: its block, and its bit in each word of it."""
    bit = "shiftleft(1L, cast(pmod(xxhash64({}, xxhash64(key)), 64) as int)) as m{}"
    return [F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(F.expr(bit.format(i, i)) for i in range(WORDS))]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(the filter's blocks, how many there can be) for n keys."""
    blocks = max(1, min(FILTER_BLOCKS, -(-n * BITS_PER_KEY // (64 * WORDS))))
    return keys.select(*places(blocks)).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def may_hold(keys: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Rows of keys(key, ...) that the filter may hold."""
    probed = keys.select("*", *places(n)).join(F.broadcast(blocks), "block")
    held = F.lit(True)
    for i in range(WORDS):
        held = held & (F.col(f"m{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"m{i}"))
    return probed.where(held).select(*keys.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url).

    rules(host, path, verdict): fits its host and all subdomains where the page's path starts with the rule's; the longest rule
    (host and path, then host, then the text) wins. listed(url): blocked where no rule fits, compared in canonical form. All other
    pages are allowed. A null URL, or one without `://`, has an empty host and path and is allowed. Null rules and URLs in the
    lists are ignored, repeated ones count once; a rule given with two verdicts blocks. Repeated rows stay; a URL that a large
    part of all rows has, or none, isn't shuffled to one task. A URL of any length is read whole. Other columns are ignored.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("size"), F.max(F.length("host")).alias("host_size"))
    lengths = [r.size for r in rules.select("size").distinct().collect()]  # as many as rules have path lengths
    listed = listed.where("url is not null").select(F.concat(F.lit("="), canonical(F.col("url"))).alias("key")).where("key <> '='").distinct()
    entries = rules.select("key", "verdict", F.col("key").alias("rule"), "host_size").unionByName(listed.select("key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_size")))
    blocks, n = bloom(entries, entries.count())

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.filter(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(lengths))), lambda p: p.isNotNull())) if lengths else F.array().cast("array<string>")
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    keys = rows.where("host <> ''").select("url", F.explode(F.concat(found, F.array(F.concat(F.lit("="), canonical(F.col("url")))))).alias("key"))
    hits = may_hold(keys, blocks, n).join(small_side(entries, 100), "key")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.col("rule").isNotNull(), F.length("key"), "host_size", "key"))
    verdicts = hits.groupBy("url").agg(best.alias("best"))
    hot = hot_keys(rows.groupBy("url").agg(F.count("*").alias("n")), "url", "n")
    return join_hot(rows, verdicts, "url", hot, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


# The production rules: fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Hosts whose pages make the production list.
LISTED_LABEL = "spam-farm"


def production(pages: DataFrame) -> DataFrame:
    """Pages judged by RULES and by the list of all URLs on hosts that have the label LISTED_LABEL."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    listed = pages.where(F.array_contains(F.split(host_of(F.col("url")), r"\."), LISTED_LABEL)).select("url")
    return judge(pages, rules, listed)
