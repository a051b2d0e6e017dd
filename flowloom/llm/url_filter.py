"""URL decisions shared by redirect equivalence. DataFrame functions only.

Rules ``(host, path, verdict)`` decide a URL directly. What no rule decides takes the
decision of its aliases: pages whose canonical link or immediate refresh leads to one
another form a connected component (distributed large-star / small-star), in which an
explicit allow outweighs any block, and a block outweighs silence. Without either the
verdict is allow.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule
and has no aliases; a null page has no links; equal URLs on several pages are one node;
link targets are decoded (decimal, hexadecimal and the common named references), cut at
their quotes and resolved against the page's URL, whatever their form; other schemes without
``//`` (mailto:, javascript:) lead nowhere; an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import components, stage

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# more rules than this belong in a joined table, not in one expression
MAX_RULES = 256

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
# what holds no tags, whatever it looks like; unclosed, it reaches to the end of the page
_NO_TAGS = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|\z)"
# attribute values with their quotes, so that a quoted one may hold what ends an unquoted one
_VALUE = r"""("[^"]*"|'[^']*'|["']?[^\s>"'][^\s>]*)"""
_CANONICAL = rf"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?(?<![\w-])href\s*=\s*{_VALUE}"""
_REFRESH = rf"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?(?<![\w-])content\s*=\s*{_VALUE}"""
# what a refresh leads to: its own quotes end it, or else the end of the value
_REFRESH_URL = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))"""
_REFERENCES = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&"))


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What equal documents share: host, path (``/`` if empty) and query; null without a host."""
    path = path_of(url)
    key = F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, _URL, 3))
    return F.when(host_of(url) != "", key)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


def _decoded(value: Column) -> Column:
    """``value`` without its quotes, character references decoded from left to right."""
    bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$|^["']""", "$2")
    names = "|".join(name for name, _ in _REFERENCES)
    # each part but the first had an ampersand before it
    parts = F.split(bare, "&")
    reference = rf"(?s)^(?:#([0-9]{{1,7}});?|#[xX]([0-9a-fA-F]{{1,6}});?|({names})(?:;|(?![A-Za-z0-9=])))(.*)$"

    def found(part: Column, group: int) -> Column:
        return F.regexp_extract(part, reference, group)

    def decoded(part: Column) -> Column:
        code = F.coalesce(F.when(found(part, 1) != "", found(part, 1).cast("int")), F.conv(F.when(found(part, 2) != "", found(part, 2)), 16, 10).cast("int"))
        named = F.lit(None).cast("string")
        for name, sign in _REFERENCES:
            named = F.when(found(part, 3) == name, F.lit(sign)).otherwise(named)
        # Spark's chr() knows one byte only: other characters are decoded from UTF-32
        sign = F.coalesce(named, F.when(code.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(sign.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(sign, found(part, 4)))

    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` parts taken away."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def _target(link: Column, url: Column) -> Column:
    """Absolute form of a link found on a page."""
    link = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    page = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    path, query = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(page, r"(?s)^(.*/)", 1)
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host_of(url) == ""), F.lit(None))
        .when(link.startswith("/"), F.concat(site, _without_dots(path), query))
        .when(path == "", F.concat(site, page, query))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), query))
    )


def page_links(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, node, targets`` from one read of the pages."""
    url = F.col("url")
    rows = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        node_of(url).alias("node"),
        F.regexp_replace("html", _NO_TAGS, " ").alias("_tags"),
        "url",
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "_tags"],
        F.regexp_extract("_tags", _CANONICAL, 1).alias("_canonical"),
        F.regexp_extract("_tags", _REFRESH, 1).alias("_refresh"),
    )
    rows = rows.withColumns({name: _decoded(F.col(name)) for name in ("_canonical", "_refresh")})
    rows = rows.withColumn("_refresh", F.concat(*(F.regexp_extract("_refresh", _REFRESH_URL, i) for i in (1, 2, 3))))
    targets = F.array_compact(F.array(*(node_of(_target(F.col(name), url)) for name in ("_canonical", "_refresh"))))
    rows = rows.withColumn("targets", targets)
    decided = rows.withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    return decided.select("page_id", "host", "path", "_r.rule", "_r.verdict", "node", "targets")


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``."""
    rows, _ = stage(page_links(pages, rules), "urls")
    edges = rows.where("node is not null").select(F.col("node").alias("a"), F.explode("targets").alias("b")).where("a <> b")
    groups, _ = stage(components(edges), "aliases")
    # a node is a URL without scheme, so its own rule can be read from it again
    as_url = F.concat(F.lit("x://"), F.col("node"))
    own = matching_rule(host_of(as_url), path_of(as_url), rules)["verdict"]
    spread, _ = stage(
        groups.groupBy("component").agg(
            F.max(F.coalesce(own == "allow", F.lit(False))).alias("allowed"),
            F.max(F.coalesce(own == "block", F.lit(False))).alias("blocked"),
        ),
        "decisions",
    )
    aliases = groups.join(spread, "component").select("node", (F.col("blocked") & ~F.col("allowed")).alias("spread_block"))
    verdict = F.coalesce("verdict", F.when(F.col("spread_block"), "block").otherwise("allow"))
    return rows.join(aliases, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
