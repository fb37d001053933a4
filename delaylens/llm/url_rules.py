"""Block and allow rules for URLs, carried over redirects and canonical links to their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.components import components
from delaylens.llm.tables import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
CANONICAL = r"(?is)<link\b(?=[^>]*\srel\s*=\s*[\"']?canonical\b)[^>]*\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the scheme; empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the URL is null or has no ``://``."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query string with its ``?``, empty where there is none."""
    return F.regexp_replace(F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1), r"^\?$", "")


def without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved; ``..`` at the top stays at the top."""

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    # A last segment of dots names a folder, so a slash stays at the end.
    parts = F.split(F.concat(F.substring(path, 2, F.length(path)), F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/", -1)
    joined = F.array_join(F.aggregate(parts, F.array(F.lit("")), step), "/")
    resolved = F.when(joined == "", "/").otherwise(joined)
    return F.when(path.rlike(r"^/(.*/)?\.\.?(/|$)"), resolved).otherwise(path)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its length, host and path joined, and verdict.

    Rules are a list in memory, at most some hundreds. Of equally long ones allow comes first.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _targets(html: Column, host: Column, path: Column, query: Column) -> Column:
    """The canonical and refresh targets of a page, made absolute, as names of pages."""
    links = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    folder = F.regexp_extract(path, r"^(.*/)?", 1)

    def key(raw: Column) -> Column:
        link = F.replace(raw, F.lit("&amp;"), F.lit("&"))
        full = (
            F.when(F.instr(link, "://") > 0, link)
            .when(link.startswith("//"), F.concat(F.lit("x:"), link))
            .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
            .when(link.startswith("?"), F.concat(F.lit("x://"), host, path, link))
            .when(link.startswith("#"), F.concat(F.lit("x://"), host, path, query))
            .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), link))
        )
        return node(*host_and_path(full), query_of(full))

    return F.transform(links, key)


def node(host: Column, path: Column, query: Column) -> Column:
    """A page's name among aliases: its query string tells pages apart, scheme and fragment don't."""
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), query)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of.

    A rule decides the pages it fits. Pages that no rule fits are blocked if an alias, that is a
    page reached over canonical and redirect links in either direction, is blocked by a rule,
    and allowed otherwise; an explicit allow always stands. Aliases are told apart by host, path with dots
    resolved, and query string; rules see host and path only. ``alias_of`` is the smallest alias.
    Null URLs and URLs without ``://`` have empty host and path, fit no rule and have no
    aliases. Null pages have no links. Repeated rows each give a row; an empty table an empty result.
    """
    url, html = pages["url"].cast("string"), pages["html"].cast("string")
    host, path = host_and_path(url)
    named = pages.select(
        pages["page_id"].alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(query_of(url), F.lit("")).alias("query"), html.alias("html"),
    )
    h, p, q = F.col("host"), F.col("path"), F.col("query")
    targets = F.when(F.lower("html").rlike("canonical|refresh"), _targets(F.col("html"), h, p, q))
    links = stored(
        named.where(h != "").select(node(h, p, q).alias("a"), F.explode(targets).alias("b")).where("a != b AND b NOT LIKE '/%'").distinct(),
        "url-links",
    )
    groups = components(links)
    parts = F.regexp_extract("node", r"^[^/]*", 0), F.regexp_extract("node", r"^[^/]*([^?]*)", 1)
    rule = rule_of(*parts, rules)
    blocked = groups.groupBy("component").agg(F.coalesce(F.max(~rule["allow"]), F.lit(False)).alias("blocked"))
    aliases = groups.join(blocked, "component").select("node", "component", "blocked")
    own = rule_of(h, p, rules)
    judged = named.select("page_id", "host", "path", own.alias("own"), F.when(h != "", node(h, p, q)).alias("node"))
    return judged.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.when(F.coalesce(F.col("own.allow"), ~F.coalesce("blocked", F.lit(False))), "allow").otherwise("block").alias("verdict"),
        F.coalesce("component", "node").alias("alias_of"),
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("alias_of")


SQL = {
    # States the rules; pages without links take the default. Alias groups are tested by brute force.
    "op8_url_rules": """
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut),
        rules(verdict, h, p) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT n.page_id, n.host, n.path, r.h || r.p AS rule, r.verdict,
                row_number() OVER (PARTITION BY n.page_id, n.host, n.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
            FROM named n LEFT JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1"""
}
QUERIES = {"op8_url_rules": op8_url_rules}
