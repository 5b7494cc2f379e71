"""URL verdicts: rules by host and path, and blocks that follow redirects and canonical links: DataFrame operations only.

Nodes are whole URLs but for scheme and fragment, so that pages told apart by their query stay apart; rules see host and
path. Edges come from pages' own markup (canonical links and refreshes) and from an optional table of redirects. An
explicit rule always holds for its own URL; another URL takes allow if its component holds an explicitly allowed URL, else
block if it holds a blocked one, else allow.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii
from quarry.llm.graph import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values of its contract).
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query of a URL as one string; empty without host."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.when(host_of(url) == "", "").otherwise(F.concat(host_of(url), rest))


def _node_host(node: Column) -> Column:
    return F.regexp_extract(node, r"(?s)^([^/?]*)", 1)


def _node_path(node: Column) -> Column:
    return F.regexp_extract(node, r"(?s)^[^/?]*([^?]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule's struct (rule, verdict), or null; of two as long, allow goes first.

    The rules are a list of the caller, tested one after another in the generated code.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


_TAG = r"(?is)<{0}\s[^>]*?\b{1}\s*=\s*[\"']?\s*{2}\b[^>]*>"
_CANONICAL = _TAG.format("link", "rel", "canonical")
_REFRESH = _TAG.format("meta", "http-equiv", "refresh")


def _resolved(node: Column, target: Column) -> Column:
    """The node of a link's target, which may be whole, without scheme, from the root, beside the page or a query alone."""
    bare = F.regexp_extract(target, r"(?s)^([^#]*)", 1)
    host, path = _node_host(node), _node_path(node)
    beside = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    return (
        F.when(target.contains("://"), node_of(target)).when(target.startswith("//"), node_of(F.concat(F.lit("x:"), target)))
        .when(target.startswith("/"), F.concat(host, bare)).when(target.startswith("?"), F.concat(host, path, bare)).otherwise(F.concat(host, beside, bare))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes, from canonical links and refreshes in pages; pages without any give none. Dots in a relative path
    aren't resolved; a link to a fragment of the page itself is none."""
    markup = F.coalesce(F.col(html), F.lit(""))
    canonical = F.regexp_extract(F.regexp_extract(markup, _CANONICAL, 0), r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(markup, _REFRESH, 0), r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    hinted = pages.filter(F.col(html).rlike(r"(?i)canonical|http-equiv"))
    found = hinted.select(node_of(F.col(url)).alias("src"), F.explode(F.array(canonical, refresh)).alias("target"))
    found = found.filter("src <> '' AND target <> '' AND NOT startswith(target, '#')")
    return found.select("src", _resolved(F.col("src"), F.col("target")).alias("dst")).filter("dst <> ''")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (page_id, url, html).

    redirects (from_url, to_url) adds edges. A null URL, or one without ://, has empty host and path, fits no rule and
    is allowed. Repeated pages are judged alike; null ids stay; other columns aren't read; an empty table gives no rows.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))).toDF("src", "dst").filter("src <> '' AND dst <> ''"))
    member = components(edges, "src", "dst")
    own = best_rule(_node_host(F.col("node")), _node_path(F.col("node")), rules)["verdict"]
    groups = member.groupBy("component").agg(F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked"))
    aliases = member.join(groups.filter("blocked AND NOT coalesce(allowed, false)"), "component", "left_semi").select(F.col("node").alias("alias"), F.lit("block").alias("from_alias"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = urls.join(aliases, F.col("node") == F.col("alias"), "left")
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.col("from_alias"), F.lit("allow")).alias("verdict"))


def _sql() -> str:
    """DuckDB SQL, with a recursive walk over links of all kinds."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

    def host(url: str) -> str:
        return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def node(url: str) -> str:
        return f"CASE WHEN {host(url)} = '' THEN '' ELSE {host(url)} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"

    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
cut AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
urls AS (
  SELECT page_id, html, {host("url")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {node("url")} AS node FROM cut),
targets AS (
  SELECT node, host, path, regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*?\brel\s*=\s*["'']?\s*canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS target FROM urls
  UNION ALL SELECT node, host, path, regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*?\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM urls),
edges AS (
  SELECT node AS a, CASE WHEN target LIKE '%://%' THEN {node("target")} WHEN starts_with(target, '//') THEN {node("('x:' || target)")}
    WHEN starts_with(target, '/') THEN host || bare WHEN starts_with(target, '?') THEN host || path || bare
    ELSE host || CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || bare END AS b
  FROM (SELECT *, regexp_extract(target, '(?s)^([^#]*)', 1) AS bare FROM targets) WHERE target <> '' AND NOT starts_with(target, '#') AND node <> ''),
both_ways AS (SELECT a, b FROM edges WHERE b <> '' UNION SELECT b, a FROM edges WHERE b <> ''),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
places AS (SELECT node, regexp_extract(node, '(?s)^([^/?]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?]*([^?]*)', 1) AS path FROM (SELECT node FROM urls UNION SELECT b FROM reach)),
fits AS (
  SELECT u.node, r.host || r.path AS rule, r.verdict FROM places u JOIN rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
best AS (SELECT node, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY node),
heard AS (SELECT r.a, bool_or(b.verdict = 'allow') AS allowed, bool_or(b.verdict = 'block') AS blocked FROM reach r JOIN best b ON r.b = b.node GROUP BY r.a)
SELECT u.page_id, u.host, u.path, b.rule,
  coalesce(b.verdict, CASE WHEN h.blocked AND NOT h.allowed THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.node = b.node LEFT JOIN heard h ON h.a = u.node
"""


SQL = _sql()
