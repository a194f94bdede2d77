"""URL filter with redirect equivalence.

A URL has a host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and a path (from there up to ``?``, ``#`` or
the end). A rule (host, path, verdict) fits the URLs of its host and of all subdomains whose path starts with the rule's; the longest
rule wins, and allow before block among equally long ones. What no rule decides is decided by redirect equivalence: URLs of one
host and path are one node, redirects and canonical links join nodes, and a connected component that holds a node that a rule blocks is
blocked; else it is allowed. A rule that allows a node takes precedence over its component's block; it doesn't unblock others.

Edges come from the pages themselves (``page_edges``: all canonical links and refreshing redirects in the HTML, with attributes in any order and quoting; relative links are resolved
against the page's URL) or from any table of (source URL, target URL). Nodes are pairs of host and path, so nothing collides. Components are found by
distributed rounds; only blocked nodes that no rule decides (a narrow table) are joined with the pages, by node.

Small rule sets (up to ``RULES_INLINE``) become one CASE expression; larger ones are joined on every suffix of the host.

Nulls and edges: a null URL or one without ``://`` has an empty host and path, fits no rule and is no node: it is allowed. Repeated pages
are judged one by one. Rules of an empty host fit nothing. Extra columns play no role, except that ``judge`` returns the columns asked for.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import arrow_rows, give_back, materialise
from terrane.llm.components import components

RULES_INLINE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
#: The forms that the SQL knows; ``targets`` reads all.
CANONICAL = r"""(?i)<link\s[^>]*rel=["']?canonical["']?[^>]*href=["']?([^"'>\s]+)"""
REFRESH = r"""(?i)<meta\s[^>]*http-equiv=["']?refresh["']?[^>]*content=["']?[^"'>]*url=([^"'>\s]+)"""
TAG = r"<(?:link|meta)[\s/]"
_TAG = re.compile(r"<(link|meta)(?=[\s/])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TIMED = re.compile(r"\s*[0-9.]+\s*(?:[;,]\s*|(?<=\s))(?:url\s*=\s*)?(.*)", re.I | re.S)
_URL = re.compile(r"url\s*=\s*(.*)", re.I | re.S)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", False),
    Rule("example.com", "/en/7", True),
    Rule("net", "/de/", True),
    Rule("example.net", "/de/8", False),
    Rule("org", "/es/", False),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched(nodes: DataFrame, rules) -> DataFrame:
    """nodes (host, path, ...) with rule string and rule_allow boolean, both null where no rule fits."""
    if not isinstance(rules, DataFrame):
        if len(rules) > RULES_INLINE:
            rules = nodes.sparkSession.createDataFrame([(r.host, r.path, r.allow) for r in rules], "host string, path string, allow boolean")
        else:
            rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
            for r in sorted((r for r in rules if r.host), key=lambda r: (len(r.text), r.allow, r.text)):  # the last that fits wins
                fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
                rule, allow = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allow)
            return nodes.withColumns({"rule": rule, "rule_allow": allow})
    own = rules.where("host <> ''").select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("allow").alias("__a"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = nodes.where("host <> ''").select("host", "path").distinct()
    found = distinct.withColumn("__h", F.explode(suffixes)).join(own, "__h").where(F.col("path").startswith(F.col("__p")))
    best = F.max(F.struct((F.length("__h") + F.length("__p")).alias("n"), F.col("__a").alias("a"), F.concat("__h", "__p").alias("r")))
    found = found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.r").alias("rule"), F.col("b.a").alias("rule_allow"))
    return nodes.join(found, ["host", "path"], "left")


def tags(text: str):
    """(name, attributes) of link and meta tags; of equal attributes the first counts. Each character is read once."""
    at = 0
    while m := _TAG.search(text, at):
        at, found = m.end(), {}
        while at < len(text) and text[at] != ">":
            a = _ATTRIBUTE.match(text, at)
            if a is None:
                at += 1
                continue
            value = a[2] if a[2] is not None else a[3] if a[3] is not None else (a[4] or "").strip("\"'")
            found.setdefault(a[1].lower(), markup.unescape(value))
            at = a.end()
        yield m[1].lower(), found


def refreshed(content: str) -> str:
    """URL of a refreshing redirect's content: after the seconds, with or without url= and quotes."""
    m = _TIMED.match(content) or _URL.search(content)
    rest = m[1].strip() if m else ""
    if rest[:1] in ("'", '"'):
        return rest[1:].split(rest[0], 1)[0].strip()
    return re.split(r"[\s\"'>]", rest, maxsplit=1)[0]


def targets(text: str) -> list[str]:
    """Different targets of canonical links and refreshing redirects, in order."""
    out = {}
    for name, found in tags(text):
        to = ""
        if name == "link" and "canonical" in (x.rstrip("/") for x in found.get("rel", "").lower().split()):
            to = found.get("href", "")
        elif name == "meta" and found.get("http-equiv", "").strip().rstrip("/").lower() == "refresh":
            to = refreshed(found.get("content", ""))
        if to := re.sub(r"[\t\r\n]", "", to.strip()):
            out[to] = None
    return list(out)


def resolved(to: str, host: str, path: str) -> str:
    """A target as an absolute URL, seen from a page of the host and path."""
    if _SCHEME.match(to):
        return to
    if to.startswith("//"):
        return f"http:{to}"
    to = re.split(r"[?#]", to, maxsplit=1)[0]
    if not to:
        return f"http://{host}{path}"
    whole = to if to.startswith("/") else (path.rpartition("/")[0] or "") + "/" + to
    kept = []
    parts = whole.split("/")[1:]
    for i, x in enumerate(parts):
        if x == "..":
            del kept[-1:]
        elif x != ".":
            kept.append(x)
        if x in (".", "..") and i == len(parts) - 1:
            kept.append("")
    return f"http://{host}/" + "/".join(kept)


def page_edges(pages: DataFrame) -> DataFrame:
    """(host, path, to_host, to_path) of canonical links and refreshing redirects in the pages' HTML."""
    arrow_rows(pages.sparkSession)

    def read(batches):
        for b in batches:
            hosts, paths, found = [], [], []
            for host, path, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for t in targets(text):
                    hosts.append(host)
                    paths.append(path)
                    found.append(resolved(t, host, path))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (hosts, paths, found)], ["host", "path", "__to"])
        give_back()

    linked = pages.where(F.col("html").rlike(f"(?i){TAG}")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    linked = linked.where("host <> ''").mapInArrow(read, "host string, path string, __to string")
    return linked.select("host", "path", host_of(F.col("__to")).alias("to_host"), path_of(F.col("__to")).alias("to_path"))


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(host, path) of nodes in components that hold a node blocked by a rule. edges: host, path, to_host, to_path."""
    node = lambda h, p: F.struct(F.col(h).alias("host"), F.col(p).alias("path"))
    edges = edges.where("host <> '' AND to_host <> ''").select(node("host", "path").alias("u"), node("to_host", "to_path").alias("v"))
    found = components(edges).select("node.host", "node.path", "root")
    found = materialise(matched(found, rules), "nodes")
    bad = found.where("NOT rule_allow").select("root").distinct()
    return found.join(bad, "root", "left_semi").select("host", "path")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` of pages with host, path, rule and verdict ('allow' or 'block')."""
    links = materialise(page_edges(pages) if edges is None else edges, "redirects")
    judged = matched(pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if links.isEmpty():
        reached = F.lit(False)
    else:
        aliases = blocked_aliases(links, rules).withColumn("__blocked", F.lit(True))
        judged = judged.join(aliases, ["host", "path"], "left")
        reached = F.coalesce("__blocked", F.lit(False))
    allow = F.coalesce("rule_allow", ~reached)
    return judged.select(*keep, "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"))


ORACLE = rf"""
WITH RECURSIVE rules(rh, rp, allow) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in RULES)}),
parts AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
targets AS (
  SELECT host, path, unnest([regexp_extract(html, '{CANONICAL.replace("'", "''")}', 1), regexp_extract(html, '{REFRESH.replace("'", "''")}', 1)]) AS t FROM parts WHERE html IS NOT NULL),
resolved AS (
  SELECT host, path, CASE WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t ELSE t END AS t FROM targets WHERE t <> ''),
edges AS (
  SELECT host, path,
    CASE WHEN strpos(t, '://') > 0 THEN translate(regexp_extract(substr(t, strpos(t, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS to_host,
    CASE WHEN strpos(t, '://') > 0 THEN regexp_extract(substr(t, strpos(t, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS to_path
  FROM resolved),
both_ways AS (
  SELECT * FROM edges WHERE host <> '' AND to_host <> '' UNION SELECT to_host, to_path, host, path FROM edges WHERE host <> '' AND to_host <> ''),
nodes AS (SELECT host, path FROM parts UNION SELECT host, path FROM both_ways),
fitting AS (
  SELECT host, path, rh || rp AS rule, allow, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, allow DESC) AS k
  FROM nodes JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)),
best AS (SELECT host, path, rule, allow FROM fitting WHERE k = 1),
reached(host, path) AS (
  SELECT host, path FROM best WHERE NOT allow
  UNION
  SELECT b.to_host, b.to_path FROM reached r JOIN both_ways b ON b.host = r.host AND b.path = r.path)
SELECT p.page_id, p.host, p.path, b.rule,
  CASE WHEN coalesce(b.allow, r.host IS NULL) THEN 'allow' ELSE 'block' END AS verdict
FROM parts p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN reached r ON r.host = p.host AND r.path = p.path
"""
