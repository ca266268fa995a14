"""URL filters: rules on host and path, and their spread over redirects and canonical links.

A rule fits its host with all subdomains, where the path starts with the rule's; the longest fitting rule
decides. Pages that no rule fits take the decision of the pages they are aliases of: the aliases are the
connected components over redirect and canonical-link edges. A component with a blocked url is blocked, but
one with an explicitly allowed url is not, and a page with a rule of its own always keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import written
from plenum.llm.components import connected_components

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url="url"):
    """(host, path) columns: what stands after the first :// to / ? # or the end, lower-cased; then to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, decision) of rules like ("example.net/en/", "allow")."""
    rows = [(*((h.lower(), "/" + p) if slash else (h.lower(), "")), r, d) for r, d in rules for h, slash, p in [r.partition("/")]]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, decision string")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, ...) with host, path, rule and decision of the longest fitting rule, or null.

    Rules are looked up once for each host and its parent domains; the rules of a host, a table of one row for
    each host that has any, then come to its urls by a join, in which a hot host can be split. Of equally long
    rules that fit, which can only be the same rule given twice, block wins.
    """
    host, path = url_parts()
    rows = urls.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(parents).alias("rule_host"))
    fitting = hosts.join(rules, "rule_host").groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("n"), F.when(F.col("decision") == "block", 1).otherwise(0).alias("b"), "rule_path", "rule", "decision")).alias("rules"))
    both = rows.join(written(fitting, "rules", compact=True), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return both.withColumn("best", best).select(*urls.columns, "host", "path", F.col("best.rule").alias("rule"), F.col("best.decision").alias("decision"))


def node(url="url"):
    """A url as a node of the alias graph: without its fragment, the scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


_CANONICAL = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>"""
_REFRESH = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_BASE = r"""(?is)<base\s[^>]*href\s*=[^>]*>"""
_HREF, _CONTENT = (re.compile(rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""") for name in ("href", "content"))
_WAIT = re.compile(r"(?is)\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(.*)")
_PARTS = re.compile(r"(?s)\s*([^/?#]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?")


def _value(tag: str, name: re.Pattern) -> str:
    """An attribute's value, its character references replaced, without blanks around it and line ends in it."""
    found = name.search(tag)
    return re.sub(r"[\t\r\n]", "", unescape(next(x for x in found.groups() if x is not None)).strip()) if found else ""


def _target(tag: str) -> str:
    """Where a canonical link or a meta refresh leads, as written."""
    if tag[1:5].lower() == "link":
        return _value(tag, _HREF)
    found = _WAIT.match(_value(tag, _CONTENT))
    to = found[1].strip() if found else ""
    return to[1:].split(to[0])[0].strip() if to[:1] in ("'", '"') else to


def _plain_path(path: str) -> str:
    """A path that starts with / without its . and .. steps."""
    out, steps = [], path.split("/")[1:]
    for k, step in enumerate(steps):
        if step == "..":
            out = out[:-1]
        elif step != ".":
            out.append(step)
        if step in (".", "..") and k == len(steps) - 1:
            out.append("")
    return "/" + "/".join(out)


def resolved(base: str | None, to: str) -> str | None:
    """A target as seen from the address base: whole, or from its scheme, host, directory or path; null if base is no address."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", to):
        return to
    parts = _PARTS.match(base or "")
    if not parts:
        return None
    scheme, host, path, query = parts.groups(default="")
    if to.startswith("//"):
        return scheme + to
    own, rest = re.match(r"(?s)([^?#]*)(.*)", to).groups()
    if own:
        path = _plain_path(own if own.startswith("/") else (path[: path.rfind("/") + 1] or "/") + own)
    elif not rest.startswith("?"):
        rest = query + rest
    return f"{scheme}//{host}{path}{rest}"


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): every page's url and the targets of its canonical link and its meta redirect.

    Character references in targets are replaced, and relative targets of each form are resolved against the
    page's base element or url. Targets of schemes without :// are left out, like pages without a url. Only
    pages that name either kind of link at all are parsed, and only their tags go to Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u, url, base, tags in zip(*(batch.column(c).to_pylist() for c in ("u", "url", "base", "tags"))):
                above = resolved(url, _value(base, _HREF)) if base else url
                rows.extend((u, resolved(above, to)) for to in map(_target, tags) if to)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["u", "to"])

    low = F.lower("html")
    named = pages.where(low.contains("canonical") | low.contains("refresh")).where("url is not null")
    tags = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)))
    found = named.select(node().alias("u"), "url", F.regexp_extract("html", _BASE, 0).alias("base"), tags.alias("tags")).where(F.size("tags") > 0)
    whole = found.mapInArrow(run, "u string, to string")
    return whole.where(F.col("to").contains("://")).select("u", node("to").alias("v")).where("u is not null and u <> v").distinct()


def filtered(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    redirects(u, v) are further edges between urls, as a crawl log has them. A url of the graph that is no
    page counts too: a rule that blocks a canonical target blocks its aliases. Null urls have an empty host
    and path and take the default. Repeated rows are judged each by itself.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node("u"), node("v")))
    edges = written(edges, "links")
    own = judged(pages.select("page_id", "url"), rules).withColumn("node", node())
    if edges.isEmpty():
        spread = F.lit(None).cast("string")
    else:
        members = written(connected_components(edges), "aliases")
        said = judged(members.select(F.col("node").alias("url"), "root"), rules).groupBy("root").agg(F.max((F.col("decision") == "allow").cast("int")).alias("a"), F.max((F.col("decision") == "block").cast("int")).alias("b"))
        verdicts = members.join(said, "root").select("node", F.when(F.col("a") == 1, "allow").when(F.col("b") == 1, "block").alias("spread"))
        own, spread = own.join(verdicts, "node", "left"), F.col("spread")
    return own.select("page_id", "host", "path", "rule", F.coalesce("decision", spread, F.lit(default)).alias("verdict"))


def op2_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql() -> str:
    rows = []
    for rule, decision in RULES:
        host, _, path = rule.partition("/")
        rows.append(f"('{host}', '/{path}', '{rule}', '{decision}')")
    return ", ".join(rows)


#: Without links between pages, as in the test tables, the method's verdict is the default.
ORACLE = {
    "op2_url_rules": f"""
with r(rule_host, rule_path, rule, decision) as (values {_rule_sql()}),
u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
fit as (select page_id, host, path, rule, decision,
               row_number() over (partition by page_id order by length(rule) desc nulls last) as n
        from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(decision, 'allow') as verdict from fit where n = 1"""
}
