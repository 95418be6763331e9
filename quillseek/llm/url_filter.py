"""URL filters with redirect equivalence.

A rule blocks or allows a host, its subdomains and the paths that start with the rule's path; of the rules that fit
a URL the longest wins, of equally long ones an allowing one.  Pages name other URLs of the same content: by a canonical link or a
redirect (meta refresh).  Those pairs are edges; the connected components over them are aliases.  A URL without a rule of
its own is blocked if a rule blocks any of its aliases; a rule that allows a URL takes precedence over what
its aliases are.

Rules are matched once per distinct host, so neither a large rule list nor a host with a large share of the pages
moves more than its pages.

Defined results: a null URL, or one without `://`, has empty host and path and no aliases, and fits no rule; pages
that repeat are judged alike; null html names nothing; very long pages are searched whole; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm._graph import components
from quillseek.llm._shared import ascii_lower, join_hot, materialise, small

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Tags whose attributes name another URL of the same content.
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, no fragment; null without `://`."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(_rest(url).isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a whole URL."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    root = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def edges_of(pages: DataFrame) -> DataFrame:
    """a, b: pages' URLs and those that they name as their own.  pages: url, html."""
    named = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all("html", F.lit(REFRESH), F.lit(1)))
    names_any = F.col("html").rlike(r"(?i)canonical|http-equiv")
    found = pages.where(F.col("url").contains("://") & names_any).select("url", F.explode(named).alias("target"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("url"), F.col("target"))).alias("b")).where("a != b")


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls, which has host and path, with rule and rule_verdict (null where no rule fits).  urls is read several times."""
    hosts = urls.groupBy("host").agg(F.count("*").alias("n")).where("host != ''")
    labels = F.split("host", r"\.")
    suffix = F.expr("explode(transform(sequence(0, size(labels) - 1), i -> array_join(slice(labels, i + 1, size(labels)), '.')))")
    fits = hosts.withColumn("labels", labels).select("host", "n", suffix.alias("rule_host")).join(small(rules), "rule_host")
    one = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    of_host = materialise(fits.groupBy("host").agg(F.collect_set(one).alias("rules"), F.max("n").alias("n")), "host-rules")
    total = of_host.agg(F.sum("n")).first()[0] or 0
    best = F.expr(
        "array_max(transform(filter(rules, r -> startswith(path, r.path)),"
        " r -> struct(length(r.rule) AS len, r.verdict = 'allow' AS allow, r.rule AS rule, r.verdict AS verdict)))"
    )
    joined = join_hot(urls, of_host, ["host"], "n", total).withColumn("best", best)
    return joined.select(*[joined[c] for c in urls.columns], F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: page_id, url, html.  Returns page_id, host, path, rule, verdict, component (null without aliases)."""
    urls = materialise(pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    aliases = materialise(components(edges_of(pages)), "aliases")
    nodes = materialise(aliases.select("node", "component").unionByName(aliases.select(F.col("component").alias("node"), "component")).distinct(), "nodes")
    judged = match(nodes.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
    is_blocked = F.coalesce(F.col("rule_verdict") == "block", F.lit(False))
    blocked = materialise(judged.groupBy("component").agg(F.max(is_blocked).alias("blocked"), F.count("*").alias("members")), "blocked")
    members = blocked.agg(F.sum("members")).first()[0] or 0
    states = join_hot(nodes, blocked, ["component"], "members", members, "inner").select("node", "component", "blocked")
    # Pages of one URL can be many; the URLs with aliases are joined with the hot ones on the side.
    counts = urls.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"))
    weighted = materialise(states.join(counts, "node"), "alias-states")
    total = weighted.agg(F.sum("n")).first()[0] or 0
    ruled = match(urls, rules).withColumn("node", F.coalesce("node", F.lit("")))
    joined = join_hot(ruled, weighted, ["node"], "n", total)
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
