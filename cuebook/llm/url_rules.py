"""Operator 6: url verdicts with redirect equivalence, in DataFrame functions only.

A rule fits its host and all subdomains when the path starts with the rule's; the longest wins. Pages without a rule take the verdict of
their alias group: the connected component over redirect (meta refresh) and canonical-link edges. In a group an explicit allow
takes precedence over a block; a group without explicit verdicts is allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebook.llm.common import Scratch, components, hub_join

#: The contract's rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url):
    """What follows the first ://; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url):
    return F.translate(F.regexp_extract(rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def node_of(url):
    """Identity of a page: host, path and query, without scheme and fragment; null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_extract(rest(url), r"(?s)^[^/?#]*([^#]*)", 1)))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of (smallest url node of its group).

    Null html has no edges, null or odd urls have empty host and path, no rule and verdict allow. Rules judge every node of a group, link targets that aren't rows
    too. All canonical links and refreshes of a page count, those in comments and scripts aside; relative targets resolve against the page's path. Repeated rows keep
    their rows and pages that are one url share a group. Of rules of equal length the last one listed wins. Html of any length is read whole; other columns are ignored."""
    u = F.col(url)
    seen = F.regexp_replace(F.col(html), r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b.*?(?:</\1\s*>|\z)", " ")
    tags = F.filter(F.array_distinct(F.regexp_extract_all(seen, F.lit(r"(?i)<(?:link|meta)\b[^<>]*+>"), F.lit(0))), linking)
    hops = F.transform(tags, lambda t: resolved(decoded(F.trim(F.when(F.lower(F.substring(t, 1, 5)) == "<link", quoted(t, "href")).otherwise(quoted(t, "url")))), u))

    base = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"), F.array_distinct(F.filter(F.coalesce(hops, F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("to"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    keep = Scratch(pages.sparkSession)
    base = keep.cut(base.withColumn("rule", rule).withColumn("said", said))  # so that html is read once
    edges = base.where("size(to) > 0 and node is not null").select(F.col("node").alias("a"), F.explode("to").alias("b")).where("a <> b").distinct()
    group = components(edges)
    at = F.concat(F.lit("http://"), F.col("node"))
    opinions = group.withColumn("said", ruled(host_of(at), path_of(at), rules)[1])
    votes = opinions.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allow"), F.max(F.col("said") == "block").alias("block"))
    inherited = hub_join(group, votes, "component", "node").select("node", "component", F.when(F.col("block") & ~F.coalesce("allow", F.lit(False)), "block").otherwise("allow").alias("group_verdict"))
    met = hub_join(base.where("node is not null"), inherited, "node", "page_id", how="left")
    met = met.unionByName(base.where("node is null"), allowMissingColumns=True)
    return met.select("page_id", "host", "path", "rule", F.coalesce("said", "group_verdict", F.lit("allow")).alias("verdict"), F.coalesce("component", "node").alias("alias_of"))


def linking(tag):
    """Whether a link tag is canonical, a meta tag a refresh. Tags and values are each passed over once, whatever is left open."""
    rel = F.coalesce(F.regexp_extract(tag, r"(?is)\brel\s*+=\s*+(\"[^\">]*+|'[^'>]*+|[^\"'>\s]++)", 1), F.lit(""))
    return F.when(F.lower(F.substring(tag, 1, 5)) == "<link", rel.rlike(r"(?i)\bcanonical\b")).otherwise(tag.rlike(r"(?i)http-equiv\s*+=\s*+[\"']?refresh\b"))


def ruled(host, path, rules):
    """(rule, verdict) columns of the longest rule that fits host and path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def quoted(tag, name: str):
    """What follows name= in a tag, up to the end of its quotes or, without quotes, to white space; empty without one."""
    own = rf"(?is)\b{name}\s*=\s*"
    return F.coalesce(F.nullif(F.regexp_extract(tag, own + r"\"\s*([^\">]*)", 1), F.lit("")), F.nullif(F.regexp_extract(tag, own + r"'\s*([^'>]*)", 1), F.lit("")), F.regexp_extract(tag, own + r"([^\"'\s>]+)", 1))


def decoded(t):
    """Character references that occur in urls, &amp; last."""
    for said, x in ((r"(?i)&#x0*2f;|&#0*47;|&sol;", "/"), (r"(?i)&#x0*3a;|&#0*58;|&colon;", ":"), (r"(?i)&#x0*3f;|&#0*63;|&quest;", "?"), (r"(?i)&#x0*3d;|&#0*61;|&equals;", "="), (r"(?i)&#x0*2e;|&#0*46;|&period;", "."), (r"(?i)&#x0*27;|&#0*39;|&apos;", "'"), (r"(?i)&quot;|&#x0*22;|&#0*34;", '"'), (r"(?i)&amp;|&#x0*26;|&#0*38;", "&")):
        t = F.regexp_replace(t, said, x)
    return t


def resolved(t, page):
    """Node of a link target: with a scheme, //host, /path, ?query or a path relative to the page's; null for an empty one, a fragment only, or another scheme."""
    t = F.regexp_extract(t, r"(?s)^([^#]*)", 1)
    host, here = host_of(page), path_of(page)
    own = F.when(t.startswith("?"), F.concat(here, t)).when(t.startswith("/"), t).otherwise(F.concat(F.when(here == "", "/").otherwise(F.regexp_extract(here, r"(?s)^(.*/)", 1)), t))
    ask = F.regexp_extract(own, r"(?s)(\?.*)$", 1)
    inner = F.when(host != "", F.concat(host, folded(F.regexp_extract(own, r"(?s)^([^?]*)", 1)), ask))
    return F.when(t == "", None).when(t.startswith("//"), node_of(F.concat(F.lit("http:"), t))).when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), node_of(t)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(inner)


def folded(path):
    """A path with its . and .. parts carried out."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    done = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), done).otherwise(path)
