"""URL filters: rules, then trust and distrust over the link graph of hosts.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest rule decides. Other urls take the verdict of their host. Hosts link
by the absolute links of their pages; relative links point at the host itself.
Trust is personalised PageRank along the links, each host a seed by the share of
its pages that rules allow; distrust runs against the links, from hosts by the
share that they block. A host is blocked where distrust exceeds trust by
``THRESHOLD``, so one on which rules block few pages is not blocked as a whole.

Defined cases: a url that is null or without ``://`` has empty host and path,
no rule, and is allowed for want of evidence; null html has no links; repeated
rows count each in shares and links; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import checkpointed, written

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules become one expression; a longer list would have to be joined.
MAX_RULES = 1000
DAMPING, ROUNDS, CUT_EVERY = 0.85, 20, 5
THRESHOLD = 0.1
LINK = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])\x20*=\x20*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\x00-\x20]+)"""
RELATIVE = r"""(?:[hH][rR][eE][fF]|[sS][rR][cC])\x20*=\x20*["']?/[^/]"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of pages (host, html): links counted per pair of hosts, without empty hosts."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # within a page first: what is shuffled is one row per pair of hosts and page
    found = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER))
    absolute = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    own = pages.where("host <> ''").groupBy("host").agg(F.sum(F.regexp_count(html, F.lit(RELATIVE))).alias("n")).select(F.col("host").alias("src"), F.col("host").alias("dst"), F.col("n").cast("long").alias("n")).where("n > 0")
    return absolute.unionByName(own).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust): ``seeds`` (host, trust, distrust) spread over ``edges`` (src, dst, n).

    A host without links the way that a score runs keeps what it has.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    kinds = hosts.select("host", F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"))
    given = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))).alias("x")).select("host", "x.*")
    start = checkpointed(kinds.join(given, ["host", "kind"], "left").na.fill(0.0, ["seed"]))
    out = both.groupBy("kind", F.col("src").alias("host")).agg(F.sum("n").alias("all"))
    loose = start.join(out, ["kind", "host"], "left_anti").select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("part"))
    parts = both.join(out.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("part"))
    parts = checkpointed(parts.unionByName(loose))
    now = start.select("kind", "host", F.col("seed").alias("score"))
    for k in range(ROUNDS):
        moved = parts.join(now.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("part") * F.col("score")).alias("got"))
        now = start.join(moved, ["kind", "host"], "left").select("kind", "host", ((1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"))
        if (k + 1) % CUT_EVERY == 0:
            now = checkpointed(now)
    score = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)), 6).alias(k)
    return now.groupBy("host").agg(score("trust"), score("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    judged = written(rows.drop("html"), "urls")
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = checkpointed(host_edges(rows.select("host", "html")))
    scores = propagate(edges, checkpointed(seeds))
    full = judged.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    verdict = F.coalesce("said", F.when(F.col("distrust") - F.col("trust") > THRESHOLD, "block").otherwise("allow"))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
