"""URL filters: rules first, and for the rest trust and distrust spread over the host graph.

Trust is a personalised PageRank from hosts with allowed pages along links; distrust one
from hosts with blocked pages against links (who links to a bad host is suspect).  Seeds
weigh as many pages as rules decide.  A host whose distrust is above its trust by more
than ``threshold`` is blocked.  Ranks are whole numbers out of SCALE and edges whole
counts, so sums don't depend on the order of tasks, and a task that runs again gives the
same rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import checkpointed, small_side

SCALE = 10**12
DAMPING = 0.85
#: A sum of changes below this share of SCALE ends the iteration.
TOLERANCE = 1e-6
#: Guard against an endless loop: DAMPING ** 100 is a tenth of TOLERANCE, so it isn't met.
ITERATIONS = 100
#: Up to so many rules are one expression; more are joined by host.
EXPRESSION_RULES = 200
#: Hosts in absolute links; a relative link stays on its host and is no edge.
LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty for null or no ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """A host without user and port: what links name."""
    return F.regexp_replace(host, r"^.*@|:\d+$", "")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): distinct edges of hosts (without user and port) with their number of links; no loops."""
    each = pages.select(site_of(host_of(pages[url_col])).alias("src"), F.explode(F.regexp_extract_all(pages[html_col], F.lit(LINK), F.lit(1))).alias("to"))
    edges = each.select("src", site_of(_lower(F.col("to"))).alias("dst"))
    return edges.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def rank(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank of edges (src, dst, w) from seeds (host, seed), out of SCALE.

    Rank that a host without links passes on is lost (it only scales the rest).  Each round
    is written out, and one number, the sum of changes, comes to the driver.
    """
    total = seeds.agg(F.coalesce(F.sum("seed"), F.lit(0)).alias("t")).first()["t"]
    start = checkpointed(seeds.where("seed > 0").select("host", (F.col("seed").cast("double") / float(max(total, 1)) * SCALE).cast("long").alias("seed")))
    now = start.select("host", F.col("seed").alias("rank"))
    if edges.isEmpty() or not total:
        return now
    out = edges.groupBy("src").agg(F.sum("w").alias("all"))
    share = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")))
    for _ in range(iterations):
        moved = share.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), F.floor(F.col("rank") * F.col("share") * damping).cast("long").alias("rank"))
        home = start.select("host", F.floor(F.col("seed") * (1 - damping)).cast("long").alias("rank"))
        new = checkpointed(moved.unionByName(home).groupBy("host").agg(F.sum("rank").alias("rank")))
        old = now.select(F.col("host").alias("h"), F.col("rank").alias("r"))
        change = new.join(old, F.col("host") == F.col("h"), "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("rank", F.lit(0)) - F.coalesce("r", F.lit(0)))), F.lit(0))).first()[0]
        now = new
        if change < tolerance * SCALE:
            break
    return now


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules (rule, rpath, verdict) of it and its parent domains, longest first."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(parents).alias("rhost")).join(rules, "rhost")
    return each.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("len"), "rule", "rpath", "verdict")), asc=False).alias("rules"))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rhost, rpath, verdict) of pairs (verdict, host/path)."""
    return spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules], "rule string, rhost string, rpath string, verdict string")


def _ruled(p: DataFrame, rules: DataFrame) -> DataFrame:
    """p (host, path, ..) with the longest fitting rule as r (rule, verdict)."""
    few = rules.limit(EXPRESSION_RULES + 1).collect()
    if len(few) <= EXPRESSION_RULES:
        r = F.lit(None).cast("struct<rule:string,verdict:string>")
        for x in sorted(few, key=lambda x: (len(x["rule"]), x["rule"])):
            fits = ((F.col("host") == x["rhost"]) | F.endswith(F.col("host"), F.lit("." + x["rhost"]))) & F.startswith(F.col("path"), F.lit(x["rpath"]))
            r = F.when(fits, F.struct(F.lit(x["rule"]).alias("rule"), F.lit(x["verdict"]).alias("verdict"))).otherwise(r)
        return p.withColumn("r", r)
    by_host = host_rules(p.select("host").distinct(), rules)
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rpath"])), F.lit(0))
    return p.join(by_host, "host", "left").withColumn("r", F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))).drop("rules")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.0, iterations: int = ITERATIONS) -> DataFrame:
    """One row per input row: id, host, path, rule (null: none), verdict, trust and distrust of the host (shares).

    Null urls and urls without :// have an empty host and path: no rule fits, and without
    seeds the verdict is allow, as for every host that neither reaches.  Equal lengths of
    fitting rules fall to the later rule by name.  Null html has no links.  Repeated rows
    are judged each; other columns are not read.
    """
    p = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    ruled = _ruled(p, rules).select("id", "host", "path", site_of(F.col("host")).alias("site"), "r.rule", F.col("r.verdict").alias("said"))
    seeds = checkpointed(ruled.where("rule is not null").groupBy(F.col("site").alias("host")).agg(F.count(F.when(F.col("said") == "allow", 1)).alias("good"), F.count(F.when(F.col("said") == "block", 1)).alias("bad")))
    edges = checkpointed(links(pages, url_col, html_col))
    trust = rank(edges, seeds.select("host", F.col("good").alias("seed")), iterations).withColumnRenamed("rank", "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = rank(against, seeds.select("host", F.col("bad").alias("seed")), iterations).withColumnRenamed("rank", "distrust")
    of_host = trust.join(distrust, "host", "full").select(F.col("host").alias("site"), *((F.coalesce(c, F.lit(0)) / SCALE).alias(c) for c in ("trust", "distrust")))
    out = ruled.join(small_side(checkpointed(of_host)), "site", "left")
    method = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) > threshold, "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
