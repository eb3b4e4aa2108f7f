"""URL filter: rules first, then trust and distrust that spread over the links between hosts.

A rule is a host and a path prefix; it fits its host and all subdomains. Pages that no rule fits get the verdict of
their host: personalised PageRank carries trust from the hosts of allowed pages along links, and distrust from the hosts of blocked
pages against them. Both start as numbers of pages, so they are on one scale: a host is blocked where more
blocked pages than allowed ones reach it. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.llm.shared import discard, stored

#: (host and path, verdict); a rule list is a parameter of at most MOST_RULES entries, as it becomes one expression.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MOST_RULES = 1000
DAMPING = 0.85
#: Rounds go on until no host's trust or distrust changes by more than this, as a part of its own, and no
#: host is newly reached; so it doesn't matter how many hosts there are.
TOLERANCE = 1e-4
#: A guard: so many rounds without that are an error.
ROUNDS = 1000
#: A host is blocked if distrust makes up more than this share of its trust and distrust together, which are in pages.
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (length, blocks, rule, verdict), or null; of equally long ones a blocking
    one, then the first in order of text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} become one expression")
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        fields = (F.lit(len(rule)).alias("length"), F.lit(verdict == "block").alias("blocks"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(inside & path.startswith(slash + rest), F.struct(*fields)))
    if not fits:
        return F.lit(None).cast("struct<length:int,blocks:boolean,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from one host's pages to another host, each page counting once for a host. pages: page_id, host,
    html."""
    links = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^<>]*?href\s*=\s*[\"']\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'#?/]+)"), 1)
    to = F.transform(links, lambda x: host_of(F.concat(F.lit("x:"), F.regexp_replace(x, "^[^/]*", ""))))
    each = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.array_distinct(to)).alias("dst"))
    return each.filter((F.col("src") != F.col("dst")) & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_trust(judged: DataFrame) -> DataFrame:
    """host, trust and distrust of every host with a page or a link, in pages: what its own allowed (blocked) pages
    count for, times 1 - DAMPING, and what comes over links from (to) others, times DAMPING. judged: host, html,
    rule_verdict (allow, block or null). Rank that comes to a host without links ends there."""
    edges = stored(host_edges(judged), "edges")
    out, into = edges.groupBy("src").agg(F.sum("n").alias("out")), edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = stored(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")), "edge-shares")
    seeds = judged.filter(F.col("host") != "").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    linked = edges.select(F.col("dst").alias("host")).distinct().select("host", F.lit(0).alias("allowed"), F.lit(0).alias("blocked"))
    seeds = stored(seeds.unionByName(linked).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "seeds")
    start = seeds.select("host", F.col("allowed").cast("double").alias("seed_trust"), F.col("blocked").cast("double").alias("seed_distrust"))
    ranks = start.withColumns({"trust": F.col("seed_trust"), "distrust": F.col("seed_distrust"), "change": F.lit(1.0)})
    first = ranks
    for _ in range(ROUNDS):  # a host reached anew changes by 1
        forth = edges.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        flow = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        moved = ranks.join(flow, "host", "left").select("host", "seed_trust", "seed_distrust", F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"), F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0.0)).alias("d"))
        moved = moved.withColumn("trust", (1 - DAMPING) * F.col("seed_trust") + DAMPING * F.col("t")).withColumn("distrust", (1 - DAMPING) * F.col("seed_distrust") + DAMPING * F.col("d"))
        part = lambda new, old: F.coalesce(F.try_divide(F.abs(F.col(new) - F.col(old)), F.greatest(new, old)), F.lit(0.0))
        change = F.greatest(part("trust", "old_t"), part("distrust", "old_d"))
        earlier, ranks = ranks, stored(moved.select("host", "seed_trust", "seed_distrust", "trust", "distrust", change.alias("change")), "ranks")
        if earlier is not first:
            discard(earlier)
        most = ranks.agg(F.max("change")).first()[0]
        if most is None or most < TOLERANCE:
            return ranks.select("host", "trust", "distrust")
    raise RuntimeError(f"trust still changes by {most} of itself after {ROUNDS} rounds")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url, html) as page_id, host, path, rule, verdict, by (rule or host), trust and distrust. A null or
    relative url has an empty host and path, no rule, and is allowed; a null html has no links; repeated rows are judged
    each. Hosts that neither trust nor distrust reaches are allowed."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    trust = host_trust(rows.select("host", "html", F.col("best.verdict").alias("rule_verdict")))
    share = F.try_divide("distrust", F.col("trust") + F.col("distrust"))
    own = F.when(share > THRESHOLD, "block").otherwise("allow")
    by = F.when(F.col("best").isNotNull(), "rule").otherwise("host")
    return rows.drop("html").join(trust, "host", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), by.alias("decided_by"), "trust", "distrust")
