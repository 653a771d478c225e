"""URL filters: rules, then empirical-Bayes reputation of hosts.

Outcomes of labelled pages (bad or not) are pooled by host, registered domain and suffix. Each level
shrinks its counts towards its parent's posterior mean by a beta-binomial prior, whose strength the level's
own counts give by the method of moments. A host is blocked where even the lower bound of its
posterior share of bad pages is above a limit.

All is JVM-side. Pages meet their host's figures in an equi-join that AQE may broadcast by measured size or split where a host is hot;
the figures are pre-aggregated counts, a row for each host. Null urls and such without "://" have
host and path ''. Repeated labels of a page count once, as the worst. An empty table, or no labels, gives prior means only.
Only the page's id and url are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRules:
    #: (host, beginning of the path, verdict)
    rules: tuple[tuple[str, str, str], ...] = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
    #: Hosts whose share of bad pages is above this, by the lower bound, are blocked.
    most_bad: float = 0.3
    #: Standard deviations from the posterior mean to the bound.
    z: float = 1.645
    #: Bounds and default of a prior's strength, in pages.
    strength: tuple[float, float, float] = (2.0, 1000.0, 10.0)
    #: The mean of the suffix level's prior where nothing is labelled.
    prior_mean: float = 0.1
    #: Labels that make a suffix with a country's label of two letters after them (co.uk), under which names are registered.
    second_labels: tuple[str, ...] = ("ac", "co", "com", "ed", "edu", "go", "gob", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
    #: Other suffixes, for instance of a public suffix list: they hold besides, the longest first.
    suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host's name: without user data and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def suffix_of(name: Column, rules: UrlRules) -> Column:
    """The part of a name under which others are registered; an address is its own."""
    out = F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), name)
    for x in sorted(rules.suffixes, key=lambda x: (-len(x), x)):
        out = out.when((name == x) | name.endswith(f".{x}"), F.lit(x))
    two = F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)
    return out.when(two.rlike(rf"^({'|'.join(rules.second_labels)})\.[a-z]{{2}}$"), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix with one label before it, or the name where there is none."""
    head = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0)))
    return F.when(head == "", name).otherwise(F.concat(F.regexp_extract(head, r"([^.]*)$", 1), F.lit("."), suffix))


def rule_of(host: Column, path: Column, rules: UrlRules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict."""
    name = verdict = None
    for h, p, v in sorted(rules.rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), verdict.otherwise(none))


def strength_of(level: DataFrame, rules: UrlRules) -> DataFrame:
    """One row: the prior strength that a level's counts show, by the method of moments."""
    low, high, default = rules.strength
    p = level.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").cast("double").alias("t"), F.sum("bad").cast("double").alias("b"), F.sum(F.expr("bad * bad / n")).alias("q"), F.sum(F.expr("cast(n as double) * n")).alias("nn"))
    p = p.selectExpr("g", "t", "nn", "b / nullif(t, 0) p", "q - b * b / nullif(t, 0) m")
    rho = F.expr("(m - p * (1 - p) * (g - 1)) / nullif(p * (1 - p) * (t - nn / t - (g - 1)), 0)")
    return p.select(F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(low)), F.lit(high))).when(rho <= 0, F.lit(high)).otherwise(F.lit(default)).alias("s"))


def reputations(pages: DataFrame, outcomes: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """host, n labelled pages, bad ones, posterior mean and its bounds; outcomes: page_id, bad (0 or 1)."""
    worst = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # Written once: each level's prior reads the counts several times.
    hosts = hosts.withColumn("name", name_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("name"), rules)).withColumn("domain", domain_of(F.col("name"), F.col("suffix"))).drop("name")
    hosts = C.written(hosts, "hosts")
    domains = C.written(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    suffixes = C.written(domains.groupBy("suffix").agg(*counts), "suffixes")
    top = suffixes.agg(F.coalesce(F.sum("bad") / F.expr("nullif(sum(n), 0)"), F.lit(rules.prior_mean)).alias("up"))

    def shrunk(level: DataFrame) -> DataFrame:
        # One row each, so a broadcast of proven size.
        return level.crossJoin(F.broadcast(strength_of(level.drop("up"), rules))).withColumn("mean", F.expr("(bad + s * up) / (n + s)"))

    suffixes = shrunk(suffixes.crossJoin(F.broadcast(top)))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("up")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("up")), "domain"))
    spread = F.expr("sqrt(mean * (1 - mean) / (n + s + 1))")
    return hosts.select("host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - rules.z * spread).alias("lower"), (F.col("mean") + rules.z * spread).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """page_id, host, path, the fitting rule or null, the verdict, and the host's figures."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = reputations(pages, outcomes, rules).select("host", "n", "bad", "mean", "lower", "upper")
    own = F.when(F.col("lower") > rules.most_bad, "block").otherwise("allow")
    return named.join(by_host, "host").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "lower", "upper")


def document_of(url: Column) -> Column:
    """The number at the end of the path, before any suffix or slash: the document that the page shows. Null without one."""
    return F.regexp_extract(path_of(url), r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: by the label of the document that a page shows, bad if of low quality or toxic (of several labels the worst; what a label leaves null doesn't count, and one without either is none)."""
    bad = labels.groupBy(F.col("doc_id").alias("_document")).agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic")).cast("long")).alias("bad")).where("_document is not null and bad is not null")
    return pages.select("page_id", document_of(F.col("url")).alias("_document")).join(bad, "_document").select("page_id", "bad")
