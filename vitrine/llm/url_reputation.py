"""URL filters: rules first, then an empirical-Bayes reputation of the host.

A rule is ``host/path``: it fits that host and all its subdomains when the url's
path starts with the rule's path; the longest fitting rule wins (ties: code point
order). A page that no rule fits is judged by its host's record of labelled pages.

The record is a beta-binomial chain. The rate of bad pages of a suffix (last
label) is shrunk to the rate of all labelled pages, the registered domain's (last
two labels) to its suffix's, the host's to its domain's. The strength of each
prior is the moment estimate of the intra-class correlation over the members of
that level: with var(y) = n m (1-m) (1 + (n-1) rho), kappa = 1/rho - 1. A page is
blocked when the lower posterior bound, mean - z * sd, is above ``max_bad``; a host
without labelled pages has its domain's mean and the prior's wide spread.

Labelled outcomes are counted per host first, so a hot host is one row per task
before anything is shuffled. Joins carry per-host and per-domain counts only.

Defined cases: null urls and urls without ``://`` have empty host and path and are
judged like any unlabelled host of an empty suffix; null labels do not count;
repeated pages count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed

BLOCK, ALLOW = "block", "allow"
#: (verdict, rule) in the order given by the contract.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
Z = 1.645
MAX_BAD = 0.5
#: Least and greatest intra-class correlation that the moment estimate may give.
RHO = (0.001, 0.95)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule; both null if none fits.

    The rules are a short configured list, checked as one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        at, slash, rest = text.partition("/")
        fits = ((host == F.lit(at)) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def _shrunk(children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior mean and pseudo-counts of each child, given its parent's mean ``__m``."""
    got = children.join(parents.select(F.col(parent).alias("__p"), F.col("mean").alias("__m")),
                        F.col(parent) == F.col("__p"))
    spread = F.col("__m") * (1 - F.col("__m"))
    dev = F.col("bad") - F.col("n") * F.col("__m")
    rho = got.agg(F.try_divide(F.sum(dev * dev - F.col("n") * spread),
                               F.sum(F.col("n") * (F.col("n") - 1) * spread)).alias("rho")).first()["rho"]
    kappa = 1 / min(max(RHO[1] if rho is None else rho, RHO[0]), RHO[1]) - 1
    mean = (kappa * F.col("__m") + F.col("bad")) / (kappa + F.col("n"))
    return got.select(key, parent, "n", "bad", F.lit(kappa).alias("kappa"), mean.alias("mean"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host of ``hosts``: host, n (labelled pages), mean, sd and lower posterior bound of the bad rate.

    ``outcomes`` has host and bad (1, 0 or null); ``hosts`` has one column, host.
    """
    counted = outcomes.filter("host is not null and bad is not null").groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    every = hosts.filter("host is not null").groupBy("host").agg(F.lit(0.0).alias("n"), F.lit(0.0).alias("bad"))
    per_host = counted.unionByName(every).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per_host = checkpointed(per_host.select("host", _last_labels(F.col("host"), 2).alias("domain"),
                                            _last_labels(F.col("host"), 1).alias("suffix"), "n", "bad"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per_domain = per_host.groupBy("domain", "suffix").agg(*sums)
    per_suffix = per_domain.groupBy("suffix").agg(*sums).withColumn("root", F.lit("all"))
    overall = per_suffix.groupBy("root").agg(
        ((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean"))
    suffix = checkpointed(_shrunk(per_suffix, overall, "suffix", "root"))
    domain = checkpointed(_shrunk(per_domain, suffix, "domain", "suffix"))
    host = _shrunk(per_host.select("host", "domain", "n", "bad"), domain, "host", "domain")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("kappa") + F.col("n") + 1))
    return host.select("host", "n", "mean", sd.alias("sd"), (F.col("mean") - Z * sd).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate_lower (null where a rule decides).

    ``outcomes`` (host, bad) are the labelled pages; without it, the pages that a
    rule fits are the labelled ones, bad where the rule blocks.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = checkpointed(seen.select("page_id", "host", "path", rule.alias("rule"), said.alias("said")))
    if outcomes is None:
        outcomes = seen.filter("said is not null").select("host", (F.col("said") == BLOCK).cast("int").alias("bad"))
    known = host_reputation(outcomes, seen.select("host"))
    lower = known.select(F.col("host").alias("__host"), "lower")
    judged = seen.join(lower, F.col("host") == F.col("__host"), "left")
    own = F.when(F.col("lower") > max_bad, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("lower")).alias("bad_rate_lower"))
