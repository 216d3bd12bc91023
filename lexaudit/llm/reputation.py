"""URL filter: fixed host rules first, then an empirical-Bayes reputation of the host.

Each host's share of bad pages is a beta-binomial posterior whose prior is its registered domain's
estimate, which is shrunk to its public suffix's, which is shrunk to the overall rate; what is not
known of a level counts at all levels under it. A host is blocked if even the lower posterior bound of its bad share is above the labels' overall rate: a host
no worse than the rest is blocked with a chance of one in twenty at most. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of two labels; every other host's suffix is its last label. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk")


@dataclass(frozen=True)
class Reputation:
    #: One-sided 95 % bound: the rate of false blocks among hosts that are as bad as the rest.
    z: float = 1.645
    #: The limit as a multiple of the labels' overall bad rate.
    times_overall: float = 1.0
    least_strength: float = 2.0
    most_strength: float = 1000.0


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if there is no '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; '' if there is no '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, as (text, verdict); null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def _suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def _domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _moments(counts: DataFrame, by: str) -> dict[str, float]:
    """Sums over the groups of a level, for the strength of the prior above it: one row."""
    groups = counts.groupBy(by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    row = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    return {k: float(row[k] or 0) for k in ("k", "n", "bad", "nn", "bb")}


def strength(m: dict[str, float], p: Reputation) -> float:
    """Moment estimate of the beta prior's pseudo-count from the spread of the groups' rates; without any
    sign of a spread, and for a single group, the groups are taken to be alike."""
    if m["n"] == 0 or m["k"] < 2:
        return p.most_strength
    rate = m["bad"] / m["n"]
    spread = m["bb"] - m["n"] * rate * rate
    free = m["n"] - m["nn"] / m["n"]
    if free <= 0 or not 0 < rate < 1:
        return p.most_strength
    between = (spread - (m["k"] - 1) * rate * (1 - rate)) / free
    if between <= 0:
        return p.most_strength
    return min(max(rate * (1 - rate) / between - 1, p.least_strength), p.most_strength)


def _shrunk(prior: Column, doubt: Column, k: float) -> tuple[Column, Column]:
    """Posterior mean and variance of a rate with bad of n outcomes under a prior of strength k, whose own
    mean is known with the variance doubt."""
    bad, n, k = F.coalesce(F.col("bad"), F.lit(0)), F.coalesce(F.col("n"), F.lit(0)), F.lit(k)
    mean = (bad + k * prior) / (n + k)
    share = k / (n + k)
    return mean, mean * (1 - mean) / (n + k + 1) + share * share * doubt


def reputations(outcomes: DataFrame, p: Reputation = Reputation()) -> tuple[DataFrame, DataFrame, DataFrame, float, tuple[float, float, float]]:
    """From outcomes (host, bad 0/1): hosts (host, n, bad), domains and suffixes (with shrunk mean and its variance),
    the overall rate and the strengths of the priors above suffixes, domains and hosts. Null outcomes count as none."""
    hosts = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    counts = hosts.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))
    by_suffix, by_domain, by_host = (_moments(counts, c) for c in ("suffix", "domain", "host"))
    overall = (by_suffix["bad"] + 1) / (by_suffix["n"] + 2)
    above = (strength(by_suffix, p), strength(by_domain, p), strength(by_host, p))
    suffix_mean, suffix_doubt = _shrunk(F.lit(overall), F.lit(0.0), above[0])
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select("suffix", suffix_mean.alias("suffix_mean"), suffix_doubt.alias("suffix_doubt"))
    domain_mean, domain_doubt = _shrunk(F.col("suffix_mean"), F.col("suffix_doubt"), above[1])
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix").select("domain", domain_mean.alias("domain_mean"), domain_doubt.alias("domain_doubt"))
    return hosts, domains, suffixes, overall, above


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], p: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, and the host's posterior bad_mean and bad_bound.

    outcomes has (url, bad 0/1) of labelled pages; rules are (allow|block, host, path). A null url,
    or one without '://', has empty host and path, fits no rule and is judged by the prior of the
    empty host. Hosts without outcomes get their domain's, suffix's or the overall estimate. Repeated
    pages and null ids are judged each; no outcomes at all leave the prior, which blocks nothing.
    Columns besides id_col and url_col are ignored. Reputations are worked out on distinct hosts
    and joined back, so that a host of a third of all pages costs one row on the joined side.
    """
    seen = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known, domains, suffixes, overall, above = reputations(outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad")), p)
    hosts = seen.select("host").distinct().withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))
    hosts = hosts.join(known, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(overall))
    mean, variance = _shrunk(prior, F.coalesce("domain_doubt", "suffix_doubt", F.lit(0.0)), above[2])
    bound = mean - F.lit(p.z) * F.sqrt(variance)
    hosts = hosts.select("host", mean.alias("bad_mean"), bound.alias("bad_bound"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("bad_bound") > F.lit(p.times_overall * overall), F.lit("block")).otherwise(F.lit("allow")))
    return seen.join(hosts, "host").select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_bound")
