"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Every host has some pages with a known outcome (its product text was usable or not). The share of usable pages of a
host is a binomial rate that is shrunk towards its registered domain, the domain towards its suffix and the suffix
towards the whole crawl. At each level the strength of the beta prior is estimated from how much the rates at that level
differ beyond chance (moments of the beta-binomial), so a host with two labelled pages is judged mostly by its
domain and one with thousands by itself. A page without a rule is blocked when even the upper posterior bound of
its host's usable share stays under ``min_usable``.

Only DataFrame expressions: a host's counts are partial sums before they are shuffled, so a host with a third of all
pages is a few rows per task, and the join back to the pages is a plain equi-join that may be split or broadcast.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm import scratch


class Rule(NamedTuple):
    """``prefix`` is a host, and a path that starts with a slash; it also holds for all subdomains of the host."""

    prefix: str
    verdict: str


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels under which names are registered; everything else is registered under its last label.
TWO_LABEL_SUFFIXES = ("co.th", "in.th", "or.th", "ac.th", "go.th", "co.uk", "com.au", "co.jp")


def host_of(url: Column) -> Column:
    """Part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(at > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    name, slash, rest = rule.prefix.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def rule_for(rules: Sequence[Rule], host: Column, path: Column, field: str) -> Column:
    """``field`` of the longest rule that fits, null if none does; of rules of one length the first given."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.prefix))):
        out = F.when(_fits(rule, host, path), F.lit(getattr(rule, field))).otherwise(out)
    return out


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered name: one label more than the suffix."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_label), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2))


def _strength(groups: DataFrame, limits: tuple[float, float]) -> float:
    """Strength (in pages) of the prior that groups of a level share: moment estimate of the beta-binomial's correlation
    inside groups around their parent's rate ``m``; the weakest where there is next to nothing to compare. One aggregate
    row comes to the driver."""
    n, p, m = F.col("n"), F.col("good") / F.col("n"), F.col("m")
    row = groups.filter("n > 0").agg(
        F.sum(n * (p - m) * (p - m)).alias("seen"), F.sum(m * (1 - m)).alias("chance"),
        F.sum((n - 1) * m * (1 - m)).alias("room"), (F.count(F.lit(1)) - F.count_distinct("m")).alias("siblings")).first()
    if row["siblings"] < 2:
        return limits[0]
    if not row["room"] or row["room"] <= 0:
        return limits[1]
    rho = (row["seen"] - row["chance"]) / row["room"]
    return min(limits[1], max(limits[0], 1 / rho - 1 if rho > 0 else limits[1]))


def host_rates(outcomes: DataFrame, strength_limits: tuple[float, float] = (2.0, 1000.0)) -> DataFrame:
    """Beta distribution of the usable share, by host.

    ``outcomes(host, usable)``, usable 0, 1 or null (ignored, as is an empty host) -> ``(level, name, a, b)``. Level host: posterior of a host with labelled
    pages. Levels domain, suffix and all: prior of a host beneath them that has none. Without any outcome there is only ``all``.
    """
    hosts = scratch.settled(
        outcomes.filter(F.col("usable").isNotNull() & (F.col("host") != ""))
        .groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("usable").cast("double").alias("good"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    # Both are read at several places below; they are small next to the hosts, and hosts next to the pages.
    domains = scratch.settled(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = scratch.settled(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g")).first()
    overall = (total["g"] + 1) / (total["n"] + 2)

    def shrunk(groups: DataFrame, strength: float) -> DataFrame:
        k = F.lit(strength)
        return groups.withColumn("a", F.col("good") + k * F.col("m")).withColumn("b", F.col("n") - F.col("good") + k * (1 - F.col("m")))

    rate = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = suffixes.withColumn("m", F.lit(overall))
    of_suffix = _strength(suffixes, strength_limits)
    suffixes = shrunk(suffixes, of_suffix)
    domains = domains.join(suffixes.select("suffix", rate.alias("m")), "suffix")
    of_domain = _strength(domains, strength_limits)
    domains = shrunk(domains, of_domain)
    hosts = hosts.join(domains.select("domain", rate.alias("m")), "domain")
    of_host = _strength(hosts, strength_limits)
    hosts = shrunk(hosts, of_host)

    def unseen(strength: float, mean: Column) -> list[Column]:
        return [(F.lit(strength) * mean).alias("a"), (F.lit(strength) * (1 - mean)).alias("b")]

    out = outcomes.sparkSession.range(1).select(F.lit("all").alias("level"), F.lit("").alias("name"), *unseen(of_suffix, F.lit(overall)))
    for level, groups, strength in (("suffix", suffixes, of_domain), ("domain", domains, of_host)):
        out = out.unionByName(groups.select(F.lit(level).alias("level"), F.col(level).alias("name"), *unseen(strength, rate)))
    return out.unionByName(hosts.select(F.lit("host").alias("level"), F.col("host").alias("name"), "a", "b"))


def judge_urls(crawled_pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], min_usable: float = 0.5,
               z: float = 1.645, strength_limits: tuple[float, float] = (2.0, 1000.0)) -> DataFrame:
    """Judge every crawled page by rule, else by the reputation of its host.

    ``crawled_pages(key, url)`` and ``outcomes(url, usable)`` -> ``(key, url, host, path, rule, verdict, usable_bound)``: verdict
    allow or block, ``usable_bound`` the upper posterior bound of the host's usable share.

    Null or malformed url: host and path empty, no rule, judged by the crawl as a whole. A host without labelled pages
    is judged by its domain, then suffix, then the crawl. No outcomes: nothing is blocked, as the prior's mean is 0.5. Repeated rows stay, extra columns are not read. Empty pages: empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rates = host_rates(outcomes.select(host.alias("host"), "usable"), strength_limits)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    bounds = scratch.settled(rates.select("level", "name", F.round(F.least(F.lit(1.0), mean + z * spread), 9).alias("bound")))
    overall = bounds.filter("level = 'all'").first()["bound"]

    def level(name: str) -> DataFrame:
        return bounds.filter(F.col("level") == name).select(F.col("name").alias(name), F.col("bound").alias(f"{name}_bound"))

    # Names of hosts are few next to pages: each host meets its domain and suffix once, then pages meet their host.
    names = crawled_pages.select(host.alias("host")).distinct().withColumn("domain", domain_of(F.col("host"))).withColumn(
        "suffix", suffix_of(F.col("host")))
    by_host = (names.join(level("host"), "host", "left").join(level("domain"), "domain", "left").join(level("suffix"), "suffix", "left")
               .select("host", F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(overall)).alias("usable_bound")))
    pages = crawled_pages.select("key", "url", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("usable_bound") < min_usable, "block").otherwise("allow")
    return pages.join(by_host, "host").select(
        "key", "url", "host", "path", rule_for(rules, host, path, "prefix").alias("rule"),
        F.coalesce(rule_for(rules, host, path, "verdict"), own).alias("verdict"), "usable_bound")
