"""URL filters: rules first, then empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (bad or not) are counted per host. Each level's bad rate has a beta prior around its parent's
posterior mean, from all pages down to suffix, registered domain and host, and the strength of each level's prior is
fitted to the spread of that level's rates around their parents' means (method of moments). A host is blocked when the lower bound of its
posterior exceeds a limit, so a host with few labelled pages is judged by its domain and suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_aware_join, lower_ascii, written

#: Labels below a country's, of two letters, under which domains are registered (as in co.uk, com.sg): a suffix of two labels.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")


@dataclass(frozen=True)
class UrlRule:
    """`rule` is host/path-prefix, as in "example.com/en/7"; verdict: allow or block."""

    rule: str
    verdict: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or "/" not in self.rule:
            raise ValueError(f"not a rule: {self}")


@dataclass(frozen=True)
class Reputation:
    """Parameters: a host is blocked if mean - z * deviation of its posterior exceeds `most_bad`. A suffix has two labels if the last is a country's and the other one of `second_labels`, or if it is one of `suffixes`."""

    most_bad: float = 0.5
    z: float = 1.645
    least_strength: float = 1.0
    most_strength: float = 1000.0
    second_labels: tuple[str, ...] = SECOND_LABELS
    suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule whose host is this one or a parent of it and whose path begins this one, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x.rule), x.rule)):
        own, _, prefix = r.rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(r.rule)).otherwise(out)
    return out


#: An address: four numbers, or what stands in brackets.
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def registered(host: Column) -> Column:
    """The host as a reputation knows it: without user part, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def _two_labels(host: Column, how: Reputation) -> Column:
    two = F.substring_index(host, ".", -2)
    return two.rlike(rf"^(?:{'|'.join(how.second_labels)})\.[a-z]{{2}}$") | two.isin(*how.suffixes)


def suffix_of(host: Column, how: Reputation = Reputation()) -> Column:
    """The last label, or the last two where domains are registered under two; none for an address."""
    own = registered(host)
    return F.when(own.rlike(ADDRESS), F.lit("")).when(_two_labels(own, how), F.substring_index(own, ".", -2)).otherwise(F.substring_index(own, ".", -1))


def domain_of(host: Column, how: Reputation = Reputation()) -> Column:
    """The suffix and one label more; an address is its own domain."""
    own = registered(host)
    return F.when(own.rlike(ADDRESS), own).when(_two_labels(own, how), F.substring_index(own, ".", -3)).otherwise(F.substring_index(own, ".", -2))


def host_reputation(hosts: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """`hosts` (host, n, bad: labelled pages and bad ones; each host once) with suffix, domain, mean, deviation and bound.

    No labelled pages at all: the mean is 0.5 with the least strength, so nothing is blocked by the default limit.
    """
    rows = hosts.withColumns({"domain": domain_of(F.col("host"), how), "suffix": suffix_of(F.col("host"), how)})
    domains = rows.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    suffixes = suffixes.withColumn("prior", F.lit((whole["bad"] + 0.5) / (whole["n"] + 1.0)))
    suffixes = _shrunk(suffixes, _strength(suffixes, how)).select("suffix", F.col("mean").alias("prior"))
    domains = domains.join(suffixes, "suffix")
    domains = _shrunk(domains, _strength(domains, how)).select("suffix", "domain", F.col("mean").alias("prior"))
    out = written(rows.join(domains, ["suffix", "domain"]), "host-priors")
    strength = _strength(out, how)
    out = _shrunk(out, strength)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1.0))
    out = out.withColumn("deviation", deviation)
    return out.withColumn("bound", F.greatest(F.lit(0.0), F.col("mean") - how.z * F.col("deviation"))).drop("prior")


def _strength(rows: DataFrame, how: Reputation) -> float:
    """A level's prior strength s = a + b from the spread of its rates around `prior`, their parents' means (method of moments).

    n (bad / n - p)^2 is p (1 - p) (1 + (n - 1) / (s + 1)) on average, so what the spread has beyond sampling gives s.
    Less than two rows with labels: the least strength; no spread beyond sampling, or no row of two labels: the most.
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    got = rows.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("prior")) ** 2).alias("spread"),
        F.sum(noise).alias("sampling"),
        F.sum(noise * (F.col("n") - 1)).alias("more"),
    ).first()
    if got["k"] < 2:
        return how.least_strength
    beyond = got["spread"] - got["sampling"]
    if beyond <= 0 or got["more"] <= 0:
        return how.most_strength
    return min(max(got["more"] / beyond - 1.0, how.least_strength), how.most_strength)


def _shrunk(rows: DataFrame, strength: float) -> DataFrame:
    return rows.withColumn("mean", (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule], how: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, bad_rate, bad_bound.

    `outcomes`: url and bad (0 or 1, nulls left out), a row for each labelled page. A rule's verdict holds; without one a
    page is blocked if its host's bound exceeds how.most_bad. Pages without a host share the empty host. Repeated rows are
    judged like others; other columns are not looked at.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.where(F.col("bad").isNotNull()).groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = written(hosts.join(labelled, "host", "left").select("host", "n_pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad")), "hosts")
    judged = written(host_reputation(counts, how).select("host", "n_pages", "mean", "bound"), "reputation")
    out = hot_aware_join(rows, judged, ["host"], "n_pages", F.xxhash64(id_col, "path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for r in rules:
        ruled = F.when(F.col("rule") == r.rule, F.lit(r.verdict)).otherwise(ruled)
    verdict = F.coalesce(ruled, F.when(F.col("bound") > how.most_bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.col("mean").alias("bad_rate"), F.col("bound").alias("bad_bound"))
