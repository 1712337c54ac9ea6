"""URL verdicts: rules first, then the reputation of the host by empirical Bayes.

Pages that a rule decides are the labelled outcomes. A host's share of blocked pages is shrunk
towards its registered domain, that towards its suffix, and that towards the whole table, each by
a beta prior whose strength is estimated from the spread of the children of that level. A page
without a rule is blocked when the lower posterior bound of its host's share of blocked pages
reaches the limit, and allowed otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from verstext.runtime import materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest fitting rule; of equally long ones the first listed."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


# fixed values: suffixes of two labels under which names are registered
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp",
    "com.br", "org.br", "com.cn", "org.cn", "co.in", "org.in", "co.kr", "or.kr", "com.mx", "com.ar", "com.tr", "com.tw", "com.sg", "com.hk", "co.za", "co.il",
)
ADDRESSES = "ip"


def bare_host(host: Column) -> Column:
    """The host without a user part before ``@`` and without a port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def is_address(bare: Column) -> Column:
    return bare.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | bare.startswith("[")


def registered_domain(host: Column, suffixes: Sequence[str]) -> Column:
    """The label before the suffix and the suffix; an address is a domain of its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(is_address(bare), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(domain: Column, suffixes: Sequence[str]) -> Column:
    """The listed suffix of two labels, else the last label; addresses have one suffix together."""
    two = F.substring_index(domain, ".", -2)
    return F.when(is_address(domain), F.lit(ADDRESSES)).when(two.isin(*suffixes), two).otherwise(F.substring_index(domain, ".", -1))


def strength(share: str, n: str, centre: str) -> Column:
    """Prior strength by moments, from children with outcomes: how little their shares spread.

    The spread beyond what chance gives for samples of this size is the variance of the prior,
    m (1 - m) / (strength + 1). Held between 1 and 1000; 1000 where no spread is left.
    """
    m = F.avg(centre)
    chance = m * (1 - m)
    noise = chance * F.avg(1 / F.col(n))
    spread = F.avg((F.col(share) - F.col(centre)) * (F.col(share) - F.col(centre))) - noise
    return F.when(spread > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), chance / spread - 1))).otherwise(F.lit(1000.0))


def reputations(pages: DataFrame, z: float, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``host, low`` of every host: the lower posterior bound of its share of blocked pages."""
    hosts = pages.groupBy("host").agg(
        F.count("outcome").cast("double").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("double").alias("b")
    ).select("host", registered_domain(F.col("host"), suffixes).alias("domain"), "n", "b")
    hosts = materialise(hosts, "host_outcomes")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    domains = domains.withColumn("suffix", suffix_of(F.col("domain"), suffixes))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    root = suffixes.agg(((F.sum("sb") + 1) / (F.sum("sn") + 2)).alias("root"))

    def with_strength(children: DataFrame, n: str, b: str, centre: str, out: str) -> DataFrame:
        seen = children.where(F.col(n) > 0).select(n, centre, (F.col(b) / F.col(n)).alias("share"))
        return children.withColumn(out, F.coalesce(seen.agg(strength("share", n, centre).alias(out)).scalar(), F.lit(1000.0)))

    suffixes = with_strength(suffixes.withColumn("root", F.coalesce(root.scalar(), F.lit(0.5))), "sn", "sb", "root", "sk")
    suffixes = suffixes.withColumn("smean", (F.col("sb") + F.col("sk") * F.col("root")) / (F.col("sn") + F.col("sk")))
    domains = with_strength(domains.join(suffixes.select("suffix", "smean"), "suffix"), "dn", "db", "smean", "dk")
    domains = domains.withColumn("dmean", (F.col("db") + F.col("dk") * F.col("smean")) / (F.col("dn") + F.col("dk")))
    hosts = with_strength(hosts.join(domains.select("domain", "dmean"), "domain"), "n", "b", "dmean", "hk")
    a = F.col("b") + F.col("hk") * F.col("dmean")
    total = F.col("n") + F.col("hk")
    mean = a / total
    return hosts.select("host", (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("low"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], limit: float = 0.5, z: float = 1.0, key: str = "page_id",
               url: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    A NULL url or one without ``://`` has an empty host and path; it fits no rule and is judged by
    the reputation of the empty host. ``rules`` is a short written list and becomes one expression, as is
    ``suffixes``, the suffixes of two labels under which names are registered (any last label is one as well).
    Without any labelled page the bound follows from the share 1/2 and pages are allowed. Counts
    are added up by host before they are shuffled; only urls and keys move. Repeated rows and NULL
    keys are judged like any other; other columns are not read.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    cut = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    marked = cut.select(
        "*", first_fit(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"),
        first_fit(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("ruled"),
    )
    outcomes = marked.select("host", (F.col("ruled") == "block").cast("int").alias("outcome"))
    low = reputations(outcomes, z, suffixes)
    verdict = F.coalesce("ruled", F.when(F.col("low") >= limit, F.lit("block")).otherwise(F.lit("allow")))
    return marked.join(low, "host", "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"))
