"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and public
suffix.  Each level's counts are shrunk by a beta prior whose mean is the posterior mean
of the level above (suffix to all data, domain to suffix, host to domain) and whose
weight is estimated from all groups of the level by the method of moments; it is never more
than ten outcomes or an average labelled group's, whichever is more, as groups could else never speak for
themselves where the estimate finds no spread.  A page is blocked if the lower bound of its host's bad rate
(mean less ``z`` standard deviations of the posterior) exceeds ``lift`` times the overall rate.
List rules come first: the longest rule that fits host and path decides.

Public suffixes: the rules in ``suffixes`` (as the public list has them, with ``*.`` and ``!``) if given;
else ``SECOND_LEVEL`` under a country code, ``HOSTING``, and any last label.  A host that is an address is a
domain of its own, under one suffix with all addresses.

Counts combine before they are shuffled; hosts without labels get their domain's,
suffix's or the overall prior.  A host that holds a third of all pages meets one row
of statistics, which adaptive execution splits.

Edges: null urls and urls without ``://`` have empty host and path; user names, ports
and brackets stay in the reported host but not in its domain; rows with a null page_id
are left out; null outcomes don't count; repeated rows are judged alike and their
labels each count; extra columns are not read; without any label, nothing is blocked but by rule; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: (rule, verdict); a rule is host + path (fixed values).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Second-level labels that are public under a country code (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Domains whose subdomains belong to their users (fixed values).
HOSTING = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
#: The suffix of addresses.
ADDRESS = "address"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(empty), F.when(has, path).otherwise(empty)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (null if none) and its verdict.  The rule list is part of the program: bounded."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule, verdict = None, None
    for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        h, p = r.split("/", 1)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def host_name(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def is_address(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"))


def domain_suffix(name: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host's name, by the built-in rules."""
    two = F.substring_index(name, ".", -2)
    second, last = F.substring_index(two, ".", 1), F.substring_index(name, ".", -1)
    double = two.isin(*HOSTING) | (F.rlike(last, F.lit("^[a-z]{2}$")) & second.isin(*SECOND_LEVEL) & F.contains(two, F.lit(".")))
    domain = F.when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(is_address(name), name).otherwise(domain), F.when(is_address(name), ADDRESS).when(double, two).otherwise(last)


def listed_suffixes(hosts: DataFrame, suffixes: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``hosts`` (with host) with domain and suffix by a table of rules (column ``rule``).

    Of the rules that fit a name an exception wins, then the longest; its last label is public if none fits.
    The table is broadcast up to ``broadcast_rows`` counted rules, else shuffled.
    """
    labels = F.split("name", r"\.")
    name = host_name(F.col("host"))
    tails = hosts.select("host", name.alias("name")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size(labels))))
    tail = F.array_join(F.slice(labels, F.size(labels) - F.col("n") + 1, F.col("n")), ".")
    star = F.concat(F.lit("*."), F.array_join(F.slice(labels, F.size(labels) - F.col("n") + 2, F.col("n") - 1), "."))
    keys = tails.select("host", "name", F.explode(F.array(
        F.struct(tail.alias("rule"), F.col("n").alias("length"), F.lit(0).alias("exception")),
        F.struct(F.when(F.col("n") > 1, star).alias("rule"), F.col("n").alias("length"), F.lit(0).alias("exception")),
        F.struct(F.concat(F.lit("!"), tail).alias("rule"), (F.col("n") - 1).alias("length"), F.lit(1).alias("exception")),
    )).alias("k")).select("host", "name", "k.*")
    rules = suffixes.select(F.lower("rule").alias("rule")).filter("rule IS NOT NULL").distinct()
    if rules.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rules = F.broadcast(rules)
    best = keys.join(rules, "rule").groupBy("host").agg(F.max(F.struct("exception", "length"))["length"].alias("length"))
    out = hosts.join(best, "host", "left").withColumn("name", name).withColumn("length", F.coalesce("length", F.lit(1)))
    domain, suffix = (F.expr(f"substring_index(name, '.', -(length + {extra}))") for extra in (1, 0))
    address = is_address(F.col("name"))
    return out.withColumns({"domain": F.when(address, F.col("name")).otherwise(domain), "suffix": F.when(address, ADDRESS).otherwise(suffix)}).drop("name", "length")


def _weight(groups: DataFrame) -> float:
    """The weight of the prior, from the spread of the groups' rates around their prior means.

    Var(rate) = m(1-m)/n + m(1-m)(1-1/n)/(weight+1); solved for the weight, at least 1, at most ten or the groups' mean n.
    """
    w, rate, prior = F.col("prior") * (1 - F.col("prior")), F.col("bad") / F.col("n"), F.col("prior")
    sums = groups.filter("n > 0").agg(
        F.sum((rate - prior) * (rate - prior)).alias("seen"), F.sum(w / F.col("n")).alias("noise"), F.sum(w * (1 - 1 / F.col("n"))).alias("room"), F.avg("n").alias("mean")
    ).first()
    most = max(10.0, float(sums["mean"] or 0.0))
    if not sums["room"] or sums["seen"] <= sums["noise"]:
        return most
    return min(max(sums["room"] / (sums["seen"] - sums["noise"]) - 1, 1.0), most)


def _level(counts: DataFrame, label: str) -> DataFrame:
    """counts (n, bad, prior) with the posterior's mean and total."""
    counts = cut(counts, label)
    weight = F.lit(_weight(counts))
    return counts.withColumn("mean", (F.col("bad") + F.col("prior") * weight) / (F.col("n") + weight)).withColumn("total", F.col("n") + weight)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = 1.0, lift: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_low of every page.

    pages: page_id, url; outcomes: page_id, bad (0 or 1, null: unknown); suffixes: rule.
    """
    host, path = host_path(F.col("url"))
    rule, listed = rule_column(F.col("host"), F.col("path"), rules)
    own = (
        pages.filter(F.col("page_id").isNotNull())
        .select("page_id", host.alias("host"), path.alias("path"))
        .select("page_id", "host", "path", rule.alias("rule"), listed.alias("listed"))
    )
    labels = outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    totals = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    counted = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "bad")]
    hosts = own.select("page_id", "host").join(labels, "page_id", "left").groupBy("host").agg(*counted)
    domain, suffix = domain_suffix(host_name(F.col("host")))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix}) if suffixes is None else listed_suffixes(cut(hosts, "url-counts"), suffixes)
    hosts = cut(hosts, "url-hosts")
    overall = hosts.agg(*totals).first()
    # one outcome, bad by a twentieth, is added to all data
    overall_rate = float(((overall["bad"] or 0) + 0.05) / ((overall["n"] or 0) + 1.0))
    overall_mean, limit = F.lit(overall_rate), lift * overall_rate
    suffixes = _level(hosts.groupBy("suffix").agg(*totals).withColumn("prior", overall_mean), "url-suffixes")
    above = suffixes.select("suffix", F.col("mean").alias("prior"))
    domains = _level(hosts.groupBy("suffix", "domain").agg(*totals).join(above, "suffix"), "url-domains")
    above = domains.select("suffix", "domain", F.col("mean").alias("prior"))
    stats = _level(hosts.join(above, ["suffix", "domain"]), "url-host-rates")
    mean, total = F.col("mean"), F.col("total")
    low = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (total + 1))
    stats = stats.select("host", mean.alias("bad_mean"), low.alias("bad_low"))
    return own.join(stats, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.when(F.col("bad_low") > limit, "block").otherwise("allow")).alias("verdict"),
        "bad_mean",
        "bad_low",
    )
