"""URL filters: rules by host and path, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.  Each level's
rate is shrunk towards its parent's by a beta-binomial prior whose strength is fitted by moments over the level's groups, from
the whole table down: suffix, domain, host.  A page is blocked when the lower posterior bound of its host's bad rate exceeds a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Two-label public suffixes beside the plain last label (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Block when mean - WIDTH * deviation of the posterior bad rate is above LIMIT.
LIMIT, WIDTH = 0.5, 1.645
#: Rules up to this many are evaluated as one expression, more as a table that host endings are joined with.
EXPRESSED = 200


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://; A-Z of the host lower-cased; both empty for a null url or one without ://."""
    both = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, both, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, both, 2), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (like "example.net/en/" -> "allow") that fits, else nulls; ties to the first by name."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        which, verdict = F.when(fits, F.lit(r)).otherwise(which), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return which, verdict


def rule_table(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rows (host, path, ...) with rule and verdict as rule() finds them, for any number of rules.

    Distinct pairs of host and path meet the rules of every ending of the host by an equi-join, and the longest that fits stays.
    """
    table = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules.items()]
    table = rows.sparkSession.createDataFrame(table, "ending string, start string, rule string, verdict string")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    some = rows.select("host", "path").distinct().withColumn("ending", F.explode(endings)).join(table, "ending").where(F.col("path").startswith(F.col("start")))
    best = some.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    return rows.join(best.select("host", "path", "best.rule", "best.verdict"), ["host", "path"], "left")


def domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host: the last label, or the last two behind a two-letter country code."""
    bare = F.regexp_replace(host, r":\d*$", "")
    suffix = F.regexp_extract(bare, rf"((?:(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})|(?:(?:^|\.)[^.]*))$", 1)
    suffix = F.regexp_replace(suffix, r"^\.", "")
    own = F.regexp_extract(F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix)), r"([^.]*\.)$", 1)
    return F.concat(own, suffix), suffix


def _strength(groups: DataFrame, mean: str) -> float:
    """Moment estimate of a + b of the beta prior over groups (n, bad) around their parents' mean; between 1 and 1000."""
    var = F.col(mean) * (1 - F.col(mean))
    r = groups.where((F.col("n") > 0) & (var > 0)).agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col(mean), 2) / var - F.col("n")).alias("over"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")
    ).first()
    if not r or not r["pairs"] or r["over"] is None:
        return 10.0
    rho = r["over"] / r["pairs"]  # correlation of two outcomes of a group: 1 / (a + b + 1)
    return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad: one row a host) with domain, suffix, rate, deviation: the posterior of the host's bad rate."""
    d, s = domain(F.col("host"))
    hosts = hosts.withColumn("domain", d).withColumn("suffix", s)
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total["bad"] + 1.0) / (total["n"] + 2.0)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(mean))
    k = _strength(suffixes, "prior")
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    domains = domains.join(suffixes, "suffix")
    k = _strength(domains, "prior")
    domains = domains.select("domain", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    hosts = hosts.join(domains, "domain")
    k = _strength(hosts, "prior")
    a, b = F.col("bad") + k * F.col("prior"), F.col("n") - F.col("bad") + k * (1 - F.col("prior"))
    return hosts.withColumn("rate", a / (a + b)).withColumn("deviation", F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], limit: float = LIMIT, width: float = WIDTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate): a row for every row of pages (page_id, url).

    outcomes: page_id, bad boolean; null or unmatched: unlabelled.  The longest fitting rule decides, else "block" when the lower
    bound of the host's posterior exceeds limit, "allow" otherwise.  Null urls have an empty host, judged like any other.  Several outcomes
    of a page all count; repeated pages are each judged.  Other columns are ignored.
    """
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) > EXPRESSED:
        rows = rule_table(rows, rules)
    else:
        which, verdict = rule(F.col("host"), F.col("path"), rules)
        rows = rows.withColumn("rule", which).withColumn("verdict", verdict)
    seen = outcomes.where("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    labelled = rows.join(seen, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = reputation(durable(labelled, "hosts")).select("host", "rate", "deviation")
    method = F.when(F.col("rate") - width * F.col("deviation") > limit, "block").otherwise("allow")
    return rows.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "rate")
