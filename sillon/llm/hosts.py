"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. Beta-binomial priors are fitted by the method of moments, level
by level: hosts of a registered domain share the domain's posterior mean, domains of a suffix the suffix's, suffixes the
overall rate. A suffix is the longest that a table of public suffixes names, else a host's last label; a registered domain
is a suffix and one label more. Ports, user names and last dots play no part in levels; an address of numbers is its own
domain and suffix. The more alike the units of a level behave, the heavier its prior. A host's posterior is a beta
distribution; a host is blocked if even the lower bound of its bad share, at ``Z`` standard deviations, is above
``LIMIT``. Hosts without outcomes are judged by their domain's posterior, domains without outcomes by the suffix's.

Rules (host, path) come first: a rule fits its host and all subdomains where the url's path starts with the rule's; the
longest wins.

Counts are summed where rows are read before they are shuffled, so that a host with a third of all pages is one row for
each task; the joins back deal frequent hosts and domains over several tasks. Each level is written once; the overall rate
and the prior of suffixes are single numbers.

Cases: a null url, or one without ``://``, has an empty host and path; the empty host has the overall reputation; pages
without outcome count for nothing; without any outcome all are allowed; repeated rows are judged each, and count each;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, materialize

#: Fixed value: the rules of the registered query, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A host is blocked where the lower bound of its bad share is above this.
LIMIT = 0.4
#: Standard deviations from posterior mean to bound.
Z = 1.0
#: Suffixes of several labels under which sites of different owners are registered. A longer table may be given.
PUBLIC_SUFFIXES = tuple(
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.sa com.sg "
    "com.tr com.tw com.ua com.vn edu.au edu.cn go.jp gov.au gov.br gov.cn gov.in gov.uk govt.nz me.uk ne.jp net.au net.br net.cn net.nz or.jp or.kr org.au org.br org.cn org.in org.nz org.uk org.za".split()
)
#: Least and greatest weight of a prior, in pages.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to the next of / ? #, with A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to the next of ? #; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer one replaces a shorter one
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def levels_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> tuple[Column, Column]:
    """A host's registered domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    by_labels: dict[int, list[str]] = {}
    for x in suffixes:
        by_labels.setdefault(x.count(".") + 1, []).append(x)
    labels = F.lit(1)
    for n in sorted(by_labels):  # a longer one replaces a shorter one
        labels = F.when(F.substring_index(name, ".", -n).isin(by_labels[n]), F.lit(n)).otherwise(labels)
    address = name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    parts = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")
    return F.when(address, name).otherwise(last(labels + 1)), F.when(address, name).otherwise(last(labels))


def _moments(mean: Column) -> list[Column]:
    """Sums over units of n pages, bad of them, and their shared mean."""
    return [
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum("n").alias("N"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        # sum n (p - m)**2, for p = bad / n
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s2"),
        F.sum("bad").alias("s1"),
        F.first(mean).alias("m"),
    ]


def _weight() -> Column:
    """The prior weight of units, from their moments.

    For units of n pages with bad share p, E[sum n (p - m)**2] = (k - 1) m (1 - m) + (N - sum n**2 / N) m (1 - m) /
    (weight + 1), with k units of N pages together.
    """
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("s2") - 2 * F.col("m") * F.col("s1") + F.col("m") * F.col("m") * F.col("N") - (F.col("k") - 1) * spread
    share = between / F.nullif((F.col("N") - F.col("nn") / F.col("N")) * spread, F.lit(0.0))
    return F.when(share > 0, F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(PRIOR_LEAST), 1 / share - 1))).otherwise(F.lit(PRIOR_MOST))


def _bound(alpha: Column, beta: Column, z: float) -> Column:
    """The lower bound of a beta distribution's mean."""
    mean = alpha / (alpha + beta)
    return mean - z * F.sqrt(mean * (1 - mean) / (alpha + beta + 1))


def reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Verdicts of hosts, domains and suffixes, and overall, from columns host and bad (0 or 1).

    Each table has its key (host, domain, suffix), alpha and beta of the posterior, and blocked.
    """
    domain, suffix = levels_of(F.col("host"), suffixes)
    hosts = outcomes.filter("bad is not null").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    summed = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialize(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *summed), "domains")
    units = materialize(domains.groupBy("suffix").agg(*summed), "suffixes")
    total = units.agg(*summed).first()
    rate = float(total.bad / total.n) if total.n else 0.0

    def posterior(given: DataFrame, key: str) -> DataFrame:
        alpha, beta = F.col("m") * F.col("w") + F.col("bad"), (1 - F.col("m")) * F.col("w") + F.col("n") - F.col("bad")
        out = given.select(key, alpha.alias("alpha"), beta.alias("beta"))
        return materialize(out.withColumn("blocked", _bound(F.col("alpha"), F.col("beta"), z) > limit), f"of_{key}")

    def below(of_above: DataFrame, parts: DataFrame, by: str, key: str) -> DataFrame:
        """The posteriors of the units of a level, from those of the level above."""
        sizes = materialize(parts.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "sizes")
        mean = of_above.select(by, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
        given = materialize(dealt_join(parts, mean, by, key, sizes), "given")
        weights = given.groupBy(by).agg(*_moments(F.col("m"))).select(by, _weight().alias("w"))
        return posterior(dealt_join(given, weights, by, key, sizes), key)

    weight = units.agg(*_moments(F.lit(rate))).select(_weight().alias("w")).first().w
    of_suffix = posterior(units.withColumn("m", F.lit(rate)).withColumn("w", F.lit(float(weight))), "suffix")
    of_domain = below(of_suffix, domains, "suffix", "domain")
    of_host = below(of_domain, hosts.select("host", "domain", "n", "bad"), "domain", "host")
    bound = outcomes.sparkSession.range(1).select(_bound(F.lit(float(total.bad)), F.lit(float(total.n - total.bad)), z) > limit).first()[0] if total.n else False
    return of_host, of_domain, of_suffix, bool(bound)


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> DataFrame:
    """Columns ``key``, host, path, rule, verdict for each row of ``pages``; ``outcomes`` has columns host and bad."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    read = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hosts, domains, of_suffix, overall = reputation(outcomes, limit, z, suffixes)
    met = materialize(read.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "met")
    domain, suffix = levels_of(F.col("host"), suffixes)
    blocked = F.coalesce("b1", "b2", "b3", F.lit(overall))
    placed = met.withColumn("domain", domain).withColumn("suffix", suffix).join(hosts.select("host", F.col("blocked").alias("b1")), "host", "left")
    # several hosts share a domain and many a suffix: verdicts of domains take their suffix's first, then hosts their domain's
    above = placed.select("domain", "suffix").distinct().join(of_suffix.select("suffix", F.col("blocked").alias("b3")), "suffix", "left").drop("suffix")
    above = materialize(above.join(domains.select("domain", F.col("blocked").alias("b2")), "domain", "left"), "above")
    sizes = placed.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    judged = dealt_join(placed.drop("n", "suffix"), above, "domain", "host", sizes).select("host", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("reputed"))
    found = dealt_join(read.withColumn("rule", text).withColumn("ruled", verdict), materialize(judged, "judged"), "host", "k", met)
    return found.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("ruled", "reputed").alias("verdict"))
