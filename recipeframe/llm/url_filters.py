"""Host reputation by empirical Bayes, and URL rules that come before it.

Labelled pages tell how often a host's pages are bad. A rate from few pages is
shrunk towards its registered domain's, that towards its suffix's, and that
towards the rate of all pages, by beta-binomial priors. A prior's strength comes
from the data: the more the units of a level differ beyond chance, the weaker.
A host is blocked if even the lower bound of its posterior rate, a quantile of
the beta distribution (or the mean, if that is lower), is too high, so a host with few labels is never blocked by
bad luck. Too high means ``limit_ratio`` times the rate of all labelled pages.

Which suffixes have two labels is a table (``suffixes``, short or of any size); a
two-label ending also counts as one where the pages show it: at least
``suffix_domains`` different names stand below it, none of which has more than
``suffix_share`` of its hosts.

All counting is by aggregates that combine before they shuffle; a host with a
third of all pages is looked up from a broadcast of at most a thousand hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.shared import hot_keys, lookup_join, materialize

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels that are known without a table; fixed values.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class ReputationParameters:
    below: float = 0.1  # probability that a rate is below its lower bound
    limit_ratio: float = 2.0  # least bad rate that is blocked, in rates of all labelled pages
    most_limit: float = 0.95  # and where that is more than this: this
    least_correlation: float = 0.001
    most_correlation: float = 0.5
    suffixes: tuple = TWO_LABELS
    suffix_domains: int = 1000
    suffix_share: float = 0.05


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z in lower case; empty if there is none."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #``."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def split_urls(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` to rows with ``url``; null urls have both empty."""
    own = pages.withColumn("url", F.coalesce(F.col("url"), F.lit("")))
    return own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def host_rules(hosts: DataFrame, rules=RULES) -> DataFrame:
    """``host, rules``: the rules whose host is each host or above it, the longest first; any number of rules."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(h, p, h + p, kind) for kind, h, p in rules], "above string, path string, rule string, kind string")
    labels = F.split("host", "[.]")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("above"))
    met = above.distinct().join(F.broadcast(table) if len(rules) <= 100_000 else table, "above")
    longest = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("size"), (-F.length("above")).alias("of_host"), "path", "rule", "kind")))
    return met.groupBy("host").agg(longest.alias("rules"))


def beta_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The beta distribution's probability of values below ``x`` (0 < x < 1), by its continued fraction."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64))
    x = np.broadcast_to(np.asarray(x, dtype=np.float64), a.shape)
    turn = x > (a + 1) / (a + b + 2)  # there the fraction for the other tail is the fast one
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[np.float64])
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p if a.size else np.zeros(a.shape)
    tiny, c = 1e-300, np.ones_like(p)
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 1000):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + top * d), safe(1 + top / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.clip(np.where(turn, 1 - front * h, front * h), 0, 1)


def beta_quantile(below: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The value that a beta variable is below with probability ``below``."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(52):
        mid = (low + high) / 2
        less = beta_below(mid, a, b) < below
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def _bounds(batches, below: float):
    for b in batches:
        a, rest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b"))
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.minimum(beta_quantile(below, a, rest), a / (a + rest)))], names=[*b.schema.names[:5], "bound"])


def _strength(groups: DataFrame, p: ReputationParameters) -> tuple[float, float, float]:
    """Strength of the prior that the groups of a level share, and the level's ``k`` and ``n``."""
    own = groups.filter("n > 0")
    sums = own.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    k, n, g = float(sums["k"] or 0), float(sums["n"] or 0), sums["g"]
    if not n:
        return 1.0, 0.0, 0.0
    rate = k / n
    noise = rate * (1 - rate)
    spread = float(sums["kk"]) - n * rate * rate  # sum of n (k/n - rate)^2
    room = noise * (n - float(sums["nn"]) / n - (g - 1))
    r = (spread - (g - 1) * noise) / room if room > 0 else p.least_correlation
    r = min(max(r, p.least_correlation), p.most_correlation)
    return (1 - r) / r, k, n


def reputation(pages: DataFrame, p: ReputationParameters | None = None) -> DataFrame:
    """Posterior of each host: ``host, n_pages, n, k, mean, bound``, and the ``limit`` that all share.

    ``pages`` has ``host`` and ``bad`` (1, 0, or null for pages without a label).
    Hosts without labels have their domain's posterior mean and the prior's width.
    """
    p = p or ReputationParameters()
    hosts = pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    hosts = materialize(hosts.withColumn("labels", F.split(bare, "[.]")).withColumn("two", F.array_join(F.slice("labels", -F.least(F.size("labels"), F.lit(2)), F.lit(2)), ".")), "hosts")
    long = _two_label_suffixes(hosts, p).withColumn("long", F.lit(True))
    if long.count() <= 100_000:  # a checked size
        long = F.broadcast(long)
    size = F.when(F.col("long") & (F.size("labels") >= 2), 2).otherwise(1)
    hosts = hosts.join(long, "two", "left").withColumn("size", size)
    last = lambda n: F.array_join(F.slice("labels", -F.least(F.size("labels"), n), n), ".")
    hosts = hosts.select("host", "n_pages", "n", "k", last(F.col("size")).alias("suffix"), last(F.col("size") + 1).alias("domain"))
    hosts = materialize(hosts, "domains-of-hosts")
    domains = materialize(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("members")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("members"))
    s_suffix, k, n = _strength(suffixes, p)
    s_domain, s_host = _strength(domains, p)[0], _strength(hosts, p)[0]
    top = (k + 0.5) / (n + 1)
    suffix_mean = suffixes.select("suffix", ((F.col("k") + s_suffix * top) / (F.col("n") + s_suffix)).alias("prior"))
    domain_mean = lookup_join(domains, suffix_mean, "suffix", hot_keys(suffixes, "suffix", "members"))
    domain_mean = domain_mean.select("domain", ((F.col("k") + s_domain * F.col("prior")) / (F.col("n") + s_domain)).alias("prior"))
    full = lookup_join(hosts, domain_mean, "domain", hot_keys(domains, "domain", "members"))
    a, total = F.col("k") + s_host * F.col("prior"), F.col("n") + s_host
    rows = full.select("host", "n_pages", "n", "k", (a / total).alias("mean"), a.alias("_a"), (total - a).alias("_b"))
    bounds = rows.mapInArrow(lambda it: _bounds(it, p.below), "host string, n_pages long, n long, k long, mean double, bound double")
    return bounds.withColumn("limit", F.lit(min(p.limit_ratio * top, p.most_limit)))


def _two_label_suffixes(hosts: DataFrame, p: ReputationParameters) -> DataFrame:
    """``two``: the endings of two labels that are suffixes, by the table or by what stands below them."""
    known = hosts.sparkSession.createDataFrame([(x,) for x in p.suffixes], "two string")
    below = hosts.filter("size(labels) > 2").groupBy("two", F.expr("labels[size(labels) - 3]").alias("name")).agg(F.count("*").alias("n"))
    seen = below.groupBy("two").agg(F.count("*").alias("names"), F.max("n").alias("most"), F.sum("n").alias("n"))
    seen = seen.filter((F.col("names") >= p.suffix_domains) & (F.col("most") <= p.suffix_share * F.col("n")))
    return known.unionByName(seen.select("two")).distinct()


def judge(pages: DataFrame, outcomes: DataFrame, p: ReputationParameters | None = None, rules=RULES) -> DataFrame:
    """A verdict on every page: ``page_id, host, path, rule, verdict``.

    ``outcomes`` has ``page_id`` and ``bad`` (the larger counts if an id repeats).
    The longest fitting rule decides; else the host is blocked if its posterior's
    lower bound is at least the limit. Null urls and urls without ``://`` belong to
    the empty host, which is judged like any other. Repeated rows and null ids
    give a row each; a null id has no outcome. An empty table gives an empty result.
    """
    p = p or ReputationParameters()
    own = split_urls(pages.select("page_id", "url")).drop("url")
    labelled = own.join(outcomes.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    known = materialize(reputation(labelled, p), "reputation")
    known = materialize(known.join(host_rules(known.select("host"), rules), "host", "left"), "judged-hosts")
    found = lookup_join(own, known.select("host", "bound", "limit", "rules"), "host", hot_keys(known, "host", "n_pages"))
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    by_host = F.when(F.col("bound") >= F.col("limit"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", first["rule"].alias("rule"), F.coalesce(first["kind"], by_host).alias("verdict"))
