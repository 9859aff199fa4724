"""URL filter by empirical-Bayes host reputation, under explicit rules.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. At each level a
beta prior, whose strength comes from the spread between that level's groups (beta-binomial moments), shrinks
the counts towards the level above: suffix towards all pages, domain towards its suffix, host towards its
domain. A host whose lower posterior bound of the bad rate passes the limit is blocked. Rules go first.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is judged as
the empty host; unlabelled hosts take their parents' posterior; ties between equally long rules cannot occur, as
both would be the same rule; repeated rows are judged each; no labels at all give the mean 0 and so `allow`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered, with a two-letter country label after them.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased, the path up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered(host: Column) -> tuple[Column, Column]:
    """(domain, suffix): the last label, or two for names such as co.uk, and one label more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    k = F.when(n < 2, 1).when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(labels, F.greatest(n - m + 1, F.lit(1)), F.least(m, n)), ".")
    return F.when(n < 2, host).otherwise(tail(k + 1)), F.when(n < 2, host).otherwise(tail(k))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. rules: (verdict, host + path) pairs."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for what, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, below = r.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + below))
        rule, verdict = rule.when(fits, F.lit(r)), verdict.when(fits, F.lit(what))
    return rule, verdict


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior's strength M at a level, from how far the groups' rates spread around the mean rate."""
    total = groups.agg(F.sum("n").cast("double").alias("t"), F.sum("bad").cast("double").alias("b"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.count("*").cast("double").alias("k"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("bb"))
    p = F.coalesce(F.try_divide("b", "t"), F.lit(0.0))
    var = p * (1 - p)
    spread = F.col("bb") - p * F.col("b")
    rho = F.try_divide(spread - var * (F.col("k") - 1), var * (F.col("t") - F.try_divide("nn", "t") - (F.col("k") - 1)))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.0001)), F.lit(0.5))
    return total.select(((1 - rho) / rho).alias(name))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(host, mean, bound, bad_host) for every host of `hosts` (host); outcomes: (host, bad 0/1).

    Host counts are partial sums before the shuffle, written once; all levels above are made from them.
    """
    seen = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    h = hosts.select("host").distinct().join(seen, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    domain, suffix = registered(F.col("host"))
    h = written(h.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    d = written(h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = s.agg(F.coalesce(F.try_divide(F.sum("bad").cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("p0"))
    one = everything
    for level, name in ((s, "ms"), (d, "md"), (h, "mh")):
        one = one.crossJoin(F.broadcast(_strength(level.where("n > 0"), name)))  # one row each
    shrunk = lambda prior, m: (F.col("bad") + F.col(m) * F.col(prior)) / (F.col("n") + F.col(m))
    s = s.crossJoin(F.broadcast(one)).withColumn("ps", shrunk("p0", "ms")).drop("n", "bad")
    d = d.join(s, "suffix").withColumn("pd", shrunk("ps", "md")).select("domain", "suffix", "pd", "mh")
    h = h.join(d, ["domain", "suffix"]).withColumn("mean", shrunk("pd", "mh"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("mh") + 1))
    return h.select("host", "n", "bad", "mean", bound.alias("bound")).withColumn("bad_host", F.round("bound", 9) > limit)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, labelled, bad, mean, bound) for every page, the last four its host's; labels: (page_id, bad 0/1).

    Only page_id and url are read. The join with the hosts' table may meet a hot host: adaptive execution
    splits its pages, since only the small side needs all of a key.
    """
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = p.select("page_id", "host").join(labels.select("page_id", "bad").where("bad is not null"), "page_id").select("host", "bad")
    rep = host_reputation(outcomes, p, limit, z).select("host", F.col("n").alias("labelled"), "bad", "mean", "bound", "bad_host")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return p.join(rep, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "labelled", "bad", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))
