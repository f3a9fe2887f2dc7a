"""URL filters: rules first, then the reputation of the host.

Labelled page outcomes give bad and all counts of a host, its registered domain
and its suffix. Each level is a beta-binomial whose prior mean is the posterior
mean of the level above and whose strength is fitted by moments, so a host with
few outcomes is drawn to its domain and that to its suffix. A host is blocked
when the lower bound of its posterior passes the limit.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.session import cut_lineage

LIMIT = 0.4
Z = 1.645


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


# Fixed values of the query.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. The rules are
    parameters, so few, and become one ordered conditional."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def strength(groups: DataFrame) -> float:
    """Prior strength of a level from counts n and y of its groups, by moments:
    how far the groups' shares differ beyond chance."""
    seen = groups.where("n > 0").agg(
        F.sum("n").cast("double").alias("n"), F.sum("y").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("y").cast("double") * F.col("y") / F.col("n")).alias("yy")).first()
    if not seen["n"]:
        return 1.0
    p = seen["y"] / seen["n"]
    room = seen["n"] - seen["nn"] / seen["n"] - (seen["g"] - 1)
    if p <= 0 or p >= 1 or room <= 0:
        return 1.0
    spread = (seen["yy"] - seen["y"] * p) / (p * (1 - p))
    rho = min(max((spread - (seen["g"] - 1)) / room, 0.001), 0.999)
    return (1 - rho) / rho


def host_reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, y, mean, low from rows (host, bad: true, false or null) of every
    page; a null outcome counts for nothing but its host is listed."""
    hosts = cut_lineage(outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("y")).withColumns({
            "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)}))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("y").alias("dy")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dy").alias("sy")))
    total = suffixes.agg(F.sum("sn").alias("n"), F.sum("sy").alias("y")).first()
    share = total["y"] / total["n"] if total["n"] else 0.0
    ks = strength(suffixes.select(F.col("sn").alias("n"), F.col("sy").alias("y")))
    kd = strength(domains.select(F.col("dn").alias("n"), F.col("dy").alias("y")))
    kh = strength(hosts.select("n", "y"))
    suffixes = suffixes.select("suffix", ((F.col("sy") + ks * share) / (F.col("sn") + ks)).alias("sm"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("dy") + kd * F.col("sm")) / (F.col("dn") + kd)).alias("dm"))
    mean = (F.col("y") + kh * F.col("dm")) / (F.col("n") + kh)
    return hosts.join(domains, "domain").withColumn("mean", mean).select(
        "host", "n", "y", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + kh + 1))).alias("low"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A page's outcome is bad when the label of its id says quality 0 or toxic 1;
    conflicting labels of an id count as bad if any does. A null url has an empty
    host. Repeated rows are judged alike; an empty table gives an empty result;
    without labels the method allows all.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = (labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")))
    # A page that a rule decides still tells about its host.
    reputations = host_reputations(split.select("page_id", "host").join(known, "page_id", "left"), z)
    blocked = cut_lineage(reputations.where(F.col("low") > limit).select("host", F.lit(True).alias("_low")))
    name, decided = matching_rule(F.col("host"), F.col("path"), rules)
    return split.join(blocked, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(decided, F.when(F.col("_low"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
