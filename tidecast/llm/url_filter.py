"""URL filter: allow and block rules, and for the other pages an empirical-Bayes reputation of their host.

Labelled outcomes (1 bad, 0 good; by default what the rules say of the pages they fit) are counted per host, registered
domain and public suffix. Each level is a beta-binomial whose prior mean is the posterior mean of the level above and
whose prior strength comes from the spread of the rates at that level (method of moments). A page that no rule fits is
blocked if the lower bound of its host's posterior (mean - z standard deviations of the beta) passes a threshold.

DataFrame operations only. Counts combine before the shuffle, so a hot host costs a row per task; the host table is
written, so its join with the pages is one that Spark splits at a hot host, or a broadcast where Spark finds it small.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the reputation of
the empty host; a null outcome is no outcome; equal pages are judged alike; without any outcome nothing is blocked; of
rules of equal length that fit, the last in order wins; a very long url is one text like any other; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import written

#: (action, host, path). A rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels; every other suffix is the last label. Fixed values, to be replaced by the caller's list.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.za")
#: Posterior bound: block from this lower bound on, so many standard deviations below the mean.
THRESHOLD, Z = 0.5, 1.645
#: Correlation of outcomes within a unit: its range, and its value where the data can't tell.
LEAST, MOST, DEFAULT = 0.01, 0.9, 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, else nulls. Rules become one expression: for lists of some hundreds."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def with_levels(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Adds the registered domain and the public suffix of ``host``."""
    bare = F.regexp_replace("host", r":\d*$", "")
    labels = F.split(bare, r"\.")
    last = F.element_at(labels, -1)
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    compound = two.isin(*suffixes)
    number = bare.rlike(r"^[0-9.]+$|^\[")
    return (hosts.withColumn("domain", F.when(number, F.col("host")).when(compound, three).otherwise(two))
            .withColumn("suffix", F.when(number, F.lit("")).when(compound, two).otherwise(last)))


def _strength(rates: DataFrame) -> float:
    """Prior strength of a level from rows (n, k, mean of the parent), by the method of moments: one number."""
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), 2))
    noise = F.sum(F.col("parent") * (1 - F.col("parent")))
    most = F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent")))
    row = rates.where("n > 0").agg(F.count("*").alias("units"), F.try_divide(spread - noise, most - noise).alias("rho")).first()
    rho = DEFAULT if row["units"] < 2 or row["rho"] is None else min(max(row["rho"], LEAST), MOST)
    return (1 - rho) / rho


def _shrunk(rates: DataFrame) -> DataFrame:
    """Adds the posterior mean: counts of the unit on top of ``strength`` outcomes at the parent's mean."""
    strength = F.lit(_strength(rates))
    mean = (F.col("k") + strength * F.col("parent")) / (F.col("n") + strength)
    return rates.withColumns({"strength": strength, "mean": mean})


def reputations(outcomes: DataFrame, suffixes=SUFFIXES, z: float = Z) -> DataFrame:
    """(host, mean, bound) for every host of ``outcomes`` (host, bad): rows with a null ``bad`` only name their host."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(with_levels(counts, suffixes), "hosts")
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    # without any outcome this is a half, with a bound far below it
    overall = F.lit((total["k"] + 0.5) / (total["n"] + 1.0))
    top = _shrunk(hosts.groupBy("suffix").agg(*add).withColumn("parent", overall))
    middle = _shrunk(hosts.groupBy("domain", "suffix").agg(*add).join(top.select("suffix", F.col("mean").alias("parent")), "suffix"))
    bottom = _shrunk(hosts.join(middle.select("domain", "suffix", F.col("mean").alias("parent")), ["domain", "suffix"]))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return bottom.select("host", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - z * deviation, 6).alias("bound"))


def judge(pages: DataFrame, rules=RULES, outcomes: DataFrame | None = None, suffixes=SUFFIXES, z: float = Z,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, bad_rate, bad_bound.

    ``outcomes`` (host, bad) replaces the rules' own verdicts as what hosts are judged by.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, action = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", name.alias("rule"), action.alias("action"))
    seen = ruled.select("host", F.when(F.col("action").isNotNull(), (F.col("action") == "block").cast("long")).alias("bad"))
    if outcomes is not None:
        seen = ruled.select("host", F.lit(None).cast("long").alias("bad")).unionByName(outcomes.select("host", F.col("bad").cast("long")))
    known = written(reputations(seen, suffixes, z), "reputations")
    found = F.when(F.col("bound") >= threshold, "block").otherwise("allow")
    return ruled.join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("action", found).alias("verdict"),
                                            F.col("mean").alias("bad_rate"), F.col("bound").alias("bad_bound"))


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _level(name: str, keys: str, source: str) -> str:
    return f"""
{name}_s AS (SELECT CASE WHEN count(*) FILTER (n > 0) > 1 THEN least(greatest(coalesce(
      (sum(n * pow(k / n - parent, 2)) FILTER (n > 0) - sum(parent * (1 - parent)) FILTER (n > 0))
      / nullif(sum(n * parent * (1 - parent)) FILTER (n > 0) - sum(parent * (1 - parent)) FILTER (n > 0), 0), {DEFAULT}e0), {LEAST}e0), {MOST}e0) ELSE {DEFAULT}e0 END AS rho FROM {source}),
{name} AS (SELECT {keys}, n, k, (1 - rho) / rho AS strength, (k + (1 - rho) / rho * parent) / (n + (1 - rho) / rho) AS mean FROM {source}, {name}_s)"""


SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(act, h, pa) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT page_id, host, path, h || pa AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pa) DESC) AS n
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa)),
j AS (SELECT p.page_id, p.host, p.path, m.rule, m.act FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1),
c AS (SELECT host, CAST(count(act) AS DOUBLE) AS n, CAST(count(*) FILTER (act = 'block') AS DOUBLE) AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM j GROUP BY host),
hd AS (SELECT host, n, k, CASE WHEN array_to_string(l[-2:], '.') IN {SUFFIXES} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN array_to_string(l[-2:], '.') IN {SUFFIXES} THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM c),
g AS (SELECT (coalesce(sum(k), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1.0e0) AS parent FROM hd),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(g.parent) AS parent FROM hd, g GROUP BY suffix),{_level("s1", "suffix", "s0")},
d0 AS (SELECT domain, suffix, sum(hd.n) AS n, sum(hd.k) AS k, any_value(s1.mean) AS parent FROM hd JOIN s1 USING (suffix) GROUP BY 1, 2),{_level("d1", "domain, suffix", "d0")},
h0 AS (SELECT hd.host, hd.n, hd.k, d1.mean AS parent FROM hd JOIN d1 USING (domain, suffix)),{_level("h1", "host", "h0")},
v AS (SELECT host, round(mean, 6) AS bad_rate, round(mean - {Z}e0 * sqrt(mean * (1 - mean) / (n + strength + 1)), 6) AS bad_bound FROM h1)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN bad_bound >= {THRESHOLD}e0 THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_bound
FROM j JOIN v USING (host)
"""
