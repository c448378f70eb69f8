"""URL filters: rules first, then empirical-Bayes host reputation.

Pages on which a rule decides are the labelled outcomes (blocked is bad). Counts go up from host
to registered domain to suffix; at each level a beta prior is centred on the level above, with a
strength estimated from how much the level's groups differ (moments of the beta-binomial), and a
host is blocked if the lower bound of its posterior share of bad pages exceeds a limit. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import join_groups
from .shared import materialise, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Under a country's two letters, names are registered below these labels; elsewhere below the last.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_LONG = r"(^|\.)(" + "|".join(SECOND_LEVELS) + r")\.[a-z]{2}$"
_ADDRESS = r"^([0-9.]*|\[.*)$"
#: Standard deviations below the mean, and the share of bad pages that the bound must exceed.
Z, LIMIT = 1.6448536269514722, 0.5
#: A rule list up to this length is one expression; longer ones are refused.
MOST_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    tail = F.substr(url, at + 3)
    some = F.coalesce(at, F.lit(0)) > 0
    host = F.when(some, F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")
    path = F.when(some, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def match(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does. A rule fits its host,
    the host's subdomains, and paths that start with its own; ties go to the smaller name."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (name, verdict) if rules else (none, none)


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without its port. A host of one label is both; an
    address is its own domain, and all addresses are under one suffix, the empty one."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    n = F.when(name.rlike(_LONG), 2).otherwise(1)
    suffix = F.when(n == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(n == 2, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    address = name.rlike(_ADDRESS)
    return F.when(address, name).otherwise(domain), F.when(address, "").otherwise(suffix)


def _strength(groups: DataFrame, parent: str) -> Column:
    """1/rho - 1 of the beta-binomial, by moments around the parents' means, between 0.01 and 1e6."""
    p = F.col(parent)
    seen = F.col("n") > 0
    n = F.when(seen, F.col("n").cast("double"))
    spread = F.sum(F.when(seen & (p > 0) & (p < 1), (F.col("bad") - n * p) * (F.col("bad") - n * p) / (n * p * (1 - p))))
    excess = F.sum(F.when(seen & (p > 0) & (p < 1), n - 1))
    count = F.sum(F.when(seen & (p > 0) & (p < 1), F.lit(1.0)))
    rho = F.coalesce((spread - count) / F.nullif(excess, F.lit(0.0)), F.lit(0.5))
    return F.greatest(F.lit(0.01), F.least(F.lit(1e6), 1 / F.greatest(rho, F.lit(1e-7)) - 1))


def reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """outcomes(host string, bad int or null where unlabelled) to one row per host: rows, n, bad, mean,
    bound and blocked. Hosts without a label take the mean of their domain; with no label at all
    every mean is a half. A null host counts as empty."""
    domain, suffix = levels(F.col("host"))
    h = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"), F.count("*").alias("rows"))
    h = materialise(h.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = h.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    s = h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("up", F.lit(top))
    s = _shrunk(s, "s_mean")
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(s.select("suffix", F.col("s_mean").alias("up")), "suffix")
    d = _shrunk(d, "d_mean")
    h = h.join(d.select("domain", "suffix", F.col("d_mean").alias("up")), ["domain", "suffix"])
    k = h.agg(_strength(h, "up").alias("k")).first()["k"]
    a, b = F.col("bad") + k * F.col("up"), F.col("n") - F.col("bad") + k * (1 - F.col("up"))
    mean = a / (a + b)
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", "domain", "suffix", "rows", "n", "bad", mean.alias("mean"), bound.alias("bound"), (bound > limit).alias("blocked"))


def _shrunk(groups: DataFrame, into: str) -> DataFrame:
    groups = materialise(groups, "level")
    k = groups.agg(_strength(groups, "up").alias("k")).first()["k"]
    return groups.withColumn(into, (F.col("bad") + k * F.col("up")) / (F.col("n") + k))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages(page_id, url, ...) to page_id, host, path, rule and verdict, a row per row.

    Null, empty and malformed urls have the empty host and are judged as it is; very long ones are
    read whole. Null ids pass through; repeated rows are judged, and count, one by one. Of rules of
    equal length the smaller name wins. An empty table gives none. Other columns, whatever their
    names, are not read. A very common host is looked up from a bounded broadcast list.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = match(F.col("host"), F.col("path"), rules)
    p = materialise(p.select("*", rule.alias("rule"), said.alias("said")), "urls")
    known = reputation(p.select("host", (F.col("said") == "block").cast("int").alias("bad")))
    known = materialise(known.select("host", "rows", "blocked"), "known")
    verdict = F.coalesce("said", F.when(F.col("blocked"), "block").otherwise("allow"))
    return join_groups(p, known, "host", size="rows").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))


def _strength_sql(table: str) -> str:
    inside = "n > 0 AND up > 0 AND up < 1"
    return f"(SELECT greatest(0.01, least(1e6, 1 / greatest(coalesce((sum((bad - n * up) * (bad - n * up) / (n * up * (1 - up))) - count(*)) / nullif(sum(n - 1.0), 0), 0.5), 1e-7) - 1)) FROM {table} WHERE {inside})"


ORACLE = f"""
WITH u AS (SELECT page_id, coalesce(position('://' IN url), 0) AS pos, substr(url, position('://' IN url) + 3) AS tail FROM pages),
p AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(tail, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
  CASE WHEN pos > 0 THEN regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(said, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, said FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said FROM m GROUP BY ALL),
h0 AS (SELECT host, count(said) AS n, count(*) FILTER (said = 'block') AS bad, regexp_replace(host, ':[0-9]*$', '') AS name FROM b GROUP BY host),
h1 AS (SELECT host, n, bad, name, string_split(name, '.') AS l, CASE WHEN regexp_matches(name, '{_LONG}') THEN 2 ELSE 1 END AS k, regexp_matches(name, '{_ADDRESS}') AS address FROM h0),
h AS (SELECT host, n, bad, CASE WHEN address THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN address THEN '' ELSE array_to_string(l[-k:], '.') END AS suffix FROM h1),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM h) AS up FROM h GROUP BY suffix),
sm AS (SELECT suffix, (bad + {_strength_sql("s")} * up) / (n + {_strength_sql("s")}) AS up FROM s),
d AS (SELECT domain, suffix, n, bad, up FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix) JOIN sm USING (suffix)),
dm AS (SELECT domain, suffix, (bad + {_strength_sql("d")} * up) / (n + {_strength_sql("d")}) AS up FROM d),
hu AS (SELECT host, n, bad, up FROM h JOIN dm USING (domain, suffix)),
ab AS (SELECT host, bad + {_strength_sql("hu")} * up AS a, n - bad + {_strength_sql("hu")} * (1 - up) AS b FROM hu),
v AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} AS blocked FROM ab)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN v USING (host)
"""
