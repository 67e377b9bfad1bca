"""URL filters by host reputation, empirical-Bayes.

Labelled outcomes of pages are counted per host and summed per registered domain and suffix. Each level's beta prior has
the posterior mean of the level above as its mean (the suffix: the overall rate) and a strength fitted to the level's
overdispersion by moments, so a host with few outcomes is shrunk to its domain, a domain to its suffix. A host is blocked
if the lower bound of its posterior, mean - z standard deviations, lies above the highest rate allowed. Path rules go
first: of those that fit, the longest decides.

Everything stays in DataFrame functions; pages are never grouped, only outcomes (partial counts before the shuffle), and
reputations are joined to the pages by host: by Spark's size check, beyond it by a shuffle whose hot hosts the skew join
splits. The html is not read.

A host without outcomes is judged as its prior says: rate of its domain (else suffix, else of all) and the deviation of
that prior. Under a two-part suffix (a parameter) the registered domain has three labels.

Cases: a null url or one without :// has an empty host and path, fits no rule, takes the overall rate and is allowed, as
there is no host to judge; outcomes with a null value are not counted; without any outcome no host is blocked; repeated pages are judged each; an empty table gives no rows; ties between rules
of equal length go to the first by text; extra columns with any name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import ascii_lower, source, table

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
# Widespread suffixes of two labels under which domains are registered. A parameter, not a complete list.
TWO_PART_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.mx", "com.ar", "com.cn", "com.tr", "co.za", "com.sg",
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(F.col(url), _URL, 1), F.lit("")))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), _URL, 2), F.lit(""))


def domain_of(h: Column, two_part_suffixes: tuple[str, ...]) -> Column:
    """The suffix (a list of two-part ones is a parameter) and one label before it."""
    parts = F.substring_index(h, ".", -3)
    return F.when(F.substring_index(h, ".", -2).isin(*two_part_suffixes), parts).otherwise(F.substring_index(h, ".", -2))


def suffix_of(h: Column, two_part_suffixes: tuple[str, ...]) -> Column:
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*two_part_suffixes), two).otherwise(F.substring_index(h, ".", -1))


def rule(h: Column, p: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [F.when(((h == r[0]) | h.endswith("." + r[0])) & p.startswith(r[1]), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _level(groups: DataFrame, key: str, prior: str) -> tuple[DataFrame, float]:
    """Posterior mean of each group under a beta prior with mean `prior` and one fitted strength for the level."""
    spread = F.col("n") * F.col(prior) * (1 - F.col(prior))
    off = F.col("bad") - F.col("n") * F.col(prior)
    r = groups.filter(spread > 0).agg(F.sum(off * off / spread).alias("q"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("m")).first()  # one row
    rho = (r["q"] - r["k"]) / r["m"] if r["m"] else 0.0
    strength = min(max(1 / rho - 1, 1.0), 10_000.0) if rho > 0 else 10_000.0
    return groups.withColumn(f"{key}_rate", (F.col("bad") + F.lit(strength) * F.col(prior)) / (F.col("n") + F.lit(strength))), strength


def reputations(outcomes: DataFrame, two_part_suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """outcomes: host, bad (0 or 1). Returns hosts (host, rate, sd), domains, suffixes with rates, the overall rate, the hosts' strength."""
    h = outcomes.filter("host <> '' and bad is not null").groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    h = table(h.withColumns({"domain": domain_of(F.col("host"), two_part_suffixes), "suffix": suffix_of(F.col("host"), two_part_suffixes)}), "hosts")
    total = h.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    overall = total["bad"] / total["n"] if total["n"] else 0.0
    up = lambda df, *key: df.groupBy(*key).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    d = table(up(h, "domain", "suffix"), "domains")
    s, _ = _level(up(d, "suffix").withColumn("prior", F.lit(overall)), "suffix", "prior")
    s = table(s.select("suffix", "suffix_rate"), "suffixes")
    d, _ = _level(d.join(s, "suffix"), "domain", "suffix_rate")
    d = table(d.select("domain", "domain_rate"), "domain-rates")
    h, strength = _level(h.join(d, "domain"), "host", "domain_rate")
    size = F.col("n") + F.lit(strength)
    h = h.select("host", F.col("host_rate").alias("rate"), F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (size + 1)).alias("sd"))
    return table(h, "host-rates"), d, s, overall, strength


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.3, z: float = 1.645, two_part_suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, rate (posterior mean) and lower (its bound)."""
    hosts, domains, suffixes, overall, strength = reputations(outcomes, two_part_suffixes)
    p = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    p = p.withColumns({"domain": domain_of(F.col("host"), two_part_suffixes), "suffix": suffix_of(F.col("host"), two_part_suffixes), "fit": rule(F.col("host"), F.col("path"), tuple(rules))})
    p = p.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    rate = F.coalesce("rate", "domain_rate", "suffix_rate", F.lit(overall))
    prior_sd = F.sqrt(rate * (1 - rate) / F.lit(strength + 1))  # a host without outcomes is as its domain, suffix or all are
    lower = F.when(F.col("host") == "", F.lit(0.0)).otherwise(rate - F.lit(z) * F.coalesce("sd", prior_sd))  # no host, no reputation
    return p.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(lower > F.lit(most_bad), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round(rate, 9).alias("rate"), F.round(lower, 9).alias("lower"),
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad: a page is bad if the document that its path numbers is labelled of low quality or toxic."""
    number = F.regexp_extract(path("url"), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    asked = pages.select(host("url").alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    told = labels.filter("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return asked.join(told, "doc_id").select("host", "bad")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = source(spark, sf_dir, "pages")
    return judge(pages, labelled_outcomes(pages, source(spark, sf_dir, "labels")))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT *, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (%TWO%) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
             CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (%TWO%) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix,
             try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM p),
t AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, domain, suffix, CAST(sum(bad) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS n FROM q JOIN t USING (doc_id) WHERE host <> '' AND bad IS NOT NULL GROUP BY ALL),
o AS (SELECT sum(bad) / sum(n) AS m FROM h),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, m FROM h, o GROUP BY suffix, m),
sm AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM (
  SELECT (sum((bad - n * m) * (bad - n * m) / (n * m * (1 - m))) - count(*)) / sum(n - 1) AS rho FROM s0 WHERE n * m * (1 - m) > 0)),
s AS (SELECT suffix, (bad + k * m) / (n + k) AS suffix_rate FROM s0, sm),
d0 AS (SELECT domain, h.suffix, sum(bad) AS bad, sum(n) AS n, suffix_rate AS m FROM h JOIN s USING (suffix) GROUP BY ALL),
dm AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM (
  SELECT (sum((bad - n * m) * (bad - n * m) / (n * m * (1 - m))) - count(*)) / sum(n - 1) AS rho FROM d0 WHERE n * m * (1 - m) > 0)),
d AS (SELECT domain, (bad + k * m) / (n + k) AS domain_rate FROM d0, dm),
h0 AS (SELECT host, bad, n, domain_rate AS m FROM h JOIN d USING (domain)),
hm AS (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM (
  SELECT (sum((bad - n * m) * (bad - n * m) / (n * m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0) AS rho FROM h0 WHERE n * m * (1 - m) > 0)),
r AS (SELECT host, (bad + k * m) / (n + k) AS rate, sqrt((bad + k * m) / (n + k) * (1 - (bad + k * m) / (n + k)) / (n + k + 1)) AS sd FROM h0, hm),
v AS (
  SELECT page_id, host, path, coalesce(rate, domain_rate, suffix_rate, m, 0.0) AS rate, 
    CASE WHEN host = '' THEN 0.0 ELSE coalesce(rate, domain_rate, suffix_rate, m, 0.0) - 1.645 * coalesce(sd, sqrt(coalesce(domain_rate, suffix_rate, m, 0.0) * (1 - coalesce(domain_rate, suffix_rate, m, 0.0)) / (hm.k + 1))) END AS lower,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM q LEFT JOIN r USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix) CROSS JOIN o CROSS JOIN hm)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 9) AS rate, round(lower, 9) AS lower FROM v
""".replace("%TWO%", ", ".join(f"'{x}'" for x in TWO_PART_SUFFIXES))
