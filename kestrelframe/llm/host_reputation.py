"""Empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host and shrunk three
times through beta-binomial priors: the suffix towards the corpus, the
registered domain towards its suffix, the host towards its domain. At each level
a Beta prior with the parent's posterior mean meets the level's own counts; how many
pseudo-pages the prior is worth is estimated from the data, level by level, from how
much more the groups' counts spread than coin tosses would (method of moments, within
``STRENGTHS``). A page is blocked when the upper posterior bound of its host's good
rate (mean + z standard deviations) lies below ``floor``: only hosts that are bad
with confidence go, and unlabelled ones inherit their parents' view.

Hand-written rules ``(verdict, host, path)`` come first: a rule fits its host and
all subdomains if the path starts with the rule's; the longest rule wins.

Scale: outcomes are summed per host before any join, so a host with a third of
all pages arrives as one row per task; pages meet the host table in an equi-join
that adaptive execution splits when one host is hot.

Edge cases: a null url, or one without ``://``, has an empty host and path, which
form a host, domain and suffix of their own. Null outcomes and outcomes of
unknown pages count for nothing. Repeated pages are judged alike, and repeated
outcome rows count again. Without outcomes every posterior mean is one half and
nothing is blocked by reputation. Urls of any length are read whole. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise, table

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of two labels below which names are registered; a parameter, not a full list.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn")
#: Words that mark a page as bad where they stand in its url; a parameter.
BAD_WORDS = ("adult", "bets", "casino", "pills", "porn", "spam", "viagra", "warez")
#: Least and most pseudo-pages of a prior, and what it is worth where no group has two outcomes.
STRENGTHS = (0.5, 1000.0)
STRENGTH = 10.0
Z = 1.645
FLOOR = 0.5


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def levels(host: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; ports and user names are left out, addresses stay whole."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    is_wide = two.isin(*wide) if wide else F.lit(False)
    address = name.rlike(r"^[0-9.]+$|[:\[\]]")
    domain = F.when(address, name).when(is_wide, F.substring_index(name, ".", -3)).otherwise(two)
    suffix = F.when(address, name).when(is_wide, two).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def strength_of(groups: DataFrame, parent: str) -> DataFrame:
    """One row: pseudo-pages of the prior, from ``groups`` of ``n`` outcomes, ``k`` good, with the prior mean ``parent``."""
    n, k, m = F.col("n"), F.col("k"), F.col(parent)
    spread = F.sum((k - n * m) * (k - n * m) / (m * (1 - m)))
    rho = F.try_divide(spread - F.sum(n), F.sum(n * (n - 1)))  # correlation of two outcomes of a group
    least, most = STRENGTHS
    worth = F.when(rho <= 1 / (most + 1), most).when(rho >= 1 / (least + 1), least).otherwise(1 / rho - 1)
    return groups.agg(F.when(rho.isNull(), STRENGTH).otherwise(worth).alias("strength"))


def _shrunk(groups: DataFrame, parent: str) -> DataFrame:
    """``groups`` with the one row of :func:`strength_of` beside each."""
    return groups.crossJoin(F.broadcast(strength_of(groups, parent)))


def reputation(hosts: DataFrame, wide: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """Beta posterior ``(host, a, b)`` of every row of ``hosts(host, n, k)``: n outcomes, k of them good."""
    domain, suffix = levels(F.col("host"), wide)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]

    def mean(parent: str) -> Column:
        return (F.col("k") + F.col("strength") * F.col(parent)) / (F.col("n") + F.col("strength"))

    top = hosts.agg(*sums).select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("m_top"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(top)), "m_top").select("suffix", mean("m_top").alias("m_suffix"))
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix"), "m_suffix").select("domain", mean("m_suffix").alias("m_domain"))
    prior = F.col("strength") * F.col("m_domain")
    return _shrunk(hosts.join(domains, "domain"), "m_domain").select("host", (F.col("k") + prior).alias("a"), (F.col("n") - F.col("k") + F.col("strength") - prior).alias("b"))


def filter_pages(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, floor: float = FLOOR, wide: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """Host, path, rule and verdict of every page. ``outcomes(page_id, good 0/1)``."""
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled})
    good = outcomes.where(F.col("good").isNotNull()).groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    # every host once, an unlabelled one with zero counts: its posterior is its domain's mean
    hosts = base.select("page_id", "host").join(good, F.col("page_id") == F.col("id"), "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    scored = reputation(materialise(hosts, "hosts"), wide)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    bound = scored.select(F.col("host").alias("h"), (mean + z * sd).alias("bound"))
    return base.join(bound, F.col("host") == F.col("h")).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") < floor, "block").otherwise("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame, words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """Outcomes ``(page_id, good)`` of pages: bad if a listed word stands in the url, else as ``labels`` says of the page's id (good if its quality is 1 and it is not toxic)."""
    told = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)
    rows = labels.select(F.col("doc_id").alias("page_id"), told.alias("good"))
    listed = F.lower(F.col("url").cast("string")).rlike("|".join(words)) if words else F.lit(False)
    bad = pages.where(listed).select("page_id").distinct()
    rest = rows.join(bad.select(F.col("page_id").alias("b")), F.col("page_id") == F.col("b"), "left_anti")
    return rest.unionByName(bad.withColumn("good", F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_url_filters``: every page by the stated rules, else by its host's reputation."""
    pages = table(spark, sf_dir, "pages")
    return filter_pages(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hosts AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p GROUP BY host),
lv AS (
  SELECT host, name, regexp_matches(name, '^[0-9.]+$|[:\\[\\]]') AS address, string_split(name, '.') AS parts,
    array_to_string(string_split(name, '.')[-2:], '.') AS two FROM hosts),
dom AS (
  SELECT host,
    CASE WHEN address THEN name WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','co.nz','com.br','co.in','co.za','com.cn') THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN name WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','co.nz','com.br','co.in','co.za','com.cn') THEN two ELSE parts[-1] END AS suffix
  FROM lv),
bad AS (SELECT DISTINCT page_id FROM pages WHERE regexp_matches(lower(url), 'adult|bets|casino|pills|porn|spam|viagra|warez')),
o AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS good FROM labels WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.page_id = doc_id)
  UNION ALL SELECT page_id, 0 FROM bad),
s AS (SELECT host, domain, suffix, count(good) AS n, coalesce(sum(good), 0) AS k FROM p JOIN dom USING (host) LEFT JOIN o USING (page_id) GROUP BY ALL),
t AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m0 FROM s),
g1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m FROM s, t GROUP BY suffix),
r1 AS (SELECT (sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0) AS rho FROM g1),
w1 AS (SELECT CASE WHEN rho IS NULL THEN 10.0 WHEN rho <= 1 / 1001.0::DOUBLE THEN 1000.0 WHEN rho >= 1 / 1.5::DOUBLE THEN 0.5 ELSE 1 / rho - 1 END::DOUBLE AS w FROM r1),
su AS (SELECT suffix, (k + w * m) / (n + w) AS ms FROM g1, w1),
g2 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(ms) AS m FROM s JOIN su USING (suffix) GROUP BY domain),
r2 AS (SELECT (sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0) AS rho FROM g2),
w2 AS (SELECT CASE WHEN rho IS NULL THEN 10.0 WHEN rho <= 1 / 1001.0::DOUBLE THEN 1000.0 WHEN rho >= 1 / 1.5::DOUBLE THEN 0.5 ELSE 1 / rho - 1 END::DOUBLE AS w FROM r2),
dm AS (SELECT domain, (k + w * m) / (n + w) AS md FROM g2, w2),
g3 AS (SELECT host, n, k, md AS m FROM s JOIN dm USING (domain)),
r3 AS (SELECT (sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0) AS rho FROM g3),
w3 AS (SELECT CASE WHEN rho IS NULL THEN 10.0 WHEN rho <= 1 / 1001.0::DOUBLE THEN 1000.0 WHEN rho >= 1 / 1.5::DOUBLE THEN 0.5 ELSE 1 / rho - 1 END::DOUBLE AS w FROM r3),
ab AS (SELECT host, k + w * m AS a, n - k + w - w * m AS b FROM g3, w3),
bd AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
best AS (
  SELECT page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(rules.verdict, length(rules.h || rules.p)) AS ruled
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN rules ON (p.host = rules.h OR p.host LIKE '%.' || rules.h) AND starts_with(p.path, rules.p)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.ruled, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN bd USING (host) LEFT JOIN best ON best.page_id IS NOT DISTINCT FROM p.page_id
"""
