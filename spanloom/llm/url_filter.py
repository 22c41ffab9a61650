"""Empirical-Bayes host reputation: labelled outcomes shrink from host to registered domain to suffix.

Explicit rules judge first; the longest that fits wins. For other urls, a host's bad outcomes get a
beta prior whose mean is its registered domain's posterior mean, the domain's prior comes from its
suffix, and the suffix's from all labelled pages. How strongly each level pulls is estimated from the
spread of its groups' rates by moments. A host is blocked where the lower posterior bound of its bad
rate is above ``limit``, so a few bad pages on a small host don't block it.

Defined results: a null url or one without ``://`` has empty host and path and is judged as host "".
Repeated labels of a page count as one, bad if any is bad; null labels don't count. Without labels
nothing is blocked but by a rule. Repeated pages are judged each; an empty table gives no rows; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_of

#: (verdict, host and path) of the rules that hold before the method.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Pulls of a level's prior, in pages: at least, and at most (also where no spread shows).
PULL = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def pull(groups: DataFrame) -> float:
    """How many pages a level's prior counts for, from the spread of its groups' rates (``n, y``)."""
    seen = groups.where("n > 0")
    t = seen.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("yy")).first()
    if not t["n"]:
        return PULL[1]
    p = t["y"] / t["n"]
    spare = t["n"] - t["nn"] / t["n"]
    spread = (t["yy"] - t["n"] * p * p - (t["k"] - 1) * p * (1 - p)) / spare if spare > 0 else 0.0
    return min(max(p * (1 - p) / spread - 1, PULL[0]), PULL[1]) if spread > 1e-12 else PULL[1]


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, rate, low``: posterior mean of the bad rate and its lower bound, from rows ``host, n, y``.

    ``n`` counts a row's labelled pages and ``y`` the bad ones among them; hosts without any get their
    domain's rate.
    """
    domain = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    hosts = Scratch(outcomes.sparkSession, "hosts").keep(hosts.select("host", domain.alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "n", "y"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    base = ((total["y"] or 0) + 1) / ((total["n"] or 0) + 2)
    of_suffix, of_domain, of_host = pull(suffixes), pull(domains), pull(hosts)
    suffixes = suffixes.select("suffix", ((F.col("y") + of_suffix * base) / (F.col("n") + of_suffix)).alias("s"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("y") + of_domain * F.col("s")) / (F.col("n") + of_domain)).alias("d"))
    rate = (F.col("y") + of_host * F.col("d")) / (F.col("n") + of_host)
    judged = hosts.join(domains, "domain").select("host", rate.alias("rate"), (F.col("n") + of_host).alias("weight"))
    return judged.select("host", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", good: str = "quality", bad: str = "toxic", rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_rate_low`` of each page.

    A page's outcome is its row in ``labels``: bad where ``good`` is 0 or ``bad`` is 1.
    """
    rows = columns_of(pages, page_id=page_id, url=url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = columns_of(labels, page_id=label_id, good=good, bad=bad).where("page_id is not null and (good is not null or bad is not null)")
    marks = marks.groupBy("page_id").agg(F.max(F.when(F.coalesce(F.col("good") == 0, F.lit(False)) | F.coalesce(F.col("bad") == 1, F.lit(False)), 1).otherwise(0)).alias("y"))
    outcomes = rows.join(marks, "page_id", "left").select("host", F.when(F.col("y").isNotNull(), 1).otherwise(0).alias("n"), F.coalesce("y", F.lit(0)).alias("y"))
    known = reputation(outcomes, z)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("rate").alias("bad_rate"), F.col("low").alias("bad_rate_low"))


def _sql_pull(name: str) -> str:
    return f"""
SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN {PULL[1]} WHEN sp > 1e-12 THEN least(greatest(p * (1 - p) / sp - 1, {PULL[0]}), {PULL[1]}) ELSE {PULL[1]} END AS pull
FROM (SELECT n, p, CASE WHEN n - nn / n > 0 THEN (yy - n * p * p - (k - 1) * p * (1 - p)) / (n - nn / n) ELSE 0 END AS sp
      FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(y) / CAST(sum(n) AS DOUBLE) AS p, CAST(sum(n * n) AS DOUBLE) AS nn, sum(y * y / CAST(n AS DOUBLE)) AS yy FROM {name} WHERE n > 0))
GROUP BY p, sp"""


SQL = f"""
WITH pg AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages
),
mk AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS y FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h AS (
  SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix,
         CAST(count(mk.y) AS BIGINT) AS n, CAST(coalesce(sum(mk.y), 0) AS BIGINT) AS y
  FROM pg LEFT JOIN mk ON pg.page_id = mk.page_id GROUP BY host
),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY domain, suffix),
sx AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY suffix),
base AS (SELECT (coalesce(sum(y), 0) + 1) / CAST(coalesce(sum(n), 0) + 2 AS DOUBLE) AS b FROM h),
ps AS ({_sql_pull('sx')}), pd AS ({_sql_pull('dm')}), ph AS ({_sql_pull('h')}),
s AS (SELECT suffix, (y + pull * b) / (n + pull) AS s FROM sx, ps, base),
d AS (SELECT domain, (y + pull * s) / (n + pull) AS d FROM dm JOIN s ON dm.suffix = s.suffix, pd),
j AS (SELECT host, (y + pull * d) / (n + pull) AS rate, n + pull AS weight FROM h JOIN d ON h.domain = d.domain, ph),
k AS (SELECT pg.page_id, pg.host, path, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS low FROM pg JOIN j ON pg.host = j.host),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM k
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 9) AS bad_rate, round(low, 9) AS bad_rate_low
FROM r
"""
