"""URL filter: explicit rules, else an empirical-Bayes reputation of the host. DataFrame operations only.

Labelled page outcomes (good or not) are counted by host. Each level is shrunk to the one above by a
beta-binomial prior: the root's rate is the prior mean of suffixes, a suffix's posterior mean that of
its registered domains, a domain's that of its hosts. Each level's prior weight M is estimated from how
much children differ from their parents beyond binomial noise (method of moments). A url is blocked
where the posterior bound mean + z * sd of its host's good rate lies below `least_good`: only confidently
bad hosts go, hosts without labels inherit.

The last label of a host counts as its suffix, the last two as its registered domain.

Defined cases. A null url or one without `://` has an empty host and path, no rule, and is judged as host ''.
Null labels don't count; with no label at all, every rate is the neutral 1/2. Repeated pages and
labels count each time. Only the key, the url and the labels are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on_hot_keys, written

#: (rule, verdict); a rule is host + path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
Z = 1.645
LEAST_GOOD = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The short list becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _prior_weight(children: DataFrame) -> float:
    """M of the beta prior from children (n, k, prior mean m), by moments."""
    m = F.least(F.greatest(F.col("m"), F.lit(1e-6)), F.lit(1 - 1e-6))
    known = children.filter("n > 0")
    a, n, n2, c = known.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, F.lit(2)) / (m * (1 - m))), F.sum("n"), F.sum(F.pow("n", F.lit(2))), F.count(F.lit(1))).first()
    free = (n - n2 / n - (c - 1)) if n else 0
    spread = min(max((a - (c - 1)) / free, 1e-4), 0.99) if free > 0 else 1e-4
    return 1 / spread - 1


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts (host, pages, n labelled, k good) -> host, pages, mean, bound."""
    labels = F.split("host", r"\.")
    hosts = hosts.withColumns({"suffix": F.element_at(labels, -1), "domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)})
    hosts = written(hosts)
    domains = written(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("children")))
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("children")))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    level = suffixes.withColumn("m", F.lit((k + 1) / (n + 2) if n is not None else 0.5))
    for children, key in ((domains, "suffix"), (hosts, "domain"), (None, None)):
        weight = _prior_weight(level)
        a, b = F.col("k") + weight * F.col("m"), F.col("n") - F.col("k") + weight * (1 - F.col("m"))
        level = level.withColumns({"mean": a / (a + b), "sd": F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))})
        if children is not None:
            parents = written(level.select(key, F.col("mean").alias("m"), F.col("children").alias("_c")))
            level = written(join_on_hot_keys(children, parents, key, "_c").drop("_c"))
    return level.select("host", "pages", "mean", (F.col("mean") + z * F.col("sd")).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, bound. outcomes: (id, good 0 or 1)."""
    host, path = host_and_path(F.col(url_col))
    parsed = written(pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")))
    known = outcomes.filter("good is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    counts = parsed.join(known, F.col("_id") == F.col("id"), "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    met = join_on_hot_keys(parsed, written(reputation(counts, z)), "host", "pages")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return met.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from `labels`, whose doc_id numbers the pages too: good if quality 1 and not toxic."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, page_outcomes(labels)).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, children: str, parents: str, key: str) -> str:
    """One level of shrinkage: children with their parents' means as m, then mean and sd."""
    return f"""
     {name}0 AS (SELECT c.*, p.mean AS m, greatest(least(p.mean, 1 - 1e-6), 1e-6) AS mm FROM {children} c JOIN {parents} p USING ({key})),
     {name}w AS (SELECT sum(n) AS nn, sum(n * pow(k / n::DOUBLE - mm, 2) / (mm * (1 - mm))) AS a, sum(pow(n, 2)) AS n2, count(*) AS c FROM {name}0 WHERE n > 0),
     {name}m AS (SELECT 1 / CASE WHEN nn IS NULL OR nn - n2 / nn - (c - 1) <= 0 THEN 1e-4 ELSE least(greatest((a - (c - 1)) / (nn - n2 / nn - (c - 1)), 1e-4), 0.99) END - 1 AS w FROM {name}w),
     {name}b AS (SELECT {name}0.*, k + w * m AS aa, n - k + w * (1 - m) AS bb FROM {name}0, {name}m),
     {name} AS (SELECT * EXCLUDE (m, mm), aa / (aa + bb) AS mean, sqrt(aa * bb / (pow(aa + bb, 2) * (aa + bb + 1))) AS sd FROM {name}b),"""


SQL = f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS h0,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
     p AS (SELECT page_id, translate(h0, '{_UPPER}', '{_LOWER}') AS host, path FROM u),
     g AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS k FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
     hosts AS (SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix,
                      coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k FROM p LEFT JOIN g ON page_id = doc_id GROUP BY host),
     doms AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain),
     sufs AS (SELECT suffix, 0 AS one, sum(n) AS n, sum(k) AS k FROM doms GROUP BY suffix),
     root AS (SELECT 0 AS one, (sum(k) + 1) / (sum(n) + 2)::DOUBLE AS mean FROM sufs),
     {_level_sql("s", "sufs", "root", "one")}
     {_level_sql("d", "doms", "s", "suffix").replace("EXCLUDE (m, mm)", "EXCLUDE (m, mm, aa, bb)")}
     {_level_sql("r", "hosts", "d", "domain")}
     f AS (SELECT p.*, mean + {Z} * sd AS bound,
                  host = 'net' OR suffix(host, '.net') AS net, host = 'example.net' OR suffix(host, '.example.net') AS enet,
                  host = 'example.com' OR suffix(host, '.example.com') AS ecom, host = 'org' OR suffix(host, '.org') AS org
           FROM p JOIN r USING (host)),
     q AS (SELECT *, CASE WHEN ecom AND prefix(path, '/de/') THEN 'example.com/de/' WHEN enet AND prefix(path, '/en/') THEN 'example.net/en/'
                          WHEN org AND prefix(path, '/fr/') THEN 'org/fr/' WHEN net AND prefix(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound < {LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""
