"""URL filters: rules by host and path, and else an empirical-Bayes reputation of the host, in SQL functions alone.

A rule (host, path) fits its host and all subdomains, where the url's path starts with the rule's; the longest of those
that fit decides, by the length of host and path together, then of the host.  Rules are joined to the distinct hosts by
the suffixes of their labels, so a page looks only at the rules of its host.

Where no rule fits, the host's reputation decides.  Labelled pages are good or bad outcomes; a host's bad ones are
beta-binomial around the rate of its registered domain, a domain's around that of its suffix, a suffix's around that of
all labelled pages (which is one of a uniform prior).  How far children of a level scatter around their parents, the
intra-class correlation rho, is estimated from all of them by moments; the prior then weighs as many outcomes as
1 / rho - 1.  A page is blocked if its host's probability of a bad page exceeds ``most_bad`` by the posterior's lower
bound, ``sigmas`` deviations under the mean.  Hosts without outcomes have the posterior of their domain, or of its suffix.

Only counts by host are held beside the pages; a host that has a large part of all pages gets its row by broadcast, as
``join_heavy`` says, and so does a suffix that has a large part of all hosts.

Defined cases: a null url and one without ``://`` have an empty host and path, which no rule fits, and the reputation of
an empty host, which is also its own domain and suffix; a null page_id is a page without an outcome; a label without
page_id or outcome doesn't count; of several labels of one page one bad one makes the page bad; rows of one page_id are
pages of their own; without labels every rate is a half and nothing is blocked but by rules; a rule without host fits
nothing; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import join_heavy

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict) of the rules that the query states.
RULES: list[tuple[str, str]] = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Suffixes of two labels under which domains are registered; any other suffix is one label.
SUFFIXES: list[str] = ["ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.nz", "org.uk"]
#: Bounds of the intra-class correlation: a prior weighs between 1 and 9999 outcomes.
LEAST_RHO, MOST_RHO = 1e-4, 0.5
MOST_BAD, SIGMAS = 0.5, 1.645
#: Digits of the rates that are returned, and compared.
DIGITS = 9


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rules_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host, path, rule, verdict of rules written as host/path."""
    rows = [(r.split("/", 1)[0].translate(str.maketrans(_UPPER, _LOWER)), "/" + r.split("/", 1)[1], r, v) for r, v in rules]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string")


def _shrunk(of: DataFrame, name: str) -> DataFrame:
    """Children (n, bad, up: the parent's rate) with the prior's weight and the posterior's rate."""
    spread = F.col("up") * (1 - F.col("up"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("up"), 2) - F.col("n") * spread)
    rho = F.coalesce(over / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * spread), F.lit(0.0)), F.lit(LEAST_RHO))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), rho))
    weight = of.agg((1 / rho - 1).alias("weight")).first()[0]
    out = of.withColumn("weight", F.lit(weight))
    return C.stored(out.withColumn("rate", (F.col("weight") * F.col("up") + F.col("bad")) / (F.col("weight") + F.col("n"))), name)


def reputations(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES, sigmas: float = SIGMAS) -> DataFrame:
    """host, n, bad, bad_rate, bad_low of hosts (host, n labelled pages, bad ones): mean and lower bound of the posterior."""
    hosts = C.stored(hosts.select("host", "n", "bad", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("below")]
    domains = C.stored(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    of_suffix = C.stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("below")), "suffixes")
    top = of_suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("up")).first()[0]
    up = lambda t, key: t.select(key, F.col("rate").alias("up"), F.col("below").alias("n"))

    def under(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
        named = rows.withColumnsRenamed({"n": "own"})
        return _shrunk(join_heavy(named, up(parents, key), key, rows.count()).withColumnRenamed("own", "n"), name)

    ranked = _shrunk(of_suffix.withColumn("up", F.lit(top)), "suffix-rates")
    ranked = under(domains, ranked, "suffix", "domain-rates")
    ranked = under(hosts, ranked, "domain", "host-rates")
    good = F.col("weight") * (1 - F.col("up")) + F.col("n") - F.col("bad")
    whole = F.col("weight") + F.col("n")
    low = F.col("rate") - F.lit(float(sigmas)) * F.sqrt(F.col("rate") * good / whole / (whole + 1))
    return ranked.select("host", "n", "bad", F.round("rate", DIGITS).alias("bad_rate"), F.round(low, DIGITS).alias("bad_low"))


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: of each distinct host that some rule's host fits, those rules, the longest first."""
    named = rules.where("host is not null and host <> ''").select(F.col("host").alias("end"), F.struct(
        (-F.length("host") - F.length("path")).alias("size"), (-F.length("host")).alias("own"), F.col("path").alias("path"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")).alias("fit")).where("fit.path is not null")
    labels = F.split("host", r"\.", -1)
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("end"))
    return ends.join(named, "end").groupBy("host").agg(F.array_sort(F.collect_set("fit")).alias("rules"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, most_bad: float = MOST_BAD, suffixes: Sequence[str] = SUFFIXES, sigmas: float = SIGMAS) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_low of each of the pages (page_id, url), by outcomes
    (page_id, bad: boolean) and rules (host, path, rule, verdict)."""
    url = F.col("url").cast("string")
    parsed = C.stored(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")), "pages")
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = parsed.select("page_id", "host").join(labels, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    hosts = C.stored(hosts, "host-counts")
    known = reputations(hosts, suffixes, sigmas).withColumnRenamed("n", "n_labelled")
    of_host = hosts.select("host", F.col("pages").alias("n")).join(known, "host").join(_rules_of(hosts.select("host"), rules), "host", "left")
    of_host = C.stored(of_host, "host-verdicts")
    rows = join_heavy(parsed, of_host, "host", parsed.count())
    rows = rows.withColumn("fit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad_low") > most_bad, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "bad_rate", "bad_low")


def allowed(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The pages, all columns, whose page_id has no blocked url; pages without page_id are kept."""
    blocked = judged(pages, outcomes, rules, **options).where("verdict = 'block' and page_id is not null").select(F.col("page_id").alias("_blocked")).distinct()
    return pages.join(blocked, pages["page_id"] == F.col("_blocked"), "left_anti")


def labelled(labels: DataFrame) -> DataFrame:
    """Outcomes by the table labels, whose doc_id is taken as the page's id: bad is low quality or toxic; without both
    there is no outcome."""
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``judged`` over pages and labels with the stated rules."""
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    rules = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES)

    def shrunk(name: str, source: str) -> str:
        return f"""{name}w AS (SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(sum((bad - n * up) ** 2 - n * up * (1 - up)) / nullif(sum(n * (n - 1) * up * (1 - up)), 0), {LEAST_RHO}))) - 1 AS weight FROM {source}),
{name} AS (SELECT *, (weight * up + bad) / (weight + n) AS rate FROM {source}, {name}w)"""

    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id, max(CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, string_split(host, '.') AS l, count(bad) AS n, count(CASE WHEN bad = 1 THEN 1 END) AS bad FROM p LEFT JOIN o ON page_id = doc_id GROUP BY 1, 2),
h1 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN 1 ELSE 0 END AS more FROM h0),
h AS (SELECT host, n, bad, array_to_string(l[-2 - more:], '.') AS domain, array_to_string(l[-1 - more:], '.') AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS up FROM d GROUP BY 1),
{shrunk("s1", "s")},
d0 AS (SELECT d.*, s1.rate AS up FROM d JOIN s1 USING (suffix)), {shrunk("d1", "d0")},
g0 AS (SELECT h.*, d1.rate AS up FROM h JOIN d1 USING (domain)), {shrunk("g1", "g0")},
g AS (SELECT host, n, round(rate, {DIGITS}) AS rate, round(rate - {SIGMAS} * sqrt(rate * (weight * (1 - up) + n - bad) / (weight + n) / (weight + n + 1)), {DIGITS}) AS low FROM g1),
r AS (SELECT * FROM (VALUES {rules}) v(end_host, begin_path, rule, verdict)),
f AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON (q.host = r.end_host OR ends_with(q.host, '.' || r.end_host)) AND starts_with(q.path, r.begin_path) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN low > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict, n AS n_labelled, rate AS bad_rate, low AS bad_low
FROM p JOIN g USING (host) LEFT JOIN f ON f.host = p.host AND f.path = p.path
"""
