"""URL filters: fixed rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes are counted per host, registered domain and suffix. At each level the spread between the units
gives a beta-binomial concentration (method of moments over all rows); the posterior of the level above is the prior
mean of the level below: everything -> suffix -> domain -> host. A page is blocked if the lower posterior bound of its
host's share of bad outcomes is at least `block_at`.

Edge cases: a null url or one without `://` has empty host and path, fits no rule and gets the verdict of the overall
rate. Hosts without labels inherit their domain's posterior. Without any label every such page is allowed. Repeated
labels of a document count once, the worst of them. Rows with the same page_id each get a row. Empty tables give no rows;
urls of any length are judged whole; other columns of the tables are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: host and path prefix, verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labels under which countries register names.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
TWO_LABELS = rf"(^|[.])({'|'.join(SECOND)})[.][a-z][a-z]$"
NUMERIC = r"^([0-9.]+|\[.*\])$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none. The rules are few and fixed, so they
    are one CASE expression inside the scan's stage."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule if rule is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def site_of(host: Column, level: str) -> Column:
    """The suffix (com, co.uk) or the registered domain (one label more) of a host without user, port and closing dot. A
    suffix has two labels where one of SECOND stands before a country's. An address in numbers is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.+$", "")
    more = int(level == "domain")
    return F.when(bare.rlike(NUMERIC), bare).when(bare.rlike(TWO_LABELS), F.substring_index(bare, ".", -2 - more)).otherwise(F.substring_index(bare, ".", -1 - more))


@dataclass(frozen=True)
class Reputation:
    block_at: float = 0.5
    z: float = 1.645
    least_rho: float = 0.001
    most_rho: float = 0.5

    def concentration(self, units: DataFrame) -> float:
        """1/rho - 1 of the beta-binomial by moments; five sums over all units come to the driver."""
        s = units.agg(F.sum("bad"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1)), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
        bad, n, nn, k, spread = (float(x or 0) for x in s)
        p = bad / n if n else 0.0
        unit = p * (1 - p)
        room = unit * (n - nn / n - (k - 1)) if n else 0.0
        rho = ((spread - n * p * p) - unit * (k - 1)) / room if room > 0 else self.least_rho
        rho = min(self.most_rho, max(self.least_rho, rho))
        return 1 / rho - 1

    def scores(self, hosts: DataFrame) -> DataFrame:
        """hosts (host, bad, n) -> host, mean, low: posterior mean and lower bound of the share of bad outcomes."""
        hosts = hosts.withColumns({"domain": site_of(F.col("host"), "domain"), "suffix": site_of(F.col("host"), "suffix")})
        summed = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
        levels = [hosts.groupBy("suffix").agg(*summed), hosts.groupBy("domain").agg(*summed, F.max("suffix").alias("suffix")), hosts]
        total = hosts.agg(*summed).first()
        overall = (float(total["bad"] or 0) + 0.5) / (float(total["n"] or 0) + 1.0) if total["n"] else 0.0
        above = None
        for key, units in zip(("suffix", "domain", "host"), levels, strict=True):
            c = self.concentration(units.filter("n > 0"))
            if above is None:
                units = units.withColumn("prior", F.lit(overall))
            else:
                parent = "suffix" if key == "domain" else "domain"
                units = units.join(above, parent)
            a, b = F.col("prior") * c + F.col("bad"), (1 - F.col("prior")) * c + F.col("n") - F.col("bad")
            mean = a / (a + b)
            units = units.withColumns({"mean": mean, "low": mean - self.z * F.sqrt(mean * (1 - mean) / (a + b + 1))})
            above = units.select(key, F.col("mean").alias("prior"))
        return units.select("host", "mean", "low")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, reputation: Reputation | None = None) -> DataFrame:
    """pages (page_id, url) and outcomes (doc_id, bad 0/1) -> page_id, host, path, rule, verdict, bad_mean, bad_low.
    The outcome of a page is that of the document whose number closes its path (/lang/NUMBER). A host with very many
    pages is split by the skew join; the counts are pre-aggregated."""
    reputation = reputation or Reputation()
    host, path = host_and_path(F.col("url").cast("string"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = seen.select("host", F.expr("try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) as long)").alias("doc_id"))
    outcomes = outcomes.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    counts = judged.join(outcomes, "doc_id", "left").groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("bad").alias("n"))
    scores = reputation.scores(counts)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("low") >= reputation.block_at, "block").otherwise("allow")
    return seen.join(scores, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, by_method).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A labelled document is a bad outcome if it is toxic or of low quality."""
    return labels.select("doc_id", F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1))).cast("int").alias("bad"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = "(host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{p}')"
    cases = [(t, v, fits.format(n=t.partition("/")[0], p=t.partition("/")[2])) for t, v in sorted(RULES, key=lambda r: -len(r[0]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for t, _, f in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for _, v, f in cases) + " WHEN low >= 0.5 THEN 'block' ELSE 'allow' END"

    def level(name: str, key: str, parent: str | None) -> str:
        prior = "(SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1.0) ELSE 0 END FROM h)" if parent is None else f"p_{parent}.mean"
        join = "" if parent is None else f" JOIN p_{parent} ON p_{parent}.{parent} = u_{name}.{parent}"
        return f"""
s_{name} AS (SELECT sum(bad)::DOUBLE bad, sum(n)::DOUBLE n, sum(n * n)::DOUBLE nn, count(*)::DOUBLE k, sum(bad * bad / n::DOUBLE) spread FROM u_{name} WHERE n > 0),
r_{name} AS (SELECT bad / n p, bad / n * (1 - bad / n) unit, bad / n * (1 - bad / n) * (n - nn / n - (k - 1)) room, n, k, spread FROM s_{name}),
c_{name} AS (SELECT 1 / least(0.5, greatest(0.001, CASE WHEN room > 0 THEN ((spread - n * p * p) - unit * (k - 1)) / room ELSE 0.001 END)) - 1 AS c FROM r_{name}),
q_{name} AS (SELECT u_{name}.*, {prior} * c + u_{name}.bad a, (1 - {prior}) * c + u_{name}.n - u_{name}.bad b FROM u_{name} CROSS JOIN c_{name}{join}),
p_{name} AS (SELECT *, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM q_{name})"""

    bare = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.+$', '', 'g')"
    last = lambda n: f"array_to_string(string_split({bare}, '.')[-{n}:], '.')"
    site = lambda n: f"CASE WHEN regexp_matches({bare}, '{NUMERIC}') THEN {bare} WHEN regexp_matches({bare}, '{TWO_LABELS}') THEN {last(n + 1)} ELSE {last(n)} END"
    return f"""
WITH e AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
g AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM e),
o AS (SELECT doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(bad), 0)::BIGINT AS bad, count(bad) AS n FROM g LEFT JOIN o ON o.doc_id = try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) AS BIGINT) GROUP BY host),
u_host AS (SELECT *, {site(2)} AS domain, {site(1)} AS suffix FROM h),
u_suffix AS (SELECT suffix, sum(bad) bad, sum(n) n FROM u_host GROUP BY suffix),
u_domain AS (SELECT domain, max(suffix) suffix, sum(bad) bad, sum(n) n FROM u_host GROUP BY domain),{level("suffix", "suffix", None)},{level("domain", "domain", "suffix")},{level("host", "host", "domain")}
SELECT page_id, g.host, path, {rule.replace("host", "g.host")} AS rule, {verdict.replace("host", "g.host")} AS verdict FROM g LEFT JOIN p_host ON p_host.host = g.host
"""


OP9_SQL = _sql()
