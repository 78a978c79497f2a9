"""Sources: tables, JSON lines, sitemaps, robots rules, pivot feeds, raw page archives. All are lazy readers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.filters import canonical_url, first_per_key, same_site


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a declared schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def archive(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """path, content, sha256 of archived pages; `verified` says whether the name's last part is the start of the hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    named = F.regexp_extract("path", r"_([0-9a-f]{12})\.[a-z]+$", 1)
    return files.select("path", "content", digest.alias("sha256"), (named == F.substring(digest, 1, 12)).alias("verified"))


def _inflate(content: bytes | None) -> str | None:
    """As far as the stream goes; null if it is none."""
    try:
        return None if content is None else zlib.decompressobj(31).decompress(content).decode("utf-8", "replace")
    except zlib.error:
        return None


@F.pandas_udf(T.StringType())
def _inflated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        yield contents.map(_inflate)


def decoded(content: Column) -> Column:
    """Text of a file's bytes. Only those that begin like gzip, whatever their name, go through Python."""
    packed = F.hex(F.substring(content, 1, 2)) == "1F8B"
    return F.when(packed, _inflated(F.when(packed, content))).otherwise(F.decode(content, "UTF-8"))


def unescaped(c: Column) -> Column:
    """The five references that XML names, the one for & last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def rate_lines(texts: DataFrame, text: str, keys: list[str], bands: tuple[str, ...]) -> DataFrame:
    """key columns, label, band, rate: lines of a rate table's text that end in just as many rates as there are bands."""
    rates = F.regexp_extract_all("line", F.lit(r"%?\s*(\d{1,3}[.,]\d{1,2})(?![\d.,])"), F.lit(1))
    lines = texts.select(*keys, F.explode(F.split(text, r"\r?\n")).alias("line")).withColumn("rates", rates).filter(F.size("rates") == len(bands))
    label = F.trim(F.regexp_extract("line", r"^(.*?)%?\s*\d{1,3}[.,]\d", 1))
    cells = lines.select(*keys, label.alias("label"), F.posexplode("rates").alias("at", "rate"))
    return cells.select(*keys, "label", F.get(F.array(*map(F.lit, bands)), "at").alias("band"), F.replace("rate", F.lit(","), F.lit(".")).try_cast("decimal(9,4)").alias("rate"))


def sitemap_urls(sitemaps: DataFrame, text: str = "xml", site: str | None = None, contains: str | None = None) -> DataFrame:
    """url and its first place, of sitemap documents (broken ones as far as they go); same site and path part if asked;
    one row per canonical address."""
    locs = F.regexp_extract_all(F.col(text), F.lit(r"(?is)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), 1)
    urls = sitemaps.select(F.posexplode(locs).alias("place", "url")).withColumn("url", unescaped(F.col("url")))
    if site:
        urls = urls.filter(same_site(F.col("url"), site))
    if contains:
        urls = urls.filter(F.contains("url", F.lit(contains)))
    return first_per_key(urls.withColumn("key", canonical_url(F.col("url"))), ["key"], ["place", "url"])


def is_sitemap_index(xml):
    return xml.rlike(r"(?is)<(?:\w+:)?sitemapindex[\s>]")


def robots_sitemaps(robots: DataFrame, text: str = "body") -> DataFrame:
    lines = robots.select(F.explode(F.split(text, r"\r?\n")).alias("line"))
    return lines.filter(F.col("line").rlike(r"(?i)^\s*sitemap\s*:")).select(F.trim(F.regexp_replace("line", r"(?i)^\s*sitemap\s*:", "")).alias("url"))


def robots_rules(robots: DataFrame, host: str = "host", status: str = "status", body: str = "body") -> DataFrame:
    """host, rule, allow for the general agent: unreachable or 5xx denies all, 4xx and empty files allow all, else the
    Disallow and Allow lines of the block for *."""
    block = F.regexp_extract(F.col(body), r"(?is)user-agent\s*:\s*\*[^\n]*\n(.*?)(?=\n\s*user-agent\s*:|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"(?i)^\s*(dis)?allow\s*:\s*\S"))
    rules = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(x, r"(?i)^\s*(dis)?allow\s*:|#.*$", "")).alias("rule"), x.rlike(r"(?i)^\s*allow").alias("allow")))
    fixed = F.when(F.col(status).isNull() | (F.col(status) >= 500), F.array(F.struct(F.lit("/").alias("rule"), F.lit(False).alias("allow")))).when((F.col(status) >= 400) | (F.trim(F.coalesce(F.col(body), F.lit(""))) == ""), F.array(F.struct(F.lit("/").alias("rule"), F.lit(True).alias("allow"))))
    return robots.select(host, F.explode(F.coalesce(fixed, rules)).alias("r")).select(host, "r.rule", "r.allow")


def robots_allowed(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """urls with robots_allowed: the longest rule that the path starts with, allowed on ties and without a rule."""
    matched = urls.select(host, path).distinct().join(rules, host)
    best = F.max(F.when(F.expr(f"startswith({path}, rule)"), F.struct(F.length("rule").alias("n"), F.col("allow"))))
    verdicts = matched.groupBy(host, path).agg(best.getField("allow").alias("robots_allowed"))
    return urls.join(verdicts, [host, path], "left").select(*urls.columns, F.coalesce("robots_allowed", F.lit(True)).alias("robots_allowed"))


def pivot_feed(feed: DataFrame, body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """The cells of a feed whose rows map "term|currency" to a decimal text: key columns, term, currency, value."""
    cells = feed.select(*(keys or []), F.explode(F.from_json(body, "map<string,string>")).alias("cell", "text"))
    parts = F.split("cell", r"\|")
    return cells.select(*(keys or []), F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).alias("currency"), F.col("text").try_cast("decimal(12,4)").alias("value"))
