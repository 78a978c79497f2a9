"""Pages, feeds, labels and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import html, text
from tallyloom.operators import answers, extraction, facts, filters, labels, ranking
from tallyloom.plans import question
from tallyloom.plans.registry import dealt, query, table
from tallyloom.sources import feeds


@query("SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<article.*', ''), '<li>')) AS n_links FROM pages")
def tag_counts(spark, sf):
    head = F.regexp_replace("html", r"(?s)<article.*", "")
    return table(spark, sf, "pages").select("page_id", F.regexp_count(head, F.lit("<li>")).cast("long").alias("n_links"))


@query(r"""
SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY 'https://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') ||
  CASE WHEN contains(url, 'page=2') THEN '?page=2' ELSE '' END ORDER BY page_id, url) AS rn FROM pages WHERE contains(url, '/en/')) WHERE rn = 1
""")
def sitemap_roundtrip(spark, sf):
    """A sitemap of all addresses, in pieces, and the addresses read from it."""
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    maps = table(spark, sf, "pages").select("page_id", entry.alias("xml"))
    urls = maps.select(F.col("page_id").alias("place"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")).withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&")))
    kept = urls.filter(F.contains("url", F.lit("/en/"))).withColumn("key", filters.canonical_url(F.col("url")))
    return filters.first_per_key(kept, ["key"], ["place", "url"]).select("url")


@query(r"""
SELECT count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS denied FROM (
  SELECT CASE WHEN host LIKE 'm.%' THEN FALSE WHEN host LIKE 'www.%' THEN TRUE WHEN starts_with(path, '/en/1') THEN TRUE WHEN starts_with(path, '/en/') THEN FALSE ELSE TRUE END AS allowed
  FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages))
""")
def robots_gate(spark, sf):
    url = F.col("url")
    urls = table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/1 # but\nDisallow:\n")
    robots = urls.select("host").distinct().select("host", F.when(F.col("host").like("m.%"), 503).when(F.col("host").like("www.%"), 404).otherwise(200).alias("status"), body.alias("body"))
    out = feeds.robots_allowed(urls, feeds.robots_rules(robots))
    return out.agg(F.count(F.when(F.col("robots_allowed"), 1)).alias("allowed"), F.count(F.when(~F.col("robots_allowed"), 1)).alias("denied"))


@query("SELECT n_name, cell, sum(v)::DOUBLE AS total FROM (SELECT n_name, unnest(['1m', '3m']) AS cell, unnest([s_acctbal, s_acctbal * 2]) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY n_name, cell".replace("sum(v)::DOUBLE", "round(sum(v), 2)::DOUBLE"))
def pivot_feed_cells(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    amount = lambda x: F.format_number(x, 2)
    feed = s.select("n_name", F.to_json(F.create_map(F.lit("1m|TRY"), F.replace(amount(F.col("s_acctbal")), F.lit(","), F.lit("")), F.lit("3m|TRY"), F.replace(amount(F.col("s_acctbal") * 2), F.lit(","), F.lit("")))).alias("body"))
    cells = feeds.pivot_feed(feed, "body", ["n_name"])
    return cells.groupBy("n_name", F.col("term").alias("cell")).agg(F.round(F.sum("value").cast("double"), 2).alias("total"))


RULES = [("metal", "steel", "type", 0.7, ("steel", "iron")), ("metal", "brass", "type", 0.9, ("brass",)), ("size", "small", "type", 0.7, ("small ", "economy")), ("size", "large", "type", 0.7, ("large",))]


@query("""
WITH h AS (SELECT p_partkey, 'metal' AS axis, 'steel' AS value, 0.7 AS confidence FROM part WHERE regexp_matches(lower(p_type), '(^|[^a-z0-9])(steel|iron)') UNION ALL SELECT p_partkey, 'metal', 'brass', 0.9 FROM part WHERE regexp_matches(lower(p_type), '(^|[^a-z0-9])brass')
  UNION ALL SELECT p_partkey, 'size', 'small', 0.7 FROM part WHERE regexp_matches(lower(p_type), '(^|[^a-z0-9])(small($|[^a-z0-9])|economy)') UNION ALL SELECT p_partkey, 'size', 'large', 0.7 FROM part WHERE regexp_matches(lower(p_type), '(^|[^a-z0-9])large'))
SELECT axis, value, count(*) AS n, round(sum(confidence), 4)::DOUBLE AS sure FROM (SELECT * FROM h UNION ALL SELECT p_partkey, axis, 'other', 0.3 FROM part, (SELECT unnest(['metal', 'size']) AS axis) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p_partkey = part.p_partkey AND h.axis = x.axis)) GROUP BY axis, value
""")
def keyword_labels(spark, sf):
    found = labels.keyword_labels(table(spark, sf, "part"), "p_partkey", {"type": "p_type"}, RULES)
    return found.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("sure"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN item_id % 5 = 0 THEN 'no_evidence' WHEN item_id % 5 = 1 THEN 'evidence_not_in_source' WHEN item_id % 5 = 2 THEN 'number_not_in_source' ELSE 'accepted' END AS reason FROM benchmark) GROUP BY reason")
def guard_facts(spark, sf):
    """Facts whose evidence or number was spoilt on purpose are found out."""
    k = F.col("item_id") % 5
    amount = F.concat(F.lit(" odeme "), F.format_number((F.col("item_id") + 1) * 1000, 0), F.lit(" TL"))
    f = table(spark, sf, "benchmark").select("item_id", F.concat("text", amount).alias("source"), F.substring("text", 5, 40).alias("e"))
    evidence = F.when(k == 0, "  ").when(k == 1, F.concat("e", F.lit(" xyzzy"))).otherwise(F.concat(F.lit("\u00a0 "), F.col("e")))
    value = F.when(k == 2, F.lit("987654321")).when(k == 3, ((F.col("item_id") + 1) * 1000).cast("string")).otherwise(F.lit("0"))
    reason = labels.guard_reason(evidence, F.col("source"), value, F.lit(False))
    return f.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS bank_code, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0 AND c_acctbal >= 5000 GROUP BY c_mktsegment")
def question_count(spark, sf):
    """A question in words, answered over all rows that pass its filters."""
    corpus = table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign_id"), F.col("c_mktsegment").alias("bank_code"), F.when(F.col("c_nationkey") % 3 != 0, "active").otherwise("expired").alias("status"), F.col("c_acctbal").alias("balance"))
    plan = question.parse_question("Building ve Machinery bankalarında bakiyesi 5 bin TL üzerinde kaç tane aktif kampanya var?", {"Building": "BUILDING", "Machinery": "MACHINERY"}, {}, {"balance": ("bakiye",)})
    return question.answer(plan, corpus)


@query("""
WITH q AS (SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nat FROM customer),
k AS (SELECT *, CASE WHEN nat % 5 = 0 THEN 'MACHINERY' ELSE seg END AS bank, nat * 300 AS least, nat % 4 AS kind FROM q),
p AS (SELECT k.seg, k.nat, k.kind, c.* FROM k JOIN customer c ON c.c_mktsegment = k.bank AND CASE k.kind WHEN 0 THEN c_nationkey % 3 <> 0 AND c_acctbal >= least WHEN 1 THEN c_nationkey % 3 = 0 WHEN 2 THEN c_nationkey % 3 <> 0 AND c_nationkey % 2 = 0 ELSE c_nationkey % 3 <> 0 AND c_acctbal <= 1000 END),
a AS (SELECT seg, nat, 'count' AS part, c_mktsegment AS bank, NULL::BIGINT AS document, NULL::DOUBLE AS value, NULL::INT AS rank, count(*) AS n FROM p WHERE kind = 0 GROUP BY ALL
  UNION ALL SELECT seg, nat, 'extremum', any_value(c_mktsegment), arg_max(c_custkey, {'v': c_acctbal, 'i': -c_custkey}), max(c_acctbal), 1, count(c_acctbal) FROM p WHERE kind = 1 GROUP BY seg, nat
  UNION ALL SELECT seg, nat, 'hit', c_mktsegment, c_custkey, 0.0, rn, NULL FROM (SELECT *, row_number() OVER (PARTITION BY seg, nat ORDER BY c_custkey) AS rn FROM p WHERE kind >= 2) WHERE rn <= 5)
SELECT k.seg, k.nat, CASE WHEN kind < 2 THEN 'aggregate' ELSE 'search' END AS intent, part, a.bank, document, value, rank, n FROM k LEFT JOIN a USING (seg, nat)
""")
def questions_in_bulk(spark, sf):
    """A question per segment and nation, in four forms, some with another bank chosen; all are answered together."""
    c = dealt(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    nation = F.col("c_nationkey")
    corpus = c.select("c_custkey", F.col("c_mktsegment").alias("bank_code"), F.when(nation % 3 != 0, "active").otherwise("expired").alias("status"), F.array(F.when(nation % 2 == 0, "even").otherwise("odd")).alias("side"), F.col("c_acctbal").alias("balance"))
    name = F.initcap("c_mktsegment")
    forms = F.when(nation % 4 == 0, F.concat(name, F.lit(" bankasında bakiyesi "), (nation * 300).cast("string"), F.lit(" TL üzerinde kaç tane aktif kampanya var?"))).when(nation % 4 == 1, F.concat(F.lit("Bitmiş kampanyalardan "), name, F.lit(" için en yüksek bakiye hangisi?")))
    forms = forms.when(nation % 4 == 2, F.concat(name, F.lit(" çift taraflı kampanyalar"))).otherwise(F.concat(name, F.lit(" bakiyesi 1.000 TL altında olan kampanyalar")))
    asked = c.select("c_mktsegment", "c_nationkey").distinct().select((F.xxhash64("c_mktsegment", "c_nationkey")).alias("q"), F.col("c_mktsegment").alias("seg"), nation.alias("nat"), forms.alias("words"), F.when(nation % 5 == 0, "MACHINERY").alias("chosen"))
    banks = {b.title(): b for b in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    out = answers.answers(asked, "q", "words", "chosen", corpus, "c_custkey", "bank_code", "status", {"side": {"even": ("çift",), "odd": ("tek taraf",)}}, {"balance": ("bakiye",)}, banks)
    return asked.select("q", "seg", "nat").join(out, "q").drop("q")


@query("SELECT s_nationkey, arg_max(s_suppkey, s_suppkey) AS newest, count(*) AS n, round(min(s_acctbal), 2) AS least FROM supplier GROUP BY s_nationkey")
def grouped_min_latest(spark, sf):
    s = table(spark, sf, "supplier")
    latest = filters.latest_per_key(s.select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"]).withColumnRenamed("s_suppkey", "newest")
    return s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("s_acctbal"), 2).alias("least")).join(latest, "s_nationkey").select("s_nationkey", "newest", "n", "least")


@query("SELECT s_name AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS match FROM supplier")
def version_suffix_match(spark, sf):
    s = table(spark, sf, "supplier")
    base = s.filter("s_suppkey % 3 = 0").select(F.concat(F.regexp_replace("s_name", "#", "x"), F.lit("-2")).alias("key"), "s_name")
    existing = base.select("key")
    wanted = s.select(F.regexp_replace("s_name", "#", "x").alias("key"), "s_name")
    # The number in a name is no version here: a letter keeps it apart.
    mark = lambda df: df.withColumn("key", F.concat(F.regexp_replace("key", r"-2$", ""), F.lit("v"), F.when(F.col("key").endswith("-2"), "-2").otherwise("")))
    out = facts.suffix_match(mark(existing), mark(wanted), "key")
    return out.select(F.col("s_name").alias("key"), F.when(F.col("match").isNotNull(), F.col("s_name")).alias("match"))


@query("SELECT p_partkey, 'Product: ' || p_name || '. Brand: ' || p_brand || '.' || CASE WHEN p_size > 25 THEN ' Size: ' || p_size || '.' ELSE '' END AS card FROM part")
def entity_cards(spark, sf):
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", labels.card([("Product", F.col("p_name")), ("Brand", F.col("p_brand")), ("Size", size)]).alias("card"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'no_data' ELSE 'ranked' END AS status FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)) GROUP BY status")
def missing_is_reported(spark, sf):
    c = table(spark, sf, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    ranked = ranking.rank_with_missing(c, "v", ["c_nationkey", "c_mktsegment"], "c_custkey")
    return ranked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT l_orderkey, l_linenumber, round(l_tax * 100, 2) AS rate, l_quantity::INT AS months, l_quantity::INT * 1000 AS spend, l_linenumber AS instalments, l_shipdate::DATE AS until FROM lineitem
""")
def rule_facts_roundtrip(spark, sf):
    """Campaign sentences written from rows, read back as facts, pivoted to metrics."""
    q = F.col("l_quantity").cast("int").cast("string")
    sentence = F.concat(
        F.lit("Aylık %"), text.number_tr(F.col("l_tax") * 100), F.lit(" kâr payı ile "), q, F.lit(" ay vade. "), q, F.lit(" bin TL ve üzeri alışverişlere "), F.col("l_linenumber").cast("string"), F.lit(" taksit. Son gün "), text.date_tr(F.to_date("l_shipdate")), F.lit("."),
    )
    docs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sentence.alias("t")).distinct()
    found = extraction.text_metrics(docs, "t", ["profit_rate_pct", "term_months_min", "min_spend_try", "installment_count", "end_date"])
    return found.select(
        "l_orderkey", "l_linenumber", F.round(F.col("profit_rate_pct").cast("double"), 2).alias("rate"), F.col("term_months_min").cast("int").alias("months"),
        F.col("min_spend_try").cast("double").cast("int").alias("spend"), F.col("installment_count").cast("int").alias("instalments"), F.col("end_date").cast("date").alias("until"),
    )
