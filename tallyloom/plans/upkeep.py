"""Limits, periods, matching, audits and table changes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import boilerplate, chunks, limits, text
from tallyloom.operators import audits, changes, matching, periods, sampling
from tallyloom.plans.registry import dealt, query, table


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderdate::DATE + 40 WHEN o_orderkey % 4 = 2 THEN o_orderdate::DATE END AS "end",
       CASE o_orderkey % 4 WHEN 2 THEN 'partial' WHEN 3 THEN 'unknown' ELSE 'exact' END AS precision FROM orders
""")
def campaign_periods(spark, sf):
    """Pages that tell their period in four ways: below a label, in a sentence, above a marker, not at all."""
    day = F.to_date("o_orderdate")
    digits = lambda d: F.date_format(d, "dd-MM-yyyy")
    ends = F.date_add(day, 40)
    field = F.concat(F.lit("Başlık\nKampanya Dönemi\n\n"), digits(day), F.lit("\n-\n"), digits(ends), F.lit("\n\nSon Gün 01.01.2030"))
    sentence = F.concat(F.lit("Yayın Tarihi 01.01.2010\nKampanya "), text.date_tr(day), F.lit(" – "), text.date_tr(ends), F.lit(" tarihleri arasında geçerlidir.\nÖdüller 1 Nisan 2031 tarihinde yüklenir."))
    banner = F.concat(F.lit("Kampanya\n"), digits(day), F.lit("\nTarihinde Sona Ermiştir.\nKoşullar"))
    other = F.concat(F.lit("Güncelleme Tarihi\n"), digits(day), F.lit("\n5 Ağustos 2023 tarihi itibarıyla müşteri olanlar"))
    k = F.col("o_orderkey") % 4
    docs = dealt(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.when(k == 0, field).when(k == 1, sentence).when(k == 2, banner).otherwise(other).alias("t"))
    return periods.campaign_period(docs, "o_orderkey", "t").drop("evidence")


@query("""
SELECT p_partkey, round(p_retailprice, 2) AS amount_min, round(p_retailprice * 2, 2) AS amount_max, least(6, p_size) AS term_months_min, greatest(12, p_size) AS term_months_max, p_size AS ltv_max_pct, 'text' AS limit_source FROM part
""")
def text_limits(spark, sf):
    n = lambda c: text.number_tr(c)
    words = F.concat(n(F.col("p_retailprice")), F.lit(" TL - "), n(F.col("p_retailprice") * 2), F.lit(" TL arası; vade 6, 12 ve "), F.col("p_size").cast("string"), F.lit(" ay; ekspertiz değerinin %"), F.col("p_size").cast("string"), F.lit("'ine kadar. %40-60 paylaşım."))
    found = limits.with_limits(table(spark, sf, "part").select("p_partkey", words.alias("t")), "t")
    return found.select("p_partkey", F.col("amount_min").cast("double").alias("amount_min"), F.col("amount_max").cast("double").alias("amount_max"), "term_months_min", "term_months_max", "ltv_max_pct", "limit_source")


@query("""
SELECT p_partkey, p_name AS name, 1 AS term_min, p_size AS term_max, p_size * 12 AS head_months, round(p_retailprice, 2) AS band_lo, round(p_retailprice * 3, 2) AS band_hi, round(p_retailprice, 2) AS number FROM part
""")
def option_labels(spark, sf):
    """Labels of calculators, heads of columns, bands and numbers, written and read back."""
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice")
    label = F.concat("p_name", F.lit("  (1-"), size, F.lit(" AY)"))
    p = dealt(spark, sf, "part", "p_partkey", "p_name", "p_size", "p_retailprice").select("p_partkey", label.alias("l"), F.concat(size, F.lit(" Yıl (%)")).alias("h"), F.concat(text.number_tr(price), F.lit(" TL < DEĞER <= "), text.number_tr(price * 3), F.lit(" TL")).alias("b"), F.concat(F.lit("01.02.2026 tarihinde "), text.number_tr(price)).alias("n"))
    read = p.select("p_partkey", "h", "n", limits.option_limits(F.col("l")).alias("o"), limits.value_band(F.col("b")).alias("band"))  # each text is read once
    o, band = F.col("o"), F.col("band")
    return read.select(
        "p_partkey", o["name"].alias("name"), o["term_min"].alias("term_min"), o["term_max"].alias("term_max"), limits.term_header(F.col("h"))["months"].alias("head_months"), band["lo"].cast("double").alias("band_lo"), band["hi"].cast("double").alias("band_hi"),
        F.get(limits.numbers_in(F.col("n")), F.lit(0)).cast("double").alias("number"),
    )


@query(r"""
SELECT doc_id, md5('Kampanya X' || chr(10) || t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents) WHERE length(t) >= 400
""")
def own_campaign_text(spark, sf):
    """Menus, buttons and other campaigns around a text of some length are cut off."""
    docs = table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("t")).filter(F.length("t") >= 400)
    page = F.concat(F.lit("Menü\nKampanyalar\nKampanya X\n"), F.col("t"), F.lit("\nPaylaş\nİlgili Kampanyalar:\nBaşka kampanya"))
    own = boilerplate.own_text(docs.select("doc_id", page.alias("page"), F.lit("KAMPANYA X!").alias("title")), "page", "title", "own")
    return own.select("doc_id", F.md5(F.col("own").cast("binary")).alias("digest"))


@query("SELECT doc_id, 1::BIGINT AS n_chunks, length(trim(text, E' \\n\\t\\r'))::BIGINT AS n_chars FROM documents WHERE length(trim(text, E' \\n\\t\\r')) BETWEEN 1 AND 6000")
def short_texts_in_one_chunk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", chunks.chunks(F.col("text")).alias("c"))
    return docs.filter(F.size("c") == 1).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.length(F.col("c")[0]).cast("long").alias("n_chars"))


@query()
def text_chunks(spark, sf):
    """Chunks of at most 6000 code points of every document."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.chunks(F.col("text"))).alias("chunk", "text"))
    return docs.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""
WITH t AS (SELECT p_partkey, p_brand, p_size, lower(p_name) AS low, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: len(x) > 3)) AS toks FROM part),
h AS (SELECT o.p_partkey, arg_min(p.p_partkey, struct_pack(a := -len(p.toks), b := p.p_partkey)) AS matched FROM t o JOIN t p ON p.p_brand = o.p_brand AND p.p_size <= 10 AND len(p.toks) > 0 AND len(list_filter(p.toks, lambda x: NOT contains(o.low, x))) = 0 GROUP BY o.p_partkey)
SELECT part.p_partkey, matched FROM part LEFT JOIN h USING (p_partkey)
""")
def token_match(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    options = part.select("p_partkey", "p_brand", F.upper("p_name").alias("label"))
    low = options.withColumn("label", F.lower("label"))
    return matching.token_match(low, part.filter("p_size <= 10").withColumnRenamed("p_partkey", "pid"), "p_brand", "label", "p_name", "pid").select("p_partkey", "matched")


@query("""
WITH p AS (SELECT p_partkey AS product, p_brand AS brand, lower(p_name) AS core, replace(lower(p_name), ' ', '-') || '-' || (p_partkey % 3) AS slug FROM part WHERE p_size <= 10 AND length(p_name) >= 10),
c AS (SELECT p_partkey AS campaign, p_brand AS brand, CASE WHEN p_partkey % 4 = 0 THEN 'Yeni ' || upper(p_name) || ' Fırsatı' ELSE 'Fırsat' END AS title, CASE WHEN p_partkey % 4 = 1 THEN '/kampanya/' || replace(lower(p_name), ' ', '-') || '-' || (p_partkey % 3) || '/x' ELSE '/x' END AS address, CASE WHEN p_partkey % 4 >= 2 THEN 'Şimdi ' || p_name || ' için' END AS body FROM part)
SELECT brand, campaign, product, CASE WHEN contains(replace(lower(title), 'ı', 'i'), core) THEN 'title' WHEN contains(address, slug) THEN 'slug' ELSE 'body' END AS method,
  CASE WHEN contains(replace(lower(title), 'ı', 'i'), core) THEN 0.90 WHEN contains(address, slug) THEN 0.85 ELSE 0.60 END::DOUBLE AS confidence,
  CASE WHEN contains(replace(lower(title), 'ı', 'i'), core) THEN title WHEN contains(address, slug) THEN slug ELSE body END AS evidence
FROM c JOIN p USING (brand) WHERE contains(replace(lower(title), 'ı', 'i'), core) OR contains(address, slug) OR contains(lower(coalesce(body, '')), core)
""")
def campaign_products(spark, sf):
    """Campaigns that name a product in their title, address or text."""
    part = table(spark, sf, "part")
    k, slug = F.col("p_partkey"), F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_partkey") % 3).cast("string"))
    campaigns = part.select(
        F.col("p_brand").alias("brand"), k.alias("campaign"), F.when(k % 4 == 0, F.concat(F.lit("Yeni "), F.upper("p_name"), F.lit(" Fırsatı"))).otherwise("Fırsat").alias("title"),
        F.when(k % 4 == 1, F.concat(F.lit("/kampanya/"), slug, F.lit("/x"))).otherwise("/x").alias("address"), F.when(k % 4 >= 2, F.concat(F.lit("Şimdi "), F.col("p_name"), F.lit(" için"))).alias("body"),
    )
    products = part.filter("p_size <= 10").select(F.col("p_brand").alias("brand"), k.alias("product"), F.concat("p_name", F.lit(" (Kredi)*")).alias("name"), slug.alias("slug"))
    return matching.contains_match(campaigns, products, "brand", "campaign", "product", "title", "address", "body", "name", "slug")


@query(r"""
SELECT slug, arg_min(url, struct_pack(a := r, b := url)) AS url FROM (SELECT url, regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS slug,
  CASE WHEN starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/') THEN 0 WHEN starts_with(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/de/') THEN 1 END AS r FROM pages) WHERE r IS NOT NULL AND slug <> '' GROUP BY slug
""")
def best_prefix_per_slug(spark, sf):
    return matching.best_prefix(table(spark, sf, "pages"), "url", ["/en/", "/de/"])


@query("""
WITH o AS (SELECT DISTINCT c_nationkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS opt FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT c_nationkey, o_custkey, list_sort(list(opt)) AS st FROM o GROUP BY 1, 2),
m AS (SELECT DISTINCT a.o_custkey FROM s a JOIN s b ON a.c_nationkey = b.c_nationkey AND a.o_custkey <> b.o_custkey WHERE len(list_intersect(a.st, b.st)) >= 0.5 * least(len(a.st), len(b.st)) AND len(list_intersect(a.st, b.st)) > 0)
SELECT c_nationkey, o_custkey, opt FROM o JOIN m USING (o_custkey)
""")
def shared_selectors(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    options = orders.select("c_nationkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("opt")).distinct()
    return matching.shared_selectors(options, "c_nationkey", "o_custkey", "opt")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN s_suppkey END AS campaign_id, CASE s_suppkey % 3 WHEN 0 THEN 'slug' WHEN 1 THEN 'url' END AS method FROM supplier
""")
def reanchor_keys(spark, sf):
    s = table(spark, sf, "supplier")
    third = F.col("s_suppkey") % 3
    labels = s.select("s_suppkey", F.col("s_nationkey").alias("bank"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("title"))
    campaigns = s.filter(third != 2).select(F.col("s_nationkey").alias("bank"), F.when(third == 0, F.concat(F.lit("k"), F.col("s_suppkey").cast("string"))).otherwise("other").alias("slug"), F.concat(F.lit("https://x.org/a/k"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("url"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("campaign_id"))
    return matching.reanchored(labels, campaigns).select("s_suppkey", "campaign_id", "method")


@query("""
WITH f AS (SELECT user_id, event_type, CASE WHEN event_id % 6 = 0 THEN '' ELSE trim(props) END AS e, event_id % 5 = 0 AS absent FROM events)
SELECT user_id, count(*) AS n_facts, count(*) FILTER (e = '') AS no_evidence, count(*) FILTER (e <> '' AND length(e) < 12) AS short, count(*) FILTER (length(e) > 300) AS long, count(*) FILTER (e <> '' AND absent) AS not_in_source,
       count(DISTINCT event_type) > 1 AND min(e) = max(e) AND max(e) <> '' AS same_evidence FROM f GROUP BY user_id
""")
def evidence_audit(spark, sf):
    k = F.col("event_id")
    f = table(spark, sf, "events").select("user_id", "event_type", F.when(k % 6 == 0, "  ").otherwise(F.col("props")).alias("e"), F.when(k % 5 == 0, "something else").otherwise(F.concat(F.lit("x "), F.upper("props"), F.lit(" y"))).alias("source"))
    return audits.evidence_flags(f, "user_id", "event_type", "e", "source")


@query(r"""
WITH d AS (SELECT doc_id, text, lang <> 'es' AS dated FROM documents),
r AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT dated THEN 'no_date' END, CASE WHEN length(text) < 300 THEN 'short' END,
  CASE WHEN len(regexp_extract_all(text, '(?i)\d[\d.,]*\s*(?:TL|₺)?\s*(?:ve\s*)?(?:üzeri|üzerine|üzerindeki)')) >= 2 THEN 'tiers' END, CASE WHEN contains(lower(text), 'özel oranlı') OR contains(lower(text), 'avantajlı') OR contains(lower(text), 'düşük maliyetli') THEN 'indirect' END,
  CASE WHEN regexp_matches(text, '(?i)saat\s*\d{1,2}[.:]\d{2}') THEN 'timed_date' END,
  CASE WHEN len(regexp_extract_all(text, '%\s*\d+(?:[.,]\d+)?')) >= 2 THEN 'rates' WHEN len(regexp_extract_all(text, '(?i)\d[\d.,]*\s*(?:TL|₺)')) >= 3 THEN 'amounts' END], lambda x: x IS NOT NULL)) AS reason FROM d)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def difficulty_reasons(spark, sf):
    docs = table(spark, sf, "documents").select(F.explode(audits.difficulty(F.col("text"), F.col("lang") != "es")).alias("reason"))
    return docs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_partkey, max(l_tax) FILTER (l_linenumber % 2 = 0) AS rate_a, max(l_tax) FILTER (l_linenumber % 2 = 1) AS rate_b FROM lineitem GROUP BY l_partkey HAVING max(l_tax) FILTER (l_linenumber % 2 = 0) <> max(l_tax) FILTER (l_linenumber % 2 = 1)
""")
def currency_anomalies(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "USD").otherwise("EUR").alias("c"), "l_tax")
    return audits.currency_anomalies(li, ["l_partkey"], "c", "l_tax")


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def coverage_report(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return audits.coverage(table(spark, sf, "customer"), "c_custkey", {"n_orders": orders, "n_events": events})


@query()
def gold_sample(spark, sf):
    """A sample of customers with quotas by segment (bank), nation (kind) and negative balance (hard)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.array(F.col("c_nationkey").cast("string")).alias("kinds"), (F.col("c_acctbal") < 0).alias("hard"))
    return sampling.quota_sample(c, "c_custkey", "c_mktsegment", "kinds", "hard", size=150)


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 5 THEN 'feed' ELSE 'site' END AS source FROM supplier WHERE s_nationkey >= 5 OR s_suppkey % 2 = 0")
def replace_stale(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    old = s.withColumn("source", F.lit("site"))
    fresh = s.filter("s_nationkey < 5 AND s_suppkey % 2 = 0").withColumn("source", F.lit("feed"))
    # A nation that lost all its rows has none in the new version either; every nation below 5 is named by the scope.
    kept = old.join(s.filter("s_nationkey < 5").select("s_nationkey").distinct(), "s_nationkey", "left_anti")
    return changes.replace_stale(kept.select(*old.columns), fresh, ["s_nationkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'expired' ELSE c_mktsegment END AS status, CASE WHEN c_nationkey < 10 THEN 'kept' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'has_children' ELSE 'retired' END AS fate FROM customer")
def expire_and_retire(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("status"))
    children = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    marked = changes.expire(c, c.join(children, "c_custkey", "left_anti"), ["c_custkey"])
    return changes.retire(marked, "c_custkey", c.filter("c_nationkey < 10"), children).select("c_custkey", "status", "fate")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS v FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT v) AS k FROM v GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN k >= 2 AND v IS NOT NULL THEN l_orderkey || '#' || lower(v) ELSE l_orderkey::VARCHAR END AS child, CASE WHEN k >= 2 AND v IS NOT NULL THEN l_orderkey::VARCHAR END AS parent FROM v JOIN n USING (l_orderkey)
""")
def variant_split(spark, sf):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rates = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("p"), "l_orderkey", "l_linenumber", flag.alias("v"))
    return changes.split_variants(rates, "p", "v").select("l_orderkey", "l_linenumber", "child", "parent")


@query("SELECT p_partkey, (p_size * greatest(length(p_brand), 1) * 2)::BIGINT AS n, CASE WHEN p_size * length(p_brand) * 2 <= 60 THEN 'full' WHEN p_size * length(p_brand) * 2 <= 2000 THEN 'grid' ELSE 'pilot' END AS plan FROM part")
def form_combinations(spark, sf):
    n = changes.combinations(F.array(F.col("p_size"), F.length("p_brand"), F.lit(2), F.lit(0)))
    return table(spark, sf, "part").select("p_partkey", n.alias("n")).withColumn("plan", changes.sampling_plan(F.col("n")))
