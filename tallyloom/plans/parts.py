"""Small operators over the driver's tables, each against SQL: clean-ups, labels, tables in pages, splits, tiers, feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions import html, limits, parse, text
from tallyloom.operators import facts, finance, labels, periods, sampling, tables
from tallyloom.plans.registry import dealt, query, table
from tallyloom.sources import feeds, sinks, staged


@query("""
SELECT p_partkey, p_name || ' & ' || p_brand AS stripped, replace(lower(p_name), ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) AS slug, upper(p_name[1]) || p_name[2:] AS capital,
  'Second line of ' || p_name || ' that is long enough to count' AS paragraph, 'keep ' || p_name || chr(10) || 'keep ' || p_size AS kept, p_name || ' ends' AS near, NULL::VARCHAR AS far FROM part
""")
def text_clean_ups(spark, sf):
    p, size = F.col("p_name"), F.col("p_size").cast("string")
    lines = F.concat(F.lit("short\n  \nSecond line of "), p, F.lit(" that is long enough to count\nmore"))
    listed = F.concat(F.lit("keep "), p, F.lit("\nAdvert "), size, F.lit("\nkeep "), size)
    return table(spark, sf, "part").select(
        "p_partkey", text.strip_tags(F.concat(F.lit("<p class='x'>"), p, F.lit("</p>\t<b>&</b> "), F.col("p_brand"))).alias("stripped"), text.slugify(F.concat(p, F.lit(" / "), F.col("p_brand"))).alias("slug"), text.capital_tr(p).alias("capital"),
        text.first_paragraph(lines).alias("paragraph"), text.without_lines(listed, "^Advert").alias("kept"), text.snippet(F.concat(p, F.lit(" ends")), p).alias("near"), text.snippet(p, F.lit("absent")).alias("far"),
    )


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag AS axis, l_shipmode AS value, l_discount AS confidence FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE l_linestatus || (l_linenumber % 2) END AS l_shipmode FROM lineitem)),
b AS (SELECT l_orderkey, axis, arg_min(value, {'c': -confidence, 'v': value}) AS value, max(confidence) AS confidence FROM l WHERE axis IN ('A', 'N') AND value IN ('other', 'F0', 'F1', 'O0') GROUP BY l_orderkey, axis),
m AS (SELECT l_orderkey, axis FROM l WHERE axis IN ('A', 'N') AND value IN ('other', 'F0', 'F1', 'O0') GROUP BY l_orderkey, axis HAVING max(CASE WHEN value <> 'other' AND confidence >= 0.05 THEN 1 ELSE 0 END) = 0)
SELECT l_orderkey, axis, value, confidence, m.axis IS NOT NULL AS missing FROM b LEFT JOIN m USING (l_orderkey, axis)
""")
def labels_known_and_best(spark, sf):
    """Labels of a known vocabulary, the best of each axis, and axes that have none worth keeping."""
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("axis"), F.when(n % 3 == 0, "other").otherwise(F.concat("l_linestatus", (n % 2).cast("string"))).alias("value"), F.col("l_discount").alias("confidence"))
    known = labels.known_only(rows, {axis: ("other", "F0", "F1", "O0") for axis in ("A", "N")})
    gone = labels.missing_axes(known, "l_orderkey", least=0.05).withColumn("missing", F.lit(True))
    return facts.best_labels(known, ["l_orderkey", "axis"], "value", "confidence").join(gone, ["l_orderkey", "axis"], "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


@query("""
SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'ticari' WHEN p_type LIKE '%STEEL%' THEN 'kobi' WHEN p_type LIKE '%BRASS%' THEN 'bireysel' END AS segment,
  list_filter([CASE WHEN p_size > 40 THEN 'too_large' END, CASE WHEN p_retailprice < p_size * 30 AND p_size <> 13 THEN 'cheap' END], lambda x: x IS NOT NULL)::VARCHAR AS broken FROM part
""")
def segments_and_rules(spark, sf):
    """Segments by address, else by words; broken rules, where one about a missing field says nothing."""
    part = table(spark, sf, "part")
    url = F.when(F.col("p_brand").endswith("1"), "https://x.example/Ticari/a").otherwise("https://x.example/a")
    segment = labels.segment_of(url, F.col("p_type"), {"ticari": "ticari"}, {"kobi": ("steel",), "bireysel": ("brass",)})
    floor = F.when(F.col("p_size") != 13, F.col("p_size") * 30)
    broken = labels.logic_reasons({"too_large": F.col("p_size") <= 40, "cheap": F.col("p_retailprice") >= floor})
    return part.select("p_partkey", segment.alias("segment"), F.concat(F.lit("["), F.array_join(broken, ", "), F.lit("]")).alias("broken"))


@query("SELECT l_orderkey, string_agg(l_linenumber || '=' || q, ',' ORDER BY l_linenumber) AS fields FROM (SELECT l_orderkey, l_linenumber, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def gold_records(spark, sf):
    """Labels as one record per key, exported as JSON lines and read back with their schema."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    gold = sinks.gold_lines(rows.withColumn("field", F.col("l_linenumber").cast("string")), "l_orderkey", "field", "q")
    path = f"{staged.shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    sinks.export_json_lines({"gold": gold}, path, {"gold": ["l_orderkey"]})
    back = feeds.json_lines(spark, f"{path}/gold", "l_orderkey long, fields map<string,string>")
    return back.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fields"))


@query("SELECT min(o_orderkey) AS next, count(*) AS left_over FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def next_to_label(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    done = table(spark, sf, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("key"))
    left = orders.join(done.distinct(), "key", "left_anti").agg(F.count(F.lit(1)).alias("left_over"))
    return sampling.next_unlabelled(orders, done, "key", "key").select(F.col("key").alias("next")).join(F.broadcast(left))  # a row each


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS start, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE + 9 END AS "end", CASE o_orderkey % 4 WHEN 3 THEN 'unknown' ELSE 'exact' END AS precision,
  CASE o_orderkey % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'conditions' WHEN 2 THEN 'body' END AS source FROM orders
""")
def periods_by_source(spark, sf):
    """The period of a labelled field, else of the conditions, else of the text."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    said = F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" - "), F.date_format(F.date_add(day, 9), "dd.MM.yyyy"))
    valid = F.concat(F.lit("Kampanya "), said, F.lit(" tarihleri arasında geçerlidir."))
    docs = dealt(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.when(k == 0, said).otherwise(F.lit("x" * 300)).alias("field"), F.when(k <= 1, valid).otherwise("Koşul yok").alias("conditions"), F.when(k <= 2, valid).otherwise("Metin").alias("body"))
    return periods.period_in_sources(docs, "o_orderkey", "field", "conditions", "body")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(s, 'the'))) AS n FROM documents")
def sentences_of_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(html.sentences_with(F.col("text"), "the")).alias("n"))


@query("""
SELECT host, 'https://' || host || '/map.xml' AS map, bool_or(page_id % 2 = 0) AS is_index FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) WHERE host <> '' GROUP BY host
""")
def robots_and_indexes(spark, sf):
    """Sitemaps that robots files name, and which sitemaps are lists of others."""
    pages = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")).filter("host <> ''")
    files = pages.select("host").distinct().withColumn("body", F.concat(F.lit("User-agent: *\r\nDisallow: /x\r\n SiteMap : https://"), F.col("host"), F.lit("/map.xml\r\n# Sitemap\n")))
    maps = feeds.robots_sitemaps(files).withColumn("host", F.regexp_extract("url", "://([^/]*)", 1))
    xml = F.when(F.col("page_id") % 2 == 0, F.lit('<?xml version="1.0"?>\n<x:sitemapindex xmlns="y"><x:sitemap/></x:sitemapindex>')).otherwise("<urlset><url/></urlset>")
    index = pages.groupBy("host").agg(F.bool_or(feeds.is_sitemap_index(xml)).alias("is_index"))
    return maps.join(index, "host").select("host", F.col("url").alias("map"), "is_index")


@query("""
SELECT p_partkey, p_size * 100 AS first_threshold, p_size * 10 AS first_reward, 2 AS n_tiers, 50 + p_size % 50 AS investor, 50 - p_size % 50 AS bank, p_size % 15 AS years, 1 + p_size / 100.0 AS lo, 2 + p_size / 100.0 AS hi FROM part
""")
def tiers_splits_and_ages(spark, sf):
    s = lambda c: c.cast("string")
    size = F.col("p_size")
    tier = F.concat(s(size * 100), F.lit(" TL ve üzeri alışverişe "), s(size * 10), F.lit(" TL; "), s(size * 200), F.lit(" TL ve üzeri alışverişe "), s(size * 30), F.lit(" TL"))
    split = F.concat(F.lit("%"), s(50 + size % 50), F.lit(" / %"), s(50 - size % 50))
    age = F.concat(s(size % 15), F.lit(" yaşına kadar 2. el taşıtlar"))
    rates = F.concat(F.lit("%"), F.format_number(1 + size / 100, 2), F.lit(" - %"), F.format_number(2 + size / 100, 2))
    read = dealt(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", parse.tiers(tier).alias("t"), parse.profit_split(split).alias("p"), limits.rate_range(rates).alias("r"), limits.vehicle_age(age).alias("a"))  # each text is read once
    t, p, r = F.col("t"), F.col("p"), F.col("r")
    number = lambda c: c.cast("double")
    return read.select(
        "p_partkey", number(F.get(t, F.lit(0))["threshold"]).alias("first_threshold"), number(F.get(t, F.lit(0))["reward"]).alias("first_reward"), F.size(t).alias("n_tiers"), number(p["investor"]).alias("investor"), number(p["bank"]).alias("bank"),
        F.col("a.hi").alias("years"), number(r["lo"]).alias("lo"), number(r["hi"]).alias("hi"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, round(max(l_tax) * 10 + 0.5, 1) AS rate FROM lineitem GROUP BY 1, 2")
def rates_of_totals(spark, sf):
    """The monthly rate that a plan of instalments stands for, from its total."""
    rate, months = F.col("l_tax") * 10 + 0.5, F.col("l_linenumber") * 6
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("l_tax"))
    total = finance.instalment(F.lit(1_000_000.0), rate, months) * months
    return rows.select("l_orderkey", "l_linenumber", "n", F.round(finance.implied_monthly_rate(F.lit(1_000_000.0), total, months), 1).alias("rate"))


@query("""
SELECT p_partkey, 'rate' AS kind, p_size::DOUBLE AS lo, p_size + 12.0 AS hi, NULL AS class, round(p_retailprice % 5, 2) AS value FROM part
UNION ALL SELECT p_partkey, 'ltv', p_size * 1000.0, p_size * 2000.0, unnest(['A', 'B']), unnest([90 - p_size % 10, 70 - p_size % 10])::DOUBLE FROM part
UNION ALL SELECT p_partkey, 'control', 1, p_size, 'number', NULL FROM part
""")
def tables_of_pages(spark, sf):
    """A rate table, a matrix of ratios and a form in every page, read back from cells and controls."""
    s = lambda c: c.cast("string")
    size, value = F.col("p_size"), F.format_number(F.round(F.col("p_retailprice") % 5, 2), 2)
    rate = F.concat(F.lit("<h2>Oranlar</h2><table><tr><th>Vade</th><th>Kâr Payı Oranı</th><th>Tahsis Ücreti</th></tr><tr><td>"), s(size), F.lit("-"), s(size + 12), F.lit(" ay</td><td>%"), F.translate(value, ".", ","), F.lit("</td><td>5</td></tr><tr><td>99 ay</td><td></td><td>5</td></tr></table>"))
    ltv = F.concat(F.lit("<table><tr><th>Değer</th><th>A</th><th>B</th></tr><tr><td>"), s(size * 1000), F.lit(" TL - "), s(size * 2000), F.lit(" TL</td><td>"), s(90 - size % 10), F.lit("</td><td>"), s(70 - size % 10), F.lit("</td></tr></table>"))
    form = F.concat(F.lit("<form><input type=number name=n min=1 max="), s(size), F.lit("></form>"))
    pages = dealt(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select(F.col("p_partkey").alias("page_id"), F.concat(rate, ltv, form).alias("html"))
    cells = staged.staged(html.exploded(pages, "page_id", "html", "cells"), "cells")  # parsed once
    rates = tables.rate_rows(cells.filter("table_no = 0")).select("page_id", F.lit("rate").alias("kind"), F.col("lo_months").cast("double").alias("lo"), F.col("hi_months").cast("double").alias("hi"), F.lit(None).cast("string").alias("class"), F.col("rate").cast("double").alias("value"))
    ratios = tables.ltv_rows(cells.filter("table_no = 1")).select("page_id", F.lit("ltv").alias("kind"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "class", F.col("ratio").cast("double").alias("value"))
    controls = html.exploded(pages, "page_id", "html", "controls").select("page_id", F.lit("control").alias("kind"), F.col("least").cast("double").alias("lo"), F.col("most").cast("double").alias("hi"), F.col("kind").alias("class"), F.lit(None).cast("double").alias("value"))
    return rates.unionByName(ratios).unionByName(controls).withColumnRenamed("page_id", "p_partkey")
