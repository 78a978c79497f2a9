"""Cards of five kinds, rules about facts, answers with forbidden words, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import cards, evaluation, labels, retrieval
from tallyloom.plans.registry import query, table

MONTH_SQL = "['Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık']"
DAY_SQL = f"day({{0}}) || ' ' || {MONTH_SQL}[month({{0}})] || ' ' || year({{0}})"
START, END = DAY_SQL.format("o_orderdate"), DAY_SQL.format("(o_orderdate::DATE + 30)")


@query(f"""
WITH f AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity::INT END) AS taksit, max(CASE WHEN l_linenumber = 2 THEN l_quantity::INT * 1000 END) AS harcama FROM lineitem GROUP BY l_orderkey),
a AS (SELECT l_orderkey, string_agg(v, ', ' ORDER BY rn) AS v FROM (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, v) AS rn FROM (SELECT l_orderkey, 'line ' || l_linenumber AS v, max(0.6 + l_discount) AS c FROM lineitem GROUP BY 1, l_linenumber)) WHERE rn <= 3 GROUP BY l_orderkey)
SELECT 'campaign' AS kind, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Bilinmeyen banka' ELSE o_orderpriority END || ' — Kampanya ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Açıklama' ELSE '' END
  || coalesce(chr(10) || 'Sektör: ' || a.v || '.', '') || CASE WHEN taksit IS NULL AND harcama IS NULL THEN '' ELSE chr(10) || CASE WHEN taksit IS NULL THEN 'Asgari ' ELSE taksit || ' taksit' || CASE WHEN harcama IS NULL THEN '' ELSE ', asgari ' END END || CASE WHEN harcama IS NULL THEN '' ELSE (harcama // 1000) || '.000 TL harcama' END || '.' END
  || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'Geçerlilik: ' || {START} || ' – ' || {END} || '.' WHEN 1 THEN 'Geçerlilik: ' || {END} || ' tarihine kadar.' WHEN 2 THEN 'Başlangıç: ' || {START} || '.' ELSE 'Geçerlilik tarihi kaynakta belirtilmemiş.' END AS card
FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN a ON a.l_orderkey = o_orderkey
UNION ALL SELECT 'bank', n_nationkey, n_name || ' — katılım bankası' || chr(10) || 'Adres: https://' || lower(replace(n_name, ' ', '')) || '.example' || chr(10) || CASE WHEN c.n IS NULL THEN 'Yayımlanmış kampanya sayfası bulunamadı.' ELSE 'Veri setinde ' || c.n || ' kampanyası bulunuyor.' END FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1) c ON s_nationkey = n_nationkey
UNION ALL SELECT 'term', r_regionkey, r_name || ' — katılım bankacılığı terimi' || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN 'Konvansiyonel bankacılıktaki karşılığı: faiz. Katılım bankacılığında bu terim kullanılmaz.' ELSE 'Konvansiyonel karşılığı: faiz.' END FROM region
UNION ALL SELECT 'product', p_partkey, p_brand || ' — ' || p_name || chr(10) || CASE WHEN p_size > 25 THEN p_size || '.000 - ' || (2 * p_size) || '.000 TL finansman, ' ELSE '' END || p_size || ' aya kadar vade.' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '(bankanın hesaplama aracından alınan tahmini değer, bağlayıcı değildir)' ELSE '' END FROM part
UNION ALL SELECT 'rate', p_partkey, p_brand || ' — ' || CASE WHEN p_partkey % 3 = 0 THEN 'Bilinmeyen ürün' ELSE p_name END || ' kâr payı oranı' || chr(10) || CASE WHEN p_size > 9 THEN p_size || ' ay vade, kâr' ELSE 'Kâr' END || ' payı oranı %' || CASE WHEN p_size % 2 = 0 THEN '2,05' ELSE '3' END || '.' || CASE WHEN p_partkey % 7 = 0 THEN chr(10) || 'Varyant: sigortalı.' ELSE '' END FROM part
""")
def five_kinds_of_cards(spark, sf):
    o = table(spark, sf, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    campaigns = o.select(
        k.alias("id"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("bank"), F.concat(F.lit("Kampanya "), k.cast("string")).alias("title"), F.when(k % 2 == 0, " Açıklama ").alias("about"),
        F.when(k % 4 % 2 == 0, day).alias("begins"), F.when(k % 4 < 2, F.date_add(day, 30)).alias("ends"),
    )
    li, q = table(spark, sf, "lineitem"), F.col("l_quantity").cast("int")
    n = F.col("l_linenumber")
    facts = li.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("id"), n).agg(F.max(q).alias("q")).select("id", F.when(n == 1, "installment_count").otherwise("min_spend_try").alias("field"), F.when(n == 1, F.col("q")).otherwise(F.col("q") * 1000).cast("string").alias("value"), F.lit(0.9).alias("confidence"), F.lit(True).alias("valid"))
    worse = facts.select("id", "field", F.lit("1").alias("value"), F.lit(0.7).alias("confidence"), "valid").unionByName(facts.select("id", "field", F.lit("2").alias("value"), F.lit(1.0).alias("confidence"), F.lit(False).alias("valid")))
    named = li.groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("line_"), n.cast("string")).alias("value")).agg(F.max(F.lit(0.6) + F.col("l_discount")).alias("confidence")).withColumn("axis", F.lit("sector"))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("id").cast("long").alias("id"), "card")
    out = kind(cards.campaign_cards(campaigns, facts.unionByName(worse), named, "id", "bank", "title", "about", "begins", "ends"), "campaign")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name", F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".example")).alias("site"), F.lit(None).cast("string").alias("notes"))
    out = out.unionByName(kind(cards.bank_cards(nations, table(spark, sf, "supplier").filter("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("id")), "id", "n_name", "site", "notes"), "bank"))
    none = F.lit(None).cast("string")
    out = out.unionByName(kind(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), cards.glossary_card(F.col("r_name"), none, F.lit("faiz"), F.col("r_regionkey") % 2 == 0).alias("card")), "term"))
    part, size, p = table(spark, sf, "part"), F.col("p_size"), F.col("p_partkey")
    large = F.when(size > 25, size * 1000)
    out = out.unionByName(kind(part.select(p.alias("id"), cards.product_card(F.col("p_brand"), F.col("p_name"), none, large, large * 2, size, p % 2 != 0).alias("card")), "product"))
    rate = F.when(size % 2 == 0, F.lit("2.0500")).otherwise("3.0000").cast("decimal(8,4)")
    return out.unionByName(kind(part.select(p.alias("id"), cards.rate_card(F.col("p_brand"), F.when(p % 3 != 0, F.col("p_name")), F.when(size > 9, size), rate, F.lit(None).cast("decimal(8,4)"), F.when(p % 7 == 0, "sigortalı"), F.lit(True)).alias("card")), "rate"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, concat_ws(',', CASE WHEN l_linenumber % 4 = 0 THEN 'tarih_sirasi' END, CASE WHEN l_discount > 0.05 THEN 'kar_payi_araligi' END, CASE WHEN l_quantity > 40 AND l_linenumber % 2 = 0 THEN 'harcama_araligi' END, CASE WHEN l_quantity < 3 THEN 'vade_araligi' END, CASE WHEN l_quantity > 45 THEN 'taksit_araligi' END, CASE WHEN l_tax > 0.07 THEN 'iade_orani' END) AS broken FROM lineitem
""")
def rules_of_metrics(spark, sf):
    """Rows of metrics against the eight rules; a rule about a missing field says nothing."""
    q, n, day = F.col("l_quantity"), F.col("l_linenumber"), F.to_date("l_shipdate")
    m = table(spark, sf, "lineitem").withColumns({
        "start_date": day, "end_date": F.when(n % 4 == 0, F.date_sub(day, 1)).when(n % 4 == 1, day), "profit_rate_pct": F.when(F.col("l_discount") > 0.05, 101.0).otherwise(F.col("l_tax")), "min_spend_try": F.when(n % 2 == 0, q), "max_spend_try": F.lit(40.0),
        "term_months_max": F.when(q < 3, 361).otherwise(360), "installment_count": F.when(q > 45, 0).otherwise(60), "reward_amount_try": q, "cashback_pct": F.when(F.col("l_tax") > 0.07, -1.0).otherwise(100.0), "financing_amount_min": F.lit(None).cast("double"), "financing_amount_max": q,
    })
    return m.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", F.array_join(labels.campaign_logic(m.columns), ",").alias("broken"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'refusal' ELSE 'template' END AS source, CASE WHEN o_orderkey % 3 <> 0 AND o_orderpriority LIKE '1%' THEN 'faiz' ELSE '' END AS terms, TRUE AS grounded FROM orders
""")
def answers_with_forbidden_words(spark, sf):
    k = F.col("o_orderkey")
    said = F.when(F.startswith("o_orderpriority", F.lit("1")), "Yıllık FAİZ oranı 12").when(F.startswith("o_orderpriority", F.lit("2")), "Faizsiz 12 ay").otherwise("Kâr payı 12")
    hits = table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("rank"), F.lit("Kart").alias("title"), F.when(k % 3 != 0, said).alias("card"))
    out = retrieval.grounded_answers(hits, "o_orderkey", "rank", "title", "card", forbidden=("faiz",), allowed=("faizsiz",))
    return out.select("o_orderkey", "source", F.array_join("terms", ",").alias("terms"), "grounded")


@query("""
WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'blind' ELSE 'assisted' END AS m, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS fn FROM labels GROUP BY 1),
f AS (SELECT m, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT round(max(CASE WHEN m = 'blind' THEN f1 END), 6)::DOUBLE AS blind_f1, round(max(CASE WHEN m = 'assisted' THEN f1 END), 6)::DOUBLE AS assisted_f1, round(max(CASE WHEN m = 'assisted' THEN f1 END) - max(CASE WHEN m = 'blind' THEN f1 END), 6)::DOUBLE AS gap FROM f
""")
def blind_and_assisted(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = table(spark, sf, "labels").groupBy(F.when(F.col("doc_id") % 3 == 0, "blind").otherwise("assisted").alias("method")).agg(one(q & t).alias("tp"), one(~q & t).alias("fp"), one(q & ~t).alias("fn"), one(~q & ~t).alias("tn"))
    return evaluation.gap_of_methods(counts).select(*[F.round(c, 6).alias(c) for c in ("blind_f1", "assisted_f1", "gap")])
