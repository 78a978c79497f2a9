"""Products, variants, seeds, filtered search, grounded answers and merged labels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import extraction, labels, products, retrieval
from tallyloom.plans.registry import dealt, query, table

STATUS = ("expired", "active", "upcoming", "unknown")
STATUS_SQL = "CASE event_id % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'active' WHEN 2 THEN 'upcoming' ELSE 'unknown' END"
HITS_SQL = f"""
WITH e AS (SELECT event_id, user_id, value, {STATUS_SQL} AS status FROM events),
a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM e QUALIFY r <= 120),
b AS (SELECT event_id, row_number() OVER (ORDER BY user_id DESC, event_id) AS r FROM e QUALIFY r <= 120),
s AS (SELECT event_id, sum(1.0::DOUBLE / (60 + r)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY event_id)
SELECT event_id, status, round(coalesce(rrf, 0), 9) AS score FROM e {{join}} JOIN s USING (event_id) WHERE {{where}}
ORDER BY coalesce(rrf, 0) DESC, CASE status WHEN 'active' THEN 0 WHEN 'unknown' THEN 1 WHEN 'upcoming' THEN 2 ELSE 3 END, event_id LIMIT 150"""


def searched(spark, sf, filtered, where):
    status = F.get(F.array(*map(F.lit, STATUS)), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", status.alias("status"))
    channels = [(retrieval.ranked(rows, c, "event_id", 120, r), r) for c, r in (("value", "by_text"), ("user_id", "by_vector"))]
    found = retrieval.hybrid(rows.filter(where).select("event_id", "status"), channels, "event_id", "status", filtered, 150)
    return found.select("event_id", "status", F.round("score", 9).alias("score"))


@query(HITS_SQL.format(join="LEFT", where="event_id % 8 <> 1"))
def search_with_filters(spark, sf):
    """Every row that passes is a candidate, ranked or not."""
    return searched(spark, sf, True, "event_id % 8 <> 1")


@query(HITS_SQL.format(join="", where="true"))
def search_without_filters(spark, sf):
    return searched(spark, sf, False, "true")


@query("""
SELECT o_orderkey, string_agg('[' || r || '] ' || o_orderpriority || ': line ' || l_linenumber || ' costs ' || floor(l_extendedprice)::BIGINT, chr(10) ORDER BY r) AS answer, count(*) AS n_cited, true AS grounded
FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS r FROM lineitem QUALIFY r <= 5) JOIN orders USING (o_orderkey) GROUP BY o_orderkey
UNION ALL SELECT o_orderkey, NULL, 0, true FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def answers_from_cards(spark, sf):
    """Orders as questions, their lines as cards; orders without lines are refused."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey"))
    card = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" costs "), F.floor("l_extendedprice").cast("string"))
    cards = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), place.alias("place"), card.alias("card"))
    hits = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(cards, "o_orderkey", "left")
    out = retrieval.grounded_answers(hits, "o_orderkey", "place", "o_orderpriority", "card")
    return out.select("o_orderkey", "answer", F.size("citations").cast("long").alias("n_cited"), "grounded")


@query("""
SELECT o_orderkey AS page_id, 1 AS row_no, o_custkey::DOUBLE AS value_lo, (o_custkey + 5000)::DOUBLE AS value_hi, (20 + o_orderkey % 60)::DOUBLE AS ratio, (12 + o_orderkey % 36)::INTEGER AS term_months_max
FROM orders WHERE o_orderkey % 3 <> 0
""")
def vehicle_limit_matrix(spark, sf):
    """A table a page: heads in any order, every third without a term and so no matrix."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = F.concat(cust, F.lit(" TL - "), (F.col("o_custkey") + 5000).cast("string"), F.lit(" TL"))
    term = F.when(key % 3 != 0, F.lit("Azami Vade")).otherwise(F.lit("Not"))
    head = [F.lit("Finansman Oranı"), F.lit("Kasko Değeri"), term]
    line = [F.concat(F.lit("%"), (20 + key % 60).cast("string")), value, F.concat((12 + key % 36).cast("string"), F.lit(" ay"))]
    return products.vehicle_limits(as_cells(table(spark, sf, "orders"), [head, line])).select("page_id", "row_no", *[F.col(c).cast("double").alias(c) for c in ("value_lo", "value_hi", "ratio")], "term_months_max")


def as_cells(orders, rows):
    """The cells of one table an order."""
    cells = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), text.alias("text")) for r, line in enumerate(rows) for c, text in enumerate(line)])
    return orders.select(F.col("o_orderkey").alias("page_id"), F.lit(0).alias("table_no"), F.explode(cells).alias("c"), F.lit("").alias("caption")).select("page_id", "table_no", "c.*", "caption")


@query("""
SELECT o_orderkey AS page_id, 2 AS term_months, (o_custkey + 1000)::DOUBLE AS principal, 250.0::DOUBLE AS profit, (o_custkey + 1250)::DOUBLE AS repayment FROM orders WHERE o_orderkey % 4 <> 1
""")
def payment_plan_totals(spark, sf):
    """Plans of two instalments; every fourth has no totals and so isn't one."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lira = lambda c: F.concat(c.cast("string"), F.lit(" TL"))
    head = [F.lit(t) for t in ("Taksit No", "Kalan Ana Para", "Taksit Tutarı", "Ana Para", "Kâr Tutarı")]
    lines = [[F.lit(str(n)), lira(cust), lira(cust), lira(cust), F.lit("125 TL")] for n in (1, 2)]
    total = [F.when(key % 4 != 1, "Toplam").otherwise("3"), F.lit(""), lira(cust + 1250), lira(cust + 1000), F.lit("250 TL")]
    found = products.plan_totals(as_cells(dealt(spark, sf, "orders", "o_orderkey", "o_custkey"), [head, *lines, total]))
    return found.select("page_id", "term_months", *[F.col(c).cast("double").alias(c) for c in ("principal", "profit", "repayment")])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(f_min, t_min) AS amount_min, coalesce(nullif(f_max, 0), nullif(t_max, 0)) AS amount_max,
  CASE WHEN (f_min IS NULL AND t_min IS NOT NULL) OR (nullif(f_max, 0) IS NULL AND nullif(t_max, 0) IS NOT NULL) THEN 'text' WHEN f_min IS NOT NULL OR nullif(f_max, 0) IS NOT NULL THEN 'html_attr' ELSE 'none' END AS limits_source
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS f_min, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey WHEN l_linenumber % 3 = 1 THEN 0 END AS f_max,
             CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey END AS t_min, CASE WHEN l_orderkey % 5 < 2 THEN l_partkey WHEN l_orderkey % 5 = 2 THEN 0 END AS t_max FROM lineitem)
""")
def limits_of_pages(spark, sf):
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    pages = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(line % 2 == 0, F.col("l_partkey")).alias("f_min"), F.when(line % 3 == 0, F.col("l_suppkey")).when(line % 3 == 1, 0).alias("f_max"),
        F.when(order % 3 == 0, F.col("l_suppkey")).alias("t_min"), F.when(order % 5 < 2, F.col("l_partkey")).when(order % 5 == 2, 0).alias("t_max"))
    return products.page_limits(pages, {"amount_min": "f_min", "amount_max": "f_max"}, {"amount_min": "t_min", "amount_max": "t_max"}).drop("f_min", "f_max", "t_min", "t_max")


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'promo') THEN 'line' END AS dimension,
  CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'promo') THEN 'promo' END AS variant FROM part
""")
def variants_of_labels(spark, sf):
    patterns = (("metal", "brass", ("brass",)), ("line", "promo", ("promo",)), ("line", "never_named", ()))
    named = products.variant_of(F.col("p_type"), patterns)
    return table(spark, sf, "part").select("p_partkey", named["dimension"].alias("dimension"), named["key"].alias("variant"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND NOT ((s_suppkey - s_suppkey % 3) % 2 = 0 OR (s_suppkey - s_suppkey % 3) IN (SELECT n_nationkey FROM nation)) THEN 'parent_missing' END AS reason
FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0
""")
def variants_with_parents(spark, sf):
    """Odd roots are left away, so their variants have a parent only if it is stored."""
    key = F.col("s_suppkey")
    new = table(spark, sf, "supplier").filter((key % 3 != 0) | (key % 2 == 0)).select(F.lit("b").alias("bank"), key.cast("long").alias("external_key"), F.when(key % 3 != 0, key - key % 3).cast("long").alias("parent_external_key"), "s_suppkey")
    stored = table(spark, sf, "nation").select(F.lit("b").alias("bank"), F.col("n_nationkey").cast("long").alias("external_key"))
    return products.with_parents(new, stored).select("s_suppkey", "reason")


@query("""
SELECT n_name AS bank_code, 'offered' AS availability, 'm' || n_regionkey AS term_label, n_regionkey::INTEGER AS term_months, n_nationkey::DOUBLE AS investor_share, (100 - n_nationkey)::DOUBLE AS bank_share FROM nation WHERE n_regionkey > 0 AND n_nationkey % 2 = 0
UNION ALL SELECT r_name, 'not_offered', NULL, NULL, NULL, NULL FROM region
""")
def nested_seed_rates(spark, sf):
    """Nations as rows of a seed with one value each; label m0 is not known, and odd nations are no known banks."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    cell = F.create_map(F.concat(F.lit("m"), F.col("n_regionkey").cast("string"), F.lit("|TRY")), F.col("n_nationkey").cast("string"))
    rows = nation.agg(F.collect_list(F.struct(F.col("n_name").alias("bank_code"), cell.alias("values"), F.lit(None).cast("string").alias("evidence_text"))).alias("rows"))
    absent = region.agg(F.collect_list("r_name").alias("not_offered_banks"))
    data = F.struct(F.lit("profit_sharing_ratio").alias("rate_type"), F.lit("normal").alias("variant"), "rows", "not_offered_banks")
    seeds = rows.crossJoin(absent).select(F.array(data).alias("datasets"))  # one row beside one row
    banks = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("bank_code")).union(region.select("r_name"))
    out = products.seed_rates(seeds, banks, {f"m{n}": n for n in range(1, 9)})
    return out.select("bank_code", "availability", "term_label", "term_months", F.col("investor_share").cast("double").alias("investor_share"), F.col("bank_share").cast("double").alias("bank_share"))


@query("""
WITH k AS (SELECT p_partkey, 'metal' AS axis, m.value, CASE WHEN m.value = 'tin' THEN 0.7 ELSE 0.9 END AS confidence, m.name AS evidence FROM part, (VALUES ('Brass', 'brass'), ('TIN', 'tin')) AS m(name, value) WHERE contains(' ' || lower(p_type) || ' ', ' ' || lower(m.name) || ' ')
  UNION ALL SELECT p_partkey, 'line', 'promo', 0.9, 'promo' FROM part WHERE starts_with(p_type, 'PROMO')
  UNION ALL SELECT p_partkey, 'line', 'card', CASE WHEN starts_with(p_type, 'PROMO') THEN 0.75 ELSE 0.7 END, 'size' FROM part WHERE p_size % 2 = 0)
SELECT * FROM k UNION ALL SELECT p_partkey, axis, 'other', 0.3, NULL FROM part, (VALUES ('metal'), ('line')) AS a(axis) WHERE (p_partkey, axis) NOT IN (SELECT (p_partkey, axis) FROM k)
""")
def labels_from_merchants(spark, sf):
    """A dictionary, whose TIN is ambiguous, and two other sources, merged."""
    part = table(spark, sf, "part")
    known = spark.createDataFrame([("Brass", "brass", None), ("TIN", "tin", True)], "name string, value string, ambiguous boolean")
    tag = lambda v, c, e: ("p_partkey", F.lit("line").alias("axis"), F.lit(v).alias("value"), F.lit(c).alias("confidence"), F.lit(e).alias("evidence"))
    sources = [labels.merchant_labels(part, "p_partkey", "p_type", known, "metal"), part.filter(F.col("p_type").startswith("PROMO")).select(*tag("promo", 0.9, "promo")), part.filter("p_size % 2 = 0").select(*tag("card", 0.7, "size"))]
    return labels.merged_labels(part, "p_partkey", sources, {"metal": "other", "line": "other"}, boosted=("line", "card", "promo"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN l_partkey % 40 WHEN 3 THEN l_suppkey % 7 + 1 WHEN 4 THEN 0 WHEN 6 THEN 90 END::DOUBLE AS rate FROM lineitem
""")
def profit_rates_of_texts(spark, sf):
    """A sentence a line: a plain rate, a discount, a share, one named rate of two, none, two named ones that differ, a high named one."""
    a, b = (F.col("l_partkey") % 40).cast("string"), (F.col("l_suppkey") % 7 + 1).cast("string")
    far = " bu oran başka bir hesap içindir ve burada geçerli olmaz. ".ljust(60)
    kinds = [
        F.concat(F.lit("Aylık %"), a, F.lit(" ile")), F.concat(F.lit("%"), a, F.lit(" indirim fırsatı")), F.lit("Değerinin %80 kadarı"), F.concat(F.lit("%49"), F.lit(far), F.lit("%"), b, F.lit(" kâr payı")),
        F.lit("Vade farksız alışveriş"), F.concat(F.lit("%48 kâr payı,"), F.lit(far), F.lit("%"), b, F.lit(" kâr payı")), F.lit("kar payı oranı yüzde 90")]
    text = F.get(F.array(*kinds), (F.col("l_linenumber") % 7).cast("int"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lower(text).alias("low"))
    return lines.select("l_orderkey", "l_linenumber", extraction.profit_rate(F.col("low"))["value"].cast("double").alias("rate"))
