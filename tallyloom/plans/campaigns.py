"""Campaign lists, cards, corpus rows, caps, deletes and evaluation over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import campaigns, evaluation, finance, labels
from tallyloom.plans.registry import dealt, query, table
from tallyloom.sources import feeds, sinks, staged

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' ELSE 'unknown' END"
LIST_SQL = f"""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END AS parent_id, {STATUS_SQL} AS status,
       o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'Fast delivery' END AS description, o_orderdate::DATE AS start_date, o_orderdate::DATE + 30 AS end_date, o_totalprice FROM orders"""


def listed(spark, sf):
    """Orders as campaigns: three of four are children of the one before them."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "expired").when(F.col("o_orderstatus") == "O", "active").otherwise("unknown")
    return table(spark, sf, "orders").select(
        key.alias("id"), F.when(key % 4 != 0, key - key % 4).alias("parent_id"), status.alias("status"), F.col("o_orderpriority").alias("title"),
        F.when(key % 3 == 0, "Fast delivery").alias("description"), day.alias("start_date"), F.date_add(day, 30).alias("end_date"), "o_totalprice")


@query(f"""
WITH k AS (SELECT * FROM ({LIST_SQL}) WHERE parent_id IS NULL AND status <> 'expired' AND (title ILIKE '%urgent%' OR description ILIKE '%urgent%')
             AND start_date >= DATE '1993-01-01' AND end_date <= DATE '2030-01-01')
SELECT id, o_totalprice, (SELECT count(*) FROM k) AS total, (SELECT count(*) // 25 + CASE WHEN count(*) % 25 > 0 THEN 1 ELSE 0 END FROM k) AS total_pages
FROM k ORDER BY o_totalprice DESC, id LIMIT 25 OFFSET 25
""")
def campaign_page(spark, sf):
    """The second page of the running roots with a word in title or description."""
    wanted = campaigns.Wanted(search=" URGENT ", start_after="1993-01-01", end_before="2030-01-01")
    kept = campaigns.campaign_filter(listed(spark, sf), wanted).select("id", "o_totalprice")
    return campaigns.paged(kept, [F.col("o_totalprice").desc(), F.col("id")], 2, 25)


@query(f"""
SELECT status, count(*) AS n, sum(id)::BIGINT AS ids FROM ({LIST_SQL}) WHERE status = 'expired' AND title IN ('1-URGENT', '5-LOW') AND (title ILIKE '%FAST%' OR description ILIKE '%FAST%') GROUP BY status
""")
def campaigns_by_status(spark, sf):
    """An explicit status and children are given if asked for."""
    wanted = campaigns.Wanted(within={"title": ("1-URGENT", "5-LOW")}, status="expired", search="fast", with_children=True)
    kept = campaigns.campaign_filter(listed(spark, sf), wanted)
    return kept.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("""
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_linestatus IS NOT NULL)
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'O')
""")
def campaigns_with_all_labels(spark, sf):
    """Both labels of an order, one of each axis, may stand on different lines."""
    axes = F.explode(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("state"), F.col("l_linestatus"))).alias("axis", "value")
    tags = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), axes)
    return campaigns.with_all_labels(table(spark, sf, "orders").select("o_orderkey"), tags, "o_orderkey", {"flag": "R", "state": "O"})


@query(f"""
SELECT * FROM (SELECT event_id, row_number() OVER (ORDER BY round(value) DESC NULLS LAST, CASE status WHEN 'active' THEN 0 WHEN 'unknown' THEN 1 WHEN 'upcoming' THEN 2 WHEN 'expired' THEN 3 ELSE 4 END, event_id) AS place
  FROM (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'active' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'unknown' END AS status FROM events)) WHERE place <= 200
""")
def search_results_in_order(spark, sf):
    """The first 200 hits: score, status, id."""
    status = F.get(F.array(*map(F.lit, ("expired", "active", "upcoming", "unknown"))), (F.col("event_id") % 5).cast("int"))
    hits = table(spark, sf, "events").select("event_id", F.round("value").alias("score"), status.alias("status"))
    order = campaigns.search_order("score", "status", "event_id")
    return hits.orderBy(*order).limit(200).select("event_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""
WITH c AS ({LIST_SQL})
SELECT r.id, count(k.id) AS n_children, coalesce(string_agg(k.id || ':' || k.status, ',' ORDER BY k.id), '') AS children FROM c r LEFT JOIN c k ON k.parent_id = r.id WHERE r.parent_id IS NULL GROUP BY r.id
""")
def campaigns_with_children(spark, sf):
    out = campaigns.with_children(listed(spark, sf).select("id", "parent_id", "status"), "id", "parent_id", ["status"])
    told = F.transform("children", lambda c: F.concat_ws(":", c["id"].cast("string"), c["status"]))
    return out.select("id", F.size("children").cast("long").alias("n_children"), F.array_join(told, ",").alias("children"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, coalesce(max(l_discount) FILTER (l_returnflag = 'R'), -1) AS most FROM lineitem GROUP BY l_orderkey")
def nested_rates_of_a_kind(spark, sf):
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("rate"))).alias("rates"))
    kept = nested.select("l_orderkey", campaigns.only_rates("rates", "kind", "R").alias("rates"))
    return kept.select("l_orderkey", F.size("rates").cast("long").alias("n"), F.coalesce(F.array_max("rates.rate"), F.lit(-1.0)).alias("most"))


@query("""
SELECT conv_id, turn, CASE WHEN d.doc_id IS NOT NULL THEN d.source END AS source FROM conversations LEFT JOIN documents d ON d.doc_id = conv_id * 7
""")
def conversation_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source")
    talks = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 7).alias("key"))
    return campaigns.with_source(talks, docs, "key", "source").drop("key")


@query("""
SELECT key, field, value, confidence FROM (SELECT l_orderkey AS key, l_returnflag AS field, l_suppkey AS value, l_discount * 10 AS confidence,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_suppkey) AS rn
  FROM lineitem WHERE l_linestatus = 'O' AND l_tax < 0.05 AND l_discount * 10 >= 0.60) WHERE rn = 1
""")
def eligible_card_fields(spark, sf):
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("field"), F.col("l_suppkey").alias("value"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") < 0.05).alias("is_validated"), F.when(F.col("l_linestatus") != "O", "old").alias("rejected_reason"))
    return campaigns.card_fields(facts, "key")


@query("""
SELECT key, CASE axis WHEN 'flag' THEN 'return' ELSE 'state' END AS field, value, evidence, confidence, 'table' AS method FROM (
  SELECT *, row_number() OVER (PARTITION BY key, axis ORDER BY confidence DESC, value) AS rn FROM (
    SELECT l_orderkey AS key, 'flag' AS axis, l_returnflag AS value, 'seen' AS evidence, max(l_discount) AS confidence FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_orderkey, 'status', l_linestatus, '', max(l_tax) FROM lineitem GROUP BY ALL)) WHERE rn = 1
""")
def label_facts(spark, sf):
    item = table(spark, sf, "lineitem")
    flags = item.select(F.col("l_orderkey").alias("key"), F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value"), F.lit("seen").alias("evidence"), F.col("l_discount").alias("confidence"))
    states = item.select("l_orderkey", F.lit("status"), "l_linestatus", F.lit(None).cast("string"), "l_tax")
    return campaigns.label_facts(flags.union(states), "key", {"return": "flag", "state": "status"})


@query("""
SELECT n_name, count(*) FILTER (has_card) AS included, count(*) FILTER (NOT has_card) AS excluded, sum(CASE WHEN has_card THEN coalesce(lines, 0) ELSE 0 END)::BIGINT AS lines, count(*) FILTER (has_card AND flags = 'A,N') AS two_flags
FROM (SELECT n_name, o_orderkey % 5 <> 0 AS has_card, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines,
        (SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS flags
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_name
""")
def corpus_build(spark, sf):
    """Orders as campaigns of nations: cards, line counts as metrics, return flags as labels."""
    orders, item = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    owned = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("key"), F.col("c_nationkey").alias("bank"))
    banks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("bank"), "n_name")
    cards = orders.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("Card").alias("card_text"))
    metrics = item.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    flags = item.select(F.col("l_orderkey").alias("key"), F.lit("flag").alias("axis"), F.col("l_returnflag").alias("value"))
    rows = campaigns.corpus(owned, banks, cards, metrics, flags, "key", "bank")
    two = F.array_join(F.col("labels")["flag"], ",") == "A,N"
    more = rows.groupBy("n_name").agg(F.sum(F.when(F.col("included"), F.coalesce("lines", F.lit(0))).otherwise(0)).alias("lines"), F.count_if(F.col("included") & two).alias("two_flags"))
    return campaigns.corpus_counts(rows, ["n_name"]).join(more, "n_name")


@query("""
WITH m AS (SELECT l_partkey AS p, min(l_quantity) AS lo, max(l_quantity) AS hi, max(l_extendedprice) AS cap FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey, coalesce(lo, 1) AS term_min, coalesce(hi, 60) AS term_max, CASE WHEN p_size < 25 THEN p_retailprice ELSE cap END AS amount_max,
       CASE WHEN p IS NOT NULL AND p_size % 3 <> 0 THEN 'html_attr' ELSE ['table', 'none', 'text'][p_size % 3 + 1] END AS limits_source FROM part LEFT JOIN m ON p = p_partkey
""")
def caps_from_options(spark, sf):
    """Options of a product merged into the widest limit and put into the products."""
    options = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("term_min"), F.col("l_quantity").alias("term_max"), F.col("l_extendedprice").alias("amount_max"))
    source = F.get(F.array(*map(F.lit, ("table", "none", "text"))), F.col("p_size") % 3)
    products = table(spark, sf, "part").select("p_partkey", F.lit(1.0).alias("term_min"), F.lit(60.0).alias("term_max"), F.when(F.col("p_size") < 25, F.col("p_retailprice")).alias("amount_max"), source.alias("limits_source"))
    limits = campaigns.widest_limits(options, "p_partkey", ["term_min"], ["term_max", "amount_max"])
    return campaigns.with_caps(products, limits, "p_partkey", ["term_min", "term_max"], ["amount_max"])


@query("""
SELECT 'orders' AS "table", count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_deleted, count(*) FILTER (o_orderstatus <> 'F') AS n_left FROM orders
UNION ALL SELECT 'lines', count(*), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'archive', count(*), 0, count(*) FROM lineitem
""")
def guarded_delete(spark, sf):
    """Expired orders go from two tables; the archive stays."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key")
    left, report = campaigns.guarded_delete({"orders": orders, "lines": lines, "archive": lines}, orders.filter("o_orderstatus = 'F'"), "key", verified=True, kept=("archive",))
    counts = None
    for name, df in left.items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_left"))
        counts = row if counts is None else counts.unionByName(row)
    return report.join(counts, "table")


ROUNDS_SQL = """
WITH r AS (SELECT doc_id, 'first' AS annotator, f AS field, CASE f WHEN 'toxic' THEN toxic ELSE quality END AS v, 'e' || doc_id AS e FROM labels, (VALUES ('toxic'), ('quality')) t(f)),
s AS (SELECT doc_id, 'second' AS annotator, field, CASE WHEN doc_id % 5 = 0 AND field = 'quality' THEN 1 - v ELSE v END AS v, CASE WHEN doc_id % 2 = 0 THEN e ELSE 'x' END AS e FROM r WHERE doc_id % 3 = 0),
t AS (SELECT doc_id, 'third' AS annotator, field, v, e FROM r WHERE doc_id % 4 = 0),
p AS (SELECT o.annotator, o.doc_id, o.field, o.v IS NOT DISTINCT FROM r.v AS same_value, o.e = r.e AS same_evidence FROM (SELECT * FROM s UNION ALL SELECT * FROM t) o JOIN r USING (doc_id, field))
"""


def rounds(spark, sf):
    own = table(spark, sf, "labels")
    first = own.select("doc_id", F.lit("first").alias("annotator"), F.explode(F.create_map(F.lit("toxic"), "toxic", F.lit("quality"), "quality")).alias("field", "v"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("e"))
    second = first.filter("doc_id % 3 = 0").withColumns({"annotator": F.lit("second"), "v": F.when((F.col("doc_id") % 5 == 0) & (F.col("field") == "quality"), 1 - F.col("v")).otherwise(F.col("v")), "e": F.when(F.col("doc_id") % 2 == 0, F.col("e")).otherwise("x")})
    third = first.filter("doc_id % 4 = 0").withColumn("annotator", F.lit("third"))
    return evaluation.paired_rounds(first.unionByName(second).unionByName(third), ["doc_id", "field"], "v", "e")


@query(ROUNDS_SQL + """
SELECT 'first' AS reference, annotator, count(*) AS shared, count(DISTINCT doc_id) AS campaigns, count(*) FILTER (same_value) AS agreeing, count(*) FILTER (same_value) / count(*)::DOUBLE AS agreement,
       count(*) >= 20 AND bool_and(same_evidence) AS copied FROM p GROUP BY annotator
""")
def agreement_of_rounds(spark, sf):
    """Two more rounds against the one with most labels; the third was copied."""
    return evaluation.agreement(rounds(spark, sf), "doc_id")


@query(ROUNDS_SQL + "SELECT field, count(*) AS n FROM p WHERE NOT same_value GROUP BY field ORDER BY n DESC, field LIMIT 5")
def fields_in_dispute(spark, sf):
    return evaluation.disagreements(rounds(spark, sf), "field")


COUNTS_SQL = """
SELECT lang, count(*) FILTER (toxic = 1 AND d.doc_id % 3 > 0) AS tp, count(*) FILTER (toxic = 0 AND d.doc_id % 7 = 0) AS fp, count(*) FILTER (toxic = 1 AND d.doc_id % 3 = 0) AS fn, count(*) FILTER (toxic = 0 AND d.doc_id % 7 > 0) AS tn
FROM documents d JOIN labels USING (doc_id) GROUP BY lang"""


def counts(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    gold, third, seventh = F.col("toxic") == 1, F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 0
    return both.groupBy("lang").agg(F.count_if(gold & ~third).alias("tp"), F.count_if((F.col("toxic") == 0) & seventh).alias("fp"), F.count_if(gold & third).alias("fn"), F.count_if((F.col("toxic") == 0) & ~seventh).alias("tn"))


@query(f"""
SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
       CASE WHEN tp + fp > 0 THEN fp / (tp + fp)::DOUBLE ELSE 0 END AS hallucination, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS silence FROM ({COUNTS_SQL})
""")
def derived_rates(spark, sf):
    return evaluation.derived(counts(spark, sf))


@query(f"""
SELECT avg(2 * tp / (2 * tp + fp + fn)::DOUBLE) FILTER (tp + fn >= 5) AS macro_f1, count(*) FILTER (tp + fn >= 5) AS fields, count(*) FILTER (tp + fn < 5) AS left_out FROM ({COUNTS_SQL})
""")
def macro_f1_with_floor(spark, sf):
    return evaluation.macro_f1(evaluation.derived(counts(spark, sf)))


@query("""
SELECT 'processed' AS counter, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'extracted', count(*) FILTER (l_returnflag = 'N') FROM lineitem
UNION ALL SELECT 'conflicts', count(*) FILTER (l_tax > 0.05) FROM lineitem UNION ALL SELECT 'rejected:' || l_returnflag, count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag
""")
def run_counters(spark, sf):
    facts = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("rejected_reason"), (F.col("l_tax") > 0.05).alias("conflict"))
    return evaluation.run_counters(facts, "l_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(text, ' le ') OR contains(text, 'Die ')")
def few_shot_leaks(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(labels.holds_marker(F.col("text"), (" le ", "Die "))).select("doc_id")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '77123' ELSE '' END AS numbers, CASE o_orderkey % 4 WHEN 0 THEN 'empty_summary' WHEN 1 THEN 'unsupported_number' WHEN 2 THEN 'forbidden_term' END AS reason FROM orders
""")
def checked_answers(spark, sf):
    """Answers whose numbers the cited card has or lacks, and summaries that fail in three ways."""
    key = F.col("o_orderkey")
    cited = F.lit("Kampanya tutarı 12.500 TL ve 36 ay vade ile sunulur, kart aidatı yoktur.")
    said = F.when(key % 3 == 0, "Tutar 12500 TL, 36 ay [99].").when(key % 3 == 1, "Tutar 77.123 TL, 36 ay [12].").otherwise("Sayı yok, 5 gün [7].")
    summary = F.when(key % 4 == 0, "Kısa.").when(key % 4 == 1, "Bu kampanyada tutar 98.765 TL olarak ilan edilmiştir.").when(key % 4 == 2, "Bu kampanyada faiz oranı ile ilgili bilgi verilmektedir.").otherwise("Kampanya tutarı 12.500 TL, vadesi 36 ay, kart aidatı yoktur.")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(labels.unverified_numbers(said, cited), ",").alias("numbers"), labels.summary_reason(summary, cited, ("faiz",)).alias("reason"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 <> 3 THEN 'ödenecek ' || p_partkey + 1000 || CASE p_size % 4 WHEN 2 THEN ' tutar TL olur' ELSE ' TL olur' END END AS evidence, CASE WHEN p_size % 2 = 0 THEN '300 TL' ELSE '20 TL' END AS reward FROM part
""")
def anchored_numbers(spark, sf):
    """A number with its unit, with the unit farther on, and as part of a longer number only; the first reward that is no total."""
    number = (F.col("p_partkey") + 1000).cast("string")
    size = F.col("p_size") % 4
    told = F.when(size == 3, F.concat(F.lit("ödenecek 9"), number, F.lit(" TL olur"))).when(size == 2, F.concat(F.lit("ödenecek "), number, F.lit(" tutar TL olur"))).otherwise(F.concat(F.lit("ödenecek "), number, F.lit(" TL olur")))
    pay = F.when(F.col("p_size") % 2 == 0, "toplamda en çok 9000 TL verilir; her müşteri için harcamaya göre ödül 300 TL ve sonra 400 TL").otherwise("ödül 20 TL, toplamda 500 TL")
    return dealt(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", labels.anchored_evidence(number, told, ("tl", "lira")).alias("evidence"), labels.first_reward(pay, r"(?<!\d)\d+ TL", ("toplamda",)).alias("reward"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS keyword, CASE WHEN c_custkey % 2 = 0 THEN (1000 + c_custkey % 9000)::VARCHAR END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'kod' || c_custkey END AS coupon FROM customer
""")
def sms_and_coupons(spark, sf):
    number = (F.lit(1000) + F.col("c_custkey") % 9000).cast("string")
    sms = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" yazıp "), number, F.lit("'e gönderin."))).otherwise("kodu yazıp 1234'e gönderin.")
    coupon = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Sepette kod"), F.col("c_custkey").cast("string"), F.lit(" kodunu kullanın."))).otherwise(" 1234 kodunu kullanın.")
    body = F.concat(sms, coupon)
    keyword, to = text.sms_entry(body)
    return table(spark, sf, "customer").select("c_custkey", keyword.alias("keyword"), to.alias("number"), text.coupon_code(body).alias("coupon"))


@query("""
SELECT s_suppkey, 'Havuz A' AS label, band, (CASE band WHEN '1-3' THEN 1.25 WHEN '3-6' THEN 2.5 WHEN '6-12' THEN 10.75 ELSE s_suppkey % 90 + 0.5 END)::DECIMAL(9,4) AS rate FROM supplier, (VALUES ('1-3'), ('3-6'), ('6-12'), ('12+')) b(band)
""")
def rate_lines(spark, sf):
    """A line with a rate for each of four terms, among lines with more or fewer."""
    line = F.concat(F.lit("Oranlar 2024\nHavuz A %1,25 % 2,50 10,75 "), (F.col("s_suppkey") % 90).cast("string"), F.lit(",50\nDiğer 1,25 2,50\n"))
    return feeds.rate_lines(table(spark, sf, "supplier").select("s_suppkey", line.alias("text")), "text", ["s_suppkey"], ("1-3", "3-6", "6-12", "12+"))


@query("SELECT p_partkey, round(1 + p_size / 25.0, 2)::DOUBLE AS rate FROM part")
def plan_rates(spark, sf):
    """Plans made at a known rate; the sum of instalments holds a fee where the profit is known, and counts where it isn't."""
    r, n = F.round(1 + F.col("p_size") / 25.0, 2) / 100, F.lit(24)
    principal = F.col("p_retailprice") * 100
    repaid = principal * r * F.pow(1 + r, n) / (F.pow(1 + r, n) - 1) * n
    known = F.col("p_partkey") % 2 == 0
    rate = finance.plan_rate(principal, F.when(known, repaid - principal), F.when(known, repaid + 5000).otherwise(repaid), n)
    return table(spark, sf, "part").select("p_partkey", F.round(rate, 2).alias("rate"))


@query("SELECT 'https://site.example/a&b/' || page_id AS url FROM pages")
def sitemap_addresses(spark, sf):
    """Sitemap files with name spaces and references, read from their bytes."""
    xml = F.concat(F.lit('<?xml version="1.0"?><s:urlset><s:url><s:loc> https://site.example/a&amp;b/'), F.col("page_id").cast("string"), F.lit(" </s:loc>"))
    maps = table(spark, sf, "pages").select(feeds.decoded(F.encode(xml, "UTF-8")).alias("xml"))
    return feeds.sitemap_urls(maps, site="site.example").select("url")


@query("""
SELECT o_orderkey, o_orderpriority AS method, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS value FROM orders
WHERE o_orderpriority NOT LIKE '2%' AND (o_orderpriority NOT LIKE '1%' OR o_orderstatus <> 'O')
""")
def labels_rewritten(spark, sf):
    """A table published in generations: labels of two methods are made anew, one of them without any rows."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    path = f"{staged.shared_folder(spark)}/tables/labels-{uuid.uuid4().hex}"
    sinks.publish(o.drop("o_orderstatus"), path, ["method"])
    again = o.filter(F.startswith("method", F.lit("1")) & (F.col("o_orderstatus") != "O")).withColumn("value", F.col("value") + 1).drop("o_orderstatus")
    sinks.publish(again, path, ["method"], F.col("method").rlike("^[12]"))
    return sinks.current(spark, path)


@query("SELECT * FROM (SELECT 'orders' AS \"table\", count(*) AS n_rows, 'r1' AS revision, 0 AS faults FROM orders UNION ALL SELECT 'customer', count(*), 'r1', 0 FROM customer)")
def export_manifest(spark, sf):
    """Two tables exported with a digest of every file, which are taken once more from the files."""
    path = f"{staged.shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    names = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    manifest = sinks.export_json_lines({n: table(spark, sf, n) for n in names}, path, names, "r1")
    faults = sinks.export_faults(spark, path, list(names)).groupBy("table").agg(F.count(F.lit(1)).alias("faults"))
    rows = manifest.groupBy("table", "revision").agg(F.sum("n_rows").alias("n_rows"))
    return rows.join(faults, "table", "left").withColumn("faults", F.coalesce("faults", F.lit(0)).cast("int"))
