"""Ranking, bands, scores, simulations and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import facts, filters, finance, ranking
from tallyloom.plans.registry import query, table
from tallyloom.sources.staged import staged

OFFERS = "lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"


def offers(spark, sf):
    """Rates (lineitem) of products at banks (supplier, nation). Join strategies are left to the optimizer's size checks."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


@query("""
SELECT n_name, s_suppkey, CASE WHEN rate IS NOT NULL THEN row_number() OVER (PARTITION BY n_name ORDER BY rate NULLS LAST, s_suppkey) END AS rank,
       rate, CASE WHEN rate IS NULL THEN 'no_data' ELSE 'ranked' END AS status
FROM (SELECT n_name, s_suppkey, min(CASE WHEN l_discount > 0.01 AND l_quantity <= 30 THEN l_tax * 100 END) AS rate
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, s_suppkey)
""")
def rank_offers_min_rate(spark, sf):
    rate = F.when((F.col("l_discount") > 0.01) & (F.col("l_quantity") <= 30), F.col("l_tax") * 100)
    per = offers(spark, sf).groupBy("n_name", "s_suppkey").agg(F.min(rate).alias("rate"))
    return ranking.rank_with_missing(per, "rate", ["n_name"], "s_suppkey").select("n_name", "s_suppkey", "rank", "rate", "status")


@query("""
SELECT lang, status, count(*) AS n, max(rank) AS last_rank FROM (
  SELECT lang, CASE WHEN quality IS NULL THEN 'no_data' ELSE 'ranked' END AS status,
         CASE WHEN quality IS NOT NULL THEN row_number() OVER (PARTITION BY lang ORDER BY quality DESC NULLS LAST, d.doc_id) END AS rank
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang, status
""")
def rank_missing_group(spark, sf):
    """Ranks in groups of any size: no task sorts a whole language."""
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    ranked = ranking.rank_by(joined.withColumnRenamed("quality", "reward_amount_try"), "en_yuksek_odul", ["lang"], "doc_id")
    return ranked.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


def _criteria_sql() -> str:
    fields = {"reward_amount_try": "CASE WHEN l_quantity > 10 THEN l_extendedprice END", "profit_rate_pct": "CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 100 END", "term_months_max": "CASE WHEN l_linenumber < 6 THEN l_quantity END", "installment_count": "CASE WHEN l_quantity <> 7 THEN l_linenumber END", "cashback_pct": "CASE WHEN l_discount > 0.02 THEN l_discount END", "discount_pct": "CASE WHEN l_discount < 0.08 THEN l_discount END"}
    ranked = [f"SELECT '{c}' AS criterion, n.l_shipmode AS bank, id, place AS rank, status FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, id, {fields[f]} AS v, CASE WHEN {fields[f]} IS NULL THEN 'no_data' ELSE 'ranked' END AS status, row_number() OVER (PARTITION BY l_returnflag || l_linestatus, {fields[f]} IS NULL ORDER BY {fields[f]} {'DESC' if down else 'ASC'}, id) AS place FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice))) n WHERE place <= 20" for c, (f, down) in ranking.CAMPAIGN_CRITERIA.items()]
    return f"SELECT criterion, bank, id, CASE WHEN status = 'ranked' THEN rank END AS rank, status FROM ({' UNION ALL '.join(ranked)})"


@query(_criteria_sql())
def campaigns_by_criteria(spark, sf):
    """The first 20 of each bank under each of six criteria, and 20 of those without data."""
    first = F.struct("l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    c = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("bank"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("reward_amount_try"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 100).alias("profit_rate_pct"),
        F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("term_months_max"), F.when(F.col("l_quantity") != 7, F.col("l_linenumber")).alias("installment_count"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("cashback_pct"), F.when(F.col("l_discount") < 0.08, F.col("l_discount")).alias("discount_pct"),
    )
    out = None
    for criterion in ranking.CAMPAIGN_CRITERIA:
        part = ranking.rank_by(c, criterion, ["bank"], "id", limit=20).select(F.lit(criterion).alias("criterion"), "bank", "id", F.col("rank").cast("long").alias("rank"), "status")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH q AS (SELECT o_orderkey AS request, round(o_totalprice, 2) AS amount, 1 + o_orderkey % 60 AS term, (o_orderkey % 6) AS kind FROM orders),
t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS kind FROM (SELECT DISTINCT p_type FROM part)),
r AS (SELECT p_brand AS bank, p_partkey AS product, kind, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS term, (p_partkey % 400) / 100.0 AS rate, CASE WHEN p_partkey % 3 = 1 THEN 50000 END AS low, CASE WHEN p_partkey % 3 = 2 THEN 150000 END AS high FROM part JOIN t USING (p_type) WHERE p_partkey % 7 <> 0),
b AS (SELECT DISTINCT p_brand AS bank FROM part),
h AS (SELECT request, amount, q.term AS months, bank, product, r.term AS rate_term, rate FROM q JOIN r ON r.kind = q.kind AND (low IS NULL OR amount >= low) AND (high IS NULL OR amount <= high)),
n AS (SELECT request, bank, min(CASE WHEN rate_term IS NOT NULL THEN {'a': abs(rate_term - months), 'r': rate, 'p': product, 't': rate_term} END) AS near FROM h GROUP BY request, bank),
o AS (SELECT q.request, b.bank, near.p AS product, near.r::DOUBLE AS rate, near.t AS rate_term, n.request IS NOT NULL AS priced, amount, q.term AS months,
  CASE WHEN near.r IS NULL THEN NULL WHEN near.r = 0 THEN round(amount / q.term, 2) ELSE round(amount * (near.r::DOUBLE / 100.0) * pow(1 + near.r::DOUBLE / 100.0, q.term) / (pow(1 + near.r::DOUBLE / 100.0, q.term) - 1), 2) END AS monthly FROM q CROSS JOIN b LEFT JOIN n ON n.request = q.request AND n.bank = b.bank),
w AS (SELECT *, round(monthly * months, 2) AS total FROM o)
SELECT request, bank, product, rate, rate_term, CASE WHEN rate IS NOT NULL THEN rate_term = months END AS is_exact, floor((monthly + 0.37) / 100) AS hundreds, CASE WHEN rate IS NOT NULL THEN row_number() OVER (PARTITION BY request ORDER BY total NULLS LAST, bank) = 1 END AS is_best,
  CASE WHEN NOT priced THEN 'no_published_rate' WHEN rate IS NULL THEN 'rates_do_not_cover_the_term' END AS missing FROM w
""")
def financing_simulation(spark, sf):
    """An offer of every bank for every request, or why there is none; payments in hundreds, as halves of a cent are rounded apart."""
    part = table(spark, sf, "part")
    kinds = F.broadcast(part.groupBy("p_type").agg(F.lit(0).alias("x")).withColumn("kind", F.row_number().over(Window.partitionBy("x").orderBy("p_type")) - 1).drop("x"))  # the types are few
    k = F.col("p_partkey")
    rates = part.filter(k % 7 != 0).join(kinds, "p_type").select(F.col("p_brand").alias("bank"), k.alias("product"), F.col("kind").cast("long").alias("product_type"), F.when(k % 11 != 0, F.col("p_size").cast("long")).alias("term"), ((k % 400) / 100.0).alias("rate"), F.when(k % 3 == 1, 50000.0).alias("low"), F.when(k % 3 == 2, 150000.0).alias("high"))
    o = F.col("o_orderkey")
    requests = table(spark, sf, "orders").select(o.alias("request"), (o % 6).alias("product_type"), F.round("o_totalprice", 2).alias("amount"), (o % 60 + 1).alias("term"))
    offers = finance.financing_offers(requests, rates, part.select(F.col("p_brand").alias("bank")).distinct())
    return offers.select("request", "bank", "product", "rate", "rate_term", "is_exact", F.floor((F.col("monthly") + 0.37) / 100).cast("double").alias("hundreds"), "is_best", "missing")


@query("""
WITH v AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 1000) END AS bal FROM supplier),
b AS (SELECT s_nationkey, min(bal) AS value, count(bal) AS with_value, count(*) - count(bal) AS without_value FROM v GROUP BY s_nationkey)
SELECT b.s_nationkey, max(CASE WHEN v.bal = b.value THEN v.s_suppkey END) AS winner, b.value, with_value, without_value,
       greatest(count(CASE WHEN v.bal = b.value THEN 1 END) - 1, 0) AS ties
FROM b JOIN v USING (s_nationkey) GROUP BY b.s_nationkey, b.value, with_value, without_value
""")
def extremum_with_coverage(spark, sf):
    v = table(spark, sf, "supplier").withColumn("bal", F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 1000)))
    return ranking.extremum(v, ["s_nationkey"], "bal", "s_suppkey", "min")


@query("""
WITH m AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice END AS price, CASE WHEN p_size <> 20 THEN p_size END AS size FROM part),
b AS (SELECT min(price) AS pl, max(price) AS ph, min(size) AS sl, max(size) AS sh FROM m),
s AS (SELECT p_partkey, (ph - price) / (ph - pl) * 100 AS a, (size - sl) / (sh - sl)::DOUBLE * 100 AS c FROM m, b)
SELECT p_partkey, CASE WHEN a IS NULL AND c IS NULL THEN NULL ELSE
  round_even((CASE WHEN a IS NULL THEN 0 ELSE a * 0.6 END + CASE WHEN c IS NULL THEN 0 ELSE c * 0.4 END) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN c IS NULL THEN 0 ELSE 0.4 END)::DOUBLE, 2) END AS score FROM s
""")
def weighted_score(spark, sf):
    m = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") != 20, F.col("p_size")).alias("size"))
    scales = ranking.with_scales(m, {"price": False, "size": True})
    return scales.select("p_partkey", ranking.weighted_score({"scaled_price": 0.6, "scaled_size": 0.4}).alias("score"))


@query("""
WITH a AS (SELECT n_name, min(l_tax) AS cheapest, median(l_extendedprice) AS typical, max(l_quantity) AS longest, count(DISTINCT l_partkey) AS variety,
                  CASE WHEN min(l_tax) < 0.005 THEN count(*) END AS volume
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name),
s AS (SELECT n_name, CASE WHEN max(cheapest) OVER () = min(cheapest) OVER () THEN 100 ELSE (max(cheapest) OVER () - cheapest) / (max(cheapest) OVER () - min(cheapest) OVER ()) * 100 END AS cost,
  CASE WHEN max(typical) OVER () = min(typical) OVER () THEN 100 ELSE (typical - min(typical) OVER ()) / (max(typical) OVER () - min(typical) OVER ()) * 100 END AS size,
  CASE WHEN max(longest) OVER () = min(longest) OVER () THEN 100 ELSE (longest - min(longest) OVER ()) / (max(longest) OVER () - min(longest) OVER ()) * 100 END AS term,
  CASE WHEN max(variety) OVER () = min(variety) OVER () THEN 100 ELSE (variety - min(variety) OVER ()) / (max(variety) OVER () - min(variety) OVER ())::DOUBLE * 100 END AS choice,
  CASE WHEN volume IS NULL THEN NULL WHEN max(volume) OVER () = min(volume) OVER () THEN 100 ELSE (volume - min(volume) OVER ()) / (max(volume) OVER () - min(volume) OVER ())::DOUBLE * 100 END AS reach FROM a)
SELECT n_name, round(cost, 4) AS cost, round(size, 4) AS size, round(term, 4) AS term, round(choice, 4) AS choice, round(reach, 4) AS reach,
       4 + CASE WHEN reach IS NULL THEN 0 ELSE 1 END AS measured_axes, 4 + CASE WHEN reach IS NULL THEN 0 ELSE 1 END >= 3 AS sufficient FROM s
""")
def radar_scores(spark, sf):
    a = offers(spark, sf).groupBy("n_name").agg(
        F.min("l_tax").alias("cost"), F.median("l_extendedprice").alias("size"), F.max("l_quantity").alias("term"), F.count_distinct("l_partkey").alias("choice"),
        F.when(F.min("l_tax") < 0.005, F.count(F.lit(1))).alias("reach"),
    )
    axes = {"cost": False, "size": True, "term": True, "choice": True, "reach": True}
    s = ranking.with_scales(staged(a, "radar"), axes)  # a row per nation, read twice and made once
    measured = sum((F.col(f"scaled_{x}").isNotNull().cast("int") for x in axes), F.lit(0))
    return s.select("n_name", *[F.round(f"scaled_{x}", 4).alias(x) for x in axes], measured.alias("measured_axes"), (measured >= 3).alias("sufficient"))


@query("SELECT r_name, count(s_suppkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9500 GROUP BY r_name")
def zero_group_counts(spark, sf):
    rich = table(spark, sf, "supplier").filter("s_acctbal > 9500")
    banks = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return banks.join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("r_name").agg(F.count("s_suppkey").alias("n"))


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name
""")
def coverage_by_region(spark, sf):
    """Counts per child table are made before the joins, so the joins don't multiply rows."""
    nations = table(spark, sf, "nation")
    count = lambda name, key, as_: table(spark, sf, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(as_))
    per = nations.join(count("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left").join(count("customer", "c_nationkey", "customers"), "n_nationkey", "left")
    sums = per.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.sum("suppliers").alias("suppliers"), F.sum("customers").alias("customers"))
    out = table(spark, sf, "region").join(sums, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select("r_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nations", "suppliers", "customers")])


@query("SELECT DISTINCT user_id FROM events e WHERE EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.value > 90) AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error')")
def multi_axis_semi(spark, sf):
    e = table(spark, sf, "events")
    axis = lambda cond: e.filter(cond).select("user_id")
    return e.select("user_id").distinct().join(axis("event_type = 'purchase' and value > 90"), "user_id", "left_semi").join(axis("event_type = 'error'"), "user_id", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti_unseen(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


_STATUS = """SELECT o_orderkey, CASE WHEN s IS NULL AND e IS NULL THEN 'unknown' WHEN e < DATE '1998-01-01' THEN 'expired' WHEN s > DATE '1998-01-01' THEN 'upcoming' ELSE 'active' END AS status
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderdate::DATE + 90 END AS e FROM orders)"""


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def status_buckets(spark, sf):
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    start = F.when(key % 7 != 0, F.to_date("o_orderdate"))
    end = F.when((key % 5 != 0) & (key % 7 != 0), F.date_add(F.to_date("o_orderdate"), 90))
    return o.select(facts.status_of(start, end, F.lit("1998-01-01").cast("date")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN s > e THEN 'reversed' WHEN year(e) < 1996 THEN 'end_before_min_year' WHEN e < DATE '1998-01-01' THEN 'end_in_past' WHEN e > DATE '2001-01-01' THEN 'end_too_far'
  WHEN e IS NULL AND year(s) < 1996 THEN 'start_before_min_year' END AS reason
FROM (SELECT o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + ((o_orderkey % 100)::INT - 10) END AS e FROM orders)
""")
def period_sanity(spark, sf):
    s, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    e = F.when(key % 5 != 0, F.date_add(s, (key % 100).cast("int") - 10))
    return table(spark, sf, "orders").select("o_orderkey", facts.period_reason(s, e, F.lit("1998-01-01").cast("date"), 1996).alias("reason"))


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS d FROM orders) ORDER BY d ASC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def page_sorted_nulls_last(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("d"))
    return ranking.page_of(o, [F.col("d").asc_nulls_last(), F.col("o_orderkey")], 3, 25)


@query("""
SELECT o_orderkey, v, p AS percent, round(v * p / 100, 2) AS amount, m AS months, hp AS home_percent FROM (SELECT o_orderkey, v,
  CASE WHEN v <= 400000 THEN 70 WHEN v <= 800000 THEN 50 WHEN v <= 1200000 THEN 30 WHEN v <= 2000000 THEN 20 ELSE 0 END AS p,
  CASE WHEN v <= 400000 THEN 48 WHEN v <= 800000 THEN 36 WHEN v <= 1200000 THEN 24 WHEN v <= 2000000 THEN 12 END AS m,
  CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN v <= 5000000 THEN 90 WHEN v <= 7000000 THEN 80 WHEN v <= 10000000 THEN 70 WHEN v <= 20000000 THEN 50 ELSE 40 END
       WHEN o_orderpriority LIKE '2%' THEN CASE WHEN v <= 5000000 THEN 80 WHEN v <= 7000000 THEN 70 WHEN v <= 10000000 THEN 60 WHEN v <= 20000000 THEN 40 ELSE 30 END
       ELSE CASE WHEN v <= 5000000 THEN 70 WHEN v <= 7000000 THEN 60 WHEN v <= 10000000 THEN 50 WHEN v <= 20000000 THEN 30 ELSE 20 END END AS hp
  FROM (SELECT o_orderkey, o_orderpriority, floor(o_totalprice * 10) AS v FROM orders))
""")
def band_lookup_ltv(spark, sf):
    v = F.floor(F.col("o_totalprice") * 10).cast("double")
    energy = F.when(F.col("o_orderpriority").like("1%"), "a+").when(F.col("o_orderpriority").like("2%"), " c ").otherwise("x")
    percent, amount, months = finance.vehicle_limit(F.col("v"))
    home, _ = finance.home_limit(F.col("v"), F.col("energy"))
    base = table(spark, sf, "orders").select("o_orderkey", v.alias("v"), energy.alias("energy"))
    return base.select("o_orderkey", "v", percent.alias("percent"), amount.alias("amount"), months.alias("months"), home.alias("home_percent"))


@query("""
SELECT l_orderkey, l_linenumber, days, currency, CASE WHEN days <= 0 THEN NULL WHEN currency IN ('USD', 'EUR') THEN 25.0 WHEN currency IN ('XAU', 'XAG') THEN 15.0 WHEN days <= 180 THEN 17.5 WHEN days <= 365 THEN 15.0 ELSE 10.0 END::DOUBLE AS percent
FROM (SELECT l_orderkey, l_linenumber, (l_quantity * 10)::INT - 20 AS days, CASE l_linenumber % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'XAU' ELSE 'TRY' END AS currency FROM lineitem)
""")
def withholding_band(spark, sf):
    base = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") * 10).cast("int") - 20).alias("days"), F.when(F.col("l_linenumber") % 5 == 0, "USD").when(F.col("l_linenumber") % 5 == 1, "XAU").otherwise("TRY").alias("currency"))
    return base.withColumn("percent", finance.withholding(F.col("currency"), F.col("days")).cast("double"))


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity - 24), l_tax, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1
""")
def nearest_term(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.struct("l_orderkey", "l_linenumber").alias("line"))
    return ranking.nearest(li, ["l_suppkey"], "l_quantity", 24, "l_tax", "line").drop("line")


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * r * pow(1 + r, l_quantity) / (pow(1 + r, l_quantity) - 1), 2) AS instalment FROM (SELECT *, (l_tax * 10 + 0.5) / 100.0 AS r FROM lineitem)
""")
def annuity_offers(spark, sf):
    pay = finance.instalment(F.col("l_extendedprice"), F.col("l_tax") * 10 + 0.5, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pay.alias("instalment"))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, (l_quantity * 9)::INT AS days, CASE WHEN l_linenumber % 3 = 0 THEN 'USD' ELSE 'TRY' END AS cur, l_extendedprice, l_discount FROM lineitem),
h AS (SELECT *, l_extendedprice * (l_discount * 300) / 100 * days / 365 AS gross, CASE WHEN cur = 'USD' THEN 25 WHEN days <= 180 THEN 17.5 WHEN days <= 365 THEN 15 ELSE 10 END::DOUBLE AS pct FROM g)
SELECT l_orderkey, l_linenumber, round(gross, 1) AS gross, pct, TRUE AS to_the_cent FROM h
""")
def yield_offers(spark, sf):
    """Gross, withheld part and net yield are within a cent of the unrounded ones, and add up."""
    days, cur = (F.col("l_quantity") * 9).cast("int"), F.when(F.col("l_linenumber") % 3 == 0, "USD").otherwise("TRY")
    gross, tax, net = finance.net_yield(F.col("l_extendedprice"), F.col("l_discount") * 300, days, cur)
    raw, pct = F.col("l_extendedprice") * (F.col("l_discount") * 300) / 100 * days / 365, finance.withholding(cur, days).cast("double")
    near = lambda a, b: F.abs(a - b) < 0.0101
    right = near(gross, raw) & near(tax, raw * pct / 100) & near(net, gross - tax)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(raw, 1).alias("gross"), pct.alias("pct"), right.alias("to_the_cent"))


def _rules():
    return [("status", F.col("o_orderstatus") != "F"), ("priority", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), ("price", F.col("price") <= 150000)]


def _gated(spark, sf):
    return table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'status' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'priority' WHEN o_orderkey % 4 = 0 THEN 'price:no_data' WHEN o_totalprice > 150000 THEN 'price' ELSE 'kept' END AS reason FROM orders) GROUP BY reason
""")
def gate_report(spark, sf):
    return filters.gate_report(filters.gate(_gated(spark, sf), _rules()))


@query("""
WITH f AS (SELECT o_orderstatus <> 'F' AS a, o_orderpriority IN ('1-URGENT', '2-HIGH') AS b, o_orderkey % 4 <> 0 AND o_totalprice <= 150000 AS c FROM orders)
SELECT 'status' AS dropped, count(CASE WHEN b AND c THEN 1 END) AS survivors FROM f UNION ALL SELECT 'priority', count(CASE WHEN a AND c THEN 1 END) FROM f UNION ALL SELECT 'price', count(CASE WHEN a AND b THEN 1 END) FROM f
""")
def relaxation_hints(spark, sf):
    return filters.relaxation_hints(_gated(spark, sf), _rules())


@query("""
SELECT p_type, count(*) AS n FROM part GROUP BY p_type HAVING p_type IN (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3)
UNION ALL SELECT 'other', sum(n)::BIGINT FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type OFFSET 3)
""")
def top_and_other(spark, sf):
    return ranking.top_and_rest(table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), "p_type", "n", 3)


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS lo, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 10 END AS hi FROM lineitem) WHERE (lo IS NULL OR lo <= 25) AND (hi IS NULL OR hi >= 25)
""")
def open_band_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("lo"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") + 10).alias("hi"))
    return li.filter(ranking.in_band("lo", "hi", 25)).select("l_orderkey", "l_linenumber")
