"""Retrieval, parsing, URLs, facts, labels and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import parse, text
from tallyloom.operators import facts, filters, matching, pivots, ranking, retrieval, search
from tallyloom.plans.registry import query, table

TERMS = ["the", "idiot", "erth", "ingedrea"]
_TOKENS = "regexp_extract_all(lower(translate(text, 'ıİşŞğĞüÜöÖçÇâÂîÎûÛI', 'iisSgGuUoOcCaAiIuUi')), '[a-z0-9]+')"
_BM25 = f"""
d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
x AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), h AS (SELECT doc_id, len, term, count(*) AS tf FROM x GROUP BY ALL),
v AS (SELECT DISTINCT term FROM h), q AS (SELECT unnest({TERMS!r}) AS q),
e AS (SELECT q, term, CASE WHEN q = term THEN 1.0 ELSE 0.6 END AS w FROM q JOIN v ON term = q OR (len(q) >= 4 AND starts_with(term, q) AND q NOT IN (SELECT term FROM v))),
w AS (SELECT term, sum(w) AS w FROM e GROUP BY term),
f AS (SELECT term, count(*) AS df FROM h JOIN w USING (term) GROUP BY term),
b AS (SELECT doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS score, string_agg(term, ',' ORDER BY term) AS matched
      FROM h JOIN w USING (term) JOIN f USING (term), s GROUP BY doc_id)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, matched FROM b ORDER BY b.score DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf):
    index = search.index_of(table(spark, sf, "documents"), "doc_id", "text")
    return search.search(spark, index, TERMS, 50, "doc_id").withColumn("score", F.round("score", 6))


_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id LIMIT 25")
def cosine_topk(spark, sf):
    scored = retrieval.vector_scores(table(spark, sf, "embeddings"), "embedding", _query_vector(spark, sf))
    return retrieval.top(scored, "score", "vec_id", 25).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""
WITH s AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS score, vec_id FROM embeddings)
SELECT label, round(max(score), 6) AS score, arg_min(vec_id, struct_pack(a := -score, b := vec_id)) AS vec_id FROM s GROUP BY label
""")
def best_chunk_per_entity(spark, sf):
    scored = retrieval.vector_scores(table(spark, sf, "embeddings"), "embedding", _query_vector(spark, sf))
    return scored.groupBy("label").agg(F.round(F.max("score"), 6).alias("score"), F.min_by("vec_id", F.struct(-F.col("score"), F.col("vec_id"))).alias("vec_id"))


@query(f"""
WITH {_BM25}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b ORDER BY score DESC, doc_id LIMIT 120),
c AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}::DOUBLE[]) DESC, vec_id) AS r FROM embeddings QUALIFY r <= 120),
u AS (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS p FROM l UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + r) FROM c),
g AS (SELECT doc_id, sum(p) AS rrf FROM u GROUP BY doc_id)
SELECT doc_id, round(rrf, 9) AS rrf FROM g JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY g.rrf DESC, doc_id LIMIT 8
""")
def rrf_hybrid(spark, sf):
    docs = table(spark, sf, "documents")
    words = retrieval.ranked(search.search(spark, search.index_of(docs, "doc_id", "text"), TERMS, 120, "doc_id"), "score", "doc_id", 120, "r1")
    vectors = retrieval.vector_scores(table(spark, sf, "embeddings"), "embedding", _query_vector(spark, sf)).withColumnRenamed("vec_id", "doc_id")
    both = retrieval.fused([(words, "r1"), (retrieval.ranked(vectors, "score", "doc_id", 120, "r2"), "r2")], "doc_id")
    kept = filters.gate(both.join(docs.select("doc_id", "lang"), "doc_id"), [("lang", F.col("lang") == "en")]).filter("reason is null")
    return retrieval.top(kept, "rrf", "doc_id", 8).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("SELECT p_partkey, p_retailprice AS amount, 'TRY' AS currency, p_retailprice * 1000 AS thousands FROM part")
def turkish_number_roundtrip(spark, sf):
    written = table(spark, sf, "part").select("p_partkey", F.concat(text.number_tr(F.col("p_retailprice")), F.lit(" TL")).alias("t"))
    spoken = F.replace("t", F.lit(" TL"), F.lit(" bin TL"))
    return written.select("p_partkey", parse.money(F.col("t")).cast("double").alias("amount"), parse.currency_of(F.col("t")).alias("currency"), parse.money(spoken).cast("double").alias("thousands"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE AS numeric_d, o_orderdate::DATE AS s, o_orderdate::DATE + 40 AS e FROM orders")
def turkish_date_roundtrip(spark, sf):
    day = F.to_date("o_orderdate")
    spelled = F.concat(F.lit("son gün "), text.date_tr(day), F.lit(" saat 23.59"))
    ranged = F.concat(text.date_tr(day), F.lit(" – "), text.date_tr(F.date_add(day, 40)))
    written = table(spark, sf, "orders").select("o_orderkey", spelled.alias("t"), F.date_format(day, "d.M.yyyy").alias("n"), ranged.alias("r"))
    read = parse.with_date_range(written, "r", "period")
    return read.select("o_orderkey", parse.date_tr(F.col("t")).alias("d"), parse.date_tr(F.col("n")).alias("numeric_d"), F.col("period.start").alias("s"), F.col("period.end").alias("e"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax * 100, 2) AS rate, l_quantity::INT AS lo, l_quantity::INT + 12 AS hi, l_linenumber AS installments, l_quantity::INT * 1000 AS least FROM lineitem")
def rate_and_term_roundtrip(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("aylık %"), text.number_tr(F.col("l_tax") * 100), F.lit(" kâr payı")).alias("r"),
        F.concat(q, F.lit("-"), (F.col("l_quantity").cast("int") + 12).cast("string"), F.lit(" ay vade")).alias("t"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" aya varan taksit")).alias("i"), F.concat(q, F.lit(" bin TL ve üzeri")).alias("m"),
    )
    li = li.select("l_orderkey", "l_linenumber", *[parse.lowered(F.col(c)).alias(c) for c in "rtim"])
    parsed = li.select("l_orderkey", "l_linenumber", parse.rate(F.col("r"), True).alias("rate"), parse.term_months(F.col("t"), True).alias("t"), parse.installments(F.col("i"), True).alias("installments"), parse.money_range(F.col("m"), True).alias("m"))
    return parsed.select("l_orderkey", "l_linenumber", F.col("rate").cast("double").alias("rate"), "t.lo", "t.hi", "installments", F.col("m.lo").cast("int").alias("least"))


@query(r"""
WITH k AS (SELECT page_id, url, 'https://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
  CASE WHEN len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN ('utm_source', 'ref'))) > 0
       THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN ('utm_source', 'ref'))), '&') ELSE '' END AS key FROM pages)
SELECT key, min(page_id) AS page_id, count(*) AS n FROM k GROUP BY key
""")
def url_canonical_dedupe(spark, sf):
    keyed = table(spark, sf, "pages").select("page_id", filters.canonical_url(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1".replace("\\\\", "\\"))
def near_dup_hash(spark, sf):
    even = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")))
    return filters.duplicates_by_hash(table(spark, sf, "documents"), even, "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf):
    latest = filters.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_repeated, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS n_orphans FROM orders")
def export_audit(spark, sf):
    parents = table(spark, sf, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return facts.key_audit(table(spark, sf, "orders"), ["o_custkey"], parents, "o_custkey")


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_props_agg(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))


_KEYWORDS = (("steel", r"STEEL|IRON"), ("soft", r"ECONOMY|SMALL"), ("brass", r"BRASS|COPPER"))


@query("SELECT axis, value, count(DISTINCT p_partkey) AS n FROM (" + " UNION ALL ".join(f"SELECT p_partkey, 'material' AS axis, '{k}' AS value FROM part WHERE regexp_matches(upper(p_type), '{p}')" for k, p in _KEYWORDS) + " UNION ALL SELECT p_partkey, 'brand', p_brand FROM part) GROUP BY axis, value")
def taxonomy_distribution(spark, sf):
    part = table(spark, sf, "part")
    found = F.array_compact(F.array(*[F.when(F.upper("p_type").rlike(p), F.struct(F.lit("material").alias("axis"), F.lit(k).alias("value"))) for k, p in _KEYWORDS], F.struct(F.lit("brand").alias("axis"), F.col("p_brand").alias("value"))))
    return part.select("p_partkey", F.explode(found).alias("l")).groupBy("l.axis", "l.value").agg(F.count_distinct("p_partkey").alias("n"))


_FACTS = "SELECT user_id, event_type AS field, CASE event_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'rule' ELSE 'llm' END AS method, round(value, 0)::VARCHAR AS value, (event_id % 10) / 10.0 AS confidence, event_id FROM events"


def _facts(spark, sf):
    m = F.col("event_id") % 3
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("field"), F.when(m == 0, "table").when(m == 1, "rule").otherwise("llm").alias("method"), F.round("value", 0).cast("string").alias("value"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))


@query(f"""
WITH f AS ({_FACTS}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY CASE method WHEN 'table' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END, confidence DESC, value DESC) AS rn FROM f),
g AS (SELECT user_id, field, count(DISTINCT value) > 1 AS conflict, count(*) AS n_facts FROM f GROUP BY user_id, field)
SELECT user_id, field, value, method, CASE WHEN conflict THEN greatest(0.10, confidence - 0.15) ELSE confidence END::DOUBLE AS confidence, conflict, n_facts FROM r JOIN g USING (user_id, field) WHERE rn = 1
""")
def merge_facts(spark, sf):
    return facts.merge_facts(_facts(spark, sf), ["user_id", "field"]).withColumn("confidence", F.col("confidence").cast("double"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS m_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def eav_pivot(spark, sf):
    e = table(spark, sf, "events")
    return facts.to_metrics(e, "user_id", "event_type", "value", _TYPES).select("user_id", *[F.col(t).alias(f"m_{t}") for t in _TYPES])


@query("""
WITH r AS (SELECT s_nationkey AS bank, l_orderkey % 2 = 0 AS led, l_linenumber AS term, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'TRY' ELSE 'GBP' END AS cur, round(l_tax * 100, 2) AS v, {'a': l_shipdate, 'b': l_orderkey, 'c': l_extendedprice, 'd': l_tax} AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <= 5 AND (l_orderkey % 2 = 1 OR s_nationkey % 3 > 0)),
c AS (SELECT bank, led, term, cur, arg_max(v, w) AS v FROM r GROUP BY ALL),
p AS (SELECT bank, term, cur, term || 'm|' || cur AS cell, CASE cur WHEN 'TRY' THEN 0 WHEN 'USD' THEN 1 ELSE 3 END AS pos, max(v) FILTER (led) AS own, max(v) FILTER (NOT led) AS oth FROM c GROUP BY ALL),
b AS (SELECT bank, bool_or(own IS NOT NULL) AS led FROM p GROUP BY bank),
s AS (SELECT bank, arg_min({'cell': cell, 'own': own, 'oth': oth}, {'p': pos, 't': term}) AS x FROM p WHERE own IS NOT NULL AND oth IS NOT NULL GROUP BY bank)
SELECT bank, CASE WHEN led THEN 'feed' ELSE 'other' END AS data_source, string_agg(cell || '=' || printf('%.2f', CASE WHEN led THEN own ELSE oth END), ',' ORDER BY pos, term) FILTER ((CASE WHEN led THEN own ELSE oth END) IS NOT NULL) AS cells, x.cell AS shared, x.own AS own, x.oth AS other,
  CASE WHEN x IS NULL THEN NULL WHEN x.own = x.oth THEN 'equal' WHEN abs(x.own - x.oth) <= 0.5 THEN 'near' ELSE 'different' END AS match FROM p JOIN b USING (bank) LEFT JOIN s USING (bank) GROUP BY bank, led, x
""")
def source_pivot_crosscheck(spark, sf):
    """Rates of two sources by nation, the last of each cell; every third nation has one source only."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter("l_orderkey % 2 = 1 OR s_nationkey % 3 > 0")
    rates = li.select(
        "s_nationkey", F.when(F.col("l_orderkey") % 2 == 0, "feed").otherwise("bank_site").alias("src"), F.col("l_linenumber").alias("term"), F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "N", "TRY").otherwise("GBP").alias("cur"),
        F.round(F.col("l_tax") * 100, 2).alias("v"), "l_shipdate", "l_orderkey", "l_extendedprice", "l_tax",
    )
    out = pivots.source_pivot(rates, "s_nationkey", "src", "term", {k: f"{k}m" for k in range(1, 6)}, "cur", "v", ["l_shipdate", "l_orderkey", "l_extendedprice", "l_tax"], "feed")
    cells = F.array_join(F.transform("cells", lambda x: F.format_string("%s=%.2f", x["cell"], x["value"])), ",")
    return out.select("bank", "data_source", cells.alias("cells"), "shared", "own", "other", "match")


_PAIRS = "SELECT d.lang, d.source, CASE WHEN l.doc_id % 6 <> 0 THEN quality::VARCHAR END AS gold, CASE WHEN n_chars < 200 THEN '0' WHEN n_chars < 4000 THEN '1' END AS found FROM documents d JOIN labels l USING (doc_id)"
_COUNTS = "count(CASE WHEN gold IS NOT NULL AND found IS NOT NULL AND gold = found THEN 1 END) AS tp, count(CASE WHEN found IS NOT NULL AND (gold IS NULL OR gold <> found) THEN 1 END) AS fp, count(CASE WHEN gold IS NOT NULL AND (found IS NULL OR gold <> found) THEN 1 END) AS fn, count(CASE WHEN gold IS NULL AND found IS NULL THEN 1 END) AS tn"


@query(f"""
WITH c AS (SELECT lang, source, {_COUNTS} FROM ({_PAIRS}) GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT lang, source, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1,
  round(coalesce(fp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS hallucination, round(coalesce(tn / nullif(tn + fp, 0), 0), 6)::DOUBLE AS silence FROM c
""")
def confusion_metrics(spark, sf):
    pairs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    pairs = pairs.select("lang", "source", F.when(F.col("doc_id") % 6 != 0, F.col("quality").cast("string")).alias("gold"), F.when(F.col("n_chars") < 200, "0").when(F.col("n_chars") < 4000, "1").alias("found"))
    same = facts.values_match(F.col("gold"), F.col("found"), F.lit("text"))
    out = facts.quality(facts.confusion(pairs, "gold", "found", same, [[], ["lang"], ["source"]]))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "hallucination", "silence")})


@query("""
WITH r AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS pairs, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement FROM r WHERE a > 0 AND b > 0 GROUP BY event_type
""")
def annotator_agreement(spark, sf):
    odd = F.col("event_id") % 2
    rounds = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.when(odd == 0, 1)).alias("a"), F.count(F.when(odd == 1, 1)).alias("b")).filter("a > 0 and b > 0")
    return rounds.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")), 6).alias("agreement"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 1 OR s_suppkey % 4 = 0")
def upsert_merge(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    old = s.filter("s_suppkey % 5 <> 1")
    new = s.filter("s_suppkey % 4 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    return facts.upsert(old, new, ["s_suppkey"])


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM documents) GROUP BY change")
def hash_skip_status(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return facts.change_status(old, docs, ["doc_id"], "text").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3 GROUP BY c_mktsegment
""")
def quota_per_stratum(spark, sf):
    picked = ranking.hash_sample(table(spark, sf, "customer"), ["c_custkey"], ["c_mktsegment", "c_nationkey"], 3)
    return picked.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS first_text, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_digest(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first_text"), F.count(F.lit(1)).alias("turns"), rows.alias("r"))
    return c.select("conv_id", "first_text", "turns", F.array_join(F.col("r.role"), ">").alias("roles"))


@query(f"SELECT item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY item_id")
def evidence_containment(spark, sf):
    """In how many documents a snippet stands, after white space and case are evened out."""
    item = table(spark, sf, "benchmark").select("item_id", "text")
    found = matching.snippets_in(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), "doc_id", "body", item, "item_id", "text")
    counts = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return item.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
