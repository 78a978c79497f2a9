"""Parsers, folding, finance, HTML cells, feeds and merges on cases with known answers."""

import datetime
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import elements, html, parse, text
from tallyloom.operators import facts, filters, finance, labels, ranking, tables
from tallyloom.plans import question
from tallyloom.sources import feeds, sinks


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("token,want", [("1.250,50", "1250.5"), ("1,250.50", "1250.5"), ("5,000", "5"), ("5.000", "5000"), ("2.05", "2.05"), ("1.234.567", "1234567"), ("1,234,567", "1234567"), ("12.", "12"), (",5", "5"), ("abc", None), ("", None), (None, None), ("1234.567", "1234.567")])
def test_decimal_tr(spark, token, want):
    got = one(spark, token, parse.decimal_tr)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize("t,want", [("5.000 TL", 5000), ("5 bin TL", 5000), ("₺500", 500), ("6026'ya SMS gönderin, 500 TL kazanın", 500), ("masrafsız", 0), ("masrafsız 50.000 TL", 50000), ("2,5 milyon TL", 2500000), ("bilgi yok", None), (None, None)])
def test_money(spark, t, want):
    got = one(spark, t, parse.money)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("t,want", [("50.000 - 2.000.000 TL", (50000, 2000000)), ("50.000 TL'ye kadar", (None, 50000)), ("5.000 TL ve üzeri", (5000, None)), ("500 TL", (500, 500)), ("5 bin ile 10 bin TL", (5000, 10000)), ("ücretsiz", (0, 0)), ("yok", (None, None))])
def test_money_range(spark, t, want):
    got = one(spark, t, parse.money_range)
    assert tuple(None if x is None else float(x) for x in (got.lo, got.hi)) == want


@pytest.mark.parametrize("t,want", [("%2,05", 2.05), ("2.05 %", 2.05), ("yüzde 2,05", 2.05), ("%50'ye varan", 50), ("vade farksız", 0), ("avantajlı kâr payı", None)])
def test_rate(spark, t, want):
    got = one(spark, t, parse.rate)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("t,want", [("120 ay", (120, 120)), ("120 aya kadar", (None, 120)), ("36 aya varan vade", (None, 36)), ("10 yıl", (120, 120)), ("3-36 ay", (3, 36)), ("32 günden başlayan vadelerle", (1, None)), ("45 gün", (2, 2)), ("75 gün", (2, 2)), ("x", (None, None))])
def test_term_months(spark, t, want):
    got = one(spark, t, parse.term_months)
    assert (got.lo, got.hi) == want


def test_more_parsers(spark):
    assert one(spark, "4 aya varan taksit", parse.installments) == 4 and one(spark, "taksit sayısı: 6", parse.installments) == 6
    assert one(spark, "12, 24 ve 36 ay vadeyle", parse.allowed_terms) == [12, 24, 36]
    split = one(spark, "%89,1-%10,9", parse.profit_split)
    assert (float(split.investor), float(split.bank)) == (89.1, 10.9) and one(spark, "90/20", parse.profit_split) is None
    assert one(spark, "100 USD", parse.currency_of) == "USD" and one(spark, "yok", parse.currency_of) == "TRY"
    tiers = one(spark, "5.000 TL ve üzeri 250 TL, 10.000 TL üzeri 600 TL", parse.tiers)
    assert [(float(x.threshold), float(x.reward)) for x in tiers] == [(5000, 250), (10000, 600)]


@pytest.mark.parametrize("t,want", [("31 Aralık 2026", "2026-12-31"), ("1.8.2026 tarihine kadar", "2026-08-01"), ("31 Şubat 2026", None), ("1 AĞUSTOS 2025", "2025-08-01"), ("yok", None)])
def test_date_tr(spark, t, want):
    assert one(spark, t, parse.date_tr) == (None if want is None else datetime.date.fromisoformat(want))


def test_date_range(spark):
    wanted = {
        "01.01.2026 - 31.12.2026": ("2026-01-01", "2026-12-31", "exact"), "6 Ağustos 2026 - 31 Aralık 2026": ("2026-08-06", "2026-12-31", "exact"), "1-31 Ağustos 2026": ("2026-08-01", "2026-08-31", "exact"),
        "10 Temmuz – 7 Ağustos 2026": ("2026-07-10", "2026-08-07", "inferred"), "20 Aralık - 5 Ocak 2026": ("2025-12-20", "2026-01-05", "inferred"), "Son Gün 31.12.2026": (None, "2026-12-31", "partial"),
        "5 Oca 2026 tarihinden itibaren 7 Şub 2026 tarihine kadar": ("2026-01-05", "2026-02-07", "exact"), "09-02-2026": (None, None, "unknown"), "8 Haziran 2026 saat 09.00 - 30 Haziran 2026": ("2026-06-08", "2026-06-30", "exact"),
    }
    rows = parse.with_date_range(spark.createDataFrame([(t,) for t in [*wanted, None]], "t string"), "t", "p").collect()
    got = {r.t: (r.p.start and str(r.p.start), r.p.end and str(r.p.end), r.p.precision) for r in rows}
    assert got == wanted | {None: (None, None, "unknown")}


def test_text(spark):
    assert one(spark, "​İSTANBUL  IĞDIR – ＡＢ ", text.normalize_text) == "İSTANBUL IĞDIR - AB"
    assert one(spark, "İSTANBUL IĞDIR", text.lower_tr) == "istanbul ığdır" and one(spark, "Şişli Çarşı", text.fold) == "sisli carsi"
    assert one(spark, "  a  b \n\n\n\n c ", text.collapse_whitespace) == "a b\n\nc"
    assert one(spark, "Kâr Payı: %2!", text.slugify) == "kar-payi-2"
    assert one(spark, "altin hesabi", lambda c: text.starts_word(c, "altin")) and not one(spark, "saltin", lambda c: text.starts_word(c, "altin"))
    assert one(spark, 12345.5, text.number_tr, "double") == "12.345,50" and one(spark, 2.05, text.number_tr_short, "double") == "2,05" and one(spark, 5000.0, text.number_tr_short, "double") == "5.000"
    assert one(spark, "istanbul", text.capital_tr) == "İstanbul"
    assert one(spark, None, text.fold) is None


def test_finance(spark):
    rows = spark.createDataFrame([(Decimal("100000"), Decimal("2.05"), 36), (Decimal("1200"), Decimal("0"), 12), (None, Decimal("1"), 3)], "p decimal(16,2), r decimal(8,4), n int")
    got = [r[0] for r in rows.select(finance.instalment_exact("p", "r", "n")).collect()]
    worth = sum(float(got[0]) / 1.0205**k for k in range(1, 37))  # the payments are worth the principal
    assert worth == pytest.approx(100000, abs=0.2) and got[1:] == [Decimal("100.00"), None]
    near = rows.limit(1).select(finance.instalment(F.col("p").cast("double"), F.col("r").cast("double"), F.col("n"))).first()[0]
    assert near == pytest.approx(float(got[0]), abs=0.011)
    back = spark.createDataFrame([(100000.0, float(got[0]) * 36, 36), (100.0, 90.0, 3)], "p double, t double, n int").select(finance.implied_monthly_rate("p", "t", "n")).collect()
    assert back[0][0] == pytest.approx(2.05, abs=1e-3) and back[1][0] is None
    got = spark.createDataFrame([(100000.0, 40.0, 92, "TRY")], "a double, y double, d int, c string").select(*finance.net_yield(F.col("a"), F.col("y"), F.col("d"), F.col("c"))).first()
    assert tuple(got) == (10082.19, 1764.38, 8317.81)


RATES = """<h2>Konut</h2><table><tr><th>Vade</th><th>Kâr Payı Oranı</th><th>Tahsis Ücreti</th></tr><tr><td>12 ay</td><td>%4,20</td><td>1.500 TL</td></tr><tr><td>24-36 ay</td><td></td><td>5</td></tr></table>
<table><tr><th>Değer</th><th>A</th><th>C</th></tr><tr><td>500 bin - 1 milyon TL</td><td>90</td><td>80</td></tr><tr><td>1 milyon TL ve üzeri</td><td>70</td><td>-</td></tr></table><form><select name="v"><option>a<option>b</select><input type=number name=n min=1 max=9></form>"""


def test_tables_and_controls(spark):
    pages = spark.createDataFrame([(1, RATES), (2, None), (3, "<p>no tables")], "page_id long, html string")
    cells = html.exploded(pages, "page_id", "html", "cells")
    rates = tables.rate_rows(cells.filter("table_no = 0")).collect()
    assert [(r.lo_months, float(r.rate), float(r.fee), r.rate_type) for r in rates] == [(12, 4.2, 1500.0, "financing_rate")]
    ltv = {(float(r.lo), None if r.hi is None else float(r.hi), r["class"]): float(r.ratio) for r in tables.ltv_rows(cells.filter("table_no = 1")).collect()}
    assert ltv == {(500000, 1000000, "A"): 90, (500000, 1000000, "C"): 80, (1000000, None, "A"): 70}
    controls = {(r.kind, r.name, r.least, r.most) for r in html.exploded(pages, "page_id", "html", "controls").collect()}
    assert controls == {("select", "v", "", ""), ("number", "n", "1", "9")}
    parts = {r.page_id: r.p for r in pages.select("page_id", elements.page_parts("html").alias("p")).collect()}
    assert parts[1].title == "Konut" and parts[2].text == "" and parts[3].text == "no tables"


def test_payment_plan(spark):
    plan = "<table><tr><th>No</th><th>Taksit</th></tr>" + "".join(f"<tr><td>{i}</td><td>1.000,50</td></tr>" for i in range(1, 4)) + "<tr><td>Toplam</td><td>3.001,50</td></tr></table>"
    cells = html.exploded(spark.createDataFrame([(1, plan)], "page_id long, html string"), "page_id", "html", "cells")
    row = tables.payment_plans(cells).first()
    assert (row.instalments, float(row.total)) == (3, 3001.5)


def test_ranking_keeps_what_has_no_data(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, None), ("a", 3, 1.0), ("a", 4, 1.0), ("b", 5, None)], "g string, id int, v double")
    got = {(r.id, r.rank, r.status) for r in ranking.rank_with_missing(df, "v", ["g"], "id", limit=2).collect()}
    assert got == {(3, 1, "ranked"), (4, 2, "ranked"), (2, None, "no_data"), (5, None, "no_data")}
    low = {r.g: tuple(r)[1:] for r in ranking.extremum(df, ["g"], "v", "id", "min").collect()}
    assert low == {"a": (4, 1.0, 3, 1, 1), "b": (None, None, 0, 1, 0)}


def test_gate_says_no_data_apart(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, "y", 5.0), (3, "x", None), (4, "x", 50.0)], "id int, k string, v double")
    rules = [("kind", F.col("k") == "x"), ("price", F.col("v") <= 10)]
    assert {r.id: r.reason for r in filters.gate(df, rules).collect()} == {1: None, 2: "kind", 3: "price:no_data", 4: "price"}
    assert {r.dropped: r.survivors for r in filters.relaxation_hints(df, rules).collect()} == {"kind": 2, "price": 3}


def test_urls(spark):
    assert one(spark, "HTTP://www.Ex.com/a/?utm_source=x&b=2&a=1#f", filters.canonical_url) == "https://ex.com/a?a=1&b=2"
    assert one(spark, "/relative", lambda c: filters.same_site(c, "ex.com")) and not one(spark, "http://other.com/", lambda c: filters.same_site(c, "ex.com"))


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, t string, keep int")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c"), (None, "N")], "k int, t string")
    assert {(r.k, r.t, r.keep) for r in facts.upsert(old, new.distinct(), ["k"]).collect()} == {(1, "a", 1), (2, "B", 2), (3, "c", None), (None, "N", 0)}
    assert {r.k for r in facts.insert_absent(old.filter("k is not null"), new.filter("k is not null"), ["k"]).collect()} == {3}


def test_fact_merging_and_values(spark):
    rows = [("c", "f", "5", "llm", 0.9), ("c", "f", "6", "table", 0.5), ("c", "g", "1", "rule", 0.8), ("c", "g", "1", "llm", 0.9)]
    got = {(r.field, r.value, r.method, round(r.confidence, 2), r.conflict) for r in facts.merge_facts(spark.createDataFrame(rows, "k string, field string, value string, method string, confidence double"), ["k", "field"]).collect()}
    assert got == {("f", "6", "table", 0.35, True), ("g", "1", "rule", 0.8, False)}
    same = lambda a, b, u: spark.range(1).select(facts.values_match(F.lit(a), F.lit(b), F.lit(u))).first()[0]
    assert same("2.05", "2.06", "pct") and not same("2.05", "2.07", "pct") and same("5000.0", "5000", "try") and same("evet", "true", "bool") and same(" Abc", "aBC", "text") and not same("x", "5", "try")


def test_guard(spark):
    row = lambda e, v: spark.range(1).select(labels.guard_reason(F.lit(e), F.lit("Aylık  %2,05 kâr payı; 5.000 TL"), F.lit(v), F.lit(False))).first()[0]
    assert row("aylık %2,05", "2.05") is None and row("5.000 TL", "5000") is None and row("", "5") == "no_evidence" and row("yok", "5") == "evidence_not_in_source" and row("5.000", "7") == "number_not_in_source"


def test_guard_keeps_nearly_equal_evidence(spark):
    rows = [("aylik kar payi orani yuzde iki", "aylik kar payi oranı yuzde iki"), ("abcdefghij", "abcdefghiX"), ("abcdefghij", "abcdefghXY"), ("abcdefghij", "abcdefghiX" + "." * 30)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string, s string").coalesce(1).select(labels.guard_reason(F.col("e"), F.col("s"), F.lit("0"), F.lit(False))).collect()]
    assert got == [None, None, "evidence_not_in_source", "evidence_not_in_source"]


def test_feeds(spark, tmp_path):
    xml = "<urlset><url><loc>http://www.a.com/x/</loc></url><url><loc><![CDATA[https://a.com/x]]></loc></url><s:loc>https://b.org/y</s:loc><url><loc>https://a.com/z"
    maps = spark.createDataFrame([(xml,)], "xml string")
    assert {r.key for r in feeds.sitemap_urls(maps).collect()} == {"https://a.com/x", "https://b.org/y"}
    assert [r.url for r in feeds.sitemap_urls(maps, site="a.com").collect()] == ["http://www.a.com/x/"]
    assert [r.url for r in feeds.robots_sitemaps(spark.createDataFrame([("a: b\nSitemap: http://x/s.xml\n",)], "body string")).collect()] == ["http://x/s.xml"]
    page = b"<p>archived</p>"
    import hashlib

    digest = hashlib.sha256(page).hexdigest()
    (tmp_path / f"0123456789abcdef_{digest[:12]}.html").write_bytes(page)
    (tmp_path / "0123456789abcdef_000000000000.html").write_bytes(page)
    assert sorted(r.verified for r in feeds.archive(spark, str(tmp_path)).collect()) == [False, True]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, Decimal("1.50"), datetime.date(2026, 1, 2)), (2, None, None)], "k int, d decimal(6,2), t date")
    path = str(tmp_path)
    manifest = sinks.export_json_lines({"a": df.coalesce(1), "b": df.filter("k > 1").repartition(2)}, path, {"a": ["k"]}, "r7").collect()
    assert {(r.table, r.revision) for r in manifest} == {("a", "r7"), ("b", "r7")} and sum(r.n_rows for r in manifest if r.table == "a") == 2 and sum(r.n_rows for r in manifest if r.table == "b") == 1
    for r in manifest:
        content = (tmp_path / r.table / r.file).read_bytes()
        assert hashlib.sha256(content).hexdigest() == r.sha256 and len(content) == r.n_bytes and content.count(b"\n") == r.n_rows
    assert spark.read.text(f"{path}/a").first()[0] == '{"k":1,"d":"1.50","t":"2026-01-02"}'
    assert sinks.export_faults(spark, path, ["a", "b"]).count() == 0
    first = next(r for r in manifest if r.table == "a")
    (tmp_path / "a" / f".{first.file}.crc").unlink()
    (tmp_path / "a" / first.file).write_text("{}\n")
    (tmp_path / "b" / "more.json").write_text("{}\n")
    assert {(r.table, r.fault) for r in sinks.export_faults(spark, path, ["a", "b"]).collect()} == {("a", "changed"), ("b", "unknown")}
    with pytest.raises(ValueError, match="not unique"):
        sinks.export_json_lines({"a": df.union(df)}, path, {"a": ["k"]})


def test_generations_are_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = lambda *x: spark.createDataFrame(list(x), "method string, bank string, v int")
    now = lambda: {(r.method, r.bank, r.v) for r in sinks.current(spark, path).collect()}
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    assert sinks.publish(rows(("rule", "a", 1), ("rule", "b", 2), ("gold", "a", 3), (None, "a", 4)), path, ["method", "bank"]) == 1
    before = sinks.current(spark, path)
    # A run that dies between its files and the swap leaves the old version.
    with pytest.raises(RuntimeError):
        sinks.publish(rows(("rule", "a", 9)), path, ["method", "bank"], F.col("method") == "rule", before_swap=lambda: (_ for _ in ()).throw(RuntimeError()))
    assert now() == {("rule", "a", 1), ("rule", "b", 2), ("gold", "a", 3), (None, "a", 4)}
    # Of the rules' partitions one is new and one has no rows any more; others stay as they are.
    assert sinks.publish(rows(("rule", "a", 9)), path, ["method", "bank"], F.col("method") == "rule") == 2
    assert now() == {("rule", "a", 9), ("gold", "a", 3), (None, "a", 4)}
    assert {(r.v) for r in before.collect()} == {1, 2, 3, 4}  # who reads the old version still has it
    with pytest.raises(ValueError, match="scope"):
        sinks.publish(rows(("gold", "a", 9)), path, ["method", "bank"], F.col("method") == "rule")
    sinks.publish(rows(), path, ["method", "bank"], F.col("method").isNull())
    assert now() == {("rule", "a", 9), ("gold", "a", 3)}
    sinks.publish(rows(), path, ["method", "bank"])
    assert now() == set()


def test_question():
    banks, fields = {"Kuzey": "k", "Kuzey Deniz": "kd"}, {"rate": ("oran", "kar payi"), "amount": ("tutar", "odul")}
    axes = {"product": {"gold": ("altın",), "home": ("konut",)}}
    p = question.parse_question("Kuzey Deniz'de konut için oranı %3 altında olan kampanyalar", banks, axes, fields)
    assert p.banks == ("kd",) and p.axes == {"product": ("home",)} and p.numbers == (("rate", "<=", 3.0),) and p.status == "active" and p.intent == "search"
    assert question.parse_question("en düşük kâr payı hangisi", banks, axes, fields).aggregate == ("min", "rate")
    assert question.parse_question("kaç tane altın kampanyası var", banks, axes, fields).aggregate == ("count", None)
    assert question.parse_question("ödülü 5 bin TL üzerinde", banks, axes, fields).numbers == (("amount", ">=", 5000.0),)
    assert question.parse_question("süresi bitmiş kampanyalar", banks, axes, fields).status == "expired"


def test_a_text_is_read_once_a_shape(spark):
    """What several answers need is made once: the expressions hold each shape a few times, not once an answer."""
    t = spark.createDataFrame([("5 - 10 bin tl",), ("12-24 ay",), (None,)], "t string")
    made = t.select(parse.money_range(F.col("t")).alias("m"), parse.term_months(F.col("t")).alias("v"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 10 and plan.count("regexp_replace(") <= 50
    assert [(r.m.lo, r.m.hi, r.v.lo, r.v.hi) for r in made.collect()] == [(5, 10_000, None, None), (12, 24, 12, 24), (None, None, None, None)]


def test_usual_texts_are_left_as_they_are(spark):
    texts = ["", " ", "a b", " a", "a ", "a  b", "a\r\nb", "a\tb", "a\n\n\n\nb", "a\u0085 b", "a  b", "x y", "a​b", "1–2", "₺ 5", "ğüşıöç İI", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    signs = F.translate(F.translate(F.translate("t", text.ZERO_WIDTH, ""), text.SPACES, " " * len(text.SPACES)), text.DASHES, "-" * len(text.DASHES))
    rows = t.select(text.normalize_text(F.col("t"), nfkc=False).alias("a"), text.collapse_whitespace(signs).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    plan = t.select(text.normalize_text(F.col("t"), nfkc=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(" in plan  # the looks that spare usual texts the rest
