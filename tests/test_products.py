import json

from pyspark.sql import functions as F

from tallyloom.operators import labels, products, retrieval
from tallyloom.plans import question

CELLS = "page_id long, table_no int, row_no int, col_no int, text string, caption string"


def cells(spark, *tables):
    rows = [(1, t, r, c, text, "") for t, table in enumerate(tables) for r, line in enumerate(table) for c, text in enumerate(line)]
    return spark.createDataFrame(rows, CELLS)


def test_vehicle_matrix_needs_all_its_columns(spark):
    good = [["Model", "Fatura Tutarı", "Finansman Oranı", "Vade"], ["a", "400.000 TL - 800.000 TL", "0", "en fazla 36 ay"], ["b", None, "yok", "24 ay"], ["short"]]
    unnamed = [["Araç", "Oran ve süre"], ["1 TL", "%10"]]
    got = {(r.table_no, r.row_no, r.value_hi, r.ratio, r.term_months_max) for r in products.vehicle_limits(cells(spark, good, unnamed)).collect()}
    assert got == {(0, 1, 800000, 0, 36), (0, 2, None, None, 24)}
    assert products.vehicle_limits(cells(spark, good).filter("false")).count() == 0


def test_plan_takes_amounts_from_its_totals(spark):
    plan = [["Konut"], ["Taksit No", "Taksit Tutarı", "Kalan Ana Para", "Ana Para"], ["1", "60 TL", "90 TL", "45 TL"], ["2", "60 TL", "45 TL", "45 TL"], ["3", None, "0 TL", "10 TL"], ["TOPLAM", "120 TL", "", "100 TL"], ["4", "9 TL", "", "9 TL"]]
    no_total, no_principal, no_rows = plan[:5], [["Taksit No", "Tutar"], ["1", "2"], ["Toplam", "2"]], [plan[1], plan[5]]
    got = products.plan_totals(cells(spark, plan, no_total, no_principal, no_rows)).collect()
    assert [(r.table_no, r.term_months, r.principal, r.profit, r.repayment) for r in got] == [(0, 3, 100, None, 120)]


def test_weakest_source_of_limits(spark):
    df = spark.createDataFrame([(1, 5, 9, 7, 8), (2, None, 0, 7, None), (3, None, None, None, 0), (4, 5, 0, None, None)], "id long, f_lo long, f_hi long, t_lo long, t_hi long")
    out = products.page_limits(df, {"amount_min": "f_lo", "amount_max": "f_hi"}, {"amount_min": "t_lo", "amount_max": "t_hi"})
    assert [(r.amount_min, r.amount_max, r.limits_source) for r in out.orderBy("id").collect()] == [(5, 9, "html_attr"), (7, None, "text"), (None, None, "none"), (5, None, "html_attr")]


def test_variants_are_never_guessed(spark):
    patterns = (("state", "used", ("ikinci el", "2. el")), ("state", "brand_new", ("sifir",)))
    df = spark.createDataFrame([("2. El Konut",), ("SIFIR araç",), ("Brand-New",), ("boat",), ("",), (None,)], "label string")
    assert [r.k for r in df.select(products.variant_of(F.col("label"), patterns)["key"].alias("k")).collect()] == ["used", "brand_new", "brand_new", None, None, None]


def test_parents_of_the_same_bank_only(spark):
    new = spark.createDataFrame([("a", "root", None), ("a", "x", "root"), ("b", "y", "root"), ("b", "z", "kept")], "bank string, external_key string, parent_external_key string")
    stored = spark.createDataFrame([("b", "kept"), ("b", "kept")], "bank string, external_key string")
    assert {(r.external_key, r.reason) for r in products.with_parents(new, stored).collect()} == {("root", None), ("x", None), ("y", "parent_missing"), ("z", None)}


def test_seed_file(spark, tmp_path):
    sets = [
        {"rate_type": "yield", "variant": "normal", "rows": [{"bank_code": "a", "values": {"1 month|TRY": "41.5", "odd|TRY": "1", "1 month|USD": "?"}}, {"bank_code": "no", "values": {"1 month|TRY": "1"}}]},
        {"rate_type": "profit_sharing_ratio", "variant": "v", "rows": [{"bank_code": "a", "values": {"1 month|EUR": "80"}, "evidence_text": "seen"}], "not_offered_banks": ["b", "no"]},
    ]
    (tmp_path / "seed.json").write_text(json.dumps({"datasets": sets}, indent=1))
    seeds = spark.read.schema(products.SEED_TYPE).json(str(tmp_path / "seed.json"), multiLine=True)
    banks = spark.createDataFrame([("a",), ("b",), ("a",)], "bank_code string")
    got = {(r.bank_code, r.variant, r.availability, r.currency, r.rate, r.bank_share, r.evidence) for r in products.seed_rates(seeds, banks, {"1 month": 1}).collect()}
    assert got == {("a", None, "offered", "TRY", 41.5, None, "1 month: 41.5"), ("a", "v", "offered", "EUR", None, 20, "seen"), ("b", "v", "not_offered", None, None, None, None)}


def test_filtered_search_keeps_what_no_channel_ranks(spark):
    kept = spark.createDataFrame([(1, "expired"), (2, None), (3, "active"), (4, "expired")], "id long, status string")
    ranks = spark.createDataFrame([(4, 2), (9, 1)], "id long, place int")
    ids = lambda filtered: [r.id for r in retrieval.hybrid(kept, [(ranks, "place")], "id", "status", filtered, 3).collect()]
    assert ids(True) == [4, 3, 1] and ids(False) == [4]


def test_answers_cite_five_cards_or_refuse(spark):
    hits = spark.createDataFrame([("q", n, f"t{n}", f"pays {n}0 percent") for n in range(1, 8)] + [("none", None, None, None), ("bare", 1, None, "x")], "q string, place int, title string, card string")
    got = {r.q: r for r in retrieval.grounded_answers(hits, "q", "place", "title", "card").collect()}
    assert got["q"].citations == [1, 2, 3, 4, 5] and got["q"].answer.split("\n")[1] == "[2] t2: pays 20 percent" and got["q"].grounded
    assert got["none"].answer is None and got["none"].citations == [] and got["bare"].answer == "[1] : x"


def test_general_words_only_where_nothing_special_was_found():
    axes = {"product": {"card": ("kredi karti",), "loan": ("konut",)}}
    bare = {"product": {"loan": ("finansman",)}}
    asked = lambda q: question.parse_question(q, {}, axes, {}, bare).axes.get("product")
    assert asked("kredi kartı finansman") == ("card",) and asked("finansman var mı") == ("loan",) and asked("hava durumu") is None


def test_merged_labels(spark):
    docs = spark.createDataFrame([(1, "Big Shop günleri"), (2, "shop"), (3, None)], "id long, title string")
    known = spark.createDataFrame([("big shop", "market", False), ("Shop", "market", True), ("!", "none", False)], "name string, value string, ambiguous boolean")
    found = labels.merchant_labels(docs, "id", "title", known, "sector")
    assert {(r.id, r.confidence, r.evidence) for r in found.collect()} == {(1, 0.9, "big shop"), (2, 0.7, "Shop")}
    more = spark.createDataFrame([(1, "sector", "market", 1.0, "own"), (2, "sector", "x", 0.94, None)], "id long, axis string, value string, confidence double, evidence string")
    got = labels.merged_labels(docs, "id", [found, more], {"sector": "other"}, boosted=("sector", "market", "x"))
    assert {(r.id, r.value, r.confidence) for r in got.collect()} == {(1, "market", 1.0), (2, "market", 0.75), (2, "x", 0.94), (3, "other", 0.3)}


def test_rates_are_judged_by_forty_letters(spark):
    """Letters before a percentage are counted over other percentages; each number is read once, whatever its form."""
    from tallyloom.functions import parse
    from tallyloom.operators import extraction

    texts = {"yüzde 3yindirim%%%49,560 %vade farksız bu oran başka 12%": 12, "%1,5 ile %1,50": 1.5, "vade farksız": 0, "": None, "%3%4": None, "%3 kâr payı" + "x" * 40 + "%4": 3, "indirim" + "x" * 40 + "%5": 5, "indirim" + "x" * 33 + "%5": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: None if r.p is None else float(r.p.value) for r in df.select("t", extraction.profit_rate(F.col("t")).alias("p")).collect()}
    assert got == texts
    plan = df.select(parse.decimal_tr(F.regexp_replace("t", "q", "w")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1
