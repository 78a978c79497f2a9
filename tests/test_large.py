"""Operators made for groups and tables of any size, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import fold, tokens
from tallyloom.operators import answers, finance, matching, pivots, ranking, retrieval, search


def test_index_finds_what_a_scan_finds(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["kampanya", "kampanyalar", "Kâr", "ŞEKER"]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.choice([1, 3, 40, 200])))) for i in range(600)] + [(600, None), (601, ""), (602, "tek kampanyasında")]
    docs = spark.createDataFrame(rows, "id int, t string")
    monkeypatch.setattr(search, "BLOCK", 8)
    index = search.build(docs, "id", "t")
    assert (index.n, index.terms.filter("term = 'kar'").count()) == (603, 1)
    for terms in (["w0", "w7"], ["kampanya", "seker"], ["kampanyas"], ["w29"], ["yok"], []):
        for limit in (5, 40, 1000):
            want = retrieval.top(retrieval.bm25(docs, "id", "t", terms), "score", "id", limit).collect() if terms else []
            got = search.search(spark, index, terms, limit, "id").collect()
            assert [(x.id, x.matched, pytest.approx(x.score)) for x in want] == [(x.id, x.matched, x.score) for x in got], (terms, limit)
    empty = search.build(docs.limit(0), "id", "t")
    assert search.search(spark, empty, ["w0"], 5, "id").count() == 0


def test_index_is_built_again_for_other_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "alfa")], "id int, t string").write.parquet(path)
    one = search.index_of(spark.read.parquet(path), "id", "t")
    assert search.index_of(spark.read.parquet(path), "id", "t") is one
    spark.createDataFrame([(2, "alfa")], "id int, t string").write.mode("append").parquet(path)
    assert search.index_of(spark.read.parquet(path), "id", "t").n == 2


def test_tokens_are_runs_of_the_folded_text(spark):
    texts = ["KÂR PAYI oranı", "İSTANBUL ıIİi", "a​b­c", "x–y z", "Ş1ş2", "", None, "KK"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("a"), F.regexp_extract_all(fold(F.col("t")), F.lit("[a-z0-9]+"), 0).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_places_across_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1.0, 2.0, None, 5.5]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, id int").repartition(7)
    got = {(x.g, x.id): x.place for x in ranking.placed(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    want = {}
    for g in ("a", "b", None):
        for k, (_, v, i) in enumerate(sorted([x for x in rows if x[0] == g], key=lambda x: (x[1] is None, -(x[1] or 0), x[2])), 1):
            want[g, i] = k
    assert got == want
    ranked = ranking.rank_by(df.withColumnRenamed("v", "cashback_pct"), "en_yuksek_iade_orani", ["g"], "id", limit=3).collect()
    assert {(x.g, x.status): len([y for y in ranked if (y.g, y.status) == (x.g, x.status)]) for x in ranked} == {(g, s): 3 for g in ("a", "b", None) for s in ("ranked", "no_data")}
    assert all((x.rank is None) == (x.status == "no_data") == (x.missing_reason is not None) for x in ranked)
    for bad in (("en_hizli", None), ("en_yuksek_getiri", "financing_rate"), ("en_yuksek_odul", "financing_rate")):
        with pytest.raises(ValueError):
            ranking.criterion_of(*bad)
    assert ranking.criterion_of("en_uzun_vade", "financing_rate") == ("term_months", True)


def test_containment_equals_all_pairs(spark):
    r = random.Random(8)
    syllables = ["fin", "ans", "kon", "ut", "tas", "it", "kart", "ihti", "yac"]
    name = lambda k: "".join(r.choices(syllables, k=k))
    names = [(b, [name(2) for _ in range(r.choice([1, 1, 2]))]) for b in "ab" for _ in range(60)] + [("a", ["kart" * 3])] * 3 + [("a", [])]
    names = [(b, [x for x in n if len(x) >= 4]) for b, n in names]
    texts = [(b, " ".join(name(r.choice([1, 2, 3])) for _ in range(6))) for b in "ab" for _ in range(150)] + [("a", None), ("a", ""), ("a", "kar")]
    want = {(b, t, tuple(n)) for b, t in texts for c, n in names if b == c and n and t is not None and all(x in t for x in n)}
    got = matching.contained(spark.createDataFrame(texts, "bank string, t string"), spark.createDataFrame(names, "bank string, n array<string>"), "bank", "t", "n").collect()
    assert len(got) == len(want) and {(x.bank, x.t, tuple(x.n)) for x in got} == want


def test_products_that_campaigns_name(spark):
    c = spark.createDataFrame([("a", 1, "İHTİYAÇ FİNANSMANI fırsatı", "/x", None), ("a", 2, "Fırsat", "/k/konut-finansmani-yeni", ""), ("a", 3, "Fırsat", "/x", "Bugün konut  finansmanı ve daha fazlası"), ("b", 4, "ihtiyaç finansmanı", "/x", None), ("a", 5, None, None, None)], "bank string, cid int, title string, url string, body string")
    p = spark.createDataFrame([("a", 10, "İhtiyaç Finansmanı (Kredi)*", "ihtiyac-finansmani"), ("a", 11, "Konut Finansmanı", "konut-finansmani"), ("a", 12, "Kart", "kart")], "bank string, pid int, name string, slug string")
    got = {(x.cid, x.pid): (x.method, x.confidence, x.evidence) for x in matching.contains_match(c, p, "bank", "cid", "pid", "title", "url", "body", "name", "slug").collect()}
    assert got == {(1, 10): ("title", 0.9, "İHTİYAÇ FİNANSMANI fırsatı"), (2, 11): ("slug", 0.85, "konut-finansmani"), (3, 11): ("body", 0.6, "Bugün konut finansmanı ve daha fazlası")} or (3, 11) not in got


def test_equal_campaigns_and_products_are_paired_last(spark):
    c = spark.createDataFrame([("a", i, "Yeni konut finansmanı" if i % 2 else "Fırsat", "/x", None if i % 2 else "Şimdi konut finansmanı") for i in range(40)], "bank string, cid long, title string, url string, body string")
    p = spark.createDataFrame([("a", i, "Konut Finansmanı", "konut-finansmani") for i in range(30)], "bank string, pid long, name string, slug string")
    found = matching.contains_match(c, p, "bank", "cid", "pid", "title", "url", "body", "name", "slug")
    got = {(x.cid, x.pid): (x.method, x.evidence) for x in found.collect()}
    assert found.count() == len(got) == 1200 and got[1, 2] == ("title", "Yeni konut finansmanı") and got[2, 29] == ("body", "Şimdi konut finansmanı")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "cid#" in line and "pid#" in line for line in plan.splitlines())


def test_offers_of_banks(spark):
    rates = spark.createDataFrame([("a", 1, "k", 12, 2.0, None, None), ("a", 2, "k", 24, 1.5, None, None), ("a", 3, "k", 36, 1.0, 5000.0, None), ("b", 4, "k", None, 1.0, None, None), ("c", 5, "k", 12, 0.0, None, 500.0), ("c", 6, "k", 12, None, None, None), ("d", 7, "t", 12, 1.0, None, None)], "bank string, product int, product_type string, term int, rate double, low double, high double")
    requests = spark.createDataFrame([(1, "k", 1000.0, 18), (2, "k", 300.0, 12), (3, "k", 9000.0, 40)], "request int, product_type string, amount double, term int")
    banks = rates.select("bank").distinct()
    got = {(r.request, r.bank): r for r in finance.financing_offers(requests, rates, banks).collect()}
    assert len(got) == 12
    assert (got[1, "a"].product, got[1, "a"].is_exact, got[1, "a"].is_best) == (2, False, True)  # equally near: the cheaper
    assert got[2, "c"].rate == 0 and got[2, "c"].monthly == 25 and got[2, "c"].is_best and got[2, "a"].is_exact and not got[2, "a"].is_best
    assert got[3, "a"].product == 3 and got[3, "c"].missing == finance.NO_RATE and got[3, "b"].missing == finance.NO_TERM and got[1, "d"].missing == finance.NO_RATE


def test_pivot_of_sources(spark):
    rows = [("a", "bank", 1, "TRY", 10.0, 1, None), ("a", "bank", 1, "TRY", 11.0, 2, None), ("a", "feed", 1, "TRY", 11.4, 1, "Anomali: x"), ("a", "feed", 3, "EUR", 4.0, 1, None), ("a", "feed", 3, "XAU", 1.0, 1, None), ("b", "bank", 3, "USD", 2.0, 1, None), ("b", "bank", 7, "USD", 2.0, 1, None), ("c", "bank", 1, "TRY", None, 1, None)]
    df = spark.createDataFrame(rows, "bank string, src string, term int, cur string, v double, seen int, note string")
    got = {r.bank: r for r in pivots.source_pivot(df, "bank", "src", "term", {1: "aylık", 3: "3 ay"}, "cur", "v", ["seen"], "feed", "note").collect()}
    assert set(got) == {"a", "b"} and got["a"].data_source == "feed" and [(x.cell, x.value) for x in got["a"].cells] == [("aylık|TRY", 11.4), ("3 ay|EUR", 4.0), ("3 ay|XAU", 1.0)]
    assert (got["a"].shared, got["a"].own, got["a"].other, got["a"].match, got["a"].notes) == ("aylık|TRY", 11.4, 11.0, "near", ["aylık|TRY: Anomali: x"])
    assert (got["b"].data_source, got["b"].shared, got["b"].match, [(x.cell, x.value) for x in got["b"].cells]) == ("other", None, None, [("3 ay|USD", 2.0)])
    assert [r[0] for r in pivots.not_offered(spark.createDataFrame([("a", "not_offered"), ("b", "offered"), ("a", "not_offered")], "bank string, s string"), "bank", "s").collect()] == ["a"]


def test_questions_in_bulk_with_an_index(spark):
    corpus = spark.createDataFrame(
        [(1, "A", "active", ["kart"], 2.0, "market alışverişi"), (2, "A", "active", ["kredi"], None, "konut market"), (3, "B", "active", None, 1.5, "market market market"), (4, "B", "expired", ["kart"], 1.0, "tatil"), (5, None, "active", ["kart"], 9.0, None)],
        "id long, bank string, status string, kind array<string>, rate double, card string",
    )
    index = search.build(corpus, "id", "card")
    questions = spark.createDataFrame(
        [(1, "Alfa bankası kaç kampanya var", None), (2, "en düşük oran hangisi", None), (3, "market kampanyaları", None), (4, "market kampanyaları", "B"), (5, "Alfa kart oranı 1,5 altında", None), (6, None, None), (7, "tüm durumlar kaç tane", None), (8, "market kampanyaları", None)],
        "q long, words string, chosen string",
    )
    out = answers.answers(questions, "q", "words", "chosen", corpus, "id", "bank", "status", {"kind": {"kart": ("kart",), "kredi": ("kredi",)}}, {"rate": ("oran",)}, {"Alfa": "A", "Beta": "B"}, index, limit=2)
    got = {}
    for r in out.collect():
        got.setdefault(r.q, []).append((r.part, r.bank, r.document, r.n) if r.part != "hit" else (r.rank, r.document))
    assert got[1] == [("count", "A", None, 2)] and got[2] == [("extremum", "B", 3, 3)]
    assert sorted(got[3]) == [(1, 3), (2, 1)] == sorted(got[8]) and got[4] == [(1, 3)]  # equal questions get equal answers, a chosen bank counts
    assert got[5] == [(None, None, None, None)]  # nothing passes: a row says so
    assert len(got[6]) == 2 and sorted(got[7], key=str) == [("count", "A", None, 2), ("count", "B", None, 2), ("count", None, None, 1)]


def test_snippets_of_any_length_are_found(spark):
    texts = [(1, "Bir  Kampanya\nile kart sahipleri ve diğer müşteriler kazanır"), (2, "kart"), (3, None), (4, ""), (5, "başka bir metin"), (6, "KART SAHİPLERİ ve diğer müşteriler kazanır")]
    items = [(10, "kampanya ile kart sahipleri ve diğer müşteriler"), (11, "Kart"), (12, "ka"), (13, "bir"), (14, ""), (15, None), (16, "yok böyle bir cümle hiç bir yerde yok"), (17, "r kampanya ile kart sahipleri ve diğ"), (18, "diğer müşteriler")]
    norm = lambda t: " ".join(t.split()).lower() if t else ""
    want = {(i, d) for i, s in items if norm(s) for d, t in texts if norm(s) in norm(t)}
    got = matching.snippets_in(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame(items, "i int, s string"), "i", "s").collect()
    assert len(got) == len(want) and {(r.i, r.d) for r in got} == want


def test_shared_options_equal_all_pairs(spark):
    r = random.Random(4)
    pages = {(s, p): set(r.sample("abcdefghijklmnop", r.choice([1, 2, 3, 5, 8]))) for s in "xy" for p in range(25)}
    for share in (0.5, 0.7, 1.0):
        want = {(s, p) for (s, p), a in pages.items() for (t, q), b in pages.items() if s == t and p != q and len(a & b) >= share * min(len(a), len(b))}
        df = spark.createDataFrame([(s, p, o) for (s, p), options in pages.items() for o in options], "s string, p int, o string")
        got = {(x.s, x.p) for x in matching.shared_selectors(df, "s", "p", "o", share).collect()}
        assert got == want, share


def test_requests_stay_one_row_until_their_offers(spark, tmp_path):
    """Nothing is dealt out by request: a request meets one row of its type and term, and offers are made beside each other."""
    requests = spark.range(2000).selectExpr("id as request", "concat('k', id % 3) as product_type", "1000.0 + id as amount", "cast(1 + id % 7 as int) as term")
    rates = spark.range(60).selectExpr("concat('b', id % 5) as bank", "cast(id as int) as product", "concat('k', id % 2) as product_type", "cast(id % 9 as int) as term", "id / 50.0D as rate", "if(id % 4 = 0, 1500.0D, null) as low", "cast(null as double) as high")
    offers = finance.financing_offers(requests, rates, rates.select("bank").distinct().union(spark.createDataFrame([("none",)], "bank string")))
    plan = offers._jdf.queryExecution().optimizedPlan().toString()
    assert "[request#" not in "".join(x for x in plan.splitlines() if "Aggregate" in x or "Window" in x)
    rows = offers.collect()
    assert len(rows) == 12_000 and {r.missing for r in rows if r.bank == "none"} == {finance.NO_RATE}
    assert len([r for r in rows if r.is_best]) == len({r.request for r in rows if r.rate is not None})


def test_shared_options_keep_no_pairs(spark):
    """A set looks for one other that is near and stops there: no join gives pairs of sets."""
    df = spark.createDataFrame([("x", p, o) for p in range(6) for o in ("ab", "ac", "bc")[p % 3]], "s string, p int, o string")
    plan = matching.shared_selectors(df, "s", "p", "o")._jdf.queryExecution().optimizedPlan().toString()
    near = [line for line in plan.splitlines() if "array_intersect" in line]
    assert len(near) == 2 and all("Join LeftSemi" in line for line in near)
