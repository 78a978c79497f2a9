"""Limits, periods, chunks, boilerplate, matching, sampling and table changes on small cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import boilerplate, chunks, limits
from tallyloom.operators import audits, changes, matching, periods, sampling


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("t,want", [("1.000 TL - 100.000 TL arası", (1000, 100000)), ("40-60 paylaşım", (None, None)), ("azami 1 milyon TL", (None, 1000000)), ("10.000 TL'den başlayan", (10000, None)), ("50.000 TL", (None, None)), ("0 TL - 5.000 TL", (None, 5000)), (None, (None, None))])
def test_amount_limit(spark, t, want):
    got = one(spark, t, limits.amount_limit)
    assert (got.lo and int(got.lo), got.hi and int(got.hi)) == want


def test_ratios_ages_bands(spark):
    assert one(spark, "ekspertiz değerinin %80'ine kadar", limits.ltv_percent) == 80 and one(spark, "gayrimenkul değeri %120", limits.ltv_percent) is None
    assert [tuple(one(spark, t, limits.vehicle_age)) for t in ("0-3 yaş", "sıfır araç", "ikinci el", "5 yaşına kadar")] == [(0, 3), (0, 0), (1, None), (None, 5)]
    assert [tuple(one(spark, t, limits.value_band)) for t in ("Değer <= 5 Milyon TL", "5 MİLYON TL < DEĞER <= 7 MİLYON TL", "10 milyon TL üzeri")] == [(None, 5000000), (5000000, 7000000), (10000000, None)]
    assert [tuple(one(spark, t, limits.term_header)) for t in ("31 Günlük", "3 Aylık", "1 Yıl (%)", "yıldan uzun")] == [(1, 31, 31), (3, None, None), (12, None, None), (12, 366, None)]
    assert tuple(one(spark, "X (0-10.000.000 TL)", limits.option_limits)) == ("X", None, None, None, Decimal("10000000.000000"))
    assert one(spark, "5.000 TL, %2,05 ve 2.05; 01.02.2026 12", limits.numbers_in) == [5000, Decimal("2.05"), 12]
    assert [tuple(one(spark, t, limits.rate_range)) for t in ("%1,5 - %2,5", "%2 ile başlayan", "%3'e varan")] == [(Decimal("1.5"), Decimal("2.5")), (2, None), (None, 3)]


def test_periods(spark):
    texts = [
        "Başlık\nKampanya Dönemi\n\n11-08-2026\n-\n31-08-2026\n\nSon Gün 01.01.2027", "Kampanya\n09-02-2026\nTarihinde Sona Ermiştir.\nmetin", "05 Aralık - 15 Ocak 2025\nmetin 3 Mart 2024 tarihinde",
        "Kampanyadan 23 Şubat - 22 Mart 2026 tarihleri arasında\nKampanya 22 Mart 2026 tarihine kadar", "Yayın Tarihi\n01.01.2020\nhiç", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.start and str(r.start), r.end and str(r.end), r.precision, r.evidence) for r in periods.campaign_period(docs, "i", "t").collect()}
    assert got == {
        0: ("2026-08-11", "2026-08-31", "exact", "11-08-2026\n-\n31-08-2026"), 1: (None, "2026-02-09", "partial", "09-02-2026"), 2: ("2024-12-05", "2025-01-15", "inferred", "05 Aralık - 15 Ocak 2025"),
        3: ("2026-02-23", "2026-03-22", "inferred", "23 Şubat - 22 Mart 2026"), 4: (None, None, "unknown", None), 5: (None, None, "unknown", None),
    }


def test_chunks_lose_nothing(spark):
    text = "\n\n".join(["Cümle bir. Cümle iki uzun. " + "x" * 45 + ". Son."] * 3)
    got = one(spark, text, lambda c: chunks.chunks(c, 40))
    assert max(map(len, got)) <= 40 and "".join("".join(got).split()) == "".join(text.split())
    assert one(spark, None, chunks.chunks) == [] and one(spark, "  \n", chunks.chunks) == [] and one(spark, " kısa ", chunks.chunks) == ["kısa"]


def test_own_text_keeps_dates_and_refuses_deep_cuts(spark):
    body = "Koşul cümlesi burada uzun uzun yazılmıştır. " * 8
    rows = [("Menü\nKampanya A\n3 Mart 2026\nKampanya A\n" + body + "\nPaylaş\nİlgili Kampanyalar:\nB", "Kampanya A!"), ("kısa\nilgili kampanyalar\nx", None), (None, "t")]
    got = [r.own for r in boilerplate.own_text(spark.createDataFrame(rows, "t string, h string"), "t", "h", "own").collect()]
    assert got == ["3 Mart 2026\nKampanya A\n" + body.strip(), rows[1][0], None]


def test_matching_and_changes(spark):
    rates = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", None), ("q", "a")], "p string, v string")
    got = {(r.p, r.v): (r.child, r.parent) for r in changes.split_variants(rates, "p", "v").collect()}
    assert got == {("p", "a"): ("p#a", "p"), ("p", "b"): ("p#b", "p"), ("p", None): ("p", None), ("q", "a"): ("q", None)}
    old = spark.createDataFrame([("c", "end_date", "x", "2026-01-01", "e", "blind", changes.AUTO)], "campaign_key string, field string, annotator string, value string, evidence string, method string, note string")
    new = spark.createDataFrame([("c", "end_date", "x", "3 Mart 2026", "e", "blind", None), ("c", "odd", "x", "1", "e", "blind", None)], old.schema)
    kept, bad = changes.annotate(old, new, ("end_date",))
    assert [(r.value, r.note) for r in kept.collect()] == [("2026-03-03", changes.AUTO)] and [r.reason for r in bad.collect()] == ["unknown_field"]
    terms = spark.createDataFrame([(1, "s", 1, 60), (2, "s", 1, 60), (3, "s", 1, 48), (4, "s", None, None)], "i int, s string, lo int, hi int")
    assert {r.i: r.hi for r in matching.without_shared_terms(terms, "s", "lo", "hi").collect()} == {1: None, 2: None, 3: 48, 4: None}
    pages = spark.createDataFrame([(1, "the evidence text is here", "nothing")], "k int, a string, b string")
    facts = spark.createDataFrame([(1, "evidence text"), (1, "not there")], "k int, e string")
    assert [r.e for r in audits.lost_coverage(pages, "a", "b", facts, "k", "e").collect()] == ["evidence text"]


def test_quota_sample(spark):
    rows = [(i, "ABCDE"[i % 5], [f"k{i % 7}"], i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, bank string, kinds array<string>, hard boolean")
    got = sampling.quota_sample(df, "i", "bank", "kinds", "hard", size=60).collect()
    assert len(got) == 60 and sorted(r.place for r in got) == list(range(1, 61)) and sum(r.method == "blind" for r in got) == 30
    assert sum(r.hard for r in got) >= 35 and {(r.i, r.place) for r in got} == {(r.i, r.place) for r in sampling.quota_sample(df, "i", "bank", "kinds", "hard", size=60).collect()}
