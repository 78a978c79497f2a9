"""Rule facts of single texts."""

import re

import pytest

from tallyloom.functions import annotate
from tallyloom.operators import extraction

CASES = {
    "%2,05 kâr payı oranı ile 120 aya kadar": {"profit_rate_pct": 2.05, "term_months_max": 120},
    "kâr payı oranı: % 1.89": {"profit_rate_pct": 1.89},
    "2.05 % oranlı finansman": {"profit_rate_pct": 2.05},
    "Özel oranlı finansman imkânı %1,89 ile sunulur.": {"profit_rate_pct": 1.89},
    "%20 indirim ve %10 nakit iade": {"discount_pct": 20, "cashback_pct": 10, "reward_type": "nakit_iade"},
    "%80 oranlı kredi oranı": {},
    "%55 oranlı ödeme": {},
    "%55 kâr payı": {"profit_rate_pct": 55},
    "%7,5 oranlı ya da kâr payı %12,5 olan": {"profit_rate_pct": 12.5},
    "%7,5 oranlı ya da %12,5 oranlı": {},
    "Vade farksız 6 taksit": {"profit_rate_pct": 0, "installment_count": 6, "reward_type": "taksit"},
    "4 aya varan taksit": {"installment_count": 4, "reward_type": "taksit"},
    "taksit sayısı: 9": {"installment_count": 9, "reward_type": "taksit"},
    "3-36 ay vade": {"term_months_min": 3, "term_months_max": 36},
    "10 yıl vade": {"term_months_min": 120, "term_months_max": 120},
    "5.000 TL ve üzeri harcamalarda 250 TL nakit iade": {"min_spend_try": 5000, "reward_amount_try": 250, "reward_type": "nakit_iade"},
    "en az 1.000 TL, asgari 5 bin TL": {"min_spend_try": 1000},
    "2.000 TL - 300.000 TL arası harcama": {"min_spend_try": 2000, "max_spend_try": 300000},
    "2.000 TL- 300.000 TL arasındaki finansman": {"min_spend_try": 2000, "max_spend_try": 300000, "financing_amount_min": 2000, "financing_amount_max": 300000},
    "100.000 TL’ye kadar finansman": {"max_spend_try": 100000, "financing_amount_max": 100000},
    "75.000 TL'ye ulaşan, 150.000 TL'ye ulaşan": {"max_spend_try": 150000},
    "9.999 TL'ye kadar 5.000 TL; 20.000 TL ve üzeri": {"min_spend_try": 20000},
    "6.000 TL ve üzeri; 100 TL - 1.000 TL arası": {"min_spend_try": 6000},
    "75 TL ve altı": {"max_spend_try": 75},
    "750 TL Bankkart Lira": {"reward_amount_try": 750, "loyalty_points": 750, "reward_type": "puan"},
    "10.000 Mil'e varan": {"loyalty_points": 10000, "reward_type": "puan"},
    "500 Türk Lirası değerinde": {"reward_amount_try": 500},
    "toplamda 5 kişi için en çok 10.000 TL nakit ödül, her bir davet edilen müşteri için 2.000 TL nakit ödül": {"reward_amount_try": 2000},
    "%18’i kadar nakit iade": {"cashback_pct": 18, "reward_type": "nakit_iade"},
    "98/2 kâr paylaşım oranı": {"profit_share_rate_pct": 2},
    "paylaşım oranı: 90/10": {"profit_share_rate_pct": 10},
    "tahsis ücreti %0,5, dosya masrafı 250 TL": {"allocation_fee_pct": 0.5, "file_fee_try": 250},
    "Dosya masrafı alınmamaktadır": {"has_no_fee": "true", "file_fee_try": 0, "reward_type": "ucret_muafiyeti"},
    "Masrafsız": {"has_no_fee": "true", "file_fee_try": 0, "reward_type": "ucret_muafiyeti"},
    "Ücret alınmaktadır": {},
    "1.000 TL hediye çeki": {"reward_amount_try": 1000, "reward_type": "hediye"},
    "1 Mart 2026 - 31 Mart 2026": {"start_date": "2026-03-01", "end_date": "2026-03-31"},
    "İSTANBUL %2 KÂR PAYI": {"profit_rate_pct": 2},
    "": {}, "   ": {}, "hiçbir şey 5": {},
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([*enumerate(CASES), (1000, None), (1001, "sayı " * 20_000 + "%3 kâr payı")], "i int, t string")
    out = {}
    for r in extraction.rule_facts(docs, "i", "t").collect():
        out.setdefault(r.i, []).append(r)
    return out


def test_fields_of_texts(found):
    wrong = {}
    for i, (text, want) in enumerate(CASES.items()):
        got = {}
        for r in found.get(i, []):
            value = r.value if r.unit in ("enum", "bool", "date") else float(r.value)
            assert got.setdefault(r.field, value) == value, (text, r)
        if got != want:
            wrong[text] = got
    assert not wrong


def test_long_and_missing_texts(found):
    assert 1000 not in found and [(r.field, float(r.value), r.at) for r in found[1001]] == [("profit_rate_pct", 3.0, 100_001)]


def test_evidence_is_the_text_at_its_place(found):
    for i, text in enumerate(CASES):
        for r in found.get(i, []):
            if r.unit != "date":
                assert text[r.at - 1 : r.at - 1 + len(r.evidence)] == r.evidence and r.evidence
    rate = next(r for r in found[0] if r.field == "profit_rate_pct")
    assert rate.evidence == "%2,05 kâr payı" and rate.confidence == 0.9


def test_folding_keeps_places():
    for text in ("İSTANBUL ıIİi ẞß ŉ ﬁ", "K̇ ǅ"):
        assert len(annotate.folded(text)) == len(text)


def test_words_that_begin_no_phrase_are_passed(spark):
    """Phrases are found where they begin, behind digits and signs too; the first date is cut out once."""
    every = [(kind, phrase.rstrip("*")) for kind, phrases in annotate.KINDS.items() for phrase in phrases]
    assert all(re.match(rf"(?:{annotate._HEADS})", phrase) for _, phrase in every)
    # As looked for one by one: the first kind with a phrase at the place.
    for _, phrase in every:
        first = next(kind for kind, phrases in annotate.KINDS.items() if re.match("|".join(map(annotate._shape, phrases)), phrase + " x"))
        assert [m.lastgroup for m in annotate._SCAN.finditer(f"{phrase} x")][0] == first, phrase
    assert [x[0] for x in annotate.scan("5tl: %3 İNDİRİM")[0]] == ["discount"] and annotate.folded("İIŞĞ ÂÎÛ") == "iisg aiu"
    docs = spark.createDataFrame([(1, "Son gün 12 Mart 2026."), (2, "12 Mart 2026"), (3, None)], "id int, t string")
    found = extraction.rule_facts(docs, "id", "t")
    assert found._jdf.queryExecution().optimizedPlan().toString().count(r"\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4}") == 1
    assert [(r.id, r.field, r.value, r.raw, r.evidence, r["at"]) for r in found.collect()] == [(1, "end_date", "2026-03-12", "12 mart 2026", "son gün 12 mart 2026.", 9)]


def test_equal_texts_are_read_once(spark):
    """Rows meet the facts of their text; the scan has each text once, however many rows share it."""
    docs = spark.createDataFrame([(1, "%2 kâr payı, 12 ay vade. %3 indirim"), (2, "%2 kâr payı, 12 ay vade. %3 indirim"), (3, "6 taksit ve 9 taksit"), (4, "hiç"), (5, None), (6, "%3 indirim")], "i int, t string")
    fields = ["profit_rate_pct", "term_months_min", "installment_count"]
    found = extraction.text_metrics(docs, "t", fields)
    number = lambda v: None if v is None else float(v)
    assert {(r.i, *(number(r[f]) for f in fields)) for r in found.collect()} == {(1, 2, 12, None), (2, 2, 12, None), (3, None, None, 6)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython[\s\S]*Aggregate \[[^,\]]+\], ", plan)


def test_sentences_of_rows_are_read_once(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["rule_facts_roundtrip"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython[\s\S]*Aggregate \[[^,\]]+\], ", plan)  # of the sentence alone
