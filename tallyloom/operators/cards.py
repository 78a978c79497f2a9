"""Entity cards of five kinds: structured fields as sentences. What is not known is left out, but for what a reader must be told:
that a campaign's dates are not in its source, that a bank has no campaigns, that a figure is not binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import capital_tr, date_tr, number_tr_short

# Confidence that a fact or label needs, the notice, phrases of fields and names of axes in order.
LEAST = 0.60
NOTICE = "(bankanın hesaplama aracından alınan tahmini değer, bağlayıcı değildir)"
PHRASES = {
    "profit_rate_pct": "kâr payı oranı %{}", "profit_share_rate_pct": "katılma hesabı kâr payı oranı %{}", "installment_count": "{} taksit", "term_months_min": "en az {} ay vade", "term_months_max": "{} aya kadar vade", "min_spend_try": "asgari {} TL harcama", "max_spend_try": "azami {} TL harcama",
    "reward_amount_try": "{} TL ödül", "cashback_pct": "%{} nakit iade", "discount_pct": "%{} indirim", "financing_amount_max": "{} TL'ye kadar finansman", "allocation_fee_pct": "tahsis ücreti %{}", "file_fee_try": "dosya masrafı {} TL",
}
AXES = {"sector": "Sektör", "product_type": "Ürün", "audience": "Hedef kitle", "benefit": "Fayda"}
UNKNOWN_BANK, UNDATED, NO_CAMPAIGNS = "Bilinmeyen banka", "Geçerlilik tarihi kaynakta belirtilmemiş.", "Yayımlanmış kampanya sayfası bulunamadı."


def _lines(*parts: Column) -> Column:
    """The parts that are there, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def _sentence(*parts: Column) -> Column:
    """The parts that are there as one sentence; null without any."""
    said = F.concat_ws(", ", *parts)
    return F.when(said != "", F.concat(capital_tr(said), F.lit(".")))


def _said(phrase: str, value: Column) -> Column:
    head, tail = phrase.split("{}")
    return F.concat(F.lit(head), number_tr_short(value), F.lit(tail))


def _bank(bank: Column) -> Column:
    return F.coalesce(bank, F.lit(UNKNOWN_BANK))


def validity(start: Column, end: Column) -> Column:
    """When a campaign is valid, in words."""
    both = F.concat(F.lit("Geçerlilik: "), date_tr(start), F.lit(" – "), date_tr(end), F.lit("."))
    return F.when(start.isNotNull() & end.isNotNull(), both).when(end.isNotNull(), F.concat(F.lit("Geçerlilik: "), date_tr(end), F.lit(" tarihine kadar."))).when(start.isNotNull(), F.concat(F.lit("Başlangıç: "), date_tr(start), F.lit("."))).otherwise(UNDATED)


def campaign_cards(campaigns: DataFrame, facts: DataFrame, labels: DataFrame, ident: str, bank: str, title: str, description: str, start: str, end: str, summary: str | None = None) -> DataFrame:
    """ident, card. facts (ident, field, value, confidence, valid): of each field the surest valid one; labels (ident, axis, value,
    confidence): the three surest of each axis; both with LEAST confidence at least. Ties go to the smaller value."""
    sure = F.struct(F.col("confidence"), F.col("value"))
    best = facts.filter(F.coalesce(F.col("valid"), F.lit(False)) & (F.col("confidence") >= LEAST) & F.col("value").isNotNull()).groupBy(ident, "field").agg(F.min_by("value", F.struct(-F.col("confidence"), F.col("value"))).alias("value"))
    wide = best.groupBy(ident).pivot("field", list(PHRASES)).agg(F.first("value"))
    three = F.slice(F.array_sort(F.collect_list(sure), lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0)), 1, 3)
    named = labels.filter(F.col("confidence") >= LEAST).groupBy(ident, "axis").agg(F.array_join(F.transform(three, lambda x: F.replace(x["value"], F.lit("_"), F.lit(" "))), ", ").alias("values"))
    axes = named.groupBy(ident).pivot("axis", list(AXES)).agg(F.first("values"))
    both = campaigns.join(wide, ident, "left").join(axes, ident, "left")
    told = F.concat_ws(" ", *[F.concat(F.lit(f"{name}: "), F.col(axis), F.lit(".")) for axis, name in AXES.items()])
    measures = _sentence(*[_said(phrase, F.col(field).try_cast("decimal(24,6)")) for field, phrase in PHRASES.items()])
    head = F.concat(_bank(F.col(bank)), F.lit(" — "), F.col(title))
    return both.select(ident, _lines(head, F.col(description), told, measures, validity(F.col(start), F.col(end)), F.col(summary) if summary else F.lit(None).cast("string")).alias("card"))


def bank_cards(banks: DataFrame, campaigns: DataFrame, ident: str, name: str, website: str, notes: str) -> DataFrame:
    counts = campaigns.groupBy(ident).agg(F.count(F.lit(1)).alias("_n"))
    there = F.concat(F.lit("Veri setinde "), F.col("_n").cast("string"), F.lit(" kampanyası bulunuyor."))
    return banks.join(counts, ident, "left").select(ident, _lines(F.concat(F.col(name), F.lit(" — katılım bankası")), F.concat(F.lit("Adres: "), F.coalesce(website, F.lit(""))), F.coalesce(there, F.lit(NO_CAMPAIGNS)), F.col(notes)).alias("card"))


def glossary_card(term: Column, definition: Column, conventional: Column, forbidden: Column) -> Column:
    no = F.concat(F.lit("Konvansiyonel bankacılıktaki karşılığı: "), conventional, F.lit(". Katılım bankacılığında bu terim kullanılmaz."))
    return _lines(F.concat(term, F.lit(" — katılım bankacılığı terimi")), definition, F.when(forbidden, no).otherwise(F.concat(F.lit("Konvansiyonel karşılığı: "), conventional, F.lit("."))))


def product_card(bank: Column, name: Column, description: Column, low: Column, high: Column, months: Column, binding: Column) -> Column:
    amounts = F.concat(number_tr_short(low), F.lit(" - "), number_tr_short(high), F.lit(" TL finansman"))
    return _lines(F.concat(_bank(bank), F.lit(" — "), name), description, _sentence(amounts, F.concat(months.cast("string"), F.lit(" aya kadar vade"))), F.when(~binding, NOTICE))


def rate_card(bank: Column, product: Column, months: Column, rate: Column, fee: Column, variant: Column, binding: Column) -> Column:
    said = _sentence(F.concat(months.cast("string"), F.lit(" ay vade")), _said("kâr payı oranı %{}", rate), _said("tahsis ücreti %{}", fee))
    return _lines(F.concat(_bank(bank), F.lit(" — "), F.coalesce(product, F.lit("Bilinmeyen ürün")), F.lit(" kâr payı oranı")), said, F.concat(F.lit("Varyant: "), variant, F.lit(".")), F.when(~binding, NOTICE))
