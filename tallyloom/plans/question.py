"""A natural-language question as filters: one string on the driver becomes Column predicates; the data stay on Spark."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import FOLD_FROM, FOLD_TO
from tallyloom.operators import filters, ranking

# Marker words, folded.
COUNT_WORDS = ("kac tane", "kac adet", "kac", "sayisi", "how many")
LOWEST, HIGHEST = ("en dusuk", "en az", "en ucuz", "lowest", "cheapest"), ("en yuksek", "en fazla", "en cok", "highest")
BELOW, ABOVE = ("altinda", "en fazla", "kadar", "under", "below"), ("ustunde", "uzerinde", "en az", "fazla", "over", "above")
STATUS_WORDS = {"aktif": "active", "guncel": "active", "bitmis": "expired", "gecmis": "expired", "yaklasan": "upcoming", "tum durumlar": None}
STOP = frozenset("ve ile icin bir bu da de mi en olan hangi nedir ne kac tane var banka bankasi the a of for which what is are".split())
SCALE = {"bin": 1_000, "milyon": 1_000_000, "milyar": 1_000_000_000}


def folded(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).replace("İ", "i").replace("I", "ı").lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return " ".join(s.split())


@dataclass(frozen=True)
class Plan:
    banks: tuple[str, ...] = ()
    axes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    status: str | None = "active"
    numbers: tuple[tuple[str, str, float], ...] = ()  # field, <= or >=, value
    aggregate: tuple[str, str | None] | None = None  # ("count", None), ("min", field), ("max", field)
    terms: tuple[str, ...] = ()
    intent: str = "search"


def _has(text: str, needle: str) -> bool:
    return re.search(r"(?<![a-z0-9])" + re.escape(needle), text) is not None


def parse_question(raw: str, banks: dict[str, str], axes: dict[str, dict[str, tuple[str, ...]]], fields: dict[str, tuple[str, ...]], bare: dict[str, dict[str, tuple[str, ...]]] | None = None) -> Plan:
    """banks: alias -> code; axes: axis -> value -> keywords; fields: field -> marker words. Longer aliases win; words that
    compare numbers are masked before keywords are looked up; a number needs a field nearby and a direction.
    `bare` has words too general for axes; an axis takes them only where none of its own were found."""
    text = folded(raw)
    found, rest = [], text
    for alias in sorted(banks, key=len, reverse=True):
        if _has(rest, folded(alias)):
            found.append(banks[alias])
            rest = rest.replace(folded(alias), " ")
    numbers, masked = [], rest
    for m in re.finditer(r"(?:%\s*)?(\d[\d.,]*)\s*(bin|milyon|milyar)?\s*(tl|%|ay)?", rest):
        token = m[1].rstrip(".,")
        value = float(token.replace(".", "").replace(",", ".") if "," in token or re.fullmatch(r"\d{1,3}(\.\d{3})+", token) else token) * SCALE.get(m[2] or "", 1)
        near = rest[max(0, m.start() - 28) : m.end() + 28]
        after = rest[m.end() : m.end() + 24]
        before = rest[max(0, m.start() - 14) : m.start()]
        op = "<=" if any(_has(after, w) for w in BELOW[:1] + BELOW[2:]) or any(_has(before, w) for w in ("en fazla", "under", "below", "azami")) else ">=" if any(_has(after, w) for w in ABOVE[:2]) or any(_has(before, w) for w in ("en az", "over", "above", "asgari")) else None
        places = sorted((abs(near.find(w) - (m.start() - max(0, m.start() - 28))), f) for f, words in fields.items() for w in words if _has(near, w))
        if op and places:
            numbers.append((places[0][1], op, value))
        masked = masked.replace(m[0], " ")
    for w in (*BELOW, *ABOVE):
        masked = re.sub(r"(?<![a-z0-9])" + re.escape(w) + r"\w*", " ", masked)
    picked = {a: tuple(v for v, words in values.items() if any(_has(masked, folded(w)) for w in words)) for a, values in axes.items()}
    for axis, values in (bare or {}).items():
        if not picked.get(axis):
            picked[axis] = tuple(v for v, words in values.items() if any(_has(masked, folded(w)) for w in words))
    status = next((s for w, s in STATUS_WORDS.items() if _has(text, w)), "active")
    aggregate = None
    if any(_has(text, w) for w in COUNT_WORDS):
        aggregate = ("count", None)
    elif not numbers:
        kind = "min" if any(_has(text, w) for w in LOWEST) else "max" if any(_has(text, w) for w in HIGHEST) else None
        named = [f for f, words in fields.items() if any(_has(text, w) for w in words)]
        if kind and named:
            aggregate = (kind, named[0])
    terms = tuple(dict.fromkeys(w for w in re.findall(r"[a-z0-9]+", masked) if len(w) >= 3 and w not in STOP and not w.isdigit()))
    intent = "aggregate" if aggregate else "compare" if len(found) > 1 or "karsilastir" in text else "search"
    return Plan(tuple(found), {a: v for a, v in picked.items() if v}, status, tuple(numbers), aggregate, terms, intent)


def rules_of(plan: Plan, bank: str = "bank_code", status: str = "status") -> list[tuple[str, Column]]:
    """Gate rules in order: bank, status, axes, numbers. Axis columns are arrays; a missing measure is unknown."""
    rules = []
    if plan.banks:
        rules.append(("bank", F.col(bank).isin(*plan.banks)))
    if plan.status:
        rules.append(("status", F.col(status) == plan.status))
    for axis, values in plan.axes.items():
        rules.append((axis, F.coalesce(F.arrays_overlap(F.col(axis), F.array(*map(F.lit, values))), F.lit(False))))
    for name, op, value in plan.numbers:
        rules.append((name, F.col(name) <= value if op == "<=" else F.col(name) >= value))
    return rules


def answer(plan: Plan, corpus: DataFrame, ident: str = "campaign_id", bank: str = "bank_code") -> DataFrame:
    """Aggregates are over all rows that pass, never over a top-k: counts per bank, or the extremum with its coverage."""
    kept = filters.gate(corpus, rules_of(plan)).filter("reason is null").drop("reason")
    if plan.aggregate == ("count", None):
        return kept.groupBy(bank).agg(F.count(F.lit(1)).alias("n"))
    if plan.aggregate:
        kind, name = plan.aggregate
        return ranking.extremum(kept.withColumn("_all", F.lit(0)), ["_all"], name, ident, kind).drop("_all")
    return kept


def conjunction(rules: list[tuple[str, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [r for _, r in rules], F.lit(True))
