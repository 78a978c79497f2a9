"""One scan of a text for all that its numbers may mean: marks (words and signs of a kind, with their places) and numbers with
the marks beside them. What a number stands for is then a matter of columns: rules over its neighbours, and over marks near
by distance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import FOLD_FROM, FOLD_TO

# Phrases by kind, folded; "*" stands for any ending. A longer phrase goes before a shorter one.
_FEES, _NONE = ("dosya masrafi", "tahsis ucreti", "ucret", "masraf", "komisyon"), ("alinmaz*", "alinmamakta*", "alinmayacak*", "yok*", "talep edilmez*")
KINDS = {
    "nofee": ("masrafsiz*", *(f"{fee} {none}" for fee in _FEES for none in _NONE), "sifir komisyon*", "sifir masraf*", "sifir ucret*"),
    "zero": ("vade farksiz*", "pesin fiyatina"),
    "share": ("kar paylasim oran*", "paylasim oran*"),
    "context": ("ozel oranli*", "avantajli oran*", "avantajli kar payi*", "kampanyali oran*", "dusuk maliyetli*"),
    "cheap": ("indirimli oran*",),
    "profit": ("kar payi*",),
    "guard": ("teminat*", "pesinat*", "enerji sinif*", "ltv", "kredi oran*"),
    "cash": ("nakit iade*", "para iade*", "cashback"), "back": ("iade*",), "discount": ("indirim*",),
    "gift": ("hediye ceki*", "alisveris ceki*", "hediye*"), "prize": ("nakit odul*", "odul*", "degerinde", "para", "lira"),
    "loyal": ("bankkart lira", "paraf para", "parafpara", "world puan", "worldpuan", "mil", "puan"),
    "count": ("taksit sayisi",), "instalment": ("taksit*",), "month": ("ay", "aya"), "year": ("yil",),
    "least": ("asgari", "en az", "minimum"), "above": ("ve uzeri*", "uzeri*"), "below": ("ve alti*",), "until": ("kadar", "ulasan", "varan"), "amid": ("aras*",),
    "each": ("kisi icin", "toplamda", "toplam"),
    "allocation": ("tahsis ucreti", "tahsis"), "filefee": ("dosya masrafi",), "financing": ("finansman*", "odeme kolayligi*"),
    "rate": ("oranl*", "oran", "orani*"), "tl": ("tl", "turk lirasi"),
}
TIMES = {"bin": 1_000, "milyon": 1_000_000, "milyar": 1_000_000_000}
#: Words that stand between a number and what it belongs to without a meaning of their own.
PASSED = ("tutar*", "ve", "olan")
MARKS_WITHOUT_WORDS = {"%": "pct", "₺": "tl", "/": "slash", "-": "dash", "–": "dash", "—": "dash"}


def _shape(phrase: str) -> str:
    return re.escape(phrase.rstrip("*")).replace(r"\ ", r"\s+") + (r"\w*" if phrase.endswith("*") else r"(?!\w)")


#: How the phrases begin, by three letters at most: other words are passed without a look at each kind.
_HEADS = "|".join(sorted({re.escape(phrase.rstrip("*").split()[0][:3]) for phrases in (*KINDS.values(), PASSED) for phrase in phrases}, reverse=True))
_PHRASES = "|".join(rf"(?P<{kind}>{'|'.join(map(_shape, phrases))})" for kind, phrases in (KINDS | {"passed": PASSED}).items())
_SCAN = re.compile(
    "(?! )(?:" + "|".join(
        [r"(?P<num>\d+(?:[.,]\d+)*)", r"(?P<suffix>['’‘ʼ´`]\s*\w{1,4}(?!\w))", "(?P<pct>%|yuzde(?!\\w))", rf"(?P<times>(?<!\\w)(?:{'|'.join(TIMES)})(?!\\w))", rf"(?<!\w)(?={_HEADS})(?:{_PHRASES})"]
        + [r"(?P<colon>:)", r"(?P<word>[^\W\d_]+)", r"(?P<sign>[₺/\-–—.,;!?()\n])"]
    ) + ")"
)
#: Small letters only, as nothing else is left to fold; a few replacements take a tenth of the time of one table of all.
_FOLD = [(a, b) for a, b in zip(FOLD_FROM, FOLD_TO, strict=True) if a == a.lower() or len(a.lower()) > 1]
#: Neighbours of a number, behind its unit and before it.
BESIDE = 3
#: Of a mark: its kind and place. Of a number: token, factor, unit, place (with the unit), kinds behind it (a) and where they end,
#: kinds before it (b) and where they begin. Arrays beside each other, which Arrow takes much faster than structs.
MARK = {"mark": "string", "mark_s": "int", "mark_e": "int"}
NUMBER = {"token": "string", "times": "bigint", "unit": "string", "s": "int", "e": "int"} | {f"{n}{k}": kind for n, kind in (("a", "string"), ("e", "int"), ("b", "string"), ("s", "int")) for k in range(1, BESIDE + 1)}
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType()}
SCANNED = T.StructType([T.StructField(n, T.ArrayType(_TYPES[kind])) for n, kind in (MARK | NUMBER).items()])


def folded(text: str) -> str:
    """Lower case and plain letters, place by place."""
    low = text.replace("İ", "i").replace("I", "ı").lower()
    low = low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for letter, plain in _FOLD:
        low = low.replace(letter, plain)
    return low


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """Marks (kind, start, end) and numbers (token, factor, unit, start, end with the unit, marks behind and before it)."""
    spots, tokens = [], []
    low = folded(text)
    for m in _SCAN.finditer(low):
        kind = m.lastgroup
        if kind in ("suffix", "passed", "colon"):
            continue
        if kind == "sign":
            kind = MARKS_WITHOUT_WORDS.get(m[0], "stop")
        spots.append((kind, m.start(), m.end()))
        tokens.append(m[0])
    numbers = []
    for i, (kind, s, e) in enumerate(spots):
        if kind != "num":
            continue
        left, right, unit, times = i, i + 1, "", 1
        if right < len(spots) and spots[right][0] == "times":
            times, e, right = TIMES[tokens[right]], spots[right][2], right + 1
        if right < len(spots) and spots[right][0] in ("tl", "pct"):
            unit, e, right = spots[right][0], spots[right][2], right + 1
        elif i and spots[i - 1][0] == "pct":
            unit, s, left = "pct", spots[i - 1][1], i - 1
        behind, ahead = spots[right : right + BESIDE], spots[max(0, left - BESIDE) : left][::-1]
        behind += [("", None, None)] * (BESIDE - len(behind))
        ahead += [("", None, None)] * (BESIDE - len(ahead))
        numbers.append((tokens[i], times, unit, s, e, *[x[0] for x in behind], *[x[2] for x in behind], *[x[0] for x in ahead], *[x[1] for x in ahead]))
    return [x for x in spots if x[0] not in ("num", "times", "word", "stop", "dash", "slash", "pct", "tl")], numbers


@F.pandas_udf(SCANNED)
def scanned(column: pd.Series) -> pd.DataFrame:
    """The arrays of MARK and NUMBER of a text column; null counts as empty."""
    out = {n: [] for n in (*MARK, *NUMBER)}
    for text in column:
        marks, numbers = scan(text or "")
        for names, rows in ((MARK, marks), (NUMBER, numbers)):
            for name, values in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True):
                out[name].append(list(values))
    return pd.DataFrame(out)


def marks_of(scan: str):
    """array<struct<kind, s, e>> of a scanned column."""
    c = lambda n: F.col(f"{scan}.{n}")
    return F.arrays_zip(c("mark").alias("kind"), c("mark_s").alias("s"), c("mark_e").alias("e"))


def numbers_of(scan: str):
    """array<struct> of a scanned column with the fields of NUMBER."""
    return F.arrays_zip(*[F.col(f"{scan}.{n}").alias(n) for n in NUMBER])
