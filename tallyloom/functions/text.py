"""Text as Column expressions: Turkish-aware folding, clean-up, tokens, evidence. All but NFKC are built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that are dropped, that become a space, that become a hyphen.
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x180E)))
SPACES = "".join(map(chr, (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
DASHES = "".join(map(chr, (*range(0x2010, 0x2016), 0x2212, 0x2043, 0xFE58, 0xFE63, 0xFF0D)))
FOLD_FROM, FOLD_TO = "ıİşŞğĞüÜöÖçÇâÂîÎûÛ", "iIsSgGuUoOcCaAiIuU"
MONTHS_TR = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse_whitespace(c: Column) -> Column:
    """One space for runs inside a line, no space at line ends, at most one empty line."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r"(?m)^ | $", "")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n\t\f\x0b"))


def once(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept(value: Column, holds) -> Column:
    """A row with the value where it holds, else none: a generator that makes the value once, where a filter on a column would
    make it again for itself."""
    return F.explode(F.filter(F.array(value), holds))


#: A text without signs beyond Latin letters has nothing to translate, and one without such white space nothing to collapse: one look at it instead
#: of three tables and five shapes. U+0085, U+2028 and U+2029 end lines too.
_ODD, _LOOSE = "[^\\x00-\\x9F\\u00C0-\\u017F]", "[\\r\\n\\t\\f\\x0B\\u0085\\u2028\\u2029]|  |^ | $"


def _plain_signs(c: Column) -> Column:
    return F.translate(F.translate(c, SPACES, " " * len(SPACES)), DASHES, "-" * len(DASHES))


def normalize_text(c: Column, nfkc: bool = True) -> Column:
    """Zero-width characters go, NFKC, Unicode spaces and dashes become plain, white space collapses. Only texts beyond
    Latin letters go through Python for NFKC."""
    if nfkc:
        c = F.translate(c, ZERO_WIDTH, "")
        c = F.when(c.rlike(_ODD), _nfkc(F.when(c.rlike(_ODD), c))).otherwise(c)
        return collapse_whitespace(_plain_signs(c))
    usual = once(c, lambda t: F.when(t.rlike(_ODD), _plain_signs(F.translate(t, ZERO_WIDTH, ""))).otherwise(t))
    return once(usual, lambda t: F.when(t.rlike(_LOOSE), collapse_whitespace(t)).otherwise(t))


def lower_tr(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def fold(c: Column, nfkc: bool = False) -> Column:
    """For comparison only: normalized, Turkish lower case, ASCII."""
    return ascii_fold(lower_tr(normalize_text(c, nfkc)))


#: Folding in one table: letters to plain small ones, then the signs that vanish.
_TO_PLAIN = ("İI" + FOLD_FROM + ZERO_WIDTH, "ii" + FOLD_TO.lower())


def tokens(c: Column) -> Column:
    """Runs of letters a to z and digits of the folded text. Blanks and dashes need no unifying where only runs are taken."""
    return F.regexp_extract_all(F.lower(F.translate(c, *_TO_PLAIN)), F.lit("[a-z0-9]+"), 0)


def starts_word(haystack: Column, needle: str) -> Column:
    """Whether a word begins with the needle; suffixes may follow. A trailing space asks for the whole word."""
    right = r"(?![a-z0-9])" if needle.endswith(" ") else ""
    quoted = "".join("\\" + x if not x.isalnum() else x for x in needle.rstrip(" "))
    return haystack.rlike(r"(?<![a-z0-9])" + quoted + right)


def strip_tags(c: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(c, "<[^>]+>", " "))


def without_lines(c: Column, pattern: str) -> Column:
    """The lines that don't match the pattern."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def slugify(c: Column, most: int = 80) -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, most), "-+$", "")


def snippet(text: Column, needle: Column, before: int = 40, after: int = 60, most: int = 160) -> Column:
    """The surroundings of the first occurrence, null if there is none."""
    at = F.instr(text, needle)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(F.trim(text.substr(start, at + F.length(needle) + after - start)), 1, most))


def number_tr(c: Column, digits: int = 2) -> Column:
    """12345.5 as 12.345,50."""
    return F.translate(F.format_number(c, digits), ".,", ",.")


def number_tr_short(c: Column, digits: int = 4) -> Column:
    """Without closing zeros: 2,05 and 5.000."""
    return F.regexp_replace(number_tr(c, digits), ",?0+$", "")


def date_tr(c: Column) -> Column:
    """31 Aralık 2026."""
    return F.concat_ws(" ", F.dayofmonth(c).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS_TR)), F.month(c)), F.year(c).cast("string"))


def capital_tr(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return F.concat(F.when(first == "i", "İ").when(first == "ı", "I").otherwise(F.upper(first)), F.substring(c, 2, 1 << 30))


def first_paragraph(c: Column, least: int = 40, most: int = 500) -> Column:
    return F.substring(F.get(F.filter(F.split(c, "\n"), lambda line: F.length(F.trim(line)) >= least), F.lit(0)), 1, most)


def match_text(c: Column) -> Column:
    """For evidence search: quotes unified, one kind of space, lower case."""
    c = F.translate(F.translate(c, ZERO_WIDTH, ""), "“”„«»‘’‚`´", "\"\"\"\"\"'''''")
    c = F.translate(F.translate(c, SPACES, " " * len(SPACES)), DASHES, "-" * len(DASHES))
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def _runs(c: Column, n: int) -> Column:
    """Every n words in a row."""
    words = F.split(F.trim(c), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.slice(words, i, F.lit(n)))


def _begins(word: Column, *starts: str) -> Column:
    low = lower_tr(word)
    return reduce(lambda a, b: a | b, [F.startswith(low, F.lit(s)) for s in starts])


def sms_entry(c: Column) -> tuple[Column, Column]:
    """Keyword and number of "WORD yazıp 1234'e gönderin": four words in a row, the first in capitals, the third led by four
    digits. Null where a text has none."""
    word = lambda w: F.regexp_replace(F.get(w, F.lit(0)), r"^[^\p{L}]+|[^\p{L}]+$", "")
    number = lambda w: F.regexp_extract(F.get(w, F.lit(2)), r"^(\d{4})(?!\d)", 1)
    fits = lambda w: word(w).rlike(r"^\p{Lu}{3,20}$") & _begins(F.get(w, F.lit(1)), "yaz") & (number(w) != "") & _begins(F.get(w, F.lit(3)), "gönder", "gonder")
    hit = F.get(F.filter(_runs(c, 4), fits), F.lit(0))
    return word(hit), number(hit)


def coupon_code(c: Column, verbs: tuple[str, ...] = ("kullan", "gir", "yaz")) -> Column:
    """The code of "abcd20 kodunu kullanın": a letter, then 3 to 19 letters and digits, before a form of the word for code
    and a verb."""
    word = lambda w: F.regexp_replace(F.get(w, F.lit(0)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    fits = lambda w: word(w).rlike("^[A-Za-z][A-Za-z0-9]{3,19}$") & _begins(F.get(w, F.lit(1)), "kod") & _begins(F.get(w, F.lit(2)), *verbs)
    return word(F.get(F.filter(_runs(c, 3), fits), F.lit(0)))
