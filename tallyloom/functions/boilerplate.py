"""Foreign blocks of a page's text: navigation before the title, sections on other campaigns, buttons. All by
higher-order functions over the array of a text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import ascii_fold, lower_tr

# Whole lines, folded and without punctuation at their ends.
RELATED = (
    "ilgili kampanyalar", "benzer kampanyalar", "ilginizi cekebilir", "ilginizi cekebilecek kampanyalar", "ilginizi cekebilecek diger kampanyalar", "bunlar da ilginizi cekebilir", "bunlar da ilgini cekebilir", "one cikan kampanyalar",
    "son kampanyalar", "diger kampanyalarimiz", "diger tum kampanyalar", "size ozel diger kampanyalar",
)
LATE_ONLY = ("tum kampanyalar", "diger kampanyalar")
BUTTONS = (
    "paylas", "kampanyayi paylas", "sayfayi yazdir", "facebook'da paylas", "twitter'da paylas", "linkedin'de paylas", "whatsapp'ta paylas", "sayfa goruntusu", "sayfa icerigi", "hemen indir", "detaylar", "detayli bilgi", "kampanya detayi", "incele", "tumunu goster", "devamini oku",
)
DATE_HINT = r"\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{2,4}|\d{1,2}\s+(ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)"
LEAST_LEFT, NAVIGATION_CHARS, LATE = 200, 90, 0.5


def line_key(line: Column) -> Column:
    return F.regexp_replace(ascii_fold(lower_tr(F.trim(line))), r"^[ .:!?\-–—…]+|[ .:!?\-–—…]+$", "")


def _joined(lines: Column) -> Column:
    return F.trim(F.array_join(lines, "\n"), F.lit(" \n\t\r"))


def _places(lines: str, holds) -> Column:
    """The 1-based places of the lines for which holds(line, place) is true."""
    flagged = F.transform(F.col(lines), lambda line, i: F.when(holds(line, i + 1), i + 1))
    return F.array_compact(flagged)


def _chars_from(lengths: str, at: Column) -> Column:
    """Characters of the lines from place `at` on, line ends included."""
    return F.aggregate(F.slice(F.col(lengths), at, F.size(lengths)), F.lit(0), lambda s, x: s + x) - 1


def own_text(df: DataFrame, text: str, title: str, out: str, late_markers: tuple[str, ...] = ()) -> DataFrame:
    """df with the text's own part in `out`. First navigation goes: the text begins at the last line that is the title and has
    nothing but navigation before it (short lines that end no sentence); lines with a date stay. Then the tail goes: all
    from the first heading of other campaigns on, where ambiguous headings and a site's own `late_markers` count in the
    second half only. Neither cut is made where less than LEAST_LEFT characters would be left. Then buttons go. Null
    stays null. In steps, so that a text is split into lines once."""
    d = df.withColumns({"_lines": F.split(F.col(text), "\n"), "_title": line_key(F.col(title))})
    d = d.withColumns({"_keys": F.transform("_lines", line_key), "_sizes": F.transform("_lines", lambda l: F.length(l) + 1)})
    stops = _places("_lines", lambda l, i: (F.length(F.trim(l)) > NAVIGATION_CHARS) | F.trim(l).rlike(r"[.;:]$"))
    d = d.withColumn("_last", F.coalesce(F.get(stops, F.lit(0)), F.size("_lines")))
    d = d.withColumn("_anchor", F.array_max(_places("_keys", lambda k, i: (i > 1) & (i <= F.col("_last")) & (k == F.col("_title")) & (k != "") & (_chars_from("_sizes", i) >= LEAST_LEFT))))
    dated = F.filter(F.slice("_lines", 1, F.col("_anchor") - 1), lambda l: ascii_fold(lower_tr(l)).rlike(DATE_HINT))
    begun = F.when(F.col("_anchor").isNotNull(), F.concat(dated, F.slice("_lines", F.col("_anchor"), F.size("_lines")))).otherwise(F.col("_lines"))
    d = d.withColumn("_lines", begun)
    d = d.withColumns({"_keys": F.transform("_lines", line_key), "_sizes": F.transform("_lines", lambda l: F.length(l) + 1)})
    late = (*LATE_ONLY, *late_markers)
    d = d.withColumn("_mark", F.array_min(_places("_keys", lambda k, i: k.isin(*RELATED) | (k.isin(*late) & (_chars_from("_sizes", i) <= _chars_from("_sizes", F.lit(1)) * (1 - LATE))))))
    d = d.withColumn("_kept", F.slice("_lines", 1, F.greatest(F.coalesce("_mark", F.lit(1)) - 1, F.lit(0))))
    cut = F.col("_mark").isNotNull() & (F.length(_joined(F.col("_kept"))) >= LEAST_LEFT)
    d = d.withColumn("_lines", F.when(cut, F.col("_kept")).otherwise(F.col("_lines")))
    d = d.withColumn(out, _joined(F.filter("_lines", lambda l: ~line_key(l).isin(*BUTTONS))))
    return d.drop("_lines", "_title", "_keys", "_sizes", "_last", "_anchor", "_mark", "_kept")
