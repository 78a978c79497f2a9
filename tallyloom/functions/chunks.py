"""Texts in chunks of bounded length, along paragraphs and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 6000


def _hard(piece: Column, limit: int) -> Column:
    """Cuts of fixed length; nothing is dropped."""
    n = F.greatest(F.ceil(F.length(piece) / limit).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(piece, i * limit + 1, F.lit(limit)))


def _packed(pieces: Column, glue: str, limit: int) -> Column:
    """Pieces joined from left to right as long as they fit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit(glue), piece))
        fits = F.length(joined) <= limit
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.when(fits, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(closed.alias("done"), piece.alias("open")))

    return F.aggregate(pieces, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunks(text: Column, limit: int = LIMIT) -> Column:
    """array<string>: a short text whole; a long one by paragraphs, too long paragraphs by sentences, too long sentences by
    cuts, packed greedily up to `limit` code points. Empty for a null or blank text."""
    whole = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    paragraphs = F.filter(F.transform(F.split(whole, r"\n\s*\n"), lambda p: F.trim(p, F.lit(" \n\t\r"))), lambda p: p != "")

    def parts(p: Column) -> Column:
        sentences = F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: _hard(s, limit)))
        return F.when(F.length(p) <= limit, F.array(p)).otherwise(_packed(sentences, " ", limit))

    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(_packed(F.flatten(F.transform(paragraphs, parts)), "\n\n", limit))
