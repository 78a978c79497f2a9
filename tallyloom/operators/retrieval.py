"""BM25 over exploded tokens, exact vector search, reciprocal rank fusion behind hard filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import tokens
from tallyloom.operators.campaigns import search_order
from tallyloom.operators.labels import forbidden_terms, unverified_numbers

K1, B, RRF = 1.5, 0.75, 60
PREFIX_FROM, PREFIX_WEIGHT = 4, 0.6


def bm25(docs: DataFrame, ident: str, text: str, terms: list[str]) -> DataFrame:
    """ident, score, matched of the documents with any of the terms. idf is ln(1 + (N - df + .5) / (df + .5)). A term that
    no document has exactly is taken as a prefix from four letters on, every expansion with its own idf and the weight
    0.6. Only tokens that can match leave the scan; document frequencies are counts of pre-aggregated rows."""
    sized = docs.select(F.col(ident), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_tokens")).withColumn("_len", F.size("_tokens"))
    totals = sized.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    stems = [t for t in terms if len(t) >= PREFIX_FROM]
    may = lambda t: t.isin(*terms) | _any_prefix(t, stems)
    hits = sized.select(ident, "_len", F.explode(F.filter("_tokens", may)).alias("term")).groupBy(ident, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    exact = {r["term"] for r in df.filter(F.col("term").isin(*terms)).select("term").collect()}  # no more than the query's terms
    weight = F.lit(0.0)
    for t in terms:
        weight = weight + (F.when(F.col("term") == t, 1.0) if t in exact else F.when(F.col("term").startswith(t), PREFIX_WEIGHT) if t in stems else F.when(F.lit(False), 0.0)).otherwise(0.0)
    weighed = df.withColumn("weight", weight).filter("weight > 0")
    scored = hits.join(weighed, "term").join(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return scored.groupBy(ident).agg(F.sum(part).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("matched"))


def _any_prefix(token: Column, stems: list[str]) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | token.startswith(s)
    return out


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    norms = size(a) * size(b)
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


def vector_scores(vectors: DataFrame, embedding: str, query: list[float]) -> DataFrame:
    """vectors with score, the cosine with the query vector, exact over all rows."""
    return vectors.withColumn("score", cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])))


def top(df: DataFrame, score: str, ident: str, limit: int) -> DataFrame:
    """A top-k: each task keeps `limit` rows."""
    return df.orderBy(F.col(score).desc(), F.col(ident)).limit(limit)


def ranked(df: DataFrame, score: str, ident: str, limit: int, name: str) -> DataFrame:
    """ident and rank (from 1) of the best `limit` rows; ranks are numbered over those alone."""
    best = top(df, score, ident, limit).withColumn("_all", F.lit(0))
    return best.select(ident, F.row_number().over(Window.partitionBy("_all").orderBy(F.col(score).desc(), F.col(ident))).alias(name))


def fused(channels: list[tuple[DataFrame, str]], ident: str) -> DataFrame:
    """ident and rrf: the sum of 1 / (60 + rank) over the channels that have the row."""
    out = None
    for df, rank in channels:
        part = df.select(ident, (1.0 / (RRF + F.col(rank))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(ident).agg(F.sum("part").alias("rrf"))


def hybrid(kept: DataFrame, channels: list[tuple[DataFrame, str]], ident: str, status: str, filtered: bool, limit: int) -> DataFrame:
    """The best `limit` of the rows that passed the filters, with score (fused ranks). With filters every such row is a
    candidate, at score 0 where no channel ranks it, so that a narrow filter never empties the list; without, only what a
    channel ranks is. Equal scores go by status, then by id."""
    scored = kept.join(fused(channels, ident), ident, "left" if filtered else "inner")
    return scored.withColumn("score", F.coalesce("rrf", F.lit(0.0))).drop("rrf").orderBy(*search_order("score", status, ident)).limit(limit)


#: How an answer came about: fixed values.
TEMPLATE, REFUSAL = "template", "refusal"


def grounded_answers(hits: DataFrame, question: str, rank: str, title: str, card: str, most: int = 5, forbidden: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> DataFrame:
    """question, answer, source, citations, grounded, terms of ranked hits (rank from 1; a null card is no hit): a
    line "[n] title: card" for each of the first `most` cards, and what it cites. A question
    without cards is refused with a null answer. Every number of the answer must stand in the cited cards
    (labels.unverified_numbers). terms are the forbidden words of the answer outside allowed phrases; none for a refusal."""
    used = F.when(F.col(card).isNotNull() & (F.col(rank) <= most), F.struct(F.col(rank).alias("n"), F.coalesce(title, F.lit("")).alias("title"), F.col(card).alias("card")))
    context = hits.groupBy(question).agg(F.array_sort(F.collect_list(used)).alias("_cards"))
    line = lambda c: F.concat(F.lit("["), c["n"].cast("string"), F.lit("] "), c["title"], F.lit(": "), c["card"])
    answer = F.when(F.size("_cards") > 0, F.array_join(F.transform("_cards", line), "\n"))
    cited = F.array_join(F.transform("_cards", lambda c: F.concat_ws(" ", c["title"], c["card"])), " ")
    empty = F.array().cast("array<string>")
    terms = F.coalesce(forbidden_terms(answer, forbidden, allowed), empty) if forbidden else empty
    return context.select(
        question, answer.alias("answer"), F.when(F.size("_cards") > 0, TEMPLATE).otherwise(REFUSAL).alias("source"), F.col("_cards.n").alias("citations"),
        (F.size(F.coalesce(unverified_numbers(answer, cited), empty)) == 0).alias("grounded"), terms.alias("terms"),
    )
