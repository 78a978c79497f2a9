"""A written index for BM25: postings by term in blocks of documents with the maxima of each block.

A block holds documents of about equal length. For every term and block there is a row: the documents that hold the term with
how often, the highest frequency and the shortest length among them. Rows lie in folders by a hash of the term and in order of
terms, so a query reads the rows of its terms and nothing of the texts. From the maxima alone comes a bound for every
document of a block; the best blocks are scored first, and blocks whose bound is under the score of the k-th best document
found there are never opened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import tokens
from tallyloom.operators.retrieval import K1, PREFIX_FROM, PREFIX_WEIGHT, B
from tallyloom.sources.staged import staged

#: Documents of a block and folders of the postings; blocks scored first for each that k documents would fill.
BLOCK, FOLDERS, FIRST = 1024, 32, 4


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # folder, term, block, docs array<struct<doc, tf, len>>, most, least
    terms: DataFrame  # term, df
    n: int
    average: float


def build(docs: DataFrame, ident: str, text: str) -> Index:
    """An index over all documents with a non-null id; equal ids count as one document each time they occur. Texts are cut into
    tokens once, their lengths come from the written tokens, and the postings take one shuffle."""
    cut = staged(docs.select(F.col(ident).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("len", F.size("tokens")), "tokens")
    kind = F.floor(F.log2(F.col("len") + 1.0) * 4).cast("int")
    classes = cut.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("s")).collect()  # four an octave of lengths
    n, total = sum(r["n"] for r in classes), sum(r["s"] for r in classes)
    parts = F.create_map(*[F.lit(x) for r in classes for x in (r["k"], -(-r["n"] // BLOCK))]) if classes else F.create_map(F.lit(0), F.lit(1))
    block = F.shiftleft(kind.cast("long"), 40) + F.pmod(F.xxhash64("doc"), parts[kind])
    held = cut.select("doc", "len", block.alias("block"), F.explode("tokens").alias("term")).repartition("term", "block")
    counted = held.groupBy("term", "block", "doc", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    rows = counted.groupBy("term", "block").agg(F.collect_list(F.struct("doc", "tf", "len")).alias("docs"), F.max("tf").alias("most"), F.min("len").alias("least"), F.count(F.lit(1)).alias("n"))
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")
    postings = staged(rows.withColumn("folder", folder).sortWithinPartitions("folder", "term"), "postings", "folder")
    known = staged(postings.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    return Index(postings, known, n, total / n if n else 0.0)


def expanded(index: Index, terms: list[str]) -> list[tuple[str, float, int]]:
    """term, weight, df of what the query's terms stand for: a term that no document has is taken as a prefix from four letters on.
    A query's terms come to the driver, with the dictionary's words that begin so."""
    stems = [t for t in terms if len(t) >= PREFIX_FROM]
    may: Column = F.col("term").isin(*terms)
    for s in stems:
        may = may | F.col("term").startswith(s)
    found = {r["term"]: r["df"] for r in index.terms.filter(may).collect()}
    out: dict[str, float] = {}
    for t in terms:
        if t in found:
            out[t] = out.get(t, 0.0) + 1.0
        elif t in stems:
            for x in found:
                if x.startswith(t):
                    out[x] = out.get(x, 0.0) + PREFIX_WEIGHT
    return [(t, w, found[t]) for t, w in sorted(out.items())]


def search(spark: SparkSession, index: Index, terms: list[str], limit: int, ident: str = "doc") -> DataFrame:
    """ident, score, matched of the best `limit` documents with any of the terms; ties go to the smaller id."""
    wanted = expanded(index, list(dict.fromkeys(terms)))
    if not wanted:
        return index.postings.select(F.col("docs")[0]["doc"].alias(ident), F.lit(0.0).alias("score"), F.lit("").alias("matched")).limit(0)
    names, n = [t for t, _, _ in wanted], index.n
    table = F.create_map(*[F.lit(x) for t, w, df in wanted for x in (t, float(w))])
    counts = F.create_map(*[F.lit(x) for t, w, df in wanted for x in (t, float(df))])
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in names], "t string").select(F.pmod(F.xxhash64("t"), F.lit(FOLDERS)).cast("int")).distinct().collect()]
    own = index.postings.filter(F.col("folder").isin(*folders) & F.col("term").isin(*names))
    idf = F.log(1 + (n - counts[F.col("term")] + 0.5) / (counts[F.col("term")] + 0.5)) * table[F.col("term")]
    part = lambda tf, size: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / index.average))
    bounds = own.withColumn("idf", idf).groupBy("block").agg((F.sum(part(F.col("most"), F.col("least"))) * (1 + 1e-9)).alias("bound"))
    ranked = [(r["block"], r["bound"]) for r in bounds.orderBy(F.desc("bound")).limit(max(1, FIRST * -(-limit // BLOCK))).collect()]

    def scored(blocks: Column) -> DataFrame:
        hits = own.filter(blocks).withColumn("idf", idf).select("term", "idf", F.inline("docs"))
        return hits.groupBy("doc").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("matched")).select(F.col("doc").alias(ident), "score", "matched")

    best = lambda df: df.orderBy(F.desc("score"), ident).limit(limit)
    first = [r["score"] for r in best(scored(F.col("block").isin(*[b for b, _ in ranked]))).select("score").collect()]
    if len(first) < limit:
        return best(scored(F.lit(True)))
    open_blocks = bounds.filter(F.col("bound") >= first[-1]).select("block")
    opened = own.join(F.broadcast(open_blocks), "block", "left_semi") if n < BLOCK * 100_000 else own.join(open_blocks, "block", "left_semi")  # a number per block
    hits = opened.withColumn("idf", idf).select("term", "idf", F.inline("docs"))
    out = hits.groupBy("doc").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("matched"))
    return best(out.select(F.col("doc").alias(ident), "score", "matched"))


_kept: dict[tuple, Index] = {}


def index_of(docs: DataFrame, ident: str, text: str) -> Index:
    """The index of a table of files, built once in a session and used until other files (names or sizes) stand there."""
    spark = docs.sparkSession
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    sizes = []
    for f in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        sizes.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, ident, text, *sizes)
    if key not in _kept:
        _kept[key] = build(docs, ident, text)
    return _kept[key]
