"""MinHash near-dedup by an inverted join over signature coordinates.

A text's set of 5-word shingles has a signature of COORDINATES minima. Every set is posted under each (coordinate,
value) pair. Pairs of sets that agree in at least MATCHES coordinates must share one of the COORDINATES - MATCHES + 1
rarest postings of either (prefix merging, in one global order: rarest first); longer posting lists are skipped and only
looked up when a pair is counted. Candidates with enough collisions are confirmed on their full shingle sets. A pair at
the similarity limit (0.75) collides in fewer than 32 of 64 coordinates with a probability of about 5 in a million.

Large groups: equal sets are one node. Round one confirms each set against the most central set of each of its posting
lists (a star, not all pairs) and merges what is linked. Round two confirms the candidate pairs that still lie in
different components; in lists of one component there are none. For the sets in the other lists the shingles that no
other of them has are counted and bitmaps of the sets are compared; both bound every intersection, so that few pairs are left
to confirm.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing. Texts of fewer than
five words have one shingle of them all. Rows with equal texts are one group, whatever their ids; null ids are ignored
when the smallest id is sought. Texts of any length are read whole. Sets are equal if 128-bit
digests of their sorted shingle hashes are. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import apart, as_text, saved, shingles_of, small_batches, with_rows, word_hashes
from tallyloom.llm.components import components

COORDINATES, MATCHES, WIDTH = 64, 32, 5
#: Pairs of one pivot that a task takes in a run before the pivot's text is sent to another.
RUN = 256


def multipliers(n: int = COORDINATES) -> np.ndarray:
    return np.random.default_rng(20_240).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the minima, as signed ints."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (factors[:, None] * shingles[None, at : at + 2048]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.list_(pa.int32()))])
SIGNED_DDL = "doc_id long, text_hash long, low long, high long, n_shingles long, sig array<int>"


def signed_rows(rows: Iterator[dict]) -> Iterator[tuple]:
    factors = multipliers()
    for row in rows:
        shingles = np.unique(shingles_of(word_hashes(row["text"]), WIDTH))
        if not len(shingles):
            yield row["doc_id"], row["text_hash"], None, None, 0, None
        else:
            low, high = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
            yield row["doc_id"], row["text_hash"], low, high, len(shingles), signature(shingles, factors)


def keyed_texts(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text"))
    return base.withColumn("text_hash", F.xxhash64("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, low and high (a 128-bit digest of the shingle set; null if empty), n_shingles, sig of every document."""
    small_batches(docs.sparkSession)
    return saved(keyed_texts(docs).mapInArrow(with_rows(signed_rows, SIGNED), SIGNED_DDL), "signatures")


def prefixes(sets: DataFrame) -> DataFrame:
    """sid, keys, sig of the sets that can have a partner: keys are the postings of the prefix that others share."""
    postings = sets.select("sid", F.posexplode("sig").alias("at", "value")).select("sid", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = postings.join(shared, "key").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    take = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("shared"))
    # How near a set is to the middle of its group: members that agree with most others make the best pivots.
    centre = F.aggregate("shared", F.lit(0.0), lambda s, x: s + F.log(x["n"]))
    kept = own.filter(take > 0).select("sid", F.slice("shared", F.lit(1), take).getField("key").alias("keys"), centre.alias("centre"))
    return saved(kept.join(sets.select("sid", "sig", "n_shingles"), "sid"), "prefixes")


def agreeing(left, right):
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def star_pairs(table: DataFrame) -> DataFrame:
    """Every set with the most central set of each of its posting lists."""
    lists = table.select("sid", "centre", F.explode("keys").alias("key"))
    pivots = lists.groupBy("key").agg(F.max(F.struct("centre", "sid")).getField("sid").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = lists.join(pivots, "key").filter("sid <> pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
    left = table.select(F.col("sid").alias("a"), F.col("sig").alias("sig_a"))
    right = table.select(F.col("sid").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").filter(agreeing(F.col("sig_a"), F.col("sig_b")) >= MATCHES).select("a", "b")


BITS = 1024
SHINGLED = pa.schema([("sid", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit words: which residues the shingles take."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(13)) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def shingled_rows(rows: Iterator[dict]) -> Iterator[tuple]:
    for row in rows:
        shingles = np.unique(shingles_of(word_hashes(row["text"]), WIDTH))
        yield row["sid"], shingles.view(np.int64), bitmap(shingles)


def bounded(texts: DataFrame) -> DataFrame:
    """sid, bits, support: how many of a set's shingles some other set of `texts` has. No intersection can be larger."""
    rows = saved(texts.select("sid", "text").mapInArrow(with_rows(shingled_rows, SHINGLED, flush=500), "sid long, shingles array<long>, bits array<long>"), "shingles")
    each = rows.select("sid", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle")
    support = each.join(shared, "shingle").groupBy("sid").agg(F.count(F.lit(1)).alias("support"))
    return rows.select("sid", "bits").join(support, "sid", "left").withColumn("support", F.coalesce("support", F.lit(0)))


def lacking(left, right):
    """How many residues of the left bitmap the right one lacks: as many shingles of the left set at least are not in the
    right one."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def crossing_pairs(table: DataFrame, texts: DataFrame, merged: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Candidates between different components. In each posting list the members outside its largest component meet the
    others; a list of one component yields nothing. A pair is counted in the first list that both have, and only if
    their sizes, supports and bitmaps leave room for the similarity asked for: copies with many edits of their own have
    low support and differ in their bitmaps, so in a large group they meet few partners."""
    labelled = table.drop("centre").join(merged.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    lists = labelled.select("sid", "component", F.explode("keys").alias("key"))
    tally = lists.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = tally.groupBy("key").agg(F.max(F.struct("n", "component")).getField("component").alias("major"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds")
    entries = saved(lists.join(mixed, "key"), "lists")
    open_sets = saved(entries.select("sid").distinct(), "open")
    facts = bounded(texts.join(open_sets, "sid")).join(labelled.select("sid", "sig", "keys", "n_shingles"), "sid")
    open_lists = saved(entries.join(facts, "sid"), "lists")
    sides = [open_lists.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "component", "sig", "keys", "n_shingles", "support", "bits")], "major") for x in "ab"]
    minor, every = sides[0].filter("component_a <> major").drop("major"), sides[1].withColumnRenamed("key", "key_b")
    apart = F.expr("key = key_b AND component_a <> component_b AND (component_b = major OR sid_a < sid_b)")
    both = F.least("support_a", "support_b", "n_shingles_a", "n_shingles_b")
    room = lambda most: 100 * most >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - most)
    tight = F.least(F.col("n_shingles_a") - lacking(F.col("bits_a"), F.col("bits_b")), F.col("n_shingles_b") - lacking(F.col("bits_b"), F.col("bits_a")))
    enough = (agreeing(F.col("sig_a"), F.col("sig_b")) >= MATCHES) & (F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == F.col("key"))
    met = minor.join(every, apart & room(both) & enough & room(tight)).select(F.least("sid_a", "sid_b").alias("x"), F.greatest("sid_a", "sid_b").alias("y")).distinct()
    known = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return met.join(known, ["x", "y"], "left_anti").select(F.col("y").alias("a"), F.col("x").alias("b"))


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def confirmed_rows(percent: int):
    """Rows come sorted by (b, run): first the pivot's text, then the texts to compare with it."""

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        pivot = own = None
        for row in rows:
            mine = np.unique(shingles_of(word_hashes(row["text"]), WIDTH))
            if row["a"] is None:
                pivot, own = row["b"], mine
                continue
            if pivot != row["b"]:
                raise ValueError(f"the text of {row['b']} did not come before its pairs")
            both = len(np.intersect1d(own, mine, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(mine) - both):
                yield row["a"], row["b"]

    return make


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts (sid, text) of all that occur in pairs. The text of b is
    sent once for each run of its pairs, so a pivot of very many pairs is spread over tasks."""
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    runs = pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / RUN)).cast("int").alias("run"))
    heads = runs.select("b", "run").distinct().select(F.lit(None).cast("long").alias("a"), "b", "run", F.col("b").alias("sid"))
    rows = runs.select("a", "b", "run", F.col("a").alias("sid")).unionByName(heads).join(texts, "sid").select("a", "b", "run", "text")
    ordered = rows.repartition("b", "run").sortWithinPartitions("b", "run", F.col("a").asc_nulls_first())
    return ordered.mapInArrow(with_rows(confirmed_rows(percent), EDGE, flush=20_000), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = signatures(docs)
    sets = signed.filter("low is not null").groupBy("low", "high").agg(F.min(F.struct("doc_id", "text_hash")).alias("pick"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"))
    # 64 bits name a set from here on; of sets that share the lower half each takes a hash of both.
    alike = F.count(F.lit(1)).over(Window.partitionBy("low"))
    sets = saved(sets.withColumn("sid", F.when(alike > 1, F.xxhash64("low", "high")).otherwise(F.col("low"))), "sets")
    table = prefixes(sets)
    picks = table.select("sid").join(sets.select("sid", "pick"), "sid").select("sid", F.col("pick.doc_id").alias("_id"), F.col("pick.text_hash").alias("_hash"))
    keyed = keyed_texts(docs)
    same = keyed.doc_id.eqNullSafe(picks._id) & (keyed.text_hash == picks._hash)
    texts = saved(keyed.join(picks, same).select("sid", "text").dropDuplicates(["sid"]), "texts")
    first = saved(star_pairs(table), "pairs")
    links = saved(confirmed(first, texts, percent), "links")
    second = saved(crossing_pairs(table, texts, components(links), first, percent), "pairs")
    links = links.unionByName(saved(confirmed(second, texts, percent), "links"))
    merged = components(links)
    named = sets.select("sid", "low", "high", "least_id").join(merged.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(least, "component").select("low", "high", "component_id")
    out = signed.select("doc_id", "n_shingles", "low", "high").join(of_set, ["low", "high"], "left")
    ident = F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", ident.alias("component_id"), F.col("doc_id").eqNullSafe(ident).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without near duplicates: of each group the document with the smallest id stays, once. Other columns may have
    any name."""
    packed, back = apart(docs, "doc_id", "text")
    kept = near_duplicates(docs, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return packed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "text"]).select(*back)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
