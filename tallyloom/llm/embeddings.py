"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

On a bounded sample the vectors are centred, turned to their principal axes, and rotations are learned that bring them
nearest to the corners of a cube; a bit says on which side of the sample's median a turned vector lies, so codes are
balanced. The codes are cut into substrings of about log2(n) bits; each substring is a table, and vectors that share a
bucket of any table are candidates. Rotations are added until pairs at the similarity limit, made from the sample, are
found with probability `recall`. Candidates whose codes in the table's rotation and the next differ in more bits than
nearly all such pairs do are dropped without reading vectors; the rest are ranked again by the cosine of the original
vectors in double precision.

Vectors of different lengths are never near; each of the COMMON commonest lengths has a quantiser of its own, others one
of random rotations, and the length is part of the bucket.

Equal vectors are one node with a count, so copies are never paired with each other. Bucket sizes stay about one however
many vectors there are, except for true neighbours.

Edge cases: a vector that is null, zero, or holds null or non-finite components links with nothing and is a component of
its own. Very small and very large components are scaled by a power of two first, so squares neither vanish nor
overflow. Repeated vec_ids each get a row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import mixed, saved, small_batches, with_rows
from tallyloom.llm.components import components

#: Vectors of a length at most that its rotations are learned from, and lengths at most that have learned ones.
SAMPLE, COMMON = 20_000, 4
#: Rotations at most; only vectors crowded in a narrow cone, where nearly all pairs are near, would need more.
TURNS = 96


@dataclass(frozen=True)
class Quantiser:
    rotations: tuple[np.ndarray, ...]
    medians: tuple[np.ndarray, ...]
    bits: int  # of a table
    most: int  # differing bits of two codes at most

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A code of up to 64 bits per unit vector and rotation."""
        out = np.empty((len(x), len(self.rotations)), np.uint64)
        for k, (r, m) in enumerate(zip(self.rotations, self.medians, strict=True)):
            signs = (x @ r > m).astype(np.uint64)
            out[:, k] = (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    @property
    def per(self) -> int:
        """Tables of a rotation."""
        return self.rotations[0].shape[1] // self.bits

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """The substring of each table."""
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([codes[:, k] >> np.uint64(j * self.bits) & mask for k in range(codes.shape[1]) for j in range(self.per)], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([[int(v).bit_count() for v in row] for row in (a ^ b).tolist()])


def turn(centred: np.ndarray, width: int, draws: np.random.Generator, rounds: int) -> np.ndarray:
    """A rotation of the columns of `centred`, learned by alternating with the nearest corners of the cube."""
    r, _ = np.linalg.qr(draws.standard_normal((width, width)))
    for _ in range(rounds):
        corners = np.where(centred @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(centred.T @ corners)
        r = left @ right
    return r


def learn(sample: np.ndarray, n: int, cosine: float, recall: float, rounds: int = 20, seed: int = 5) -> Quantiser:
    """Rotations of unit vectors until pairs at the limit meet with probability `recall`. The pairs are the sample's vectors
    and one each at exactly that cosine in a random direction."""
    dims = sample.shape[1]
    x, draws = unit(sample), np.random.default_rng(seed)
    if len(x) < 256:  # too few to learn from or to measure with
        x = np.concatenate([x, unit(draws.standard_normal((256, dims)))])
    probe = x[draws.permutation(len(x))[:4000]]
    noise = draws.standard_normal(probe.shape)
    noise -= (noise * probe).sum(axis=1, keepdims=True) * probe
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    near = cosine * probe + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 1e-12)
    width = min(dims, 64)
    bits = max(1, min(width, 32, max(8, round(math.log2(max(2, n))))))
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    top = axes[:, ::-1][:, :width]
    rotations, medians, missed = [], [], np.ones(len(probe), bool)
    apart = []
    while len(rotations) < 2 or missed.mean() > 1 - recall and len(rotations) < TURNS:
        # Wider vectors than codes: the first turn takes the principal axes, others random ones of the whole space.
        base = top if dims <= 64 or not rotations else np.linalg.qr(draws.standard_normal((dims, width)))[0]
        r = base @ turn((x - mean) @ base, width, draws, rounds)
        rotations.append(r)
        medians.append(np.median(x @ r, axis=0))
        one = Quantiser((r,), (medians[-1],), bits, 0)
        a, b = one.codes(probe), one.codes(near)
        missed &= (one.parts(a) != one.parts(b)).all(axis=1)
        if len(rotations) <= 2:
            apart.append(bits_apart(a, b)[:, 0])
    both = apart[0] + apart[1]
    return Quantiser(tuple(rotations), tuple(medians), bits, int(math.ceil(both.mean() + 5 * both.std())))


def valid(embedding) -> object:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.withColumn("n", F.size("v"))
    # Classes of equal vectors; -0.0 is 0.0. The class is named by its smallest id, told apart by its components.
    good = valid(F.col("v"))
    plain = base.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("digest", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x * F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.floor(F.log2(top)))))
    classes = plain.filter(good).groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("n").alias("n"))
    classes = saved(classes.withColumns({"node": F.xxhash64("digest"), "v": scaled}), "classes")
    sizes = classes.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").limit(COMMON).collect()
    quantisers = {}
    for r in sizes:
        share = min(1.0, sample / r["k"])
        of_size = classes.filter(F.col("n") == r["n"])
        rows = of_size.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("node").limit(sample).select("v").collect()
        quantisers[r["n"]] = learn(np.array([x["v"] for x in rows] or np.ones((1, r["n"])), float), r["k"], cosine, recall)
    rest = sizes[-1]["k"] if sizes else 1

    def make(stream: Iterator[dict]) -> Iterator[tuple]:
        others: dict[int, Quantiser] = {}
        for row in stream:
            dims = len(row["v"])
            q = quantisers.get(dims) or others.get(dims)
            if q is None:
                others.clear()  # one at a time: the lengths of a table are few
                q = others[dims] = learn(np.random.default_rng(dims).standard_normal((512, dims)), rest, cosine, recall, rounds=0)
            codes = q.codes(unit(np.array([row["v"]], float)))
            keys = mixed(q.parts(codes)[0] + (np.arange(q.per * codes.shape[1], dtype=np.uint64) << np.uint64(34)) + mixed(np.full(1, dims, np.uint64)))
            mine = codes[0].view(np.int64).tolist()
            for t, key in enumerate(keys.view(np.int64).tolist()):
                k = t // q.per
                yield row["node"], key, mine[k], mine[(k + 1) % len(mine)], q.most

    schema = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("own", pa.int64()), ("other", pa.int64()), ("most", pa.int32())])
    posted = saved(classes.select("node", "v").mapInArrow(with_rows(make, schema, flush=20_000), "node long, key long, own long, other long, most int"), "posted")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    posted = posted.join(shared, "key")
    left = posted.select("key", F.col("node").alias("a"), F.col("own").alias("own_a"), F.col("other").alias("other_a"), "most")
    right = posted.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("own").alias("own_b"), F.col("other").alias("other_b"))
    differ = F.bit_count(F.col("own_a").bitwiseXOR(F.col("own_b"))) + F.bit_count(F.col("other_a").bitwiseXOR(F.col("other_b")))
    pairs = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (differ <= F.col("most"))).select("a", "b").distinct()
    va = classes.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na"))
    vb = classes.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with("va", "vb", lambda x, y: x * y))
    norms = F.sqrt(total(F.transform("va", lambda x: x * x))) * F.sqrt(total(F.transform("vb", lambda x: x * x)))
    links = saved(pairs.join(va, "a").join(vb, "b").filter(dot / norms >= cosine).select("a", "b", "na", "nb"), "links")
    both = links.select(F.col("a").alias("node"), F.col("nb").alias("k")).unionByName(links.select(F.col("b").alias("node"), F.col("na").alias("k")))
    degree = both.groupBy("node").agg(F.sum("k").alias("others"))
    named = classes.select("node", "digest", "least", "copies").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").join(degree, "node", "left").select("digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = plain.select("vec_id", F.when(good, F.col("digest")).alias("digest")).join(known, "digest", "left")
    ident = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), ident.alias("component_id"), F.col("vec_id").eqNullSafe(ident).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
