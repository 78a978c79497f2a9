"""Exact k-means on integer vectors with Yinyang bounds.

Components become floor(scale * x). The first centroids are the vectors whose salted id has the smallest SHA-256. They are
put into groups of about ten once, by a few rounds of k-means among the centroids themselves. Every vector carries an upper
bound of the distance to its centroid and one lower bound per group of the distance to the group's other centroids. When
centroids have moved, the bounds are widened by how far they went. A vector whose upper bound is under all its lower
bounds stays without looking at a centroid (global filter); else its own distance is measured and groups whose lower
bound is above it are left out (group filter); in the groups that remain, centroids whose old bound less their own move is
above it too are left out; the others are measured exactly, in integers. Bounds are compared strictly and with a margin for
rounding, so no tie is lost: the smaller number wins.

Spark holds the vectors: a written table a round with assignment and bounds, made by one map without a shuffle, and sums
per cluster that are combined before they are shuffled. The driver and the tasks hold the centroids only, k x dims.

Edge cases: a vector that is null, of another length, or holds null or non-finite components is left out. Components
beyond +-2**27 after scaling count as +-2**27, so that every squared distance fits into a long. A null id is hashed as the
empty text and starts no cluster before others do; vectors with equal ids or equal hashes are taken in order of their
components, and repeated rows each count. Fewer vectors than k make as many clusters; an empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import saved, small_batches, used_up

#: Largest scaled component.
LIMIT = 1 << 27
#: Relative margin of the bounds.
MARGIN = 1e-9
STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>"


def quantised(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    e = F.col("v")
    whole = e.isNotNull() & (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    cell = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * F.lit(float(scale))))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return base.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(cell(x)).cast("int")).alias("v"))


def groups_of(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: k-means among the centroids, about ten to a group."""
    k = len(centroids)
    t = max(1, k // 10)
    x = centroids.astype(float)
    middle = x[:t].copy()
    for _ in range(rounds):
        near = np.argmin(np.square(x[:, None, :] - middle[None]).sum(axis=2), axis=1)
        for g in range(t):
            if (near == g).any():
                middle[g] = x[near == g].mean(axis=0)
    return np.unique(near, return_inverse=True)[1]


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all v to all c: by a product where doubles hold every sum, else one centroid at a time."""
    most = int(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * v.shape[1] * most * most < 1 << 52:
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    return np.stack([np.square(v - row).sum(axis=1) for row in c], axis=1)


@dataclass(frozen=True)
class Round:
    """What a task needs of one round: centroids, groups, and how far each centroid moved since the last."""

    centroids: np.ndarray
    groups: np.ndarray
    moved: np.ndarray

    @property
    def far(self) -> np.ndarray:
        """The farthest move in each group."""
        out = np.zeros(self.groups.max() + 1)
        np.maximum.at(out, self.groups, self.moved)
        return out

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds from all distances."""
        d = squares(v, self.centroids)
        mine = np.argmin(d, axis=1)
        return mine, *self._bounds(np.sqrt(d.astype(float)), mine)

    def _bounds(self, d: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.arange(len(d))
        upper = d[row, mine] * (1 + MARGIN)
        others = d.copy()
        others[row, mine] = np.inf
        lower = np.full((len(d), self.groups.max() + 1), np.inf)
        for g in range(lower.shape[1]):
            lower[:, g] = others[:, self.groups == g].min(axis=1) * (1 - MARGIN)
        return upper, lower

    def next(self, v: np.ndarray, mine: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds after the centroids have moved."""
        old = lower
        mine, upper, lower = mine.copy(), upper + self.moved[mine] * (1 + MARGIN), old - self.far * (1 + MARGIN)
        look = np.flatnonzero(upper >= lower.min(axis=1))  # global filter
        if len(look):
            own = np.square(v[look] - self.centroids[mine[look]]).sum(axis=1)
            upper[look] = np.sqrt(own.astype(float)) * (1 + MARGIN)
            still = upper[look] >= lower[look].min(axis=1)
            look, own = look[still], own[still]
        if not len(look):
            return mine, upper, lower
        at = np.arange(len(look))
        x, was, bound = v[look], mine[look], upper[look]
        # Below these no distance to the centroid can be; the exact ones take their place as they are measured.
        low = old[look][:, self.groups] - self.moved * (1 + MARGIN)
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        exact[at, was] = own
        open_groups = bound[:, None] >= lower[look]  # group filter
        scan = open_groups[:, self.groups] & (bound[:, None] >= low)  # local filter
        scan[at, was] = False
        for c in np.flatnonzero(scan.any(axis=0)):
            rows = np.flatnonzero(scan[:, c])
            exact[rows, c] = np.square(x[rows] - self.centroids[c]).sum(axis=1)
        measured = exact < np.iinfo(np.int64).max
        low = np.where(measured, np.sqrt(exact.astype(float)), np.maximum(low, lower[look][:, self.groups]))
        new = np.argmin(exact, axis=1)
        mine[look] = new
        upper[look], lower[look] = self._bounds(low, new)
        return mine, upper, lower


def stepper(now: Round, first: bool, last: bool):
    """For mapInArrow: a round's assignments. The last round gives distances in place of vectors and bounds."""

    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        n, width = x.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(x.ravel(), type=kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = now.centroids.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            v = column["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            if first:
                mine, upper, lower = now.first(v)
            else:
                bounds = column["lower"].flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                mine, upper, lower = now.next(v, column["cluster"].to_numpy(), column["upper"].to_numpy(), bounds)
            cluster = pa.array(mine.astype(np.int32))
            if last:
                distance = np.square(v - now.centroids[mine]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([column["vec_id"], cluster, pa.array(distance)], ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([column["vec_id"], column["v"], cluster, pa.array(upper), lists(lower, pa.float64())], ["vec_id", "v", "cluster", "upper", "lower"])

    return run


def assigned(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2, dims: int = 64, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    state = saved(quantised(vectors, dims, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = state.orderBy(F.col("vec_id").isNull(), name, "v").limit(k).select("v").collect()
    if not seeds:
        return state.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), np.empty((0, dims), np.int64)
    centroids = np.array([r["v"] for r in seeds], np.int64)
    groups, moved = groups_of(centroids), np.zeros(len(centroids))
    for turn in range(rounds + 1):
        last = turn == rounds
        step = stepper(Round(centroids, groups, moved), turn == 0, last)
        after = saved(state.mapInArrow(step, "vec_id long, cluster int, distance long" if last else STATE), "round")
        used_up(state)
        state = after
        if last:
            return state, centroids
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]).collect()
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        moved = np.sqrt(np.square(new - centroids).sum(axis=1).astype(float))
        centroids = new


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """assigned() with the sums of squared distances of the cluster and of all vectors, and a digest of the final centroid."""
    state, centroids = assigned(vectors, **options)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in state.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most, total = (1 << 63) - 1, sum(sums.values())
    rows = [(c, min(most, s), min(most, total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 40, rounds: int = 5, salt: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Plain k-means, a pair of tables a round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY 1 LIMIT {k})",
    ]
    for t in range(rounds + 1):
        distance = "list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min({{'d': ({distance})::BIGINT, 'c': b.c}}) AS m FROM kept a CROSS JOIN c{t} b GROUP BY r)")
        if t < rounds:
            parts.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(n.v, c{t}.v) AS v FROM c{t} LEFT JOIN (SELECT c, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM
(SELECT m.c AS c, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{t} JOIN kept USING (r) CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL) GROUP BY c) n ON n.c = c{t}.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(final, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, v AS final FROM c{rounds}) z ON z.c = m.c"""


OP13_SQL = _sql()
