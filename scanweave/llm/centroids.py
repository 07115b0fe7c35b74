"""Centroid clustering (Lloyd's rounds) with annulus search.

Vectors are whole numbers, floor(scale * x).  Centroids start as the vectors
whose ids have the least hashes.  In each round every vector goes to its nearest
centroid:

1. Centroids are sorted by norm.  The distance to the one whose norm is nearest
   to the vector's is an upper bound of the least distance.
2. By the triangle inequality a centroid that is no farther than the bound has
   a norm within the bound of the vector's norm: an annulus, whose centroids
   binary search finds as a range of the sorted ones.  The bound is taken a
   little larger, for the rounding of norms, so ties at the edge are inside.
3. The centroids of the range are compared exactly, in whole numbers; of equal
   distances the smaller number wins.

Each task adds up its own vectors by cluster, so a round shuffles a row for each
task and cluster; vectors themselves are never shuffled or written.  The
centroids (k x dim numbers) are all that the driver holds.

Defined results: a vector that is null, of another dimension, or that holds a
null or non-finite component takes no part; one without an id is clustered, but
starts no centroid; repeated rows are vectors each, and may start equal
centroids, of which the first number gets all; among equal hashes the smaller
vector (by components) comes first; with fewer than k vectors there are fewer centroids; an
empty table gives no rows; no column but id and vector is read, so other names
can't clash.  A scaled component beyond 64 bits counts as the greatest or least
of them, and so does a sum of distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import table, written

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Components of pairs of vectors and centroids that are compared at once.
AT_ONCE = 1 << 22
LONG = 2**63 - 1

ASSIGNED = "vec_id long, cluster int, distance long"
PARTS = "cluster int, n long, sums array<decimal(38,0)>"


def whole(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))
    return named.filter((F.size("v") == dim) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers: 64-bit where squares of differences and their sums fit in 64 bits, else of any size."""
    f = np.floor(scale * x)
    if 4 * x.shape[-1] * float(np.abs(f).max(initial=0)) ** 2 < 2.0**62:
        return f.astype(np.int64)
    out = np.empty(f.shape, object)
    out.flat = [min(max(int(c), -LONG - 1), LONG) if np.isfinite(c) else (LONG if c > 0 else -LONG - 1) for c in f.flat]
    return out


def _norms(v: np.ndarray) -> np.ndarray:
    f = v.astype(float)
    return np.sqrt((f * f).sum(-1))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, pairs compared) for each row of v."""
    if v.dtype != centroids.dtype or v.dtype == np.int64 and 4 * v.shape[1] * max(int(np.abs(a).max(initial=0)) for a in (v, centroids)) ** 2 >= 2**62:
        v, centroids = v.astype(object), centroids.astype(object)
    norm = _norms(centroids)
    order = np.argsort(norm, kind="stable")
    norm, own = norm[order], _norms(v)
    right = np.clip(np.searchsorted(norm, own), 0, len(norm) - 1)
    left = np.maximum(right - 1, 0)
    guess = order[np.where(own - norm[left] < norm[right] - own, left, right)]
    bound = np.sqrt(((v - centroids[guess]) ** 2).sum(1).astype(float))
    bound += 1e-6 + 1e-9 * (bound + own)  # norms and distances are rounded
    low, high = np.searchsorted(norm, own - bound), np.searchsorted(norm, own + bound, "right")
    width = high - low
    cluster, least = np.empty(len(v), np.int64), np.empty(len(v), v.dtype)
    run = np.cumsum(width * v.shape[1]) // AT_ONCE
    for r in np.unique(run):
        rows = np.flatnonzero(run == r)
        first = np.cumsum(width[rows]) - width[rows]
        which = order[np.arange(width[rows].sum()) + np.repeat(low[rows] - first, width[rows])]
        gap = v[np.repeat(rows, width[rows])] - centroids[which]
        d = (gap * gap).sum(1)
        least[rows] = np.minimum.reduceat(d, first)
        tie = np.where(d == np.repeat(least[rows], width[rows]), which, len(centroids))
        cluster[rows] = np.minimum.reduceat(tie, first)
    return cluster, least, int(width.sum())


def _rows(batch: pa.RecordBatch, dim: int, scale: float) -> np.ndarray:
    return _scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), scale)


def _parts(centroids: np.ndarray, dim: int, scale: float):
    """PARTS: each task's vectors by cluster, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), object)
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch, dim, scale)
                cluster = nearest(v, centroids)[0]
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                sums[own] += np.add.reduceat(v[order], first).astype(object)  # 64-bit sums of a batch don't overflow
                n += np.bincount(cluster, minlength=len(centroids))
        own = np.flatnonzero(n)
        kinds = pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((own, n[own], sums[own].tolist()), kinds, strict=True)], names=["cluster", "n", "sums"])

    return run


def _assigner(centroids: np.ndarray, dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, d, _ = nearest(_rows(batch, dim, scale), centroids)
                d = d if d.dtype == np.int64 else np.array([min(int(x), LONG) for x in d], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def starting(rows: DataFrame, k: int, dim: int, scale: float, seed: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id IS NOT NULL").withColumn("digest", digest).orderBy("digest", "v").limit(k).select("v").collect()
    return _scaled(np.array([r["v"] for r in first], float).reshape(len(first), dim), scale)


def moved(rows: DataFrame, centroids: np.ndarray, dim: int, scale: float) -> np.ndarray:
    """Each centroid's place after a round: the floor of its vectors' mean, or where it was."""
    parts = rows.mapInArrow(_parts(centroids, dim, scale), PARTS).select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    sums = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # at most k x dim rows
    out = centroids.astype(object)
    for r in sums:
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    fits = max((abs(c) for c in out.flat), default=0) < 2**31
    return out.astype(np.int64) if fits and centroids.dtype == np.int64 else out


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    rows = whole(vectors, key, vector, dim)
    centroids = starting(rows, k, dim, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, dim, scale)
    assigned = written(rows.mapInArrow(_assigner(centroids, dim, scale), ASSIGNED), "clusters")
    # a row for each of k clusters
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(i, min(d, LONG), min(sum(sums.values()), LONG), ",".join(str(int(x)) for x in centroids[i])) for i, d in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, c string").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
