"""Centroid clustering by sort-means on whole numbers.

Components become floor(scale * x), so that distances, sums and means are exact and every run gives the same clusters. A round
sorts, for each centroid, the other centroids by their distance from it. A vector starts at the centroid it had (at
first number 0) and walks that centroid's list; a centroid further away than twice the vector's current distance
cannot be nearer, so the walk stops at the first that is strictly beyond, and ties still find the smaller number. Vectors
of a batch that come from the same centroid walk together.

Assignments are written in the shared folder after each round; the new centroids are sums by cluster, combined before the
shuffle, so a cluster that holds most vectors sends one row a task. The driver holds k centroids and k sums.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite. Components beyond ``BOUND`` after scaling count as
that bound, so that squared distances stay longs. Repeated rows are vectors of their own; starting centroids of
equal hash (repeated keys) come in the order of their components; a null key is hashed as no digits. With fewer vectors
than k there are fewer centroids; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, release
from sparkloom.operators.graph import forget

#: 16 * 64 * BOUND^2 is within a long: four times a squared distance is compared.
BOUND = 1 << 26


def whole_numbers(df: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = 64, scale: int = 64) -> DataFrame:
    """key, x (array of long) of the vectors that are kept."""
    raw = F.col(vector).try_cast("array<double>")
    bad = F.exists(raw, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.select(F.col(key).alias("key"), raw.alias("raw")).where((F.size(raw) == dims) & ~bad)
    edge = F.lit(float(BOUND))
    return kept.select("key", F.transform("raw", lambda v: F.floor(F.greatest(-edge, F.least(edge, v * float(scale))))).cast("array<long>").alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose seeded key has the smallest hash, in that order."""
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of each row of x, walking from the centroid that it had."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    own = ((x - centroids[was]) ** 2).sum(1)
    cluster, best, tried = was.copy(), own.copy(), len(x)
    for c in np.unique(was):
        rows = np.flatnonzero(was == c)
        for other in np.argsort(apart[c], kind="stable"):
            if other == c:
                continue
            rows = rows[4 * own[rows] >= apart[c, other]]
            if not len(rows):
                break
            far = ((x[rows] - centroids[other]) ** 2).sum(1)
            tried += len(rows)
            better = (far < best[rows]) | (far == best[rows]) & (other < cluster[rows])
            cluster[rows[better]], best[rows[better]] = other, far[better]
    return cluster, best, tried


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (key, x, cluster) with the nearest centroid and the squared distance from it."""
    schema = vectors.select("key", "x", "cluster", F.lit(0).cast("long").alias("distance")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                cluster, distance, _ = nearest(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["key", "x", "cluster", "distance"])
        release()

    return vectors.select("key", "x", "cluster").mapInArrow(work, schema)


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster that has vectors; the others stay."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])))
    out = centroids.copy()
    for row in sums.collect():  # at most k rows
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def sort_means(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, rounds: int = 3, seed: str = "1:", dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(key, x, cluster, distance of every kept vector; the final centroids) after so many rounds and a last assignment."""
    vectors = keep(whole_numbers(df, vector, key, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(vectors, k, seed).reshape(-1, dims)
    if not len(centroids):
        return vectors.withColumn("distance", F.lit(0).cast("long")), centroids
    for left in range(rounds, -1, -1):
        assigned = keep(assign(vectors, centroids), "assigned")
        forget(vectors)
        vectors = assigned
        if left:
            centroids = means(assigned, centroids)
    return vectors, centroids


def cluster_report(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 16, rounds: int = 3, seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    assigned, centroids = sort_means(df, vector, key, k, rounds, seed)
    spark = df.sparkSession
    named = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    facts = names.join(sums, "cluster").join(whole)  # at most k rows and one row
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
