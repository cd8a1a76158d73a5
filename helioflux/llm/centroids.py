"""Centroid clustering of whole-number vectors by annulus search.

Centroids are sorted by norm. For each vector an upper bound of its distance to the nearest centroid is the exact distance to
one of the two centroids next to it in norm. By the triangle inequality only centroids with a norm within that bound of
the vector's own norm can be as near or nearer; binary search finds where they begin and end, and only they are compared, in
whole numbers. The borders belong to the annulus, so a tie is never lost; among equals the smaller number wins.

A round is one pass over the vectors: each task adds up its vectors per centroid, and one row a task and centroid is
shuffled. The driver sees the centroids and their sums, never a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Components of all centroids together; they are sent to every task.
MOST_NUMBERS = 4_000_000
#: Components are below this in magnitude, so that squared distances fit a long.
REACH = 2**27
RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def as_numbers(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """Rows (key, x array<bigint>) of the vectors with exactly ``dims`` components, none null, infinite or not a number."""
    d = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dims)
    d = d.where(F.forall("v", lambda c: F.coalesce(c.between(-1.8e308, 1.8e308) & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    far = F.exists("v", lambda c: F.abs(c * scale) >= float(REACH))
    error = F.raise_error(F.concat(F.lit("a component is out of range in the vector of key "), F.coalesce(F.col("key").cast("string"), F.lit("null")))).cast("array<double>")
    return d.select("key", F.transform(F.when(far, error).otherwise(F.col("v")), lambda c: F.floor(c * scale)).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of ``x`` and the squared distance, both exact; ties go to the smaller number."""
    square = (centroids * centroids).sum(axis=1)
    by_norm = np.argsort(square, kind="stable")
    c, norms = centroids[by_norm], np.sqrt(square[by_norm].astype(float))
    own = np.sqrt((x * x).sum(axis=1).astype(float))

    def distance(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = x[rows] - c[at]
        return (d * d).sum(axis=1)

    rows = np.arange(len(x))
    above = np.searchsorted(norms, own)
    bound = np.minimum(distance(rows, np.minimum(above, len(c) - 1)), distance(rows, np.maximum(above - 1, 0)))
    radius = np.sqrt(bound.astype(float))
    slack = 1e-9 * (own + radius + 1)  # more than the roots can be off by
    first = np.searchsorted(norms, own - radius - slack, "left")
    past = np.searchsorted(norms, own + radius + slack, "right")
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k in range(int((past - first).max(initial=0))):
        r = rows[first + k < past]
        d, n = distance(r, first[r] + k), by_norm[first[r] + k]
        better = (d < best[r]) | ((d == best[r]) & (n < number[r]))
        best[r[better]], number[r[better]] = d[better], n[better]
    return number, best


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids, dims: int) -> Callable:
    """Per task and centroid with vectors: how many, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b, dims)
                to, _ = nearest(x, c)
                order = np.argsort(to, kind="stable")
                used, starts, count = np.unique(to[order], return_index=True, return_counts=True)
                n[used] += count
                total[used] += np.add.reduceat(x[order], starts, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": used.astype(np.int32), "n": n[used], "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    return run


def _assign(centroids, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, d = nearest(_matrix(b, dims), centroids.value)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(to.astype(np.int32)), pa.array(d)], ["key", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:key``, in that order; equal hashes by the vectors themselves."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.select("x", rank.alias("h")).orderBy("h", "x").limit(k).collect()], np.int64)


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per kept vector, after ``rounds`` of averaging.

    Vectors with another number of components than ``dims``, or with a null, infinite or undefined one, are left out; null
    vectors too. Components become floor(scale * x); one of 2^27 or more is an error that names the key. Centroids are means
    rounded down; one without vectors stays. Fewer than ``k`` vectors give as many centroids; none give no rows. Repeated
    vectors and keys are rows of their own, a null key hashes as the empty text. Other columns of ``df`` are not read, and
    a key named as a column of the result is an error.
    """
    if key in RESULT:
        raise ValueError(f"the key may not be named {key}")
    if k < 1 or k * dims > MOST_NUMBERS:
        raise ValueError(f"k * dims must be from dims to {MOST_NUMBERS}")
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    vectors = table(as_numbers(df, key, vector, dims, scale), "vectors")
    c = first_centroids(vectors, k, seed)
    if not len(c):
        c = np.zeros((1, dims), np.int64)  # no vector will ask for it
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(c)
        part = vectors.mapInArrow(_sums(sent, dims), "cluster int, n long, total array<long>")
        cells = part.select("cluster", "n", F.posexplode("total").alias("at", "total")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        c = c.copy()
        for r in cells.collect():  # k * dims numbers
            c[r["cluster"], r["at"]] = r["total"] // r["n"]
        sent.unpersist()
    done = table(vectors.mapInArrow(_assign(spark.sparkContext.broadcast(c), dims), f"key {kind}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    rows = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(c.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), *RESULT)
