"""Centroid clustering of integer vectors with an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids in a stored table. When centroids move, a dot
product changes by the sum over the nonzero component changes of its centroid alone; squared distances then follow from
stored squares and dot products, and the smallest is the assignment. All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, map_batches, named, new_path, workspace

#: Components are held within this, so that squared distances of up to 64 components, and sums of components, fit longs.
LIMIT = 1 << 27
_STATE = "id {kind}, x array<int>, square long, dots array<long>, cluster int, distance long"

Change = tuple[int, np.ndarray, np.ndarray]


def changes(old: np.ndarray, new: np.ndarray) -> list[Change]:
    """``(centroid, places, differences)`` of the centroids that differ, nonzero differences only."""
    moved = [(c, np.flatnonzero(new[c] != old[c])) for c in range(len(new))]
    return [(c, at, new[c, at] - old[c, at]) for c, at in moved if len(at)]


def advance(x: np.ndarray, dots: np.ndarray, moved: list[Change]) -> np.ndarray:
    """The dot products after the centroids moved."""
    dots = dots.copy()
    for c, at, by in moved:
        dots[:, c] += x[:, at] @ by
    return dots


def _step(moved: list[Change], squares: np.ndarray, dim: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A batch of the state with its dot products, assignments and distances brought up to date."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, k = len(batch), len(squares)
        x = np.asarray(batch.column(1).flatten(), np.int64).reshape(n, dim)
        old = np.asarray(batch.column(3).flatten(), np.int64)
        dots = advance(x, old.reshape(n, k) if len(old) else np.zeros((n, k), np.int64), moved)
        distances = np.asarray(batch.column(2))[:, None] - 2 * dots + squares
        best = distances.argmin(axis=1)  # the first one of equals
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(dots.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists, pa.array(best, pa.int32()), pa.array(distances[np.arange(n), best])], ["id", "x", "square", "dots", "cluster", "distance"])

    return run


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every cluster's componentwise ``floor(sum / count)``; a cluster without vectors keeps its centroid. One row a
    cluster comes to the driver."""
    dim, new = centroids.shape[1], centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("x", F.lit(i)).cast("long")) for i in range(dim))).alias("sums")).collect():
        new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return new


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors with exactly ``dim`` components, none null or non-finite; a component ``x`` becomes
    ``floor(scale * x)``, held within ``LIMIT``. The ``k`` kept vectors with the smallest ``sha256("seed:id")``, ties by
    components, are the first centroids, fewer if there are fewer vectors; a null id counts as empty. Ties in distance
    go to the smaller number. Repeated rows are vectors of their own; other columns are left out; no kept vectors give an
    empty result; an inertia beyond the range of long is null.

    The state, about as large as the vectors, is written once a round to the shared folder and the one before removed,
    so a lost executor costs its tasks alone. A round reads and writes it once and adds up components by cluster inside
    every task first. Centroids go out with the tasks: ``k * dim`` numbers.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    v = F.col("v")
    usable = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    rows = vectors.select(named(id_col).alias("id"), named(vector).cast("array<double>").alias("v")).where(F.coalesce(usable, F.lit(False))).select("id", whole.alias("x"))
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)
    none = [F.array().cast("array<long>").alias("dots"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")]
    with workspace(spark, "centroids"):
        first = new_path(spark, "state")
        rows.select("id", "x", square.alias("square"), *none).write.parquet(first)
        state, at = spark.read.parquet(first), first
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        begin = [r["x"] for r in state.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()]
        centroids, before = np.array(begin, np.int64).reshape(len(begin), dim), np.zeros((len(begin), dim), np.int64)
        for turn in range(rounds + 1):
            moved = changes(before, centroids)
            if moved or not turn:  # else nothing moves any more
                path = new_path(spark, "state")
                map_batches(state, _step(moved, (centroids * centroids).sum(axis=1), dim), _STATE.format(kind=kind)).write.parquet(path) if begin else state.write.parquet(path)
                discard(spark, at)
                state, at = spark.read.parquet(path), path
            if turn < rounds:
                before, centroids = centroids, means(state, centroids)
        sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    within = lambda x: int(x) if x < 1 << 63 else None
    total = within(sum(sums.values()))
    table = spark.createDataFrame([(c, within(s), total, digests[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
