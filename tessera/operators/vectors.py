"""Exact cosine search over tables of vectors ``(doc_id long, vector array<float>, norm)``."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, l2_norm, unit
from tessera.operators.columns import with_made
from tessera.session import new_path

#: Dimensions that a payload may have.
MIN_DIM, MAX_DIM = 1, 4096
#: Components of the vectors that a task of the batch search holds at once, and most scores of a product.
HELD_COMPONENTS, PRODUCT = 16_000_000, 4_000_000


class VectorError(ValueError):
    """Vectors or queries that break a rule of the table."""


def decode_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``explicit_id, dim, vector, ok`` from ``u32 dim, f32[dim], optional u64 id``, little-endian; they replace
    columns of these names.

    ``ok`` is false, and the others null, where the length or dimension is wrong or the id is 2**63 or more.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        ids, dims, vectors = [], [], []
        for raw in column.to_pylist():
            dim = struct.unpack_from("<I", raw)[0] if raw is not None and len(raw) >= 4 else 0
            extra = len(raw) - 4 - 4 * dim if dim else -1
            number = struct.unpack_from("<Q", raw, 4 + 4 * dim)[0] if extra == 8 else None
            good = MIN_DIM <= dim <= MAX_DIM and extra in (0, 8) and (number is None or number < 1 << 63 or number == (1 << 64) - 1)
            ids.append(None if not good or number == (1 << 64) - 1 else number)
            dims.append(dim if good else None)
            vectors.append(np.frombuffer(raw, "<f4", dim, 4) if good else None)
        return [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vectors, pa.list_(pa.float32())), pa.array([d is not None for d in dims], pa.bool_())]

    return with_made(payloads, [payload], make, {"explicit_id": "long", "dim": "int", "vector": "array<float>", "ok": "boolean"})


def resolve_ids(decoded: DataFrame) -> DataFrame:
    """``doc_id``: the explicit id, else the automatic one."""
    return decoded.withColumn("doc_id", F.coalesce("explicit_id", "auto_id"))


def uniform_dim(vectors: DataFrame, vector: str = "vector") -> int | None:
    """The dimension that all vectors share, None for an empty table; raises where they differ."""
    r = vectors.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise VectorError(f"dimensions differ: {r['lo']} to {r['hi']}")
    if r["lo"] is not None and not MIN_DIM <= r["lo"] <= MAX_DIM:
        raise VectorError(f"dimension {r['lo']} is outside {MIN_DIM}..{MAX_DIM}")
    return r["lo"]


def normalize(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Unit vectors and the norm of the result in ``norm``; a zero vector fails the job."""
    v = F.when(l2_norm(vector) > 0, unit(vector)).otherwise(F.raise_error(F.lit("a vector of norm zero")))
    return vectors.withColumn(vector, v.cast("array<float>")).withColumn("norm", l2_norm(vector).cast("float"))


def build_vectors(payloads: DataFrame) -> DataFrame:
    """``(doc_id, vector, norm)`` from ``(auto_id, payload)``; raises on bad payloads, unlike dimensions and no rows."""
    decoded = decode_payloads(payloads)
    bad = decoded.where(~F.col("ok")).count()
    if bad:
        raise VectorError(f"{bad} bad payloads")
    if uniform_dim(decoded) is None:
        raise VectorError("no vectors")
    return normalize(resolve_ids(decoded).select("doc_id", "vector"))


def _query(query: Sequence[float]) -> list[float]:
    q = [float(x) for x in query]
    if not any(q):
        raise VectorError("a query of norm zero")
    return q


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "doc_id", vector: str = "vector", check: bool = True) -> DataFrame:
    """``(doc_id, score)`` of the ``k`` most similar vectors, by score, then id; scores have six decimals.

    The order is taken on full-precision scores. ``k`` rows reach one task; every task first keeps its own ``k``. A
    query of norm zero is refused at once; a vector of another dimension than the query's, with nulls or without a norm
    fails the job, where it is scored, unless ``check`` is off.
    """
    q = _query(query)
    own = l2_norm(vector)
    score = dot(vector, F.lit(q)) / (own * float(np.linalg.norm(q)))
    if check:
        stored = [F.coalesce(F.col("norm") > 0, F.lit(False)) & ~F.isnan("norm")] if "norm" in vectors.columns else []
        good = F.coalesce((F.size(vector) == len(q)) & (own > 0) & (own < float("inf")), F.lit(False))  # NaN is over infinity
        for c in stored:
            good = good & c
        score = F.when(good & score.isNotNull(), score).otherwise(F.raise_error(F.lit("a vector of another dimension, or without a norm")).cast("double"))
    top = vectors.select(F.col(id_col).alias("doc_id"), score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return top.select("doc_id", F.round("score", 6).alias("score"))


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A batch of vectors as unit rows in single precision; raises where one has another dimension, nulls or no norm."""
    if column.null_count or column.flatten().null_count or len(column) * dim != len(column.flatten()) or (np.diff(np.asarray(column.offsets)) != dim).any():
        raise VectorError(f"a vector that is null, holds nulls or has another dimension than {dim}")
    x = np.asarray(column.flatten(), np.float32).reshape(-1, dim)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        unit_rows = (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    if not np.isfinite(unit_rows).all():
        raise VectorError("a vector without a norm")
    return unit_rows


def _best(q: np.ndarray, x: np.ndarray, q32: np.ndarray, x32: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of each query's ``k`` best rows, by score, then id. Single precision finds who may be among
    them, double precision orders these."""
    s = q32 @ x32.T
    n, off = s.shape[1], 2 * (q.shape[1] + 4) * 2.0**-24  # two products of unit vectors can be off by no more together
    least = np.partition(s, n - k, axis=1)[:, n - k] if n > k else s.min(axis=1)
    rows, cols = np.nonzero(s >= least[:, None] - off)
    a, b = q[rows], x[cols].astype(np.float64)
    exact = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    order = np.lexsort((ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return rows[keep], ids[cols[keep]], exact[keep]


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vector: str = "vector", query_id: str = "query_id") -> DataFrame:
    """``(query_id, rank, doc_id, score)`` for a table of queries of like dimension.

    The queries are stored once in the shared folder. A task holds a bounded part of its vectors, reads the queries from
    there in blocks and scores each block by one matrix product; each query's ``k`` best of every part meet in a ranking
    by query. So vectors are scanned once, nothing goes through the driver, and memory grows with neither table. Queries
    that differ in dimension, hold nulls or have norm zero are refused at once; such a vector fails the job.
    """
    spark = vectors.sparkSession
    q = F.col(vector).cast("array<double>")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), q.alias("q"))
    bad = F.coalesce(F.exists("q", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | (l2_norm("q") == 0), F.lit(True))
    sums = asked.agg(F.min(F.size("q")).alias("lo"), F.max(F.size("q")).alias("hi"), F.count_if(bad).alias("bad"), F.count("*").alias("n")).first()
    if not sums["n"]:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if sums["bad"] or sums["lo"] != sums["hi"]:
        raise VectorError(f"{sums['bad']} queries that are null, hold nulls or have norm zero; dimensions from {sums['lo']} to {sums['hi']}")
    dim, path = sums["lo"], new_path(spark, "queries")
    asked.write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(path)
        held: list[pa.RecordBatch] = []
        units: list[np.ndarray] = []
        size = 0

        def scored() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.asarray(b.column(0)) for b in held])
            raw = np.concatenate([np.asarray(b.column(1).flatten()) for b in held]).reshape(-1, dim)
            x32 = np.concatenate(units)
            for block in dataset.dataset(place, filesystem=store, format="parquet").to_batches(batch_size=max(1, PRODUCT // len(ids))):
                if len(block):
                    asked_ids, q = np.asarray(block.column(0)), np.asarray(block.column(1).flatten(), float).reshape(-1, dim)
                    rows, found, score = _best(q, raw, (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), x32, ids, k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked_ids[rows], pa.int64()), "doc_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

        for batch in batches:
            if len(batch):
                units.append(_rows_of(batch.column(1), dim))
                held.append(batch)
                size += len(batch) * dim
                if size >= HELD_COMPONENTS:
                    yield from scored()
                    held, units, size = [], [], 0
        if held:
            yield from scored()

    parts = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector).alias("v")).mapInArrow(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def cosine_topk_merged(base: DataFrame, delta: DataFrame | None, superseded: DataFrame, query: Sequence[float], k: int, check: bool = True) -> DataFrame:
    """Top ``k`` of base and delta without the superseded ids, which are taken out before the ranking."""
    both = base if delta is None else base.unionByName(delta)
    return cosine_topk(both.join(superseded.select("doc_id").distinct(), "doc_id", "left_anti"), query, k, check=check)


def contains_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids that have a vector."""
    return ids.select("doc_id").distinct().join(vectors.select("doc_id"), "doc_id", "left_semi")


def same_hits(a: DataFrame, b: DataFrame, tol: float = 1e-5) -> bool:
    """Whether two results list the same ids in the same order with scores within ``tol``."""
    ranked = lambda df, name: df.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), F.struct("doc_id", "score").alias(name))  # noqa: E731  k rows
    both = ranked(a, "a").join(ranked(b, "b"), "rank", "full_outer")
    differ = F.col("a").isNull() | F.col("b").isNull() | (F.col("a.doc_id") != F.col("b.doc_id")) | (F.abs(F.col("a.score") - F.col("b.score")) > tol)
    return both.where(differ).isEmpty()


def encode_payloads(vectors: DataFrame, explicit_id: str | None = "doc_id", vector: str = "vector") -> DataFrame:
    """Adds ``payload``, the inverse of ``decode_payloads``, in the place of a column of that name; a null id is left out of
    the bytes."""

    def make(values: pa.Array, ids: pa.Array | None = None) -> list[pa.Array]:
        own = [None] * len(values) if ids is None else ids.to_pylist()
        return [pa.array([None if v is None else struct.pack(f"<I{len(v)}f", len(v), *v) + (b"" if i is None else struct.pack("<Q", i)) for v, i in zip(values.to_pylist(), own, strict=True)], pa.binary())]

    return with_made(vectors, [vector] if explicit_id is None else [vector, explicit_id], make, {"payload": "binary"})
