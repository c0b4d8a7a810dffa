"""Exact top-k search by integer inner product: columnar branch-and-bound.

Vectors become blocks in vertical layout: a block's dimensions, by falling mass, are cut into slabs, each a matrix of
dimensions by vectors. A block of queries adds up its scores slab by slab. After each slab a score can still grow by no
more than the product of the lengths that query and vector have left (Cauchy-Schwarz); vectors that no query can need
are compacted away, and once few pairs survive, these alone are carried on. What a query needs is the least of its ``k``
best scores so far. A first round over some of the blocks finds that for all queries, and the second round, over all
others, starts from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import discard, named, new_path, stored, workspace

#: Vectors of a block, queries that meet it at once, and dimensions of a slab.
BLOCK, QUERIES, SLAB = 1_024, 512, 16
#: Components of blocks that a task holds open, one block a length; beyond, they are closed as they are.
OPEN = 1 << 23
#: The first round has one block of so many of every partition; pairs are carried singly when this share of them survives.
FIRST, FEW = 16, 1 / 16
_BLOCKS = "serial long, dim int, first boolean, ids binary, asks binary, order binary, width int, slabs binary"
_FOUND = "uid long, query_id long, vec_id long, other long, score long"
#: What products of lengths in doubles may lack, as shares of what is left and of the whole.
_SLACK, _OFF = 1 + 1e-9, 1e-12


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in 2, 4 or 8 bytes, as they need."""
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _exact_in(most: int, other: int, dim: int) -> type:
    """The narrowest type in which products and sums of ``dim`` of them are exact."""
    bound = most * other * max(dim, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Block:
    """Vectors of one dimension in vertical layout."""

    def __init__(self, columns: np.ndarray, order: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        self.order, self.ids, self.uids, self.most = order, ids, uids, int(np.abs(columns).max(initial=0))
        spans = range(0, len(columns), SLAB)
        self.slabs = [columns[s : s + SLAB] for s in spans]
        squares = np.array([np.einsum("ij,ij->j", x, x) for x in (s.astype(np.float64) for s in self.slabs)]).reshape(-1, columns.shape[1])
        #: lengths of what is left of every vector after each slab, before the first one in front
        self.rest = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))]))

    def survivors(self, q: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, place, score)``: all pairs whose score is ``need`` of the query or more."""
        n = self.rest.shape[1]
        kind = _exact_in(int(np.abs(q).max(initial=0)), self.most, q.shape[1])
        q = q[:, self.order].astype(kind)
        parts = [q[:, s : s + SLAB] for s in range(0, q.shape[1], SLAB)]
        squares = np.array([np.einsum("ij,ij->i", x, x) for x in (p.astype(np.float64) for p in parts)]).reshape(-1, len(q))
        left = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(q)))])) * _SLACK
        whole = left[0] * self.rest[0].max(initial=0)
        rows, cols = np.flatnonzero(whole >= need), np.arange(n)
        need = need - _OFF * whole
        score = np.zeros((len(rows), n), kind)
        single = False
        for j, slab in enumerate(self.slabs):
            more = left[j + 1]
            if single:
                score = score + np.einsum("ij,ij->j", parts[j].T[:, rows], slab[:, cols].astype(kind))
                alive = score + more[rows] * self.rest[j + 1][cols] >= need[rows]
                rows, cols, score = rows[alive], cols[alive], score[alive]
                continue
            score += parts[j][rows] @ (slab if len(cols) == n else slab[:, cols]).astype(kind)
            alive = score + more[rows][:, None] * self.rest[j + 1][cols] >= need[rows][:, None]
            if np.count_nonzero(alive) <= alive.size * FEW:
                a, b = np.nonzero(alive)
                rows, cols, score, single = rows[a], cols[b], score[a, b], True
            else:
                live, open_ = alive.any(axis=0), alive.any(axis=1)
                if live.mean() < 0.75 or open_.mean() < 0.75:
                    rows, cols, score = rows[open_], cols[live], score[np.ix_(open_, live)]
        if not single:
            a, b = np.nonzero(score >= need[rows][:, None])
            rows, cols, score = rows[a], cols[b], score[a, b]
        return rows, cols, score.astype(np.int64)


def best_of(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` best, by falling score, then by id."""
    order = np.lexsort((uids, ids, -score, rows))
    at = rows[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def search(blocks: list[Block], q: np.ndarray, own: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(query, id, uid, score)`` of the ``k`` best of all blocks for every query with a score of ``need`` or more."""
    need, held = need.copy(), tuple(np.zeros(0, np.int64) for _ in range(4))
    for block in blocks:
        rows, cols, score = block.survivors(q, need)
        other = block.uids[cols] != own[rows]
        rows, cols, score = rows[other], cols[other], score[other]
        if not len(rows):
            continue
        held = tuple(np.concatenate(x) for x in zip(held, (rows, block.ids[cols], block.uids[cols], score), strict=True))
        keep = best_of(held[0], held[3], held[1], held[2], k)
        held = tuple(x[keep] for x in held)
        count = np.bincount(held[0], minlength=len(q))
        least = held[3][np.cumsum(count) - 1]  # each query's last one
        full = count >= k
        need[full] = np.maximum(need[full], least[full])
    return held


def to_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the rows ``(id long, x array<long>, ask boolean)``, where they lie: no row moves. A row's uid is its
    block's serial number times ``BLOCK`` plus its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def full(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, x, asks = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            order = np.argsort(-np.square(x.astype(np.float64)).sum(axis=0), kind="stable").astype("<i4")
            columns = _narrow(np.ascontiguousarray(x[:, order].T))
            made += 1
            return pa.RecordBatch.from_pylist([{
                "serial": (partition << 30) + made - 1, "dim": dim, "first": (made - 1) % FIRST == 0, "ids": ids.astype("<i8").tobytes(), "asks": asks.tobytes(), "order": order.tobytes(), "width": columns.itemsize, "slabs": columns.tobytes(),
            }], _SCHEMA)

        for batch in batches:
            size = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(size).tolist():
                some = batch.filter(pa.array(size == dim))
                ids, asks = np.asarray(some.column(0)), np.asarray(some.column(2).cast(pa.uint8()))
                x = np.asarray(some.column(1).flatten(), np.int64).reshape(len(some), dim)
                at = 0
                while at < len(ids):
                    own = held.setdefault(dim, [])
                    end = at + BLOCK - sum(len(i) for i, _, _ in own)
                    own.append((ids[at:end], x[at:end], asks[at:end]))
                    at = end
                    if sum(len(i) for i, _, _ in own) == BLOCK:
                        yield full(dim)
            if sum(x.size for rows in held.values() for _, x, _ in rows) > OPEN:
                for dim in sorted(held):
                    yield full(dim)
        for dim in sorted(held):
            yield full(dim)

    return rows.mapInArrow(run, _BLOCKS)


_SCHEMA = pa.schema([("serial", pa.int64()), ("dim", pa.int32()), ("first", pa.bool_()), ("ids", pa.binary()), ("asks", pa.binary()), ("order", pa.binary()), ("width", pa.int32()), ("slabs", pa.binary())])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Block]]:
    """``(dim, asks, block)`` of stored blocks."""
    for serial, dim, _, ids, asks, order, width, slabs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        own = np.frombuffer(ids, "<i8")
        columns = np.frombuffer(slabs, f"<i{width}").reshape(dim, len(own))
        yield dim, np.frombuffer(asks, np.uint8).astype(bool), Block(columns, np.frombuffer(order, "<i4"), own, serial * BLOCK + np.arange(len(own)))


def questions(blocks: DataFrame) -> DataFrame:
    """``(uid, query_id, dim, q)`` of the rows that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, asks, block in _opened(batch):
                at = np.flatnonzero(asks)
                x = np.zeros((len(at), dim), "<i8")
                if dim:
                    x[:, block.order] = np.concatenate([s[:, at] for s in block.slabs]).T
                yield pa.RecordBatch.from_arrays([pa.array(block.uids[at]), pa.array(block.ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["uid", "query_id", "dim", "q"])

    return blocks.mapInArrow(run, "uid long, query_id long, dim int, q binary")


def answers(blocks: DataFrame, asked: str, k: int) -> DataFrame:
    """``uid, query_id, vec_id, other, score``: for the blocks of every task each query's ``k`` best that reach its need.
    Queries are read from the table at ``asked`` in blocks; a task holds the blocks of one split of their table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(asked)
        for batch in batches:
            by_dim: dict[int, list[Block]] = {}
            for dim, _, block in _opened(batch):
                by_dim.setdefault(dim, []).append(block)
            for dim, own in by_dim.items():
                for part in dataset.dataset(place, filesystem=store, format="parquet").to_batches(batch_size=QUERIES, filter=dataset.field("dim") == dim, columns=["uid", "query_id", "q", "need"]):
                    if not len(part):
                        continue
                    uid, query = np.asarray(part.column(0)), np.asarray(part.column(1))
                    q = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i8").reshape(len(part), dim)
                    need = np.asarray(part.column(3).cast(pa.float64()).fill_null(-np.inf))
                    rows, ids, uids, score = search(own, q, uid, need, k)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[rows]), pa.array(query[rows]), pa.array(ids), pa.array(uids), pa.array(score)], ["uid", "query_id", "vec_id", "other", "score"])

    return blocks.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best of all tasks; Spark cuts to ``k`` inside every task first."""
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row for which ``asks`` holds the ``k`` rows with the largest inner
    products, its own left out; all if there are fewer; ties go to the smaller id.

    A component ``x`` becomes ``floor(scale * x)``, held within the root of ``2**62 / dim``, so that scores fit longs.
    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; vectors are
    compared with those of their own length; those of zeros, and empty ones, score 0. Repeated rows are vectors of their
    own, and an id that asks twice gets an answer for each of its rows. Other columns are left out; an empty table, or
    one in which nobody asks, gives an empty result.
    """
    v = F.col("v")
    usable = F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, -most), most)))
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("ask")).where(F.coalesce(usable, F.lit(False))).select("id", whole.alias("x"), "ask")
    spark = vectors.sparkSession
    with workspace(spark, "topk") as folder:
        blocks = stored(to_blocks(rows), "blocks")
        asked = stored(questions(blocks), "questions")
        plain, bounded = new_path(spark, "asked"), new_path(spark, "asked")
        asked.withColumn("need", F.lit(None).cast("long")).write.parquet(plain)
        first = stored(_ranked(answers(blocks.where("first"), plain, k), k).drop("rank"), "first")
        needs = first.groupBy("uid").agg(F.when(F.count("*") == k, F.min("score")).alias("need"))
        asked.join(needs, "uid", "left").select(*asked.columns, "need").write.parquet(bounded)
        both = first.unionByName(answers(blocks.where("not first"), bounded, k))
    out = stored(_ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")
    discard(spark, folder)
    return out
