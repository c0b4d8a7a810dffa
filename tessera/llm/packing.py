"""Lexical retrieval packing into windows of a fixed number of tokens.

Documents are sorted by which of their token ids come first in hash orders, over all partitions, and cut into shards of
a bounded number of tokens and of rows where they lie, so documents that share many tokens tend to meet in one. Each shard has a BM25 inverted index over
its documents' token ids. A seed document opens a window; its best-scoring unused neighbours fill it; the one that overflows is cut
there and opens the next window as its seed. So every window but a shard's last is full, and the last one is cut into
windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import named, stored
from tessera.llm._vocab import byte_level_encoder

#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: Most documents of a shard whose scores by common terms are computed at once, and terms of a product.
DENSE_ROWS, BLOCK = 4_096, 2_048
#: A sequence's number: its task's partition, then the shard in it and the sequence in that, in so many bits.
SHARD_BITS, SEQUENCE_BITS = 19, 24
#: Columns of a piece after its document's id.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Power of a token's number of binary digits by which it comes first more often.
RARE = 2
#: Odd factors of the hash orders.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class ShardIndex:
    """BM25 over the token ids of one shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        terms, owners, counts = [], [], []
        for k, ids in enumerate(docs):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t)
            counts.append(n)
            owners.append(np.full(len(t), k, np.int32))
        self.terms, self.n = terms, len(docs)
        flat, owner, tf = np.concatenate(terms), np.concatenate(owners), np.concatenate(counts).astype(np.float32)
        length = np.array([len(d) for d in docs], np.float32)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order].astype(np.intp)
        norm = K1 * (1 - B + B * length / length.mean())
        weight = (tf * (K1 + 1) / (tf + norm[owner]))[order].astype(np.float64)
        vocabulary = int(flat.max()) + 1
        df = np.bincount(flat, minlength=vocabulary)
        self.begin = np.concatenate([[0], np.cumsum(df)])
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.idf[df < 2] = 0.0  # no other document has the term
        # multiples of 2**-30, so that sums are exact in any order
        self.gain = np.round(weight * self.idf[flat[order]] * 2.0**30) / 2.0**30
        self.common = df > max(1, self.n // 16) if self.n <= DENSE_ROWS else np.zeros(vocabulary, bool)

    @cached_property
    def shares(self) -> np.ndarray:
        """Scores by common terms alone, of every document for every seed, by products of blocks of terms."""
        out = np.zeros((self.n, self.n))
        terms = np.flatnonzero(self.common)
        for first in range(0, len(terms), BLOCK):
            block = terms[first : first + BLOCK]
            has, gain = np.zeros((self.n, len(block))), np.zeros((self.n, len(block)))
            for c, t in enumerate(block.tolist()):
                at = slice(self.begin[t], self.begin[t + 1])
                has[self.owner[at], c], gain[self.owner[at], c] = 1.0, self.gain[at]
            out += has @ gain.T
        return out

    def neighbours(self, k: int, used: np.ndarray, query_terms: int | None = None) -> Iterator[int]:
        """Unused documents that share a query term with document ``k``, best first; ties by place. By default all of
        its terms are query terms."""
        terms = self.terms[k]
        idf = self.idf[terms]
        query = terms[(idf > 0) & ~self.common[terms]] if query_terms is None else terms[np.argsort(-idf, kind="stable")[:query_terms]]
        score = self.shares[k].copy() if query_terms is None and self.common.any() else np.zeros(self.n)
        if len(query):
            spans = [slice(b, e) for b, e in zip(self.begin[query].tolist(), self.begin[query.astype(np.int64) + 1].tolist(), strict=True)]
            score += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.gain[s] for s in spans]), self.n)
        score[used] = 0
        found = np.flatnonzero(score > 0)
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], window: int, query_terms: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that hold every id of ``docs`` once."""
    index = ShardIndex(docs)
    used = np.zeros(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, filled, following = 0, 0, 0

    def put(k: int) -> bool:
        """Append document ``k``; whether it ended at or went past the window's end."""
        nonlocal sequence, filled
        used[k] = True
        start, past = 0, False
        while start < len(docs[k]):
            n = min(window - filled, len(docs[k]) - start)
            pieces.append((k, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled, past = sequence + 1, 0, True
        return past

    while True:
        while following < len(docs) and used[following]:
            following += 1
        if following == len(docs):
            break
        seed: int | None = following
        put(seed)
        while seed is not None and filled:
            last = None
            for k in index.neighbours(seed, used, query_terms):
                if put(k):
                    last = k  # its rest opens the next window
                    break
            seed = last
    # the last window in lengths of powers of two
    tail = [p for p in pieces if p[3] == sequence]
    del pieces[len(pieces) - len(tail) :]
    room = 1 << (filled.bit_length() - 1) if filled else 0
    place = 0
    for k, start, n, _, _ in tail:
        while n:
            take = min(n, room - place)
            pieces.append((k, start, take, sequence, place))
            start, n, place, filled = start + take, n - take, place + take, filled - take
            if place == room and filled:
                sequence, place, room = sequence + 1, 0, 1 << (filled.bit_length() - 1)
    return pieces


def min_tokens(ids: np.ndarray) -> bytes:
    """For each of the ``len(FACTORS)`` hash orders a hash of the token that is first in it; two documents have one in
    common with a probability of about their sets' similarity. The order favours tokens of high numbers, which a byte-pair
    vocabulary made late and which are rare; the hash of the token, unlike its place in the order, tells nothing of how
    many tokens there are."""
    if not len(ids):
        return bytes(4 * len(FACTORS))
    x = (ids.astype(np.uint64) + np.uint64(1)) * FACTORS[:, None]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    drawn = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    first = ids[(-np.log(drawn) / np.log2(ids + 2.0) ** RARE).argmin(axis=1)].astype(np.uint64)
    y = (first + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return ((y * FACTORS[0]) >> np.uint64(32)).astype(">u4").tobytes()


def order_key(ids: bytes, likeness: bytes, doc_id: object, place: int) -> bytes:
    """Sort key of a row: its first tokens, content, id, then its place, so that no two rows of a table share one."""
    return likeness + zlib.crc32(ids).to_bytes(4) + hashlib.blake2b(repr(doc_id).encode(), key=hashlib.blake2b(ids, digest_size=16).digest(), digest_size=8).digest() + place.to_bytes(8)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = 1_024, end_id: int = 0, shard_tokens: int = 400_000, shard_rows: int = 512, query_terms: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Texts of any length are encoded whole.
    Null and repeated ids are kept, each row as a document of its own; ties in score go to the document that comes first
    by id and content; other columns are left out; an empty table gives no pieces. Shards are runs of rows
    in the order of ``order_key``, so copies are split as well: one ends with the row that brings it to ``shard_tokens``
    tokens, or to ``shard_rows`` rows. A task holds one shard at a time, so at most so many tokens and one document. Neighbours outside the seed's shard are not looked at. A query has all of its document's terms, or the
    ``query_terms`` rarest.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_level_encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = [own.ids(t or "") + end for t in batch.column(1).to_pylist()]
            keys = [order_key(x, min_tokens(np.frombuffer(x, own.dtype)[:-1]), i, place + k) for k, (x, i) in enumerate(zip(ids, batch.column(0).to_pylist(), strict=True))]
            place += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], ["id", "ids", "key"])

    def one(table: pa.Table, shard: int) -> pa.RecordBatch:
        kept = byte_level_encoder(path).dtype
        table = table.sort_by([("id", "ascending"), ("ids", "ascending")])
        tokens = [np.frombuffer(x, kept) for x in table.column("ids").to_pylist()]
        pieces = pack_shard(tokens, window, query_terms)
        cut = [tokens[k][s : s + n].astype("<u4").tobytes() for k, s, n, _, _ in pieces]
        longs = lambda values: pa.array(values, pa.int64())
        columns = [
            table.column("id").combine_chunks().take(longs([p[0] for p in pieces])), longs([p[1] for p in pieces]), longs([p[2] for p in pieces]),
            longs([zlib.crc32(x) for x in cut]), longs([len(tokens[p[0]]) for p in pieces]), longs([(shard << SEQUENCE_BITS) + p[3] for p in pieces]), longs([p[4] for p in pieces]),
            *([pa.array(cut, pa.binary())] if with_ids else []),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", *PIECE, *(["ids"] if with_ids else [])])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << SHARD_BITS
        width = np.dtype(byte_level_encoder(path).dtype).itemsize
        held: list[pa.RecordBatch] = []
        rows = tokens = 0
        for batch in batches:
            sizes, at = (np.asarray(pc.binary_length(batch.column(1))) // width).tolist(), 0
            for k, size in enumerate(sizes):
                rows, tokens = rows + 1, tokens + size
                if rows >= shard_rows or tokens >= shard_tokens:
                    yield one(pa.Table.from_batches([*held, batch.slice(at, k + 1 - at)]), shard)
                    shard, held, rows, tokens, at = shard + 1, [], 0, 0, k + 1
            if at < len(batch):
                held.append(batch.slice(at))
        if held:
            yield one(pa.Table.from_batches(held), shard)

    encoded = stored(docs.select(named(id_col).alias("id"), named(text).alias("text")).mapInArrow(encode, f"id {kind}, ids binary, key binary"), "encoded")
    ordered = encoded.repartitionByRange("key").sortWithinPartitions("key").select("id", "ids")
    packed = ordered.mapInArrow(shards, f"id {kind}, {', '.join(f'{c} long' for c in PIECE)}" + ", ids binary" * with_ids)
    return packed.select(F.col("id").alias(id_col), *PIECE, *(["ids"] if with_ids else []))
