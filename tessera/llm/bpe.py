"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton over the vocabulary. A word is covered from left
to right with the longest token at each place; a token stays only if its boundary with the one before could also arise
from the merges (a memoised test on the two tokens alone). Otherwise the next shorter prefix is tried, and when none is
left the last token is taken back and its start barred. Each place is barred once at most, so the time is linear.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._vocab import CACHE_CHARS, CACHE_WORDS, pre_tokens, read_ranks
from tessera.llm._shared import add_columns, map_batches, named, quoted

#: Known token pairs that a worker keeps.
_PAIRS = 500_000


class BytePairEncoder:
    """Encoder and decoder for a rank file whose ids are its ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        #: per token its longest proper prefix that is a token, or -1
        self.shorter = [-1] * self.size
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        self._known: dict[int, bool] = {}
        self._merged: dict[tuple[int, int], int] = {}
        #: per token the two it was merged from last; a single byte gives itself
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(self.size)]
        for rank in sorted(ranks.values()):
            token, left = self.bytes_of[rank], self.shorter[rank]
            while left >= 0:
                right = ranks.get(token[len(self.bytes_of[left]) :], self.size)
                if left < rank and right < rank and self._may_meet(left, right):
                    self._merged[left, right], self.parts[rank] = rank, (left, right)
                    break
                left = self.shorter[left]
        self._words: dict[str, bytes] = {}

    def _may_meet(self, a: int, b: int) -> bool:
        """Whether the merges leave a boundary between tokens ``a`` and ``b``.

        Undoes the later of the two tokens' last merges step by step; a merge across the boundary must not come before
        the merge just undone.
        """
        parts, merged, limit = self.parts, self._merged, self.size + 1
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                return False
            whole_a, whole_b = parts[a][1] == a, parts[b][0] == b
            if whole_a and whole_b:
                return True
            if whole_b or (a > b and not whole_a):
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= _PAIRS:
                self._known.clear()
            known = self._known[key] = self._may_meet(a, b)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        rank = self.ranks.get(word)
        if rank is not None:
            return [rank]
        n = len(word)
        longest, length = [-1] * n, [0] * n
        for end, (rank, size) in self.automaton.iter(word.decode("latin-1")):
            start = end - size + 1
            if size > length[start]:
                longest[start], length[start] = rank, size
        free = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        place, token, sizes, shorter = 0, longest[0] if n else -1, self.bytes_of, self.shorter
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0:
                end = place + len(sizes[token])
                if free[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place = end
                token = longest[place] if place < n else -1
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                free[place] = 0
                out.pop()
                place -= len(sizes[last])
                token = last
        return out

    def word_ids(self, word: str) -> bytes:
        ids = self._words.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word.encode("utf-8")), "<u4").tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self._words) >= CACHE_WORDS:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        known, make = self._words.get, self.word_ids
        return b"".join([known(w) or make(w) for w in pre_tokens(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One per worker process."""
    return BytePairEncoder(read_ranks(path))


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id_col``, ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` for every row.

    A null text counts as empty and has no ids; texts of any length are read whole; rows keep null or repeated ids; other
    columns are left out; an empty table gives an empty result. No shuffle: each row is encoded where it is read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "ids", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(named(id_col), named(text)), run, f"{quoted(id_col)} {kind}, ids binary, n_tokens long")


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary), which replaces a column of that name; null ids give null, empty ones nothing."""

    def run(column: pa.Array) -> list[pa.Array]:
        own = encoder(vocabulary)
        return [pa.array([None if x is None else own.decode(x) for x in column.to_pylist()], pa.binary())]

    return add_columns(encoded, ids, run, {"decoded": "binary"})


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and the SHA-256 of the ids and of the bytes decoded from them, of every row.

    A null text counts as empty; an empty one has no ids; texts of any length are read whole. Null and repeated ids and
    repeated rows stay, alike; other columns are left out; an empty table gives an empty result. Encodes and decodes in
    one pass, so that a task has one worker with one vocabulary.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        counts, of_ids, of_text = [], [], []
        for t in batch.column(1):
            ids = own.encode(t.as_py() or "")
            counts.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(named(id_col), named(text)), run, f"{quoted(id_col)} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
