"""Importance resampling of documents towards a target distribution of hashed n-grams.

Texts are scanned as UTF-8 bytes: ``A``-``Z`` are lower-cased, separators collapse to single spaces, and an overlapped
regular expression with look-around boundaries emits the span of every run of ``1 .. max_words`` words, whose bytes are
counted by CRC-32 into buckets. Bucket totals of all documents and of the target give every bucket a gain, the scaled
logarithm of its smoothed density ratio; a document's weight is the sum of gains over its features. Weights with Gumbel
noise from a hash of the id are ranked, which draws without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, map_batches, named, stored, workspace
from tessera.operators.ids import dense_ids

#: Every byte below 128 that isn't a digit or a letter becomes a space; letters are lower-cased.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = regex.compile(rb"  +")
#: Features whose buckets are held before they are packed; bounds the memory for very long texts.
_HELD = 1 << 20


def collapsed(text: bytes) -> bytes:
    """The words of a text, each with one space on either side."""
    return _SPACES.sub(b" ", b" " + text.translate(_CLEAN) + b" ")


def patterns(max_words: int) -> list[regex.Pattern]:
    """For every number of words the pattern of such a run in a collapsed text; to be scanned with overlaps."""
    return [regex.compile(rb"(?<= )[^ ]++" + (rb"(?: [^ ]++){%d}" % (n - 1) if n > 1 else b"") + rb"(?= )") for n in range(1, max_words + 1)]


def features(text: bytes, orders: list[regex.Pattern]) -> Iterator[Iterator[regex.Match]]:
    """For every order the spans of its features in a collapsed text, one by one."""
    return (pattern.finditer(text, overlapped=True) for pattern in orders)


def bucket_rows(text: bytes | None, orders: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature with repeats, in scan order."""
    found, words, crc = [np.zeros(0, np.uint32)], 0, zlib.crc32
    for order, spans in enumerate(features(collapsed(text or b""), orders)):
        while held := [crc(m[0]) for m in islice(spans, _HELD)]:
            found.append(np.array(held, np.uint32) % np.uint32(buckets))
            words += len(held) * (order == 0)
    return words, np.concatenate(found)


def featurize(docs: DataFrame, text: str, carry: dict[str, Column], max_words: int, buckets: int) -> DataFrame:
    """The ``carry`` columns, ``n_words, n_features`` (long) and ``buckets``, the sorted buckets of all features in 4 bytes
    each. A null text has no words."""
    names = list(carry)
    rows = docs.select(*(c.alias(n) for n, c in carry.items()), named(text).cast("string").cast("binary").alias("__text"))
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = patterns(max_words)
        for batch in batches:
            words, sizes, packed, held = [], [], [], 0

            def full(end: int) -> pa.RecordBatch:
                own = batch.slice(end - len(words), len(words))  # noqa: B023
                return pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], [*names, "n_words", "n_features", "buckets"])  # noqa: B023

            for k, t in enumerate(batch.column(len(names))):
                n, found = bucket_rows(t.as_py(), orders, buckets)
                words.append(n)
                sizes.append(len(found))
                held += len(found)
                packed.append(np.sort(found).astype("<u4").tobytes())
                if held >= _HELD:
                    yield full(k + 1)
                    words, sizes, packed, held = [], [], [], 0
            yield full(len(batch))

    return rows.mapInArrow(run, ", ".join([*kinds, "n_words long", "n_features long", "buckets binary"]))


def totals(features: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all features; a task adds up its own rows first and gives a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                sums += np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket: ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` in doubles. The ``buckets``
    rows of either total come to the driver, whatever the corpus."""
    count = np.zeros((2, buckets))
    for k, df in enumerate((source, target)):
        for r in df.collect():
            count[k, r["bucket"]] = r["n"]
    (s, t), (S, T) = count, count.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).astype(np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2**32)))`` with ``h`` the first 8 hexadecimal digits of ``sha256("seed:id")``; a null
    id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 10, min_words: int = 20, max_words: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` (long) of every document; ``rank`` is null where it isn't drawn.

    Of the ``N`` documents with ``min_words`` words or more, the ``percent * N // 100`` highest scores are drawn; ties go
    to the smaller id, null ids last, and rows alike in both are drawn in either order. A null or empty text has no
    features and weight 0. Texts of any length are scanned whole; repeated rows are documents of their own; other columns
    are left out; an empty table gives an empty result, and an empty target counts as one of no words. Features are
    scanned once and stored, 4 bytes each; totals, gains and the count are over all rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with workspace(docs.sparkSession, "resampling") as folder:
        scanned = stored(featurize(docs, text, {"id": named(id_col)}, max_words, buckets), "features")
        gain = gains(totals(scanned, buckets), totals(featurize(target, target_text, {}, max_words, buckets), buckets), buckets)

        def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
            weights = [int(gain[np.frombuffer(raw.as_buffer(), "<u4")].sum()) for raw in batch.column(3)]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

        weighed = map_batches(scanned, weigh, f"id {kind}, n_words long, n_features long, weight long")
        # the place splits rows that are alike in everything else over the ranges
        scored = stored(weighed.select("*", (F.col("weight") + gumbel("id", seed)).alias("score"), F.monotonically_increasing_id().alias("place")), "scored")
        able = F.col("n_words") >= min_words
        draw = percent * scored.where(able).count() // 100
        ranked = dense_ids(scored.where(able), [F.desc("score"), F.asc_nulls_last("id"), F.col("place")], "rank", 1)
        out = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    # outside the workspace, so that features and scores can go
    out = stored(out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank"), "drawn")
    discard(docs.sparkSession, folder)
    return out
