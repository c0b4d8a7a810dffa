"""Lines of files of any size, read over byte ranges.

A file is cut into splits. A line belongs to the split in which it begins: a task skips what runs into its range, and
reads on past the end for its last line. Every split's number of lines is counted first; sums over the splits before it
give its first line's number in the file and over all files, so numbers are those of a plain scan. A task holds one
block of a file and its open line.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

#: Bytes of a split, of a read, and of the lines that a task hands on at once.
SPLIT, BLOCK, HANDED = 64 << 20, 4 << 20, 8 << 20
#: Most tasks that a scan is dealt to; a task then reads several splits, one after another.
MOST_TASKS = 20_000


def store_of(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def lines_from(f: BinaryIO, start: int, end: int, max_len: int | None = None, block: int = BLOCK) -> Iterator[bytes | None]:
    """The lines that begin at ``start`` or later and before ``end``; None for one over ``max_len`` bytes, of which no more
    than that and a block is held. What follows the last line feed is a line only if it isn't empty."""
    f.seek(max(start - 1, 0))
    at, open_ = max(start - 1, 0), start == 0  # whether what is read belongs to a line of this split
    held: list[bytes] = []
    size = 0
    while data := f.read(block):
        parts = data.split(b"\n")
        for part in parts[:-1]:
            if open_:
                yield None if max_len is not None and size + len(part) > max_len else b"".join([*held, part]) if held else part
            held, size, at = [], 0, at + len(part) + 1
            if at >= end:
                return
            open_ = True
        at += len(parts[-1])
        if open_ and parts[-1]:
            size += len(parts[-1])
            held = [*held, parts[-1]] if max_len is None or size <= max_len else []
    if open_ and size:
        yield None if max_len is not None and size > max_len else b"".join(held)


def _dealt(rows: DataFrame, splits: int) -> DataFrame:
    """Rows by number, not by size: there are few, and each is a task's work."""
    return rows.repartition(max(1, min(splits, MOST_TASKS)))


def split_lines(files: DataFrame, max_len: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """``(path, line_no, seq, line)`` of the files ``(path, length)``, whose paths are addresses: lines end at line feeds
    alone, ``line_no`` counts from 1 in its file and ``seq`` from 1 over all files in path order. Lines over ``max_len``
    bytes are left out and still count."""
    files = files.where(F.col("length") > 0).select("path", "length")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / split_bytes)))
    splits = files.select("path", "length", cut.alias("k")).select("path", (F.col("k") * split_bytes).alias("start"), F.least("length", (F.col("k") + 1) * split_bytes).alias("end"))
    total = files.agg(F.sum(F.floor((F.col("length") - 1) / split_bytes) + 1).alias("n")).first()["n"] or 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = store_of(path)
                n, left = int(start == 0), end - 1 - max(start - 1, 0)
                with store.open_input_file(place) as f:
                    f.seek(max(start - 1, 0))
                    while left > 0 and (data := f.read(min(left, BLOCK))):
                        n, left = n + data.count(b"\n"), left - len(data)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["path", "start", "end", "n"])

    counted = written(_dealt(splits, total).mapInArrow(count, "path string, start long, end long, n long"), "splits")
    # windows over a row a split of a file, and over a row a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_files = counted.groupBy("path").agg(F.sum("n").alias("n")).select("path", ahead.alias("ahead"))
    numbered = counted.select("path", "start", "end", before.alias("before")).join(of_files, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, before, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = store_of(path)
                numbers: list[int] = []
                lines: list[bytes] = []

                def full() -> pa.RecordBatch:
                    no = pa.array(numbers, pa.int64())  # noqa: B023
                    return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(no)), "line_no": no, "ahead": pa.array([ahead] * len(no), pa.int64()), "line": pa.array(lines, pa.binary())})  # noqa: B023

                with store.open_input_file(place) as f:
                    size = 0
                    for k, line in enumerate(lines_from(f, start, end, max_len)):
                        if line is not None:
                            numbers.append(before + k + 1)
                            lines.append(line)
                            size += len(line) + 64
                        if size >= HANDED:
                            yield full()
                            numbers, lines, size = [], [], 0
                    yield full()

    rows = _dealt(numbered, total).mapInArrow(read, "path string, line_no long, ahead long, line binary")
    return rows.select("path", "line_no", (F.col("ahead") + F.col("line_no")).alias("seq"), F.col("line").cast("string").alias("line"))
