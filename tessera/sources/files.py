"""Sources over files: listings, documents, lines, payload folders, topic segments, facts and key-value dumps.

Listings and reads go through ``pyarrow.fs``, so a root may be any address it knows (``file:``, ``hdfs:``, ``s3:``);
Spark's own listing leaves out hidden and empty files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.checksum import crc32c_many
from tessera.operators.ids import dense_ids
from tessera.operators.keyed import as_int
from tessera.operators.lines import FACTS_MAX, SLICE_MAX
from tessera.operators.relations import parse_facts
from tessera.session import written
from tessera.sources.splits import MOST_TASKS, SPLIT, split_lines, store_of

#: Extensions of documents, folders that are skipped, and the most bytes of a document.
EXTENSIONS = (".md", ".txt", ".jsonl", ".py", ".go", ".rs", ".js", ".ts", ".cpp", ".hpp", ".c", ".h", ".zig", ".asm", ".sh")
SKIPPED = ("node_modules", "__pycache__")
MAX_DOCUMENT = 16 << 20
#: Files, or bytes of files, that a task reads or lists one after another; entries of an index that a task reads.
FILES_EACH, BYTES_EACH, ENTRIES_EACH = 64, 64 << 20, 1 << 20


def _tasks(files: int, size: int = 0) -> int:
    """Tasks for so many files of so many bytes together."""
    return max(1, min(max(-(-files // FILES_EACH), -(-size // BYTES_EACH)), files, MOST_TASKS))


def list_files(spark: SparkSession, root: str, skip_hidden: bool = False) -> DataFrame:
    """``(path, is_dir, length)`` of everything below ``root``, paths relative with ``/``; links aren't followed.

    The tree is walked level by level: a round lists the folders of one level, each in one of many tasks and in batches,
    and is stored; its folders are the next round's. So a large subtree is spread however it lies.
    """
    schema = "path string, is_dir boolean, length long"
    store, base = store_of(root)
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"{root} is no folder")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = store_of(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for i in own.get_file_info(fs.FileSelector(f"{place}/{folder}" if folder else place)):
                    is_dir, name = i.type == fs.FileType.Directory, i.base_name
                    hidden = is_dir and skip_hidden and (name.startswith(".") or name in SKIPPED)
                    if not hidden and i.type in (fs.FileType.Directory, fs.FileType.File):
                        rows.append((f"{folder}/{name}" if folder else name, is_dir, 0 if is_dir else i.size))
                for k in range(0, len(rows), 10_000):
                    some = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in some], pa.string()), "is_dir": pa.array([r[1] for r in some], pa.bool_()), "length": pa.array([r[2] for r in some], pa.int64())})

    level = spark.createDataFrame([("",)], "path string")
    found: DataFrame | None = None
    while True:
        listed = written(level.mapInArrow(walk, schema), "listing")
        found = listed if found is None else found.unionByName(listed)
        folders = listed.where("is_dir").select("path")
        n = folders.count()
        if not n:
            return found
        level = folders.repartition(_tasks(n))  # by number: the rows are small, and each is a call to the store


def read_contents(listing: DataFrame, root: str) -> DataFrame:
    """``(path, content, length)`` of the files listed as ``(path, length)``, read in tasks that get a bounded share each."""
    all_ = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    data = f.read()
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([data], pa.binary()), "length": pa.array([len(data)], pa.int64())})

    return listing.select("path").repartition(_tasks(all_["n"], all_["size"])).mapInArrow(run, "path string, content binary, length long")


def write_files(files: DataFrame, root: str) -> None:
    """Write ``(path, content)`` as files below ``root``. A file gets a name of its own and then its place, so that a task
    may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                fresh = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(fresh, compression=None) as out:
                    out.write(content or b"")
                store.move(fresh, f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content, length)`` of the documents below ``root``; one over 16 MiB is an error."""
    files = list_files(spark, root, skip_hidden=True).where(~F.col("is_dir"))
    # what a name has from its last dot on, unless that dot begins it
    files = files.where(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1).isin(*EXTENSIONS))
    checked = F.when(F.col("length") > MAX_DOCUMENT, F.raise_error(F.concat(F.lit("document too large: "), F.col("path")))).otherwise(F.col("path"))
    return read_contents(files.select(checked.alias("path"), "length"), root)


def _files_at(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, length)`` of the files given and of those below the folders given, hidden ones (``_``, ``.``) left out."""
    found, single = None, []
    for given in [paths] if isinstance(paths, str) else paths:
        store, place = store_of(given)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{given} isn't there")
        if info.type == fs.FileType.File:
            single.append((given, info.size))
            continue
        below = list_files(spark, given).where(~F.col("is_dir") & ~F.col("path").rlike("(^|/)[_.]")).select(F.concat(F.lit(given.rstrip("/") + "/"), "path").alias("path"), "length")
        found = below if found is None else found.unionByName(below)
    own = spark.createDataFrame(single, "path string, length long")
    return own if found is None else found.unionByName(own)


def scan_lines(spark: SparkSession, paths: str | list[str], max_len: int | None = SLICE_MAX, split_bytes: int = SPLIT) -> DataFrame:
    """``(path, line_no, line)`` of text files of any size, and ``seq``, the line's number over all files in path order.

    Files are read over ranges of ``split_bytes`` bytes, each in a task of its own. Lines are split at line feeds alone
    and numbered from 1; those over ``max_len`` bytes are left out and still count.
    """
    return split_lines(_files_at(spark, paths), max_len, split_bytes).select("path", "line_no", "line", "seq")


def scan_payload_dir(spark: SparkSession, root: str) -> DataFrame:
    """``(auto_id, name, payload)``: one payload a file, numbered from 0 in name order."""
    listing = list_files(spark, root).where(~F.col("is_dir") & ~F.col("path").contains("/"))
    return dense_ids(read_contents(listing, root), ["path"], "auto_id").select("auto_id", F.col("path").alias("name"), F.col("content").alias("payload"))


def scan_topic(spark: SparkSession, root: str, topic: str, on_error: str = "fail") -> DataFrame:
    """``(topic, offset, segment_base, payload, crc_ok)`` of a topic's segments in name order.

    Records are ``u32 length, u32 crc32c, payload``, little-endian. A record that is cut short is an error; a wrong
    checksum is one too unless ``on_error`` is ``flag``. Offsets count through the segments from 0.
    """
    if on_error not in ("fail", "flag"):
        raise ValueError("on_error is 'fail' or 'flag'")
    base = f"{root}/topics/{topic}"
    segments = list_files(spark, base).where(~F.col("is_dir") & F.col("path").rlike(r"^[0-9]{20}\.log$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{place}/{path}", compression=None) as f:
                    at, rows, crcs = 0, [], []

                    def full(at: int = 0) -> pa.RecordBatch:
                        ok = [int(c) == e for c, e in zip(crc32c_many(rows), crcs, strict=True)]
                        if on_error == "fail" and not all(ok):
                            raise ValueError(f"checksum mismatch in {path}")
                        return pa.RecordBatch.from_pydict({"segment_base": pa.array([int(path[:20])] * len(rows), pa.int64()), "at": pa.array(range(at - len(rows), at), pa.int64()), "payload": pa.array(rows, pa.binary()), "crc_ok": pa.array(ok, pa.bool_())})  # noqa: B023

                    while head := f.read(8):
                        size, crc = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
                        payload = f.read(size) if len(head) == 8 else b""
                        if len(head) < 8 or len(payload) < size:
                            raise ValueError(f"truncated record in {path}")
                        rows.append(payload)
                        crcs.append(crc)
                        at += 1
                        if len(rows) == 4_096:
                            yield full(at)
                            rows, crcs = [], []
                    yield full(at)

    # stored, as the counts and the records both read it
    dealt = segments.select("path").repartition(max(1, min(segments.count(), MOST_TASKS)))
    records = written(dealt.mapInArrow(run, "segment_base long, at long, payload binary, crc_ok boolean"), "records")
    counts = records.groupBy("segment_base").count()  # one row a segment
    before = F.coalesce(F.sum("count").over(Window.orderBy("segment_base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("segment_base", before.alias("first"))
    return records.join(first, "segment_base").select(F.lit(topic).alias("topic"), (F.col("first") + F.col("at")).alias("offset"), "segment_base", "payload", "crc_ok")


def scan_global_index(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """``(topic, offset, segment_base)``: the entries of ``global.idx``, one little-endian u64 a message, read over ranges."""
    store, place = store_of(f"{root}/topics/{topic}/global.idx")
    info = store.get_file_info(place)
    n = info.size // 8 if info.type == fs.FileType.File else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, path = store_of(f"{root}/topics/{topic}/global.idx")
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with own.open_input_file(path) as f:
                    f.seek(8 * first)
                    bases = np.frombuffer(f.read(8 * min(ENTRIES_EACH, n - first)), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_pydict({"offset": pa.array(np.arange(first, first + len(bases))), "segment_base": pa.array(bases)})

    ranges = -(-n // ENTRIES_EACH)
    return spark.range(0, n, ENTRIES_EACH, max(1, min(ranges, MOST_TASKS))).mapInArrow(run, "offset long, segment_base long").select(F.lit(topic).alias("topic"), "offset", "segment_base")


def scan_facts(spark: SparkSession, path: str) -> DataFrame:
    """Operations of facts files, with ``bad`` for lines that break a rule; of several files in path order."""
    return parse_facts(scan_lines(spark, path, FACTS_MAX))


def load_kv(spark: SparkSession, path: str) -> DataFrame:
    """``(key, kind, int_value, str_value)`` from a dump; comments, short lines, unknown tags and bad numbers are skipped.

    The last line of a key counts; over several files, in path order.
    """
    w = F.split("line", " ", 3)
    rows = scan_lines(spark, path, None).where(~F.col("line").startswith("#")).select("seq", F.get(w, F.lit(0)).alias("tag"), F.get(w, F.lit(1)).alias("key"), F.get(w, F.lit(2)).alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ((F.col("tag") == "S") | ((F.col("tag") == "I") & as_int(F.col("value")).isNotNull())))
    last = rows.groupBy("key").agg(F.max(F.struct("seq", "tag", "value")).alias("r"))
    number = F.col("r.tag") == "I"
    return last.select("key", F.when(number, "int").otherwise("string").alias("kind"), F.when(number, as_int(F.col("r.value"))).alias("int_value"), F.when(~number, F.col("r.value")).alias("str_value"))


def save_kv(kv: DataFrame, path: str) -> None:
    kv.select(F.concat_ws(" ", F.when(F.col("kind") == "int", "I").otherwise("S"), "key", F.coalesce(F.col("int_value").cast("string"), "str_value")).alias("line")).write.text(path)


def save_facts(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)


def path_summary(listing: DataFrame) -> DataFrame:
    """One row ``(files, dirs, bytes)`` of a listing."""
    return listing.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("length"))), F.lit(0)).cast("long").alias("bytes"))


def path_rollup(listing: DataFrame) -> DataFrame:
    """``(dir, ext, files, bytes)`` with subtotals by folder and in all (nulls)."""
    rows = listing.where(~F.col("is_dir")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"), "length")
    return rows.rollup("dir", "ext").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_topic(log: DataFrame, root: str) -> None:
    """Write ``(topic, offset, segment_base, payload)`` as segments, each with its index, and ``global.idx`` files that
    ``scan_topic`` and ``topics.read_topic`` read.

    A segment is written by one task under a name of its own and then put in place, so a task may run again.
    """

    def put(group: pa.Table, file: str, data: Iterator[bytes]) -> pa.Table:
        topic = group.column("topic")[0].as_py()
        store, place = store_of(f"{root}/topics/{topic}")
        store.create_dir(place, recursive=True)
        fresh = f"{place}/{file}.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh, compression=None) as out:
            for part in data:
                out.write(part)
        store.move(fresh, f"{place}/{file}")
        return pa.table({"file": pa.array([f"{topic}/{file}"])})

    def segment(group: pa.Table) -> pa.Table:
        payloads = group.sort_by("offset").column("payload").to_pylist()
        ends = list(accumulate((8 + len(p) for p in payloads), initial=0))
        put(group, f"{group.column('segment_base')[0].as_py():020}.idx", (struct.pack("<Q", at) for at in ends[:-1]))
        parts = (struct.pack("<II", len(p), int(c)) + p for p, c in zip(payloads, crc32c_many(payloads), strict=True))
        return put(group, f"{group.column('segment_base')[0].as_py():020}.log", parts)

    def index(group: pa.Table) -> pa.Table:
        rows = group.sort_by("segment_base").to_pylist()
        return put(group, "global.idx", (struct.pack("<Q", r["segment_base"]) * r["n"] for r in rows))

    rows = log.select("topic", "offset", "segment_base", "payload")
    rows.groupBy("topic", "segment_base").applyInArrow(segment, "file string").write.format("noop").mode("overwrite").save()
    counts = rows.groupBy("topic", "segment_base").agg(F.count("*").alias("n"))  # one row a segment
    counts.groupBy("topic").applyInArrow(index, "file string").write.format("noop").mode("overwrite").save()
