"""Topics of segment files as a data source, in batches and as a stream: only the segments that hold wanted offsets are
opened.

A topic is ``topics/<topic>/<first offset, 20 digits>.log`` with records ``u32 length, u32 crc32c, payload``, beside each
the byte places of its records (``.idx``, one u64 a record), and ``global.idx``, one u64 a message: the base of the
segment it lies in. All are little-endian. A message counts once ``global.idx`` names it; what a segment holds beyond
those is an orphan and isn't read. Bases never fall along ``global.idx``, so a message's segment, and the end of a
segment's run, are found by reads of single entries.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.functions.checksum import crc32c_many
from tessera.operators import topics as operators
from tessera.operators.topics import MAX_BATCH, MAX_FETCH, MAX_RECORDS, RECORD_HEAD, TopicError
from tessera.sources.splits import store_of

NAME = "tessera_topic"
SCHEMA = "topic string, offset long, segment_base long, payload binary, crc_ok boolean"
_SEGMENT = re.compile(r"^([0-9]{20})\.log$")
#: Session setting with which Spark hands filters to data sources in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Records that a task hands on at once.
_HANDED = 4_096


class TopicFiles:
    """The files of one topic."""

    def __init__(self, root: str, topic: str):
        self.topic = topic
        self.store, place = store_of(f"{root}/topics/{topic}")
        self.place = place.rstrip("/")

    def committed(self) -> int:
        """Number of messages."""
        info = self.store.get_file_info(f"{self.place}/global.idx")
        return info.size // 8 if info.type == fs.FileType.File else 0

    def base_of(self, offset: int) -> int:
        """Base of the segment that holds a message."""
        with self.store.open_input_file(f"{self.place}/global.idx") as f:
            return _entry(f, offset)

    def end_of(self, base: int, most: int) -> int:
        """The offset after the last message of the segment, ``most`` at most; ``base`` itself if the index doesn't name
        it. A binary search over the entries."""
        with self.store.open_input_file(f"{self.place}/global.idx") as f:
            if base >= most or _entry(f, base) != base:
                return base
            low, high = base, most  # the entry at low is the segment's, that at high is not
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if _entry(f, middle) == base else (low, middle)
            return high

    def bases(self) -> list[int]:
        """Bases of the segments there are, ascending."""
        names = (_SEGMENT.match(i.base_name) for i in self.store.get_file_info(fs.FileSelector(self.place, allow_not_found=True)) if i.type == fs.FileType.File)
        return sorted(int(m[1]) for m in names if m)

    def records(self, base: int, first: int, until: int, most_bytes: int | None = None) -> Iterator[tuple[int, bytes, int]]:
        """``(offset, payload, checksum)`` of the segment's messages from ``first`` on and before ``until``; with
        ``most_bytes`` none begins after so many bytes, heads included. Starts at the record's place, by the segment's own
        index or else from head to head."""
        index = f"{self.place}/{base:020}.idx"
        with self.store.open_input_file(f"{self.place}/{base:020}.log") as f:
            at, known = base, 0
            if first > base and self.store.get_file_info(index).type == fs.FileType.File:
                with self.store.open_input_file(index) as i:
                    if i.size() >= 8 * (first - base + 1):
                        at, known = first, _entry(i, first - base)
            f.seek(known)
            read = 0
            while at < until and (most_bytes is None or read <= most_bytes):
                head = f.read(8)
                size, crc = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
                if at < first:
                    f.seek(size, 1)
                    payload = b""
                else:
                    payload = f.read(size)
                if len(head) < 8 or at >= first and len(payload) < size:
                    raise ValueError(f"truncated record {at} of {self.topic}")
                if at >= first:
                    read += RECORD_HEAD + size
                    yield at, payload, crc
                at += 1


def _entry(f: pa.NativeFile, k: int) -> int:
    f.seek(8 * k)
    return struct.unpack("<Q", f.read(8))[0]


@dataclass
class Span(InputPartition):
    """Wanted messages of one segment."""

    base: int
    first: int
    until: int


class _Segments:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.root, self.topic, self.on_error = options["root"], options["topic"], options.get("on_error", "fail")
        self.most_bytes = int(options["most_bytes"]) if "most_bytes" in options else None

    def spans(self, first: int, until: int) -> list[Span]:
        """A span for every segment from that of ``first`` on; ``until`` is within what is committed."""
        if first >= until:
            return []
        files = TopicFiles(self.root, self.topic)
        low = files.base_of(first)
        return [Span(b, max(b, first), until) for b in files.bases() if low <= b < until]

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # what Spark gives where there are no spans
            return
        files = TopicFiles(self.root, self.topic)
        held: list[tuple[int, bytes, int]] = []

        def full() -> pa.RecordBatch:
            offsets, payloads, crcs = zip(*held, strict=True)
            ok = [int(c) == e for c, e in zip(crc32c_many(list(payloads)), crcs, strict=True)]
            if self.on_error == "fail" and not all(ok):
                raise ValueError(f"checksum mismatch at record {offsets[ok.index(False)]} of {self.topic}")
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([self.topic] * n), pa.array(offsets, pa.int64()), pa.array([span.base] * n, pa.int64()), pa.array(payloads, pa.binary()), pa.array(ok)], ["topic", "offset", "segment_base", "payload", "crc_ok"])

        end = files.end_of(span.base, span.until)
        if end > span.first:
            for record in files.records(span.base, span.first, end, self.most_bytes):
                held.append(record)
                if len(held) == _HANDED:
                    yield full()
                    held = []
        if held:
            yield full()


class TopicReader(_Segments, DataSourceReader):
    """Batch reader of the messages from option ``start`` on and before ``until``."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.first, self.until = int(options.get("start", 0)), int(options["until"]) if "until" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        n = TopicFiles(self.root, self.topic).committed()
        return self.spans(self.first, n if self.until is None else min(n, self.until))


class FilteredTopicReader(TopicReader):
    """Filters on ``offset`` narrow what is read. Spark takes it only in sessions with ``PUSHDOWN``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("offset",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.until = end if self.until is None else min(self.until, end)
            yield f  # Spark looks again


class TopicStreamReader(_Segments, DataSourceStreamReader):
    """Stream reader; its position is the number of messages that were read."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.first = int(options.get("start", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": max(self.first, TopicFiles(self.root, self.topic).committed())}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.spans(start["offset"], end["offset"])


class TopicSource(DataSource):
    """Options ``root`` and ``topic``; ``on_error``, ``fail`` or ``flag`` for wrong checksums; ``start``, ``until`` and
    ``most_bytes`` bound a batch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        options = dict(self.options)
        return FilteredTopicReader(options) if options.get("pushdown") == "true" else TopicReader(options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return TopicStreamReader(dict(self.options))


def _options(root: str, topic: str, on_error: str, **more: int | None) -> dict[str, str]:
    if on_error not in ("fail", "flag"):
        raise ValueError("on_error is 'fail' or 'flag'")
    return {"root": root, "topic": topic, "on_error": on_error} | {k: str(v) for k, v in more.items() if v is not None}


def read_topic(spark: SparkSession, root: str, topic: str, start: int = 0, until: int | None = None, most_bytes: int | None = None, on_error: str = "fail") -> DataFrame:
    """``(topic, offset, segment_base, payload, crc_ok)`` of the committed messages from ``start`` on and before ``until``.

    Segments before that of ``start`` aren't opened, and in its own the read begins at its place. Each segment is a task;
    with ``most_bytes`` a task reads no record that begins beyond so many bytes of its share. In a session with
    ``PUSHDOWN``, filters on ``offset`` do what ``start`` and ``until`` do."""
    if start < 0:
        raise TopicError("an offset is 0 or more")
    spark.dataSource.register(TopicSource)
    return spark.read.format(NAME).options(**_options(root, topic, on_error, start=start, until=until, most_bytes=most_bytes), pushdown=spark.conf.get(PUSHDOWN, "false")).load()


def stream_topic(spark: SparkSession, root: str, topic: str, start: int = 0, on_error: str = "fail") -> DataFrame:
    """The topic as a stream, from ``start`` on; a query with a checkpoint goes on after the last message it has read."""
    spark.dataSource.register(TopicSource)
    return spark.readStream.format(NAME).options(**_options(root, topic, on_error, start=start)).load()


def fetch_from(spark: SparkSession, root: str, topic: str, offset: int, max_bytes: int = MAX_FETCH, max_records: int = MAX_RECORDS) -> DataFrame:
    """``fetch`` from a topic's files: opens the segments of its at most ``max_records`` messages alone."""
    if offset < 0 or min(max_bytes, max_records) <= 0:
        raise TopicError("an offset is 0 or more and a limit is over 0")
    n = min(max_records, MAX_RECORDS)
    log = read_topic(spark, root, topic, offset, offset + n, min(max_bytes, MAX_FETCH) + n * RECORD_HEAD)
    return operators.fetch(log, topic, offset, max_bytes, max_records)


def fetch_batch_from(spark: SparkSession, root: str, topic: str, offset: int, max_bytes: int = MAX_BATCH) -> DataFrame:
    """``fetch_batch`` from a topic's files: opens one segment, and reads no more of it than the batch and a record."""
    if offset < 0 or max_bytes <= 0:
        raise TopicError("an offset is 0 or more and a limit is over 0")
    most, files = min(max_bytes, MAX_BATCH), TopicFiles(root, topic)
    n = files.committed()
    end = min(offset + most // RECORD_HEAD + 1, files.end_of(files.base_of(offset), n)) if offset < n else offset
    return operators.fetch_batch(read_topic(spark, root, topic, offset, end, most), topic, offset, max_bytes)


def resume_from(spark: SparkSession, root: str, offsets: DataFrame, group: str, topic: str) -> DataFrame:
    """``(offset, payload)`` from the group's committed offset on; segments before it aren't opened."""
    return read_topic(spark, root, topic, operators.committed_offset(offsets, group, topic)).select("offset", "payload").orderBy(F.col("offset"))
