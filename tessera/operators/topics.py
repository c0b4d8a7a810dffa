"""Append-only topic logs ``(topic, offset, payload)`` with segments and consumer offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import valid_topic
from tessera.operators.ids import dense_ids

#: Most bytes of a payload; of a fetch and a batch fetch; most records of a fetch; bytes of a record's head.
MAX_PAYLOAD, MAX_FETCH, MAX_BATCH, MAX_RECORDS, RECORD_HEAD = 4_096, 8_192, 1 << 20, 64, 8


class TopicError(ValueError):
    """A topic, payload, offset or limit that breaks a rule."""


def append(log: DataFrame, new_rows: DataFrame, seq: str = "seq") -> DataFrame:
    """``(topic, offset, payload)`` of the new rows ``(seq, topic, payload)``, numbered after what each topic has.

    Numbers come from one dense order over topic and ``seq``, so a topic with most of the rows isn't one task's work.
    """
    bad = new_rows.agg(F.count_if(~valid_topic("topic")).alias("names"), F.count_if(F.octet_length("payload") > MAX_PAYLOAD).alias("sizes")).first()
    if bad["names"] or bad["sizes"]:
        raise TopicError(f"{bad['names']} bad topic names, {bad['sizes']} payloads over {MAX_PAYLOAD} bytes")
    numbered = dense_ids(new_rows.select("topic", F.col(seq).alias("__seq"), "payload"), ["topic", "__seq"], "__n")
    first = numbered.groupBy("topic").agg(F.min("__n").alias("__first"))
    ends = log.groupBy("topic").agg(F.max("offset").alias("__end"))
    base = first.join(ends, "topic", "left").select("topic", (F.coalesce("__end", F.lit(-1)) + 1 - F.col("__first")).alias("__shift"))
    return numbered.join(base, "topic").select("topic", (F.col("__n") + F.col("__shift")).alias("offset"), "payload")


def committed(log: DataFrame, global_index: DataFrame) -> DataFrame:
    """Records that the global index names in their own segment; what follows these is an orphan."""
    return log.join(global_index.select("topic", "offset", "segment_base"), ["topic", "offset", "segment_base"], "left_semi")


def _from(log: DataFrame, topic: str, offset: int, limit: int) -> DataFrame:
    if offset < 0 or limit <= 0:
        raise TopicError("an offset is 0 or more and a limit is over 0")
    return log.where((F.col("topic") == topic) & (F.col("offset") >= offset))


def _while_fits(rows: DataFrame, offset: int, size, max_bytes: int) -> DataFrame:  # noqa: ANN001
    """The run of rows from ``offset`` on whose summed size stays within ``max_bytes``; nothing if ``offset`` is missing."""
    w = Window.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)  # over few rows, cut before
    run = rows.withColumn("__sum", F.sum(size).over(w)).withColumn("__first", F.min("offset").over(Window.partitionBy()))
    return run.where((F.col("__sum") <= max_bytes) & (F.col("__first") == offset)).drop("__sum", "__first")


def fetch(log: DataFrame, topic: str, offset: int, max_bytes: int = MAX_FETCH, max_records: int = MAX_RECORDS) -> DataFrame:
    """``(offset, payload)`` from ``offset``, up to the record that would pass the bytes or the number."""
    few = _from(log, topic, offset, min(max_bytes, max_records)).select("offset", "payload").orderBy("offset").limit(min(max_records, MAX_RECORDS))
    return _while_fits(few, offset, F.octet_length("payload"), min(max_bytes, MAX_FETCH))


def fetch_batch(log: DataFrame, topic: str, offset: int, max_bytes: int = MAX_BATCH) -> DataFrame:
    """``(offset, payload)`` from ``offset`` within its segment, counting each record's head."""
    most = min(max_bytes, MAX_BATCH)
    rows = _from(log, topic, offset, max_bytes)
    start = rows.where(F.col("offset") == offset).select("segment_base").first()
    if start is None:
        return rows.select("offset", "payload").limit(0)
    few = rows.where(F.col("segment_base") == start[0]).select("offset", "payload").orderBy("offset").limit(most // RECORD_HEAD + 1)
    return _while_fits(few, offset, F.octet_length("payload") + RECORD_HEAD, most)


def replay(log: DataFrame, topic: str, from_offset: int = 0) -> DataFrame:
    """``(offset, payload)`` of the whole topic from an offset, in order."""
    return _from(log, topic, from_offset, 1).select("offset", "payload").orderBy("offset")


def commit(offsets: DataFrame, group: str, topic: str, offset: int) -> DataFrame:
    """``offsets(group, topic, offset, seq)`` with one more row; the last one counts, whatever its offset."""
    if offset < 0:
        raise TopicError("a negative offset")
    seq = offsets.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("n")).first()["n"]
    return offsets.unionByName(offsets.sparkSession.createDataFrame([(group, topic, offset, seq)], offsets.select("group", "topic", "offset", "seq").schema))


def committed_offsets(offsets: DataFrame) -> DataFrame:
    """``(group, topic, offset)``: the last commit of each."""
    return offsets.groupBy("group", "topic").agg(F.coalesce(F.max_by("offset", "seq"), F.lit(0)).alias("offset"))


def committed_offset(offsets: DataFrame, group: str, topic: str) -> int:
    """The last commit; 0 if there is none."""
    r = committed_offsets(offsets.where((F.col("group") == group) & (F.col("topic") == topic))).first()
    return r["offset"] if r else 0


def read_from_group(log: DataFrame, offsets: DataFrame, group: str, topic: str) -> DataFrame:
    return replay(log, topic, committed_offset(offsets, group, topic))
