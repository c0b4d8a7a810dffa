"""Structured Streaming forms of the topic tail, the line slice and the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.lines import slice_condition
from tessera.operators.vectors import decode_payloads, normalize, resolve_ids


def stream_vectors(stream: DataFrame, delta_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Decode payloads ``(auto_id, payload)`` as they come and write vectors under ``delta_path/batch=<id>``.

    A batch that runs again replaces its own folder, so each payload is written once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_payloads(batch)
        good = F.when(F.col("ok"), F.col("vector")).otherwise(F.raise_error(F.lit("bad payload")))
        normalize(resolve_ids(decoded).select("doc_id", good.alias("vector"))).write.mode("overwrite").parquet(f"{delta_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_slice(stream: DataFrame, **how: object) -> DataFrame:
    """Lines that match, as they come; takes what ``slice_condition`` takes."""
    return stream.where(slice_condition(**how))


def stream_fold(ops: DataFrame) -> DataFrame:
    """The deciding operation on each atom or pair so far: ``(kind, name, a, b, op)``.

    In complete mode each result holds the whole state, in update mode what changed; keep the rows whose ``op`` adds.
    """
    return ops.groupBy(F.substring("op", 1, 1).alias("kind"), "name", "a", F.coalesce("b", F.lit("")).alias("b")).agg(F.max_by("op", "seq").alias("op"))
