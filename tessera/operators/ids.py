"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

_MASK = (1 << 33) - 1


def dense_ids(df: DataFrame, order: Sequence[str | Column], into: str = "doc_id", start: int = 0) -> DataFrame:
    """``df`` with ``into`` = start, start + 1, ... in ``order``.

    Rows are dealt by ranges and sorted inside partitions; partitions' counts (one small row each) give each one's
    first number. Rows that tie in ``order`` are numbered in either order.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    table = written(sorted_, "ordered").withColumn("__part", F.shiftright("__at", 33))
    counts = sorted((r["__part"], r["count"]) for r in table.groupBy("__part").count().collect())
    firsts, at = [], start
    for part, n in counts:
        firsts.append((part, at))
        at += n
    first = spark.createDataFrame(firsts, "__part long, __first long")
    return table.join(F.broadcast(first), "__part").withColumn(into, F.col("__first") + F.col("__at").bitwiseAND(_MASK)).drop("__part", "__first", "__at")
