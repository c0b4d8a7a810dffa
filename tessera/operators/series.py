"""Scans of ordered series, one answer per key.

A key's series is cut where Spark's range partitioning cuts it; each cut is summed up where it lies, and the few sums
of a key are folded in order. So a key with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def _cuts(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    return written(rows.repartitionByRange("key", "at").withColumn("cut", F.spark_partition_id()), "series")


def _fold(parts: DataFrame, fields: list[str], start: Column, step, finish) -> DataFrame:  # noqa: ANN001
    listed = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cut", *fields))).alias("parts"))
    return listed.select("key", F.aggregate("parts", start, step, finish).alias("answer"))


def best_trade(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, best)``: the most that a later value exceeds an earlier one by, 0 at least."""
    w = Window.partitionBy("key", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = _cuts(df, key, order, value).withColumn("gain", F.col("v") - F.min("v").over(w)).groupBy("key", "cut").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("gain").alias("gain"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("lo"), F.lit(0.0).alias("best"))
    step = lambda a, p: F.struct(F.least(a["lo"], p["lo"]).alias("lo"), F.greatest(a["best"], p["gain"], p["hi"] - a["lo"]).alias("best"))
    return _fold(parts, ["lo", "hi", "gain"], start, step, lambda a: a["best"]).select(F.col("key").alias(key), F.col("answer").alias("best"))


def max_run_sum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``(key, best)``: the largest sum of one or more neighbouring values."""
    w = Window.partitionBy("key", "cut").orderBy("at")
    sums = _cuts(df, key, order, value).withColumn("p", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.min("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("run", F.col("p") - F.least(F.lit(0.0), before))
    # the largest sum that starts with the cut, that ends with it, within it, and its whole sum
    parts = sums.groupBy("key", "cut").agg(F.sum("v").alias("all"), F.max("p").alias("head"), F.max("run").alias("inner"), F.min(F.col("p") - F.col("v")).alias("low")).withColumn("tail", F.col("all") - F.col("low"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("tail"), none.alias("best"))
    step = lambda a, p: F.struct(F.greatest(p["tail"], a["tail"] + p["all"]).alias("tail"), F.greatest(a["best"], p["inner"], a["tail"] + p["head"]).alias("best"))
    return _fold(parts, ["all", "head", "inner", "tail"], start, step, lambda a: a["best"]).select(F.col("key").alias(key), F.col("answer").alias("best"))
