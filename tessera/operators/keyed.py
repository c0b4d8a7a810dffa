"""Typed key-value state folded from commands ``(seq, cmd, key, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

_RESET = ("SET", "DEL")
_COUNT = ("INCR", "DECR")


def as_int(value: Column) -> Column:
    """The text as a 64-bit integer, null if it isn't one."""
    return F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast("long"))


def _last_reset(commands: DataFrame) -> DataFrame:
    """``(key, at, cmd, value)`` of the last SET or DEL of each key."""
    last = commands.where(F.col("cmd").isin(*_RESET)).groupBy("key").agg(F.max(F.struct("seq", "cmd", "value")).alias("r"))
    return last.select("key", F.col("r.seq").alias("at"), F.col("r.cmd").alias("reset"), F.col("r.value").alias("start"))


def fold_kv(commands: DataFrame) -> DataFrame:
    """``(key, kind, int_value, str_value)``, kind ``int`` or ``string``.

    The last SET or DEL of a key gives its start; INCR and DECR after it add up, unless it set a string, which they leave
    unchanged. Both steps pre-aggregate, so a frequent key costs its tasks one row each.
    """
    start = as_int(F.col("start"))
    counted = commands.where(F.col("cmd").isin(*_COUNT)).join(_last_reset(commands).select("key", "at"), "key", "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
    sums = counted.groupBy("key").agg(F.sum(F.when(F.col("cmd") == "INCR", 1).otherwise(-1)).alias("moved"))
    both = _last_reset(commands).join(sums, "key", "full_outer")
    is_string = (F.col("reset") == "SET") & start.isNull()
    exists = (F.col("reset") == "SET") | F.col("moved").isNotNull()
    number = F.coalesce(F.when(F.col("reset") == "SET", start), F.lit(0).cast("long")) + F.coalesce("moved", F.lit(0))
    string = F.coalesce(is_string, F.lit(False))
    return both.where(F.coalesce(exists, F.lit(False))).select("key", F.when(string, "string").otherwise("int").alias("kind"), F.when(~string, number).alias("int_value"), F.when(string, F.col("start")).alias("str_value"))


def kv_errors(commands: DataFrame) -> DataFrame:
    """INCR and DECR commands that met a string.

    Commands are cut where range partitioning by key and order cuts them. Inside a cut a window finds the reset before a
    command; before its first one the last reset of the key's earlier cuts counts, which a small table gives: one row a
    key and cut. So a key with most of the rows is spread over many tasks.
    """
    rows = commands.select("seq", "cmd", "key", F.when(F.col("cmd").isin(*_RESET), F.struct("cmd", "value")).alias("reset"))
    cut = written(rows.repartitionByRange("key", "seq").withColumn("cut", F.spark_partition_id()), "commands")
    inside = Window.partitionBy("key", "cut").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("key", "cut").agg(F.max_by("reset", F.when(F.col("reset").isNotNull(), F.col("seq"))).alias("end"))
    before = Window.partitionBy("key").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cut
    entry = written(ends.select("key", "cut", F.last("end", ignorenulls=True).over(before).alias("entry")), "entries")
    met = F.coalesce(F.last("reset", ignorenulls=True).over(inside), F.col("entry"))
    found = cut.join(entry, ["key", "cut"]).withColumn("met", met)
    return found.where(F.col("cmd").isin(*_COUNT) & (F.col("met.cmd") == "SET") & as_int(F.col("met.value")).isNull()).select("seq", "cmd", "key")


def mget(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """``(position, key, value)`` in request order; a missing key has null."""
    value = F.coalesce(F.col("int_value").cast("string"), "str_value")
    return keys.join(kv.select("key", value.alias("value")), "key", "left").select("position", "key", "value").orderBy("position")


def exists(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().join(kv, "key", "left_semi")


def dbsize(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count("*").alias("n"))


def keys(kv: DataFrame) -> DataFrame:
    return kv.select("key")
