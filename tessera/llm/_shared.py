"""Storage and batch helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import discard, new_path, workspace
from tessera.session import written as stored

__all__ = ["add_columns", "as_row", "discard", "from_row", "map_batches", "named", "new_path", "quoted", "stored", "table", "workspace"]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; the result has the Spark schema ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, source: str, fn: Callable[[pa.Array], list[pa.Array]], new: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``new`` (name to Spark type) that ``fn`` makes of each batch of the column ``source``; a
    new one replaces an old one of its name. Columns go through tasks under plain names, as their own may hold any sign."""
    plain = [f"_{k}" for k in range(len(df.columns))]
    place, taken = df.columns.index(source), {c.lower() for c in new}
    added = [f"_new{k}" for k in range(len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch.column(place))], [*plain, *added])

    schema = [f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, df.schema.fields, strict=True)] + [f"{p} {kind}" for p, kind in zip(added, new.values(), strict=True)]
    out = df.select(*(named(c).alias(p) for p, c in zip(plain, df.columns, strict=True))).mapInArrow(run, ", ".join(schema))
    kept = [F.col(p).alias(c) for p, c in zip(plain, df.columns, strict=True) if c.lower() not in taken]
    return out.select(*kept, *(F.col(p).alias(c) for p, c in zip(added, new, strict=True)))


def quoted(name: str) -> str:
    """A column's name as SQL writes it, whatever signs it holds."""
    return f"`{name.replace('`', '``')}`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def as_row(names: list[str]) -> Column:
    """The columns ``names`` as one struct ``__row`` with fields ``_0``, ``_1`` ..., so that no name can clash with an
    operator's own or with another."""
    return F.struct(F.lit(0).alias("_"), *(named(c).alias(f"_{k}") for k, c in enumerate(names))).alias("__row")


def from_row(df: DataFrame, new: dict[str, Column], names: list[str]) -> DataFrame:
    """The columns ``names`` that ``as_row`` packed and the new ones; a new one replaces an old one of its name."""
    taken = {c.lower() for c in new}
    old = [(k, c) for k, c in enumerate(names) if c.lower() not in taken]
    return df.select(*(F.col("__row").getField(f"_{k}").alias(c) for k, c in old), *(v.alias(c) for c, v in new.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
