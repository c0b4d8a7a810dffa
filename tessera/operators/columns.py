"""Columns made in tasks beside others, whatever the others' names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of this very name, which may hold dots and back-ticks."""
    return F.col(f"`{name.replace('`', '``')}`")


def with_made(df: DataFrame, sources: Sequence[str], make: Callable[..., list[pa.Array]], new: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``new`` (name to Spark type) that ``make`` gives for each batch of the columns ``sources``;
    a new one replaces an old one of its name. Columns pass through tasks under plain names."""
    plain, places = [f"_{k}" for k in range(len(df.columns))], [df.columns.index(s) for s in sources]
    added, taken = [f"_new{k}" for k in range(len(new))], {c.lower() for c in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(*(batch.column(p) for p in places))], [*plain, *added])

    kinds = [f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, df.schema.fields, strict=True)] + [f"{p} {kind}" for p, kind in zip(added, new.values(), strict=True)]
    out = df.select(*(named(c).alias(p) for p, c in zip(plain, df.columns, strict=True))).mapInArrow(run, ", ".join(kinds))
    return out.select(*(F.col(p).alias(c) for p, c in zip(plain, df.columns, strict=True) if c.lower() not in taken), *(F.col(p).alias(c) for p, c in zip(added, new, strict=True)))
