"""Columns over arrays of numbers, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """``v`` by its norm; null for a zero norm."""
    norm = F.nullif(l2_norm(v), F.lit(0.0))
    return F.transform(_double(v), lambda x: x / norm)
