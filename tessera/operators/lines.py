"""Slicing lines of text and JSON: ``lines(path, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains, json_field

#: Longest lines that slicing, searching and facts read, in bytes.
SLICE_MAX, SEARCH_MAX, FACTS_MAX = 16_384, 8_192, 1_024


def lines_of(texts: DataFrame, path: str = "path", text: str = "text", max_len: int | None = SLICE_MAX) -> DataFrame:
    """``(path, line_no, line)``: split at line feeds alone, numbered from 1.

    What follows the last line feed is a line only if it isn't empty. Lines over ``max_len`` bytes are left out, and
    still count in the numbers.
    """
    parts = F.split(F.col(text), "\n", -1)
    rows = texts.select(F.col(path).alias("path"), F.size(parts).alias("n"), F.posexplode(parts).alias("at", "line"))
    rows = rows.where((F.col("at") < F.col("n") - 1) | (F.length("line") > 0))
    if max_len is not None:
        rows = rows.where(F.octet_length("line") <= max_len)
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def slice_condition(contains_text: str | None = None, field: tuple[str, str] | None = None, level: str | None = None, jsonl: bool = False, first_match: bool = False, line: str = "line") -> Column:
    """Lines that hold the text and whose field has the value.

    ``level`` is the field of that name and takes the place of ``field``. A field matches nothing unless ``jsonl``.
    """
    keep = F.lit(True)
    if contains_text is not None:
        keep = keep & contains(line, contains_text)
    if level is not None:
        field = ("level", level)
    if field is not None:
        keep = keep & (F.coalesce(json_field(line, field[0], first_match) == field[1], F.lit(False)) if jsonl else F.lit(False))
    return keep


def slice_lines(lines: DataFrame, contains_text: str | None = None, field: tuple[str, str] | None = None, level: str | None = None, jsonl: bool = False, first_match: bool = False) -> DataFrame:
    return lines.where(slice_condition(contains_text, field, level, jsonl, first_match))


def slice_count(lines: DataFrame, **how: object) -> DataFrame:
    """One row ``(n)``."""
    return slice_lines(lines, **how).agg(F.count("*").alias("n"))


def lines_containing(lines: DataFrame, needle: str) -> DataFrame:
    return lines.where(contains("line", needle))


def lines_containing_ci(lines: DataFrame, needle: str) -> DataFrame:
    """Folds A to Z only."""
    return lines.where(contains("line", needle, ignore_case=True))


def jsonl_field_eq(lines: DataFrame, key: str, value: str, first_match: bool = False) -> DataFrame:
    return slice_lines(lines, field=(key, value), jsonl=True, first_match=first_match)


def jsonl_level(lines: DataFrame, level: str, first_match: bool = False) -> DataFrame:
    return slice_lines(lines, level=level, jsonl=True, first_match=first_match)


def _pattern(pattern: str) -> str:
    if not pattern:
        raise ValueError("an empty pattern")
    return pattern


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """``(path, line_no, line)`` of the lines that hold the pattern."""
    return lines.where(contains("line", _pattern(pattern), ignore_case)).select("path", "line_no", "line")


def grep_count(lines: DataFrame, paths: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """``(path, n)`` for every path of ``paths``, with none counted as 0."""
    found = lines.groupBy("path").agg(F.count_if(contains("line", _pattern(pattern), ignore_case)).alias("n"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grep_files(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    return grep(lines, pattern, ignore_case).select("path").distinct()
