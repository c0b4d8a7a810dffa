"""Columns over lines of text and JSON."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Folds A to Z only; other letters keep their case."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def contains(c: Column | str, needle: str, ignore_case: bool = False) -> Column:
    """Whether the text holds ``needle``; an empty needle is in every text."""
    if ignore_case:
        return ascii_lower(c).contains(ascii_lower(F.lit(needle)))
    return _col(c).contains(needle)


def json_field(c: Column | str, key: str, first_match: bool = False) -> Column:
    """Text of a top-level field; null if there is none.

    ``first_match`` takes the first place where the quoted key is followed by a colon, at any depth, and reads the value
    by its raw characters.
    """
    if not first_match:
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        return F.get_json_object(_col(c), f"$['{quoted}']")
    pattern = f'"{re.escape(key)}"\\s*:\\s*(?:"([^"]*)"|([^",}}\\s][^,}}\\s]*))'
    return F.when(_col(c).rlike(pattern), F.concat(F.regexp_extract(_col(c), pattern, 1), F.regexp_extract(_col(c), pattern, 2)))


def valid_name(c: Column | str) -> Column:
    """Names of atoms, sets and relations."""
    return F.coalesce(_col(c).rlike(r"^[0-9A-Za-z_./-]+\z"), F.lit(False))


def valid_topic(c: Column | str) -> Column:
    """Names of topics and consumer groups."""
    return F.coalesce(_col(c).rlike(r"^[0-9A-Za-z_.-]+\z"), F.lit(False))


def snippet(content: Column | str, size: int = 200, offset: Column | int = 0) -> Column:
    """The first ``size`` bytes from ``offset``; a cut inside a character is replaced."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(_col(content).cast("binary"), at.cast("int") + 1, F.lit(size)).cast("string")
