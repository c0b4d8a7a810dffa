"""CRC-32C (Castagnoli) of binary values, vectorised over a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


_TABLE = _table()


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """Checksums of all payloads, one byte place of all of them at a time."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    left = sizes[order]
    crc = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    live = len(payloads)
    for k in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= k:
            live -= 1
        crc[:live] = _TABLE[(crc[:live] ^ flat[begin[:live] + k]) & 0xFF] ^ (crc[:live] >> 8)
    out = np.empty(len(payloads), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(payload: Column | str) -> Column:
    """Checksum as a long; null for null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series(pd.array([None] * len(values), "Int64"), index=values.index)
        out[known] = crc32c_many([bytes(v) for v in values[known]]).astype(np.int64)
        return out

    return run(F.col(payload) if isinstance(payload, str) else payload)
