"""Blocked exchanges: many small numbers travel as a few binary rows, one for each source block and part.

Spark deals the rows by their part; inside a task numpy sorts and groups. Parts follow the session's shuffle partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identity of a row: its doc_id and the hash of its text, so rows that share a doc_id are told apart.
ROW_SCHEMA = "doc_id long, mark long"


def mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash, from bits that differ from those that the sketch takes."""
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """Columns cut by part: for each part with rows, its number and the columns' bytes, order kept."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_columns = {k: v[order] for k, v in columns.items()}
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[p], bounds[p + 1]
        yield {"part": p, **{k: v[a:b].tobytes() for k, v in sorted_columns.items()}}


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Numbers of a binary column's rows, one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)


def numbers_out(x: np.ndarray) -> bytes:
    """Unsigned numbers in few bytes: those of each place together, as many places as the largest number has, deflated."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    made = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_RLE)
    body = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
    return bytes([size]) + made.compress(body) + made.flush()


def numbers_in(body: bytes) -> np.ndarray:
    """What ``numbers_out`` wrote."""
    planes = np.frombuffer(zlib.decompress(body[1:]), dtype=np.uint8).reshape(body[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : body[0]] = planes.T
    return out.view("<u8").ravel()
