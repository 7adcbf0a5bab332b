"""Count-min sketches: those of the partitions are merged, and a count is never below the true one.

``repeated`` is the prefilter: a key counted once in the merged sketch occurs once at most.

A cell of the sketch counts to two: one plane of bits for "met", one for "met again". Cells are taken from a key's upper bits,
so several keys may share one and a count is never too low: no repeated key is lost. The number of cells follows the input
(``cells_for``) up to 2**MAX_BITS; beyond that more keys pass the filter and the exact stage after it has more to group,
but the result stays the same. The plane sent to the tasks therefore has at most 2**MAX_BITS / 8 bytes (32 MB).

``levels`` counts on: a byte per cell holds the logarithm of its count, 2**LEVEL_BITS cells (16 MB) at most. All tasks share it, so it
is an order of keys by how often they occur, heavy ones last, that nobody has to be sent back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.scratch import parts
from ledgerspark.llm.words import slices

MAX_BITS = 28
MIN_BITS = 16
BLOCKS = 64
PART_BYTES = 1 << 18  # of a merged plane, for each task
THIN = 32
LEVEL_BITS = 24
STEPS = 4  # levels for each doubling of a count

Keys = Callable[[pa.RecordBatch], np.ndarray]


def cells_for(docs: DataFrame, bytes_per_key: float, column: str = "text") -> int:
    """Logarithm of the number of cells: two for each key that the texts are expected to have."""
    total = docs.select(F.sum(F.octet_length(column)).alias("n")).first().n or 0
    return bits_for(total / bytes_per_key)


def bits_for(keys: float) -> int:
    """Logarithm of two cells for each of so many keys, within the limits."""
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(2 * keys + 1))))


def _deflated(body: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_RLE)  # bits of hashes hold runs, but nothing that is met again
    return made.compress(body) + made.flush()


def bits_out(block: np.ndarray) -> bytes:
    """A block of bits in few bytes: where one in THIN or fewer is set the gaps between them, low bytes first, else the bits."""
    if THIN * int(np.bitwise_count(block).sum()) > 8 * len(block):
        return b"b" + _deflated(block.tobytes())
    at = np.flatnonzero(block)
    row, bit = np.nonzero(np.unpackbits(block[at], bitorder="little").reshape(-1, 8))
    gaps = np.diff(8 * at[row] + bit, prepend=0).astype("<u4")
    return b"g" + _deflated(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def bits_in(body: bytes, size: int) -> np.ndarray:
    """The block of ``size`` bytes that ``bits_out`` wrote."""
    raw = np.frombuffer(zlib.decompress(body[1:]), dtype=np.uint8)
    if body[:1] == b"b":
        return raw
    out = np.zeros(size, dtype=np.uint8)
    if len(raw):
        cells = np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
        at = cells >> 3
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[begin]] = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (cells & 7).astype(np.uint8)), begin)
    return out


class Planes:
    """A partition's sketch."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.once, self.again = (np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(2))

    def add(self, keys: np.ndarray) -> None:
        cells = np.sort(keys >> self.shift)
        if not len(cells):
            return
        new = np.r_[True, cells[1:] != cells[:-1]]
        twice = np.r_[new[1:], True] ^ True  # the next is equal
        at = (cells >> np.uint64(3)).astype(np.int64)
        bit = np.left_shift(np.uint8(1), (cells & np.uint64(7)).astype(np.uint8))
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = at[begin]
        met = np.bitwise_or.reduceat(bit, begin)
        more = np.bitwise_or.reduceat(np.where(twice, bit, 0).astype(np.uint8), begin)
        self.again[place] |= more | (self.once[place] & met)
        self.once[place] |= met


def _merged(size: int):
    """Add up the blocks, of ``size`` bytes each, of all tasks."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, *planes, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                once, again = (bits_in(x, size) for x in planes)
                counts = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
                if block in blocks:
                    a, b, n = blocks[block]
                    blocks[block] = [a | once, b | again | (a & once), n + counts]
                else:
                    blocks[block] = [once, again, counts.astype(np.int64)]
        for block, (_, again, counts) in blocks.items():
            bodies = (pa.array([x], pa.binary()) for x in (bits_out(again), zlib.compress(counts.tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *bodies], ["block", "again", "counts"])

    return merged


COUNT_BITS = 20


def repeated(docs: DataFrame, keys: Keys, bits: int, pieces: Callable = slices) -> np.ndarray:
    """Plane of the cells that hold more than one key of all rows; ``pieces`` cuts a batch into what ``keys`` takes at once."""
    return repeated_counted(docs, keys, bits, False, pieces)[0]


def repeated_counted(docs: DataFrame, keys: Callable, bits: int, with_counts: bool = True, pieces: Callable = slices) -> tuple[np.ndarray, np.ndarray]:
    """The plane of ``repeated`` and, from the same pass, counts of 2**COUNT_BITS coarser cells (8 MB in the driver).

    With counts ``keys`` gives the keys of the plane and those that are counted.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits)
        cells = np.zeros(1 << COUNT_BITS if with_counts else 0, dtype=np.uint32)
        for batch in batches:
            for piece in pieces(batch):
                found, other = keys(piece) if with_counts else (keys(piece), None)
                planes.add(found)
                if with_counts:
                    met, n = np.unique(other >> np.uint64(64 - COUNT_BITS), return_counts=True)
                    cells[met.astype(np.int64)] += n.astype(np.uint32)
        size, coarse = len(planes.once) // BLOCKS, len(cells) // BLOCKS
        for block in range(BLOCKS):
            once, again = (x[block * size : (block + 1) * size] for x in (planes.once, planes.again))
            if once.any():
                counts = zlib.compress(cells[block * coarse : (block + 1) * coarse].tobytes(), 1)
                bodies = (pa.array([x], pa.binary()) for x in (bits_out(once), bits_out(again), counts))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *bodies], ["block", "once", "again", "counts"])

    rows = docs.mapInArrow(sketched, "block int, once binary, again binary, counts binary")
    n = parts(docs.sparkSession) if with_counts else min(parts(docs.sparkSession), max(1, (1 << (bits - 3)) // PART_BYTES))
    rows = rows.repartition(n, "block").mapInArrow(_merged((1 << (bits - 3)) // BLOCKS), "block int, again binary, counts binary")
    plane = np.zeros(1 << (bits - 3), dtype=np.uint8)
    counts = np.zeros(1 << COUNT_BITS if with_counts else 0, dtype=np.int64)
    size, coarse = len(plane) // BLOCKS, len(counts) // BLOCKS
    for row in rows.collect():  # BLOCKS rows at most, of a size that is bounded
        plane[row.block * size : (row.block + 1) * size] = bits_in(bytes(row.again), size)
        counts[row.block * coarse : (row.block + 1) * coarse] = np.frombuffer(zlib.decompress(bytes(row.counts)), dtype=np.int64)
    return plane, counts


def passes(plane: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which keys may occur more than once."""
    cells = keys >> np.uint64(64 - bits)
    return (plane[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(counts, 1).astype(float))).astype(np.uint8)


def levels(rows: DataFrame, keys: Keys, total: int) -> np.ndarray:
    """Level of each cell for the keys of all rows; ``total`` is their number, for which the cells are chosen."""
    bits = min(LEVEL_BITS, max(MIN_BITS, math.ceil(math.log2(2 * total + 1))))
    size = (1 << bits) // BLOCKS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            met, n = np.unique(keys(batch) >> np.uint64(64 - bits), return_counts=True)
            cells[met.astype(np.int64)] += n.astype(np.uint32)
        for block in range(BLOCKS):
            own = cells[block * size : (block + 1) * size]
            at = np.flatnonzero(own)
            if len(at):
                body = np.concatenate([np.diff(at, prepend=0), own[at]]).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(body, 1)], pa.binary())], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                at, n = np.frombuffer(zlib.decompress(body), dtype="<u4").reshape(2, -1).astype(np.int64)
                cells = sums.setdefault(block, np.zeros(size, dtype=np.int64))
                cells[np.cumsum(at)] += n
        for block, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(_level(cells).tobytes(), 1)], pa.binary())], ["block", "level"])

    merged = rows.mapInArrow(counted, "block int, counts binary").repartition(parts(rows.sparkSession), "block").mapInArrow(added, "block int, level binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in merged.collect():  # BLOCKS rows at most
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.level)), dtype=np.uint8)
    return out


def level_of(plane: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key: no lower than that of its true count."""
    bits = len(plane).bit_length() - 1
    return plane[(keys >> np.uint64(64 - bits)).astype(np.int64)]
