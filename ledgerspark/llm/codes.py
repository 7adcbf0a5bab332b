"""Vector code compression: codebooks of whole-numbered parts, refined over Hilbert-sorted flat blocks.

Vectors are cut into PARTS parts. The parts of each position are sorted along a Hilbert curve (a range exchange, ties by row) and
cut into flat blocks of BLOCK neighbours that store their least and greatest components (a box) and their sums. In a
round, the distances of each codebook entry to a block's box rule out the entries whose least distance exceeds some
entry's greatest one. Where one entry is left, the block counts by its stored sums and its points are not looked at;
else a small exact kernel compares its points with the entries of the block's shortlist alone. What ties is never ruled
out, so results equal those of a full search. A task sends one sum and count per entry; the driver sees codebooks only.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; of several vector lengths the one that
most rows have counts (the longer of two), the others are dropped; a length that PARTS does not divide is filled up with
zeros; fewer than ENTRIES rows give so many entries; rows of equal vec_id begin in the order of their vectors, null ids last; entries
beyond 2**27 / SCALE are held there; equal rows get equal codes; an empty table gives an empty result; a sum beyond 64 bits is
null; only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.partials import summed
from ledgerspark.llm.scratch import parts, stored
from ledgerspark.llm.vectors import floored, matrices

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 128  # points of a block
MOST = float(1 << 27)
KEY_BITS = 60
EXACT = float(1 << 52)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits a dimension (rows of ``cells``)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            swap = np.where(x[i] >> b & 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] >> b & 1, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hilbert keys of KEY_BITS bits at most, the range of the first entries cut evenly; of many dimensions the first ones count."""
    d = min(points.shape[1], KEY_BITS)
    bits = min(10, KEY_BITS // d)
    span = np.maximum(high - low, 1)[:d]
    cells = np.clip((points[:, :d] - low[:d]) * (1 << bits) // span, 0, (1 << bits) - 1)
    return hilbert(cells, bits)


_POINT = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("point", pa.binary())])
_POINT_SQL = "part int, key long, row long, point binary"
_BLOCK = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("box", "sums", "rows", "points"))])
_BLOCK_SQL = "part int, box binary, sums binary, rows binary, points binary"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``row, size, vector`` and the given columns for usable rows: ``row`` numbers them, ``vector`` holds int32 in big-endian order
    with the sign turned, so that binary order is the order of the components."""
    schema = rows.drop("embedding").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            rest = batch.select([c for c in batch.schema.names if c != "embedding"])
            for places, matrix in matrices(batch.column("embedding")):
                x = floored(matrix, SCALE, MOST)
                raw = _ordered(x)
                m, size = x.shape
                vector = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * 4 * size).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base + np.arange(m)), pa.array(np.full(m, size, np.int32)), vector, *rest.take(pa.array(places)).columns],
                    ["_row", "_size", "_vector", *rest.schema.names],
                )
                base += m

    sql = "_row long, _size int, _vector binary, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(cut, sql)


def _ordered(x: np.ndarray) -> bytes:
    return (x + (1 << 31)).astype(">u4").tobytes()


def _numbers(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=">u4").astype(np.int64).reshape(-1, size) - (1 << 31)


def _filled(x: np.ndarray) -> np.ndarray:
    """Vectors as (rows, PARTS, components of a part), filled up with zeros."""
    width = -(-x.shape[1] // PARTS)
    out = np.zeros((len(x), PARTS * width), dtype=np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), PARTS, width)


def blocks(vectors: DataFrame, size: int, first: np.ndarray) -> DataFrame:
    """Blocks of neighbouring points, each with its box and sums; ``first`` are the first codebooks."""
    low, high = first.min(axis=1), first.max(axis=1)
    n_parts = parts(vectors.sparkSession)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                x = _filled(_numbers(b"".join(some.column("_vector").to_pylist()), size))
                for p in range(PARTS):
                    raw = np.ascontiguousarray(x[:, p].astype(np.int32))
                    width = raw.shape[1] * 4
                    body = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(_keys(x[:, p], low[p], high[p])), some.column("_row"), body], schema=_POINT)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = -1, [], []

        def block() -> dict:
            x = np.frombuffer(b"".join(held), dtype=np.int32).reshape(len(held), -1)
            box = np.stack([x.min(axis=0), x.max(axis=0)])
            return {"part": part, "box": box.tobytes(), "sums": x.sum(axis=0, dtype=np.int64).tobytes(), "rows": np.array(rows, dtype=np.int64).tobytes(), "points": x.tobytes()}

        for batch in batches:
            out = []
            for p, row, point in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "point"))):
                if held and (p != part or len(held) == BLOCK):
                    out.append(block())
                    rows, held = [], []
                part = p
                rows.append(row)
                held.append(point)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)
        if held:
            yield pa.RecordBatch.from_pylist([block()], schema=_BLOCK)

    order = ["part", "key", "row"]
    rows = vectors.select("_row", "_vector").mapInArrow(points, _POINT_SQL)
    rows = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(boxed, _BLOCK_SQL)


def shortlists(boxes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to a point of each box: their least distance exceeds no entry's greatest (blocks x entries)."""
    low, high = boxes[:, None, 0], boxes[:, None, 1]
    below, above = low - entries, entries - high
    apart = np.maximum(np.maximum(below, above), 0)
    least = (apart * apart).sum(axis=2)
    far = np.maximum(np.abs(below), np.abs(above))
    return least <= (far * far).sum(axis=2).min(axis=1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (the lower of two) and squared distance of each point, exactly."""
    reach = float(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * reach * reach * points.shape[1] < EXACT:
        # whole numbers that a double holds exactly
        x, c = points.astype(float), entries.astype(float)
        distance = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        apart = points[:, None].astype(np.int64) - entries
        distance = (apart * apart).sum(axis=2)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(points)), best].astype(np.int64)


def _shortlisted(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Place in the batch, part and shortlist of each block."""
    part = batch.column("part").to_numpy()
    width = books.shape[2]
    step = max(1, (1 << 20) // (books.shape[1] * width))
    for p in np.unique(part).tolist():
        places = np.flatnonzero(part == p)
        for k in range(0, len(places), step):
            some = places[k : k + step]
            raw = b"".join(batch.column("box").take(pa.array(some)).to_pylist())
            boxes = np.frombuffer(raw, dtype=np.int32).astype(np.int64).reshape(len(some), 2, width)
            for at, row in zip(some.tolist(), shortlists(boxes, books[p])):
                yield at, p, np.flatnonzero(row)


def refined(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry moves to the floored mean of its points, unused entries stay."""
    count, width = books.shape[1:]

    def add(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        total = sums.setdefault(0, np.zeros(PARTS * count * (width + 1), np.int64)).reshape(PARTS, count, width + 1)
        rows, points, stored_sums = (batch.column(c) for c in ("rows", "points", "sums"))
        for at, p, short in _shortlisted(batch, books):
            if len(short) == 1:
                total[p, short[0], 0] += len(rows[at].as_buffer()) // 8
                total[p, short[0], 1:] += np.frombuffer(stored_sums[at].as_buffer(), dtype=np.int64)
                continue
            x = np.frombuffer(points[at].as_buffer(), dtype=np.int32).reshape(-1, width)
            best = short[nearest(x, books[p][short])[0]]
            np.add.at(total[p], (best, 0), 1)
            np.add.at(total[p][:, 1:], best, x)

    total = summed(table, add, np.int64)[0].reshape(PARTS, count, width + 1)
    n = total[:, :, :1]
    return np.where(n > 0, total[:, :, 1:] // np.maximum(n, 1), books)


_CODED = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("entry", pa.int64()), ("error", pa.int64())])


def assigned(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``row, part, entry, error`` for each point of the blocks."""
    width = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, points = batch.column("rows"), batch.column("points")
            out, held = [], 0

            def ready() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=_CODED)

            for at, p, short in _shortlisted(batch, books):
                x = np.frombuffer(points[at].as_buffer(), dtype=np.int32).reshape(-1, width)
                best, error = nearest(x, books[p][short])
                out.append((np.frombuffer(rows[at].as_buffer(), dtype=np.int64), np.full(len(x), p, np.int32), short[best], error))
                held += len(x)
                if held > 50_000:
                    yield ready()
                    out, held = [], 0
            if out:
                yield ready()

    return table.mapInArrow(coded, "row long, part int, entry long, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """``vec_id, label, code, error`` for each usable row of ``rows(vec_id, embedding, label)``, and the codebooks (part, entry, component)."""
    spark = rows.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    vectors = stored(whole_vectors(rows), "vectors")
    common = vectors.groupBy("_size").count().orderBy(F.desc("count"), F.desc("_size")).first()
    if common is None:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), None
    size = common["_size"]
    vectors = vectors.filter(F.col("_size") == size)
    begin = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "_vector").limit(ENTRIES).select("_vector").collect()
    books = _filled(_numbers(b"".join(bytes(r[0]) for r in begin), size)).transpose(1, 0, 2)
    table = stored(blocks(vectors, size, books), "blocks")
    for _ in range(rounds):
        books = refined(table, books)
    shift = F.expr(f"shiftleft(entry, 8 * ({PARTS - 1} - part))")
    whole = assigned(table, books).groupBy("row").agg(F.sum(shift).alias("_code"), F.sum("error").alias("error"))
    code = F.lpad(F.lower(F.hex("_code")), 2 * PARTS, "0").alias("code")
    return vectors.join(whole, F.col("_row") == F.col("row")).select("vec_id", "label", code, "error"), books


def codes(rows: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each usable row of ``rows(vec_id, embedding, label)``."""
    coded, books = compress(rows)
    coded = stored(coded, "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
