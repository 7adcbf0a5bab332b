"""N-gram Jaccard join by vertical partitioning: documents whose sets of 5-word shingles overlap by 80 % or more, as components.

1. Equal sets form one class (sets whose name was met once are not grouped), and only one member of a class goes on. Each set sends its least
   shingles, about a half, in few bytes to where equal ones meet; a set that has met fewer of them again than a link asks for
   (``_looked``) can have none and is done. No table of all shingles is held anywhere, so this works alike at any size.
2. The global order of all shingles is that of their level in a merged count sketch, rare ones first, then of their hash. Every
   task has the sketch, so every task knows the order and nothing is sent back to the sets. The order is cut
   into FRAGMENTS of about equal weight; each set is cut at the same places, and an overlap is the sum of the fragments'
   overlaps, counted one by one from the rarest on until the sum, or what is still possible, decides.
3. Near neighbours first: class sets are sorted by their least shingle hashes and compared with the ones before them, which
   joins most of a group of near copies by few links and without its pairs. A sketch of least hashes leaves out sets that would be alone.
4. The rest is exact. The order is cut into parts. A set's first n - ceil(0.8 n) + 1 shingles, without those that a sketch of them
   met once only, meet those of other components in their part; pairs there are kept unless their lengths or a parity bitmap (its distance never exceeds the sets'
   difference) rule a link out. The fragments of the pairs left are joined, counted apart and summed per pair.

No group of copies is expanded into its pairs: copies are classes, near copies are mostly one component before step 4, and
step 4 pairs only sets of different components. A shingle that many sets hold comes last in the order, so it is met in step 4
only for sets that have hardly others.

Defined cases: null or empty text has the empty set and is linked with nothing; with fewer than five words the whole sequence
is the one shingle; a null doc_id counts as larger than every id (a component of null ids alone has a null label); rows that
share a doc_id are rows of their own; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sketch
from ledgerspark.llm.components import rounds
from ledgerspark.llm.exchange import joined, numbers_in, numbers_out, packed, part_of
from ledgerspark.llm.scratch import dropped, numbered, parts, stored, swept
from ledgerspark.llm.words import Words, mixed, slices, windows
from ledgerspark.session import fewer

SIZE = 5
PERCENT = 80
ROUNDS = 5  # sortings in step 2
BACK = 16  # sets before it that a set is compared with
FRAGMENTS = 6
PIECE_ROWS = 512
BITMAP_BITS = 1024
MORE = 30  # percent of a set's shingles that are looked at in step 1, beyond those that a linked set may lack
SPARE = 5
CELL_BITS = 43
FLUSH = 2_000_000  # shingles that a task holds before it sends them
FLUSH_SETS = 1 << 19
PART_KEYS = 2_000_000  # shingles that meet in a task
LEAST_PARTS = 64
THIN_CELLS = 16

_MASK = (1 << 64) - 1


def _salted(hashes: np.ndarray, k: int) -> np.ndarray:
    return mixed(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & _MASK))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other, with the texts' offsets in them."""
    words = Words(column, lower=True)
    hashes, n = words.hashes(), len(column)
    owners, found = [], []
    for size in range(1, SIZE + 1):
        whole = windows(hashes, size, seed=100 + size)
        if size < SIZE:
            texts = np.flatnonzero(words.counts == size)
            owners.append(texts)
            found.append(whole[words.first[texts]])
        elif len(whole):
            left = np.repeat(words.first[1:], words.counts) - np.arange(len(hashes))
            ok = left[: len(whole)] >= size
            owners.append(words.owner[: len(whole)][ok])
            found.append(whole[ok])
    owner, found = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    owner, found = owner[new], found[new]
    return found, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("shingles", pa.binary())])
_SETS_SQL = "doc_id long, n long, node long, check long, shingles binary"


def _looked(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of its least shingles a set of n looks at, and how many of them it shares at least with a set that it is linked with.

    A linked set has ceil(0.8 n) members or more and lacks n - ceil(0.8 n) of this one's or fewer. So of that many least ones
    and k more, k are shared, and they are among the other's least ones where it takes as many more; a smaller set takes fewer.
    """
    least = -(-PERCENT * n // 100)
    more, fewest = (-(-MORE * x // 100) for x in (n, least))
    return n - least + more, fewest


class _Held:
    """Least shingles of a task's sets, before they are sent."""

    def __init__(self, bits: int, n_parts: int, task: int):
        self.bits, self.n_parts, self.task, self.flushes = bits, n_parts, task, 0
        self.clear()

    def clear(self) -> None:
        self.cells, self.rows, self.names, self.needed = ([] for _ in range(4))
        self.size = self.sets = 0

    def add(self, piece: pa.RecordBatch) -> None:
        found, offsets = shingles(piece.column("text"))
        n = np.diff(offsets)
        looked, shared = _looked(n)
        least = np.arange(len(found)) - np.repeat(offsets[:-1], n) < np.repeat(looked, n)
        some = n > 0
        number = self.sets + np.cumsum(some)  # from 1 on
        self.cells.append(_salted(found[least], 40) >> np.uint64(64 - self.bits))
        self.rows.append(np.repeat(number, n)[least])
        self.names.append(_sums(_salted(found, 90), offsets)[some])
        self.needed.append(shared[some])
        self.size += len(self.cells[-1])
        self.sets += int(some.sum())

    def full(self) -> bool:
        return self.size >= FLUSH or self.sets >= FLUSH_SETS

    def sent(self) -> Iterator[dict]:
        """Cells by part; a cell that several sets of the task have is counted here and sent once, as row 0."""
        if not self.sets:
            return
        source, at = self.task << 32 | self.flushes, (7919 * self.task + self.flushes) % self.n_parts
        self.flushes += 1
        cells, rows, names, needed = (np.concatenate(x) for x in (self.cells, self.rows, self.names, self.needed))
        shift = np.uint64(self.sets.bit_length())
        both = np.sort(cells << shift | rows.astype(np.uint64))
        cells, rows = both >> shift, both & ((np.uint64(1) << shift) - np.uint64(1))
        first = np.r_[True, cells[1:] != cells[:-1]]
        alone = first & np.r_[first[1:], True]
        met = np.bincount(rows[~alone].astype(np.int64), minlength=self.sets + 1)[1:]
        rows[~alone] = 0
        cells, rows = cells[first], rows[first]
        left = np.maximum(needed - met, 0).astype(np.uint64)
        yield {"part": at, "source": source, "cells": None, "rows": numbers_out(left), "names": names.tobytes()}
        starts = _part_starts(self.bits, self.n_parts)
        bounds = np.searchsorted(cells, starts)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[p], bounds[p + 1]
            yield {"part": p, "source": source, "cells": numbers_out(np.diff(cells[a:b], prepend=starts[p])), "rows": numbers_out(rows[a:b]), "names": None}


def _part_starts(bits: int, n_parts: int) -> np.ndarray:
    """Where each part of the cells begins, and the end of the last."""
    return np.array([(k << bits) // n_parts for k in range(n_parts + 1)], dtype=np.uint64)


def _met_rows(messages: list[dict]) -> Iterator[dict]:
    """For each message of a part its rows whose cells are met elsewhere or several times in one task, a row once for each cell."""
    cells = [np.cumsum(numbers_in(m["cells"]), dtype=np.uint64) for m in messages]  # from the part's start on
    ends = np.cumsum([len(x) for x in cells])
    cells, rows = np.concatenate(cells), np.concatenate([numbers_in(m["rows"]) for m in messages])
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.r_[True, cells[1:] != cells[:-1]]
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(cells)])
    again = (size > 1) | np.bitwise_or.reduceat(rows[order] == 0, begin)
    met = np.zeros(len(cells), dtype=bool)
    met[order] = np.repeat(again, size)
    met &= rows > 0
    for m, a, b in zip(messages, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        own = np.sort(rows[a:b][met[a:b]])
        if len(own):
            yield {"source": m["source"], "rows": numbers_out(np.diff(own, prepend=np.uint64(0))), "names": None}


_LEAST = pa.schema([("part", pa.int32()), ("source", pa.int64()), *((c, pa.binary()) for c in ("cells", "rows", "names"))])
_LEAST_SQL = "part int, source long, cells binary, rows binary, names binary"
_MET = pa.schema([("source", pa.int64()), ("rows", pa.binary()), ("names", pa.binary())])


def met_names(docs: DataFrame) -> DataFrame:
    """``names``: in binary rows, the names of all sets that may be linked with another (``_looked``).

    Shingles travel as cells of a number space with 2**SPARE of them for each shingle, so about one in 2**SPARE is met by chance, whatever
    the size; a task of the exchange holds PART_KEYS of them. Sets are told apart by the flush that they were sent in and their
    number there, so a task that runs again must read the same rows in the same order, as those of stored tables do.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    keys = total / 6.5 * (100 - PERCENT + MORE) / 100
    bits = min(CELL_BITS, max(sketch.MIN_BITS, math.ceil(math.log2(keys + 1)) + SPARE))
    n_parts = max(LEAST_PARTS, math.ceil(keys / PART_KEYS))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(bits, n_parts, TaskContext.get().partitionId())
        for batch in batches:
            for piece in slices(batch):
                held.add(piece)
                if held.full():
                    yield from (pa.RecordBatch.from_pylist([row], schema=_LEAST) for row in held.sent())
                    held.clear()
        yield from (pa.RecordBatch.from_pylist([row], schema=_LEAST) for row in held.sent())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _MET.names} for r in rows if r["cells"] is None], schema=_MET)
            for r in rows:
                if r["cells"] is not None:
                    by_part.setdefault(r["part"], []).append(r)
        while by_part:
            yield pa.RecordBatch.from_pylist(list(_met_rows(by_part.popitem()[1])), schema=_MET)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[bytes, bytes]] = {}
        counts: dict[int, list[bytes]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["names"] is not None:
                    own[r["source"]] = r["names"], r["rows"]
                else:
                    counts.setdefault(r["source"], []).append(r["rows"])
        for source, (raw, needed) in own.items():
            names, needed = np.frombuffer(raw, dtype=np.uint64), numbers_in(needed).astype(np.int64)
            for body in counts.pop(source, []):
                rows, n = np.unique(np.cumsum(numbers_in(body), dtype=np.uint64).astype(np.int64) - 1, return_counts=True)
                needed[rows] -= n
            yield pa.RecordBatch.from_arrays([pa.array([names[needed <= 0].tobytes()], pa.binary())], ["names"])

    rows = docs.select("text").mapInArrow(sent, _LEAST_SQL).repartition(n_parts, "part").mapInArrow(met, "source long, rows binary, names binary")
    return rows.repartition(parts(spark), "source").mapInArrow(named, "names binary")


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, node, check, shingles``: size of the set, 128 bits that name it, and the set where a link is possible."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = stored(fewer(met_names(docs), docs.count()), "names")
    bits = sketch.bits_for(THIN_CELLS * (names.select(F.sum(F.octet_length("names")).alias("n")).first().n or 0) / 8)

    def keys(batch: pa.RecordBatch) -> np.ndarray:  # each twice, so that its cell is met again
        return np.repeat(_salted(joined(batch.column("names"), np.uint64), 50), 2)

    plane = spark.sparkContext.broadcast(sketch.repeated(names, keys, bits, lambda batch: [batch]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, offsets = shingles(piece.column("text"))
                n = np.diff(offsets)
                names = [_sums(_salted(found, k), offsets) for k in (90, 91)]
                live = (n > 0) & sketch.passes(plane.value, bits, _salted(names[0], 50))
                raw = [found[a:b].tobytes() if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), live.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in names), pa.array(raw, pa.binary())], schema=_SETS
                )

    return docs.mapInArrow(sets, _SETS_SQL)


class Order:
    """Global order of shingles: level in the merged count sketch, then hash; ``cuts`` are where fragments end."""

    def __init__(self, plane: np.ndarray):
        self.plane = plane
        weight = np.bincount(plane, weights=2.0 ** (plane / sketch.STEPS) - (plane == 0), minlength=256)
        total = np.r_[0.0, np.cumsum(weight)]
        wanted = total[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
        level = np.clip(np.searchsorted(total, wanted, side="right") - 1, 0, 255)
        inside = (wanted - total[level]) / np.maximum(weight[level], 1e-300)
        self.cuts = (level.astype(np.uint64) << np.uint64(56)) | (np.clip(inside, 0, 1 - 1e-9) * 2.0**56).astype(np.uint64)

    def places(self, found: np.ndarray) -> np.ndarray:
        """Numbers that sort like the order (equal only for shingles that agree in all but 8 bits)."""
        return (sketch.level_of(self.plane, found).astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))

    def first(self, found: np.ndarray, n: int) -> np.ndarray:
        return found[np.lexsort((found, self.places(found)))[:n]]

    def fragments(self, found: np.ndarray) -> list[np.ndarray]:
        """The set cut at the cuts, each fragment sorted by hash."""
        which = np.searchsorted(self.cuts, self.places(found), side="right")
        return [found[which == f] for f in range(FRAGMENTS)]


def _size(classes: DataFrame) -> int:
    """Members of all sets."""
    return int(classes.select(F.sum(F.octet_length("shingles") / 8).alias("n")).first().n or 0)


def shingle_order(classes: DataFrame) -> Order:
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.uint64)

    return Order(sketch.levels(classes.select("shingles"), keys, _size(classes)))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _fragments_linked(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether two sets are linked, from the overlaps of their fragments; ends as soon as what is left cannot change it."""
    size_a, size_b = sum(map(len, a)), sum(map(len, b))
    possible = [min(len(x), len(y)) for x, y in zip(a, b)]
    most, overlap = sum(possible), 0
    for x, y, p in zip(a, b, possible):
        if not _linked(most, size_a, size_b):
            return False
        if p:
            own = _overlap(x, y)
            overlap, most = overlap + own, most - p + own
    return _linked(overlap, size_a, size_b)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of sets cut into runs of PIECE_ROWS, so that a task's copies of their members stay small."""
    return (batch.slice(k, PIECE_ROWS) for k in range(0, len(batch), PIECE_ROWS))


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of all sets of a batch and the sets' offsets in them."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.uint64), np.r_[0, np.cumsum([len(x) // 8 for x in raw])].astype(np.int64)


def _least(batch: pa.RecordBatch) -> np.ndarray:
    """Least hashes of each set, one column for each round."""
    found, offsets = _members(batch.column("shingles"))
    return np.stack([np.minimum.reduceat(_salted(found, k), offsets[:-1]) for k in range(ROUNDS)], axis=1)


def _least_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Least hashes of all rounds as keys of a sketch; that of one round is no key of another."""
    least = _least(batch)
    return np.concatenate([_salted(least[:, k], 80 + k) for k in range(ROUNDS)])


def _near_rows(classes: DataFrame) -> DataFrame:
    """``round, k1, k2, k3, node, shingles``: each set with its least hashes in the rounds in which another set may have the same first one.

    Only sets of one least hash are compared, so the others need not be sent.
    """
    spark = classes.sparkSession
    bits = sketch.bits_for(ROUNDS * classes.count())
    shared = spark.sparkContext.broadcast(sketch.repeated(classes.select("shingles"), _least_keys, bits, _pieces))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            met = sketch.passes(shared.value, bits, _least_keys(batch)).reshape(ROUNDS, -1)
            least = _least(batch).view(np.int64)
            for k in range(ROUNDS):
                some = np.flatnonzero(met[k])
                nodes, sets = (batch.column(c).take(pa.array(some)) for c in ("node", "shingles"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, np.int32)), *(pa.array(least[some, (k + j) % ROUNDS]) for j in range(3)), nodes, sets],
                    ["round", "k1", "k2", "k3", "node", "shingles"],
                )

    return classes.select("node", "shingles").mapInArrow(keyed, "round int, k1 long, k2 long, k3 long, node long, shingles binary")


def _neighbour_links(classes: DataFrame, order_) -> DataFrame:
    """Links found among sets that are near each other when sorted by least hashes, ``a, b``."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: list[tuple[tuple, int, int, list[np.ndarray]]] = []  # key, node, head of its chain, fragments
        for batch in batches:
            a, b = [], []
            for group, key, node, raw in zip(*(batch.column(c).to_pylist() for c in ("round", "k1", "node", "shingles"))):
                recent = [x for x in recent if x[0] == (group, key)][-BACK:]
                own, head = order_.value.fragments(np.frombuffer(raw, dtype=np.uint64)), node
                for _, _, before, other in reversed(recent):
                    if before != head and _fragments_linked(own, other):
                        a.append(before)
                        b.append(head)
                        head = before if head == node else head
                recent.append(((group, key), node, head, own))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    order = ["round", "k1", "k2", "k3", "node"]
    rows = _near_rows(classes).repartitionByRange(parts(classes.sparkSession), *order).sortWithinPartitions(*order)
    return rows.mapInArrow(compared, "a long, b long")


_RAREST = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()), ("rarest", pa.binary())])
_POSTED = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("hash", "row", "node", "label", "n", "bitmap"))])
_POSTED_SQL = "part int, hash binary, row binary, node binary, label binary, n binary, bitmap binary"


def _posted(found: np.ndarray, row: np.ndarray, rows: dict[str, np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Shingles by part, each part with what its sets need to be told apart."""
    for p in packed(part_of(found, n_parts), n_parts, {"hash": found, "row": row}):
        used, at = np.unique(np.frombuffer(p["row"], dtype=np.int64), return_inverse=True)
        sent = {k: v[used].tobytes() for k, v in rows.items()}
        yield pa.RecordBatch.from_pylist([{**p, "row": at.astype(np.uint32).tobytes(), **sent}], schema=_POSTED)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The postings of one part after the other; ``row`` numbers the sets of the part."""
    by_part: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            by_part.setdefault(r["part"], []).append(r)
    kinds = {"hash": np.uint64, "row": np.uint32, "node": np.int64, "label": np.int64, "n": np.int64, "bitmap": np.uint64}
    while by_part:
        _, rows = by_part.popitem()
        out = {c: [np.frombuffer(r[c] or b"", dtype=t) for r in rows] for c, t in kinds.items()}
        base = np.r_[0, np.cumsum([len(x) for x in out["node"]])]
        out["row"] = [x.astype(np.int64) + b for x, b in zip(out["row"], base)]
        yield {c: np.concatenate(x) for c, x in out.items()}


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: each member turns one bit, so two bitmaps differ in no more bits than the sets in members."""
    bits = np.bincount((_salted(found, 70) % np.uint64(BITMAP_BITS)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _rarest_rows(classes: DataFrame, order_) -> DataFrame:
    """``node, n, bitmap, rarest``: of each set's rarest shingles those that another set may have among its own; sets without any are left out."""
    spark = classes.sparkSession

    def rarest(raw: bytes) -> np.ndarray:
        own = np.frombuffer(raw, dtype=np.uint64)
        return order_.value.first(own, len(own) - (PERCENT * len(own) + 99) // 100 + 1)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return _salted(np.concatenate([rarest(x) for x in batch.column("shingles").to_pylist()]), 60)

    bits = sketch.bits_for((100 - PERCENT) * _size(classes) / 100 + classes.count())
    shared = spark.sparkContext.broadcast(sketch.repeated(classes.select("shingles"), keys, bits, _pieces))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            rows = []
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                found = rarest(raw)
                found = found[sketch.passes(shared.value, bits, _salted(found, 60))]
                if len(found):
                    own = np.frombuffer(raw, dtype=np.uint64)
                    rows.append({"node": node, "n": len(own), "bitmap": bitmap(own).tobytes(), "rarest": found.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_RAREST)

    return classes.select("node", "shingles").mapInArrow(cut, "node long, n long, bitmap binary, rarest binary")


def _candidates(classes: DataFrame, order_, n_parts: int, labels: DataFrame | None = None) -> DataFrame:
    """Pairs of sets ``a, b`` of different components that lengths, rarest shingles and bitmaps leave possible.

    ``labels`` are the sets' components where ``classes`` has no ``label``: they meet the rarest shingles, not the sets.
    """
    labels = classes.select("node", "label") if labels is None else labels

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found, offsets = _members(batch.column("rarest"))
                rows = {c: batch.column(c).to_numpy() for c in ("node", "label", "n")}
                rows["bitmap"] = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), dtype=np.uint64).reshape(len(batch), -1)
                yield from _posted(found, np.repeat(np.arange(len(batch)), np.diff(offsets)), rows, n_parts)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _gathered(batches):
            maps = p["bitmap"].reshape(-1, BITMAP_BITS // 64)
            order = np.lexsort((p["n"][p["row"]], p["hash"]))
            found, row = p["hash"][order], p["row"][order]
            begin = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            stop = np.r_[begin[1:], len(found)]
            seen = np.zeros(0, dtype=np.int64)
            size, waiting, held = len(p["node"]), [], 0
            for a, b in zip(begin.tolist(), stop.tolist()):
                if b - a < 2:
                    continue
                for i in range(a, b - 1):
                    # sorted by size: partners follow, up to a quarter more
                    x = row[i]
                    y = row[i + 1 : b]
                    y = y[: np.searchsorted(p["n"][y], 100 * p["n"][x] // PERCENT, side="right")]
                    y = y[p["label"][y] != p["label"][x]]
                    if len(y):
                        waiting.append(np.minimum(x, y) * size + np.maximum(x, y))
                        held += len(y)
                if held > 1_000_000:
                    seen, waiting, held = _ruled(np.concatenate(waiting), p, maps, seen), [], 0
            if held:
                seen = _ruled(np.concatenate(waiting), p, maps, seen)
            if len(seen):
                a, b = p["node"][seen // size], p["node"][seen % size]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = _rarest_rows(classes, order_).join(labels, "node").select("node", "label", "n", "bitmap", "rarest")
    rows = rows.mapInArrow(posted, _POSTED_SQL).repartition(n_parts, "part")
    return rows.mapInArrow(paired, "a long, b long").distinct()


def _ruled(pairs: np.ndarray, p: dict[str, np.ndarray], maps: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Pairs met so far that the bitmaps do not rule out: the sets' difference may be 2 (na + nb) / 18 at 80 %."""
    size, pairs = len(p["node"]), np.unique(pairs)
    keep = []
    for k in range(0, len(pairs), 100_000):
        some = pairs[k : k + 100_000]
        a, b = some // size, some % size
        apart = np.bitwise_count(maps[a] ^ maps[b]).sum(axis=1)
        together = p["n"][a] + p["n"][b]
        keep.append(some[apart * (100 + PERCENT) <= together * (100 - PERCENT)])
    return np.union1d(seen, np.concatenate(keep))


def _counted_links(pairs: DataFrame, classes: DataFrame, order_) -> DataFrame:
    """Pairs whose overlap, counted fragment by fragment and summed, reaches the limit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                own = np.frombuffer(raw, dtype=np.uint64)
                rows += [{"node": node, "fragment": f, "n": len(own), "part": x.tobytes()} for f, x in enumerate(order_.value.fragments(own))]
            yield pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [_overlap(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(overlap, pa.int64())], ["a", "b", "n_a", "n_b", "overlap"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    fragments = classes.select("node", "shingles").join(ends, "node", "left_semi").mapInArrow(cut, "node long, fragment int, n long, part binary")
    fragments = stored(fewer(fragments, classes.count()), "fragments")
    sides = [fragments.select(F.col("node").alias(s), "fragment", F.col("n").alias(f"n_{s}"), F.col("part").alias(f"part_{s}")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], ["b", "fragment"])
    rows = rows.select("a", "b", "n_a", "n_b", "part_a", "part_b").mapInArrow(counted, "a long, b long, n_a long, n_b long, overlap long")
    sums = rows.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return sums.filter(100 * F.col("overlap") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


_FRAGMENT = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("n", pa.int64()), ("part", pa.binary())])


def set_classes(live: DataFrame) -> DataFrame:
    """``node, shingles``, one row for each different set; a set whose name no other row may have is not sent anywhere."""
    n = live.count()
    bits = sketch.bits_for(n)
    again = sketch.repeated(live.select("node"), lambda batch: _salted(batch.column("node").to_numpy().view(np.uint64), 50), bits, _pieces)
    shared = live.sparkSession.sparkContext.broadcast(again)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = sketch.passes(shared.value, bits, _salted(batch.column("node").to_numpy().view(np.uint64), 50))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met)], [*batch.schema.names, "met"])

    rows = live.select("node", "check", "shingles").mapInArrow(marked, "node long, check long, shingles binary, met boolean")
    one = rows.filter("met").groupBy("node", "check").agg(F.first("shingles").alias("shingles"))
    return rows.filter("not met").select("node", "shingles").union(fewer(one.select("node", "shingles"), n))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    sets = stored(document_sets(docs), "sets")
    swept(spark)
    ids = sets.select("doc_id", "n", "node", F.col("shingles").isNotNull().alias("live"))
    ids = stored(fewer(ids, sets.count()), "ids")
    classes = stored(set_classes(sets.filter("shingles is not null")), "classes")
    dropped(sets)
    swept(spark)
    own = classes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    order_ = spark.sparkContext.broadcast(shingle_order(classes))
    n = classes.count()
    labels, _ = rounds(_neighbour_links(classes, order_).union(own), 2 * n)
    swept(spark)
    pairs = stored(fewer(_candidates(classes, order_, n_parts, labels), n), "pairs")
    swept(spark)
    links = stored(fewer(_counted_links(pairs, classes, order_), n), "exact")
    dropped(classes, pairs)
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in "ab")
    merged = links.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    top = rounds(merged, links.count())[0].select(F.col("node").alias("label"), F.col("label").alias("top"))
    final = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("component"))
    live = ids.filter("live").select("doc_id", "n", "node")
    smallest = live.groupBy("node").agg(F.min("doc_id").alias("first")).join(final, "node")
    first = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(fewer(smallest.select("node", "component").join(first, "component").select("node", "component_id"), n), "named")
    swept(spark)
    alone = ids.filter("not live").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return live.join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null counts as larger), the first of those that share it.

    Rows without words are linked with nothing and all stay.
    """
    rows = numbered(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), F.col("_rest.text").alias("text"))).select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("_rest.doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("_row"))
    stay = ids.join(found, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return fewer(rows.join(stay.select(F.col("first._row").alias("_row")), "_row", "left_semi").select("_rest.*"), rows.count())
