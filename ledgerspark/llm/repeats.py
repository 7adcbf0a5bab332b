"""Suffix-array dedup: byte strings of LENGTH or more that start twice anywhere, found as maximal repeats.

Anchors. Of every LENGTH bytes the least hash of GRAM bytes marks an anchor (winnowing), so equal strings of LENGTH bytes hold
the same anchor at the same place, and at least half of their other bytes lie on one side of it. A merged sketch over the hashes of anchors
with so many bytes before, and with so many after, leaves the anchors for which one may occur twice; each of these is sent
to its hash's part with the bytes around it, at most LENGTH - GRAM before and LENGTH after, which is all that a string of
LENGTH bytes holding the anchor can touch. Where only spans are asked for, a task sends equal contexts once, and
compressed: most of them overlap nothing that travels with them.

Hot anchors. A line that very many texts hold, with different text around it, would gather all its contexts in one part. So an anchor
whose count in a merged count sketch is above HOT is sent under other keys: hashes of its gram with LONGER bytes more, taken from the
left, the right or both sides in SHARES ways. Two contexts that share LENGTH bytes around the anchor agree on one
of these spans, so they still meet, and a hot group is left only where almost LENGTH equal bytes are that frequent.

Intervals. In a part the suffixes that begin at the anchors are sorted (a sparse suffix array) and a stack over their common
prefixes gives the LCP intervals. The bytes before the anchors, read backwards, are ranked once in the same way. Inside an
interval its members in the order of that rank, with least common prefixes between neighbours, show where the left extension ends
(left-extension diversity). For the spans, every member keeps the longest extension to each side that it shares with another
member; for the groups, the intervals over the left extensions that no longer suffix shares give every maximal repeat
with all its occurrences.

For spans a context ends LEFT bytes before and LENGTH bytes after its anchor; ``removed`` unites the spans per document. For groups it
begins one byte earlier and goes on for ``reach`` bytes. A repeat's first anchor sees the repeat's begin, others see that it goes on to the
left and leave it out, so each maximal repeat comes once; above ``reach`` bytes after the first anchor it is cut there.

Defined cases: null and empty text have no bytes; texts shorter than LENGTH stay whole; a null doc_id is an id of its own;
equal rows repeat each other; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sketch
from ledgerspark.llm.exchange import joined, mark, packed, part_of
from ledgerspark.llm.scratch import parts
from ledgerspark.llm.words import _byte_values, _powers, mixed, slices, text_bytes

LENGTH = 400
GRAM = 64
LEFT = LENGTH - GRAM
FLUSH_BYTES = 48_000_000  # context bytes that a task holds before it sends them
HOT = 20_000  # places of an anchor above which, if they are also HOT_SHARE times a cell's mean, it is sent under longer keys
HOT_SHARE = 8
SHARES = 4
MEMBER_BYTES = 100  # what one more place of a known context takes
REACH = 4096  # bytes after the anchor of a context in repeat_groups
NO_ID = np.iinfo(np.int64).max


def _running(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each ``width`` values in a row (the last width - 1 places are left out)."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in a run of texts and the hashes of the GRAM bytes there."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values(11)[data] * up[: len(data)], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    width = LENGTH - GRAM + 1
    least = _running(grams, width, np.minimum)
    start = np.arange(len(least))
    stop = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least = np.where(start + LENGTH <= stop, least, 0)
    padded = np.zeros(len(grams) + width - 1, dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    chosen = np.flatnonzero((grams == _running(padded, width, np.maximum)) & (grams > 0))
    return chosen, grams[chosen]


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values(17)[data] * _powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _span_hashes(total: np.ndarray, low: np.ndarray, high: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the bytes from each ``low`` to its ``high``; different for spans of a different kind."""
    return mixed(((total[high] - total[low]) * _powers(len(total))[1][low]) ^ np.uint64(kind))


def _halves(total: np.ndarray, at: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which anchors have half of LEFT bytes before, or after, and the hashes of these spans."""
    for kind, before, after in ((101, LEFT // 2, 0), (102, 0, LEFT // 2)):
        low, high = at - before, at + GRAM + after
        ok = np.flatnonzero((low >= begin) & (high <= stop))
        yield ok, _span_hashes(total, low[ok], high[ok], kind)


def _keys(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes for the sketch, and those of the anchors themselves, which are counted."""
    data, offsets = text_bytes(piece.column("text"))
    at, grams = anchors(data, offsets)
    if not len(at):
        return grams, grams
    owner = np.searchsorted(offsets, at, side="right") - 1
    return np.concatenate([x for _, x in _halves(_sums(data), at, offsets[owner], offsets[owner + 1])]), grams


_SENT = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("key", "left", "right", "text", "open", "row", "place", "ids", "marks", "spans"))])
_SENT_SQL = "part int, " + ", ".join(f"{c} binary" for c in ("key", "left", "right", "text", "open", "row", "place", "ids", "marks", "spans"))
_FOUND = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "marks", "spans"))])
_FOUND_SQL = "bucket int, ids binary, marks binary, spans binary"


def _bucket(ids: np.ndarray, marks: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64) ^ mixed(marks.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(ids: np.ndarray, marks: np.ndarray, spans: np.ndarray, buckets: int) -> Iterator[dict]:
    """Spans (start, stop, group) by bucket of their rows."""
    for p in packed(_bucket(ids, marks, buckets), buckets, {"ids": ids, "marks": marks, "spans": spans}):
        yield {"bucket": p["part"], **{k: p[k] for k in ("ids", "marks", "spans")}}


def _name(text: bytes) -> int:
    """Number of a maximal repeat group: a hash of its string."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> 1


def _longer(total: np.ndarray, at: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each way of sharing the bytes between the sides: which anchors have them, and the hashes of their longer spans."""
    # with LEFT bytes more in all, one of SHARES + 1 steps on the right and the rest on the left, less one step that may be split
    step = LEFT // (SHARES + 1)
    for k in range(SHARES + 1):
        low, high = at - step * (SHARES - k), at + GRAM + step * k
        ok = np.flatnonzero((low >= begin) & (high <= stop))
        yield ok, _span_hashes(total, low[ok], high[ok], k + 1)


def _sides(reach: int | None) -> tuple[int, int]:
    """Bytes of a context before and after its anchor; ``reach`` is given where groups are asked for."""
    return (LEFT, LENGTH) if reach is None else (LEFT + 1, max(reach, LENGTH))


class _Held:
    """Anchors of a task that may repeat, with their contexts; equal contexts are kept once unless groups are asked for."""

    def __init__(self, n_parts: int, reach: int | None, hot: np.ndarray):
        self.n_parts, self.named, self.hot = n_parts, reach is not None, hot
        self.left, self.right = _sides(reach)
        self.clear()

    def clear(self) -> None:
        self.context: dict[tuple, list[tuple[int, int, int]]] = {}
        self.size = 0

    def add(self, piece: pa.RecordBatch, plane: np.ndarray, bits: int) -> None:
        data, offsets = text_bytes(piece.column("text"))
        at, keys = anchors(data, offsets)
        if not len(at):
            return
        total, owner = _sums(data), np.searchsorted(offsets, at, side="right") - 1
        some = np.zeros(len(at), dtype=bool)
        for ok, hashes in _halves(total, at, offsets[owner], offsets[owner + 1]):
            some[ok] |= sketch.passes(plane, bits, hashes)
        at, keys, owner = at[some], keys[some], owner[some]
        begin, stop = offsets[owner], offsets[owner + 1]
        hot = self.hot[(keys >> np.uint64(64 - (len(self.hot).bit_length() - 1))).astype(np.int64)]
        rows = [(np.flatnonzero(~hot), keys[~hot])]
        if hot.any():
            there = np.flatnonzero(hot)
            rows += [(there[ok], longer) for ok, longer in _longer(total, at[hot], begin[hot], stop[hot])]
        left, right = np.maximum(begin, at - self.left), np.minimum(stop, at + self.right)
        ids = piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)[owner]
        marks = piece.column("mark").to_numpy(zero_copy_only=False)[owner]
        raw = data.tobytes()
        for places, names in rows:
            for key, a, p, b, i, m, s in zip(names.tolist(), *(x[places].tolist() for x in (left, at, right, ids, marks, begin))):
                name = (key, p - a, raw[a:b], *((len(self.context),) if self.named else ()))
                known = self.context.get(name)
                self.size += MEMBER_BYTES
                if known is None:
                    self.context[name] = [(i, m, p - s)]
                    self.size += b - a
                else:
                    known.append((i, m, p - s))

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.context:
            return
        # contexts met twice here are repeats as they stand; elsewhere they only serve as partners
        rows = [(i, m, p - n[1], p - n[1] + len(n[2]), 0) for n, members in self.context.items() if len(members) > 1 and len(n[2]) >= LENGTH for i, m, p in members]
        if rows:
            found = np.array(rows, dtype=np.int64)
            for p in _by_bucket(found[:, 0].copy(), found[:, 1].copy(), np.ascontiguousarray(found[:, 2:]), self.n_parts):
                yield pa.RecordBatch.from_pylist([{"part": p["bucket"], **{c: p[c] for c in ("ids", "marks", "spans")}}], schema=_SENT)
        names = list(self.context)
        key = np.array([n[0] for n in names], dtype=np.uint64)
        left = np.array([n[1] for n in names], dtype=np.int32)
        right = np.array([len(n[2]) - n[1] for n in names], dtype=np.int32)
        first = np.array([x[0] for x in self.context.values()], dtype=np.int64)
        open_ = np.array([len(x) == 1 or len(n[2]) < LENGTH for n, x in self.context.items()], dtype=np.uint8)
        index, squeeze = np.arange(len(names)), zstandard.ZstdCompressor(level=7)
        for p in packed(part_of(key, self.n_parts), self.n_parts, {"key": key, "left": left, "right": right, "open": open_, "place": first[:, 2], "ids": first[:, 0], "marks": first[:, 1], "row": index}):
            at = np.frombuffer(p.pop("row"), dtype=np.int64).tolist()
            yield pa.RecordBatch.from_pylist([{**p, "text": squeeze.compress(b"".join(names[i][2] for i in at))}], schema=_SENT)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
    """Bytes that the places ``a`` and ``b`` share from there on, or before there with a negative ``width``, ``most`` of each pair at
    most and no more than the width. ``text`` has as many bytes more on either side than the places need."""
    forward, width = width > 0, abs(width)
    rows = np.lib.stride_tricks.sliding_window_view(text, width)
    out, step = np.zeros(len(a), dtype=np.int64), max(1, 2_000_000 // width)
    for k in range(0, len(a), step):
        x, y = (p[k : k + step] - (0 if forward else width) for p in (a, b))
        differ = rows[x] != rows[y]
        differ = differ if forward else differ[:, ::-1]
        out[k : k + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(out, most)


class _Least:
    """Least value of any range of an array, from least values of ranges of every power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Least of ``values[begin:stop]``; ranges are not empty."""
        size = stop - begin
        level = np.frexp(size.astype(float))[1] - 1
        out = np.zeros(len(begin), dtype=self.rows[0].dtype)
        for k in np.unique(level).tolist():
            some = level == k
            row = self.rows[k]
            out[some] = np.minimum(row[begin[some]], row[stop[some] - (1 << k)])
        return out


def intervals(common: list[int]) -> list[tuple[int, int, int]]:
    """LCP intervals (length, first, last) of a sorted group; common[k] is the prefix that k shares with k - 1. Inner ones come first."""
    out, stack = [], [(0, 0)]
    for k in range(1, len(common) + 1):
        value, begin = (common[k] if k < len(common) else 0), k - 1
        while stack[-1][0] > value:
            length, begin = stack.pop()
            out.append((length, begin, k - 1))
        if stack[-1][0] < value:
            stack.append((value, begin))
    return out


class _Group:
    """Contexts of one key, in the order of their suffixes (``members``, numbers of contexts of the part)."""

    def __init__(self, text: np.ndarray, middle: np.ndarray, left: np.ndarray, right: np.ndarray, members: np.ndarray, sides: tuple[int, int]):
        body = lambda a, b: text[a:b].tobytes()
        own = members.tolist()
        after = {i: body(m, m + r) for i, m, r in zip(own, middle[members].tolist(), right[members].tolist())}
        own.sort(key=after.__getitem__)
        del after
        self.members = np.array(own)
        m, r, n = middle[self.members], right[self.members], left[self.members]
        self.room = n
        self.common = np.r_[0, _common(text, m[:-1], m[1:], np.minimum(r[:-1], r[1:]), sides[1])]
        before = [body(a, b)[::-1] for a, b in zip((m - n).tolist(), m.tolist())]
        by_left = np.array(sorted(range(len(own)), key=before.__getitem__))
        del before
        a, b = by_left[:-1], by_left[1:]
        self.rank = np.empty(len(own), dtype=np.int64)
        self.rank[by_left] = np.arange(len(own))
        self.by_left = by_left
        self.shared = _Least(np.r_[0, _common(text, m[a], m[b], np.minimum(n[a], n[b]), -sides[0])])

    def _backwards(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Members of an interval in the order of their left sides, and the bytes before that each shares with the one before it."""
        rank = np.sort(self.rank[first : last + 1])
        return self.by_left[rank], self.shared.of(rank[:-1] + 1, rank[1:] + 1)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before and after that each member shares with others in strings of LENGTH or more; 0 where there is none."""
        before, after = np.zeros((2, len(self.members)), dtype=np.int64)
        for length, first, last in intervals(self.common.tolist()):
            if length < GRAM or last == first:
                continue
            some = slice(first, last + 1)
            if (after[some] >= length).all() and (before[some] >= self.room[some]).all():
                continue  # inner intervals have found all that there is
            at, shared = self._backwards(first, last)
            own = np.maximum(np.r_[0, shared], np.r_[shared, 0])
            hit = own + length >= LENGTH
            at, own = at[hit], own[hit]
            before[at] = np.maximum(before[at], own)
            after[at] = np.maximum(after[at], length)
        return before, after

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats that begin LEFT bytes before the anchor at most: bytes before, bytes after and all members of each."""
        suffixes = _Least(self.common)
        for length, first, last in intervals(self.common.tolist()):
            if length < GRAM or last == first:
                continue
            at, shared = self._backwards(first, last)
            for own, a, b in intervals([0, *shared.tolist()]) + ([(0, 0, last - first)] if length >= LENGTH and not shared.all() else []):
                some = at[a : b + 1]
                if b > a and own <= LEFT and own + length >= LENGTH and suffixes.of(some.min(keepdims=True) + 1, some.max(keepdims=True) + 1)[0] == length:
                    yield own, length, self.members[some]


def _part_spans(rows: list[dict], n_parts: int, reach: int | None) -> Iterator[pa.RecordBatch]:
    named, sides = reach is not None, _sides(reach)
    room = max(sides)
    kinds = {"key": np.uint64, "left": np.int32, "right": np.int32, "open": np.uint8, "place": np.int64, "ids": np.int64, "marks": np.int64}
    col = {c: np.concatenate([np.frombuffer(r[c], dtype=t) for r in rows]) for c, t in kinds.items()}
    left, right = col["left"].astype(np.int64), col["right"].astype(np.int64)
    # all bytes of the part once, with room for reading over either end
    expand, text, at = zstandard.ZstdDecompressor(), np.zeros(int((left + right).sum()) + 2 * room, dtype=np.uint8), room
    for r in rows:
        body = expand.decompress(r.pop("text"))
        text[at : at + len(body)] = np.frombuffer(body, dtype=np.uint8)
        at += len(body)
    middle = room + np.cumsum(left + right) - right
    order = np.argsort(col["key"], kind="stable")
    key = col["key"][order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(key)])
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # context, bytes before, bytes after, group
    small = begin[size == 2]
    a, b = order[small], order[small + 1]
    if len(a):
        after = _common(text, middle[a], middle[b], np.minimum(right[a], right[b]), sides[1])
        before = _common(text, middle[a], middle[b], np.minimum(left[a], left[b]), -sides[0])
        hit = (after >= GRAM) & (before + after >= LENGTH) & (before <= LEFT)
        a, b, before, after = (x[hit] for x in (a, b, before, after))
        for own in (a, b):
            spans.append((own, before, after, _names(text, middle[a], before, after) if named else np.zeros(len(a), np.int64)))
    for k, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        group = _Group(text, middle, left, right, order[k : k + n], sides)
        if named:
            for before, after, members in group.groups():
                ones = np.ones(len(members), dtype=np.int64)
                name = _names(text, middle[members[:1]], ones[:1] * before, ones[:1] * after)[0]
                spans.append((members, ones * before, ones * after, ones * name))
        else:
            before, after = group.reach()
            hit = after > 0
            spans.append((group.members[hit], before[hit], after[hit], np.zeros(int(hit.sum()), np.int64)))
    if not spans:
        return
    row, before, after, name = (np.concatenate(x) for x in zip(*spans))
    some = col["open"][row] == 1
    row, before, after, name = row[some], before[some], after[some], name[some]
    place = col["place"][row]
    for p in _by_bucket(col["ids"][row], col["marks"][row], np.stack([place - before, place + after, name], axis=1), n_parts):
        yield pa.RecordBatch.from_pylist([p], schema=_FOUND)


def _names(text: np.ndarray, middle: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.array([_name(text[a:b].tobytes()) for a, b in zip((middle - before).tolist(), (middle + after).tolist())], dtype=np.int64)


def repeat_spans(docs: DataFrame, reach: int | None = None, hot: int = HOT, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """Repeated spans in binary rows by bucket (``_bucket``) of the documents.

    With a ``reach`` they come with their groups, else the spans of one anchor as the one that they cover together.
    """
    spark = docs.sparkSession
    n_parts = parts(spark)
    bits = sketch.cells_for(docs, LEFT / 4)  # two keys for each anchor
    again, counts = sketch.repeated_counted(docs.select("text"), _keys, bits)
    plane = spark.sparkContext.broadcast(again)
    heavy = spark.sparkContext.broadcast(counts > max(hot, HOT_SHARE * counts.mean()))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_parts, reach, heavy.value)
        for batch in batches:
            for piece in slices(batch):
                held.add(piece, plane.value, bits)
                if held.size >= flush_bytes:
                    yield from held.sent()
                    held.clear()
        yield from held.sent()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] is None:
                    yield pa.RecordBatch.from_pylist([{"bucket": row["part"], **{c: row[c] for c in ("ids", "marks", "spans")}}], schema=_FOUND)
                else:
                    by_part.setdefault(row["part"], []).append(row)
        while by_part:
            yield from _part_spans(by_part.popitem()[1], n_parts, reach)

    rows = docs.select("doc_id", "text", mark()).mapInArrow(sent, _SENT_SQL)
    return rows.repartition(n_parts, "part").mapInArrow(found, _FOUND_SQL)


def repeat_groups(docs: DataFrame, reach: int = REACH, **options: int) -> DataFrame:
    """``group, doc_id, start, stop``: every maximal repeat of LENGTH or more with all its occurrences as byte spans."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, spans = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["spans"], dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spans[:, 2]), pa.array(ids, mask=ids == NO_ID), pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["group", "doc_id", "start", "stop"]
                )

    return repeat_spans(docs, reach, **options).mapInArrow(listed, "group long, doc_id long, start long, stop long").distinct()


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(docs: DataFrame, with_text: bool = True, **options: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs(doc_id, text)``; kept are the bytes that stay."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_parts = parts(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            bucket = _bucket(ids, batch.column("mark").to_numpy(zero_copy_only=False), n_parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", "doc_id", "text", "mark"])

    def kept(texts: pa.Table, found: pa.Table) -> pa.Table:
        by_row: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if found.num_rows:
            spans = joined(found["spans"], np.int64).reshape(-1, 3)
            names = zip(joined(found["ids"], np.int64).tolist(), joined(found["marks"], np.int64).tolist())
            for name, a, b in zip(names, spans[:, 0].tolist(), spans[:, 1].tolist()):
                by_row.setdefault(name, []).append((a, b))
        out = {c: [] for c in _RESULT.names}
        for doc_id, text, m in zip(*(texts[c] for c in ("doc_id", "text", "mark"))):
            raw = (text.as_py() or "").encode()
            number = doc_id.as_py()
            rest, at, gone, runs = [], 0, 0, 0
            for a, b in _united(by_row.get((NO_ID if number is None else number, m.as_py()), [])):
                rest.append(raw[at:a])
                at, gone, runs = b, gone + b - a, runs + 1
            rest = b"".join([*rest, raw[at:]])
            for c, x in zip(_RESULT.names, (number, len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest if with_text else None)):
                out[c].append(x)
        return pa.Table.from_pydict(out, schema=_RESULT)

    dealt = docs.select("doc_id", "text", mark()).mapInArrow(deal, "bucket int, doc_id long, text string, mark long")
    return dealt.groupBy("bucket").cogroup(repeat_spans(docs, **options).groupBy("bucket")).applyInArrow(kept, RESULT)


def _united(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of bytes that the spans cover, touching ones as one."""
    begin = end = None
    for a, b in sorted(spans):
        if end is None:
            begin, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield begin, end
            begin, end = a, b
    if end is not None:
        yield begin, end
