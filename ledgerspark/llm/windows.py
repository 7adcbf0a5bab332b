"""Substring dedup: words in 13-word windows that already start in a document with a smaller id are removed.

Three steps. (1) Every window is stood for by the least of its SUB-word hashes; partition sketches of these are merged, and a
window whose stand-in was met once only is unique. (2) The other windows, never fewer than all repeated ones, are grouped
exactly by 96-bit hashes. A task keeps only the smallest document of each window before the shuffle, so a window that a third
of all documents share is sent once per task. (3) The starts found go back to their documents, where covered words are dropped.

Defined cases: null or empty text has no words and keeps the empty text; a null doc_id counts as larger than every id; rows
with one doc_id are judged apart, and neither is smaller; equal rows give equal results; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import sketch
from ledgerspark.llm.exchange import joined, mark, packed, part_of
from ledgerspark.llm.scratch import parts
from ledgerspark.llm.words import Words, mixed, slices, window_starts, windows

SIZE = 13
SUB = 7
NO_ID = np.iinfo(np.int64).max
FLUSH = 4_000_000  # windows that a task holds before it sends them

_SENT = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("check", pa.binary()), ("row", pa.binary()), ("start", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary())])
_SENT_SQL = "part int, key binary, check binary, row binary, start binary, ids binary, marks binary"
_FOUND_SQL = "bucket int, ids binary, marks binary, starts binary, counts binary"
_FOUND = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "marks", "starts", "counts"))])


def _stand_ins(hashes: np.ndarray) -> np.ndarray:
    """For each window of SIZE words the least hash of its SUB-word windows."""
    sub = windows(hashes, SUB, seed=1)
    n = len(hashes) - SIZE + 1
    out = sub[:n].copy()
    for k in range(1, SIZE - SUB + 1):
        np.minimum(out, sub[k : k + n], out=out)
    return mixed(out)


def _keys(piece: pa.RecordBatch) -> np.ndarray:
    words = Words(piece.column("text"))
    ok = window_starts(words, SIZE)
    if not ok.any():
        return np.zeros(0, np.uint64)
    keys, owner = _stand_ins(words.hashes())[ok], words.owner[: len(ok)][ok]
    # windows beside each other mostly share their stand-in; a document needs to count once
    return keys[np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]]


def _bucket(ids: np.ndarray, marks: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64) ^ mixed(marks.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def _replies(ids: np.ndarray, marks: np.ndarray, row: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[dict]:
    """Starts by bucket of their rows; ``row`` numbers the rows in ids and marks."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    rows, counts = np.unique(row, return_counts=True)
    bucket = _bucket(ids[rows], marks[rows], buckets)
    by_start = np.repeat(bucket, counts)
    of = {p["part"]: p for p in packed(bucket, buckets, {"ids": ids[rows], "marks": marks[rows], "counts": counts.astype(np.int32)})}
    for p in packed(by_start, buckets, {"starts": start.astype(np.int32)}):
        yield {"bucket": p["part"], "starts": p["starts"], **{k: of[p["part"]][k] for k in ("ids", "marks", "counts")}}


class _Held:
    """Windows of a task that may repeat elsewhere."""

    def __init__(self, n_parts: int, buckets: int):
        self.n_parts, self.buckets = n_parts, buckets
        self.clear()

    def clear(self) -> None:
        self.key, self.check, self.row, self.start, self.ids, self.marks = ([] for _ in range(6))
        self.rows = self.size = 0

    def add(self, piece: pa.RecordBatch, plane: np.ndarray, bits: int) -> None:
        words = Words(piece.column("text"))
        ok = window_starts(words, SIZE)
        self.ids.append(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        self.marks.append(piece.column("mark").to_numpy(zero_copy_only=False))
        if ok.any():
            hashes = words.hashes()
            at = np.flatnonzero(ok & sketch.passes(plane, bits, _stand_ins(hashes)))
            self.key.append(windows(hashes, SIZE, seed=2)[at])
            self.check.append((windows(words.hashes(2), SIZE, seed=3)[at] >> np.uint64(32)).astype(np.uint32))
            owner = words.owner[at]
            self.row.append(owner + self.rows)
            self.start.append((at - words.first[owner]).astype(np.int32))
            self.size += len(at)
        self.rows += piece.num_rows

    def sent(self) -> Iterator[dict]:
        if not self.size:
            return
        key, check, row, start = (np.concatenate(x) for x in (self.key, self.check, self.row, self.start))
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        # what a smaller document of this task has is removed at once; the first document of each window is sent
        number = ids[row]
        order = np.lexsort((number, check, key))
        k, c, n = key[order], check[order], number[order]
        group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) - 1
        least = n[np.flatnonzero(np.r_[True, np.diff(group) > 0])][group]
        removed = order[n > least]
        first = np.sort(order[n == least])
        for i, reply in enumerate(_replies(ids, marks, row[removed], start[removed], self.buckets)):
            yield {"part": (i * 7919 + int(key[0] % np.uint64(997))) % self.n_parts, "key": None, "check": None, "row": reply["counts"], "start": reply["starts"], "ids": reply["ids"], "marks": reply["marks"]}
        key, check, row, start = key[first], check[first], row[first], start[first]
        for p in packed(part_of(key, self.n_parts), self.n_parts, {"key": key, "check": check, "row": row.astype(np.int64), "start": start}):
            rows, at = np.unique(np.frombuffer(p["row"], dtype=np.int64), return_inverse=True)
            yield {**p, "row": at.astype(np.uint32).tobytes(), "ids": ids[rows].tobytes(), "marks": marks[rows].tobytes()}


def repeated_starts(docs: DataFrame) -> DataFrame:
    """Starts of windows that a smaller document has, in binary rows by bucket (``_bucket``) of the documents."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    bits = sketch.cells_for(docs, 20)
    plane = spark.sparkContext.broadcast(sketch.repeated(docs.select("text"), _keys, bits))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_parts, n_parts)
        for batch in batches:
            for piece in slices(batch):
                held.add(piece, plane.value, bits)
                if held.size >= FLUSH:
                    for row in held.sent():
                        yield pa.RecordBatch.from_pylist([row], schema=_SENT)
                    held.clear()
        for row in held.sent():
            yield pa.RecordBatch.from_pylist([row], schema=_SENT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] is None:
                    ids, marks = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "marks"))
                    bucket = int(_bucket(ids[:1], marks[:1], n_parts)[0])
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "ids": row["ids"], "marks": row["marks"], "starts": row["start"], "counts": row["row"]}], schema=_FOUND)
                else:
                    by_part.setdefault(row["part"], []).append(row)
        for rows in by_part.values():
            yield from _resolved(rows)

    def _resolved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        read = lambda c, t: [np.frombuffer(r[c], dtype=t) for r in rows]
        ids, row = read("ids", np.int64), read("row", np.uint32)
        base = np.r_[0, np.cumsum([len(x) for x in ids])]
        key, check, start = (np.concatenate(read(c, t)) for c, t in (("key", np.uint64), ("check", np.uint32), ("start", np.int32)))
        row = np.concatenate([x.astype(np.int64) + b for x, b in zip(row, base)])
        ids, marks = np.concatenate(ids), np.concatenate(read("marks", np.int64))
        number = ids[row]
        order = np.lexsort((number, check, key))
        k, c, n = key[order], check[order], number[order]
        group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) - 1
        least = n[np.flatnonzero(np.r_[True, np.diff(group) > 0])][group]
        removed = order[n > least]
        for reply in _replies(ids, marks, row[removed], start[removed], n_parts):
            yield pa.RecordBatch.from_pylist([reply], schema=_FOUND)

    rows = docs.select("doc_id", "text", mark()).mapInArrow(sent, _SENT_SQL)
    return rows.repartition(n_parts, "part").mapInArrow(found, _FOUND_SQL)


def _starts_by_row(found: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    if not found.num_rows:
        return {}
    ids, marks = joined(found["ids"], np.int64), joined(found["marks"], np.int64)
    counts, starts = joined(found["counts"], np.int32), joined(found["starts"], np.int32)
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    bounds = np.r_[0, np.cumsum(counts)]
    for i, m, a, b in zip(ids.tolist(), marks.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        out.setdefault((i, m), []).append(starts[a:b])
    return {k: np.concatenate(v) for k, v in out.items()}


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def removed(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for each row of ``docs(doc_id, text)``; kept is the text that stays."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_parts = parts(docs.sparkSession)
    starts = repeated_starts(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            bucket = _bucket(ids, batch.column("mark").to_numpy(zero_copy_only=False), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", "doc_id", "text", "mark"])

    def kept(texts: pa.Table, found: pa.Table) -> pa.Table:
        by_row = _starts_by_row(found)
        out: list[pa.RecordBatch] = []
        for batch in texts.combine_chunks().to_batches():
            for piece in slices(batch):
                out.append(_kept(piece, by_row, with_text))
        return pa.Table.from_batches(out, schema=_RESULT)

    dealt = docs.select("doc_id", "text", mark()).mapInArrow(deal, "bucket int, doc_id long, text string, mark long")
    return dealt.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(kept, RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _kept(piece: pa.RecordBatch, by_row: dict[tuple[int, int], np.ndarray], with_text: bool) -> pa.RecordBatch:
    words = Words(piece.column("text"))
    raw = words.data.tobytes()
    ids = piece.column("doc_id").fill_null(NO_ID).to_pylist()
    digests, removed, texts = [], [], []
    for i, (number, m) in enumerate(zip(ids, piece.column("mark").to_pylist())):
        a, b = int(words.first[i]), int(words.first[i + 1])
        gone = np.zeros(b - a + SIZE, dtype=np.int32)
        starts = by_row.get((number, m))
        if starts is not None:
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + SIZE, -1)
        stay = np.flatnonzero(np.cumsum(gone)[: b - a] == 0) + a
        text = b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())])
        digests.append(hashlib.sha256(text).hexdigest())
        removed.append(b - a - len(stay))
        texts.append(text.decode() if with_text else None)
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
        schema=_RESULT,
    )
