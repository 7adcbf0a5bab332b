"""Language-model scores: marginal likelihood of a text over all its segmentations into subword pieces.

The pieces and their first weights come from an existing vocabulary file. Training texts' words are counted over all tasks
(blocked exchange by word hash), and EM_ROUNDS of expected piece counts over those words replace the weights; the file's
weights stay as a prior of PRIOR tokens. No piece but the mark ``▁`` reaches over a word's begin, so the lattice of a text
falls apart at its words and its probability is the product of theirs and of the end.

The base score is a word unigram with one added. Words of which at most 2**HEAVY_BITS can exist, those with a share of at
least 2**-HEAVY_BITS of all training tokens, are known to every task; the counts of the others are looked up by an exchange
that sends each word once per task and text.

Defined cases: null and empty text hold the end alone; a null doc_id belongs to the training rows; without training rows all
counts are 0; equal rows give equal results; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.exchange import mark, packed, part_of
from ledgerspark.llm.lattice import Lattice, Pieces, logs_of, read_vocabulary
from ledgerspark.llm.scratch import parts, stored
from ledgerspark.llm.words import Words, mixed, slices

EM_ROUNDS = 2
PRIOR = 1000.0
BYTE_SHARE = 0.001
HEAVY_BITS = 20
FLUSH = 2_000_000  # different words that a task holds before it sends them
MAX_KEPT = 1_000_000
SYMBOLS = 150_000  # symbols of words in one lattice
SLICES = 32
NO_ID = np.iinfo(np.int64).max
LOG10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


_COUNTED = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("key", "count", "size", "text"))])
_COUNTED_SQL = "part int, key binary, count binary, size binary, text binary"


def _picked(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, where each is met first, and the number of each key's value."""
    codes, unique = pd.factorize(keys)
    first = np.flatnonzero(np.r_[True, codes[1:] > np.maximum.accumulate(codes)[:-1]]) if len(codes) else codes
    return unique, first, codes


class _Counts:
    """Words of a task's texts with their counts."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.text: list[bytes] = []
        self.count: list[np.ndarray] = []

    def add(self, words: Words) -> None:
        unique, first, codes = _distinct(words.hashes())
        raw = words.data.tobytes()
        rows = np.fromiter((self.row.get(h, -1) for h in unique.tolist()), dtype=np.int64, count=len(unique))
        new = np.flatnonzero(rows < 0)
        rows[new] = len(self.text) + np.arange(len(new))
        self.row.update(zip(unique[new].tolist(), rows[new].tolist()))
        self.text += _picked(raw, words.starts[first[new]], words.ends[first[new]])
        self.count.append(np.stack([rows, np.bincount(codes, minlength=len(unique))]))

    def sent(self, n_parts: int) -> Iterator[pa.RecordBatch]:
        if not self.text:
            return
        pairs = np.concatenate(self.count, axis=1)
        count = np.bincount(pairs[0], weights=pairs[1], minlength=len(self.text)).astype(np.int64)
        key = np.fromiter(self.row, dtype=np.uint64, count=len(self.row))
        size = np.fromiter(map(len, self.text), dtype=np.int32, count=len(self.text))
        place = np.arange(len(key))
        for p in packed(part_of(key, n_parts), n_parts, {"key": key, "count": count, "size": size, "place": place}):
            at = np.frombuffer(p.pop("place"), dtype=np.int64).tolist()
            yield pa.RecordBatch.from_pylist([{**p, "text": b"".join(self.text[i] for i in at)}], schema=_COUNTED)


def word_counts(texts: DataFrame) -> DataFrame:
    """Words (A-Z lower-cased) of ``texts(text)`` with their counts; binary rows, each word in one of them."""
    n_parts = parts(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for piece in slices(batch):
                counts.add(Words(piece.column("text"), lower=True))
                if len(counts.text) >= FLUSH:
                    yield from counts.sent(n_parts)
                    counts = _Counts()
        yield from counts.sent(n_parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by_part.setdefault(row["part"], []).append(row)
        for part, rows in by_part.items():
            key, count, size = (np.concatenate([np.frombuffer(r[c], dtype=t) for r in rows]) for c, t in (("key", np.uint64), ("count", np.int64), ("size", np.int32)))
            raw = b"".join(r["text"] for r in rows)
            ends = np.cumsum(size, dtype=np.int64)
            unique, first, codes = _distinct(key)
            total = np.bincount(codes, weights=count, minlength=len(unique)).astype(np.int64)
            text = b"".join(_picked(raw, ends[first] - size[first], ends[first]))
            out = {"part": part, "key": unique.tobytes(), "count": total.tobytes(), "size": size[first].tobytes(), "text": text}
            yield pa.RecordBatch.from_pylist([{**out, "n_words": len(unique), "n_tokens": int(total.sum())}], schema=_MERGED)

    rows = texts.mapInArrow(counted, _COUNTED_SQL).repartition(n_parts, "part")
    return rows.mapInArrow(merged, _COUNTED_SQL + ", n_words long, n_tokens long")


_MERGED = pa.schema([*_COUNTED, ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _lattices(words: list[bytes], pieces: Pieces) -> Iterator[tuple[slice, Lattice]]:
    """Words in runs of bounded size."""
    size = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SYMBOLS, side="right")))
        yield slice(a, b), Lattice(words[a:b], pieces)
        a = b


def _expected(counts: DataFrame, pieces, logs) -> np.ndarray:
    """Expected piece counts over all training words: a task's vector travels in slices and is summed slice by slice."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces.value.n + 256)
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(np.frombuffer(row["size"], dtype=np.int32), dtype=np.int64)
                words = _picked(row["text"], np.r_[0, ends[:-1]], ends)
                count = np.frombuffer(row["count"], dtype=np.int64)
                for some, lattice in _lattices(words, pieces.value):
                    total += lattice.expected(logs.value, count[some])
        for k, x in enumerate(np.array_split(total, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "sums"])

    rows = counts.select("size", "text", "count").mapInArrow(expect, "slice int, sums binary")
    rows = rows.repartition(SLICES, "slice").mapInArrow(summed, "slice int, sums binary").collect()
    if not rows:
        return np.zeros(pieces.value.n + 256)
    return np.concatenate([np.frombuffer(bytes(r.sums)) for r in sorted(rows, key=lambda r: r.slice)])


class Model:
    """Piece weights and what the base score needs; small, for all tasks."""

    def __init__(self, pieces, logs, end_log: float, tokens: int, types: int, ends: int, heavy: tuple[np.ndarray, np.ndarray]):
        self.pieces, self.logs, self.end_log, self.heavy = pieces, logs, end_log, heavy
        self.tokens, self.types, self.ends = tokens, types, ends


def train(docs: DataFrame, vocabulary: str) -> tuple[Model, DataFrame]:
    """Model from all rows of ``docs(text)``, and their word counts."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs.select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("v")).first()
    ends = docs.count()
    tokens, types = total.n + ends, total.v + (ends > 0)
    raw, weights = read_vocabulary(vocabulary)
    pieces = spark.sparkContext.broadcast(Pieces.of(raw))
    prior = np.r_[weights / weights.sum() * (1 - BYTE_SHARE), np.full(256, BYTE_SHARE / 256)]
    current, end_share = prior, 0.5
    for _ in range(EM_ROUNDS if total.n else 0):
        seen = _expected(counts, pieces, spark.sparkContext.broadcast(logs_of(current)))
        current = (seen + PRIOR * prior) / (seen.sum() + PRIOR)
        end_share = ends / (seen.sum() + ends)
    least = max(1, tokens >> HEAVY_BITS)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, count in zip(batch.column("key").to_pylist(), batch.column("count").to_pylist()):
                key, count = np.frombuffer(key, dtype=np.int64), np.frombuffer(count, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x[count >= least].tobytes()], pa.binary()) for x in (key, count)], ["key", "count"])

    rows = counts.select("key", "count").mapInArrow(often, "key binary, count binary").collect()
    key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r.key), dtype=np.uint64) for r in rows)])
    count = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(bytes(r["count"]), dtype=np.int64) for r in rows)])
    order = np.argsort(key)
    return Model(pieces, logs_of(current * (1 - end_share)), math.log(end_share), tokens, types, ends, (key[order], count[order])), counts


_SENT = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("kind", "key", "row", "times", "ids", "marks", "values"))])
_SENT_SQL = "part int, kind binary, key binary, row binary, times binary, ids binary, marks binary, values binary"
_BACK = pa.schema([("bucket", pa.int32()), ("whole", pa.bool_()), *((c, pa.binary()) for c in ("ids", "marks", "values"))])
_BACK_SQL = "bucket int, whole boolean, ids binary, marks binary, values binary"
#: Numbers that travel for a row: base score so far, known tokens so far, tokens, score.
WIDTH = 4
RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among the sorted keys, and its value or 0."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0)


class _Asked:
    """Rows of a task with what is known of them, and the words whose counts they still need."""

    def __init__(self, n_parts: int, bucket_of):
        self.n_parts, self.bucket_of = n_parts, bucket_of
        self.clear()

    def clear(self) -> None:
        self.ids, self.marks, self.values, self.key, self.row, self.times = ([] for _ in range(6))
        self.rows = self.pairs = 0

    def add(self, ids, marks, values, key, row, times) -> None:
        for name, x in (("ids", ids), ("marks", marks), ("values", values), ("key", key), ("row", row + self.rows), ("times", times.astype(np.int32))):
            getattr(self, name).append(x)
        self.rows += len(ids)
        self.pairs += len(key)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, marks, values, key, row, times = (np.concatenate(x) for x in (self.ids, self.marks, self.values, self.key, self.row, self.times))
        for p in packed(self.bucket_of(ids, marks), self.n_parts, {"ids": ids, "marks": marks, "values": values}):
            yield pa.RecordBatch.from_pylist([{**p, "kind": b"row"}], schema=_SENT)
        for p in packed(part_of(key, self.n_parts), self.n_parts, {"key": key, "row": row, "times": times}):
            used, place = np.unique(np.frombuffer(p["row"], dtype=np.int64), return_inverse=True)
            p = {**p, "kind": b"ask", "row": place.astype(np.uint32).tobytes(), "ids": ids[used].tobytes(), "marks": marks[used].tobytes()}
            yield pa.RecordBatch.from_pylist([p], schema=_SENT)


class _Replies:
    """Answers of a task, kept until they are many."""

    def __init__(self):
        self.ids, self.marks, self.values, self.rows = [], [], [], 0

    def add(self, ids, marks, values) -> None:
        self.ids.append(ids)
        self.marks.append(marks)
        self.values.append(values)
        self.rows += len(ids)

    def sent(self, n_parts: int, bucket_of) -> Iterator[pa.RecordBatch]:
        if self.rows:
            ids, marks, values = (np.concatenate(x) for x in (self.ids, self.marks, self.values))
            for p in packed(bucket_of(ids, marks), n_parts, {"ids": ids, "marks": marks, "values": values}):
                yield pa.RecordBatch.from_pylist([{"bucket": p.pop("part"), "whole": False, **p}], schema=_BACK)
        self.__init__()


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    n_parts = parts(spark)
    shared = spark.sparkContext.broadcast(model.__dict__ | {"pieces": None, "logs": None})
    pieces, logs = model.pieces, spark.sparkContext.broadcast(model.logs)
    divisor = math.log10(model.tokens + model.types + 1)

    def bucket_of(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return (mixed(ids.astype(np.uint64) ^ mixed(marks.astype(np.uint64))) % np.uint64(n_parts)).astype(np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, held = shared.value, {}, _Asked(n_parts, bucket_of)
        heavy, heavy_count = m["heavy"]
        for batch in batches:
            for piece in slices(batch):
                words = Words(piece.column("text"), lower=True)
                n, raw = piece.num_rows, words.data.tobytes()
                unique, first, codes = _distinct(words.hashes())
                if len(known) > MAX_KEPT:
                    known.clear()
                log = np.fromiter((known.get(h, math.nan) for h in unique.tolist()), dtype=float, count=len(unique))
                new = np.flatnonzero(np.isnan(log))
                texts = _picked(raw, words.starts[first[new]], words.ends[first[new]])
                for some, lattice in _lattices(texts, pieces.value):
                    log[new[some]] = lattice.scores(logs.value)
                known.update(zip(unique[new].tolist(), log[new].tolist()))
                owner = words.owner
                values = np.zeros((n, WIDTH))
                values[:, 3] = (np.bincount(owner, weights=log[codes], minlength=n) + m["end_log"]) / LOG10
                values[:, 2] = words.counts + 1
                hit, count = _looked_up(heavy, heavy_count, unique)
                part_log = np.where(hit, np.log10(count + 1.0) - divisor, 0.0)
                values[:, 0] = np.bincount(owner, weights=part_log[codes], minlength=n) + math.log10(m["ends"] + 1) - divisor
                values[:, 1] = np.bincount(owner, weights=hit[codes], minlength=n) + (m["ends"] > 0)
                rare = np.flatnonzero(~hit[codes])
                width = max(1, len(unique))
                pair, times = np.unique(owner[rare] * width + codes[rare], return_counts=True)
                ids = piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held.add(ids, piece.column("mark").to_numpy(zero_copy_only=False), values, unique[pair % width], pair // width, times)
                if held.pairs >= FLUSH:
                    yield from held.sent()
                    held.clear()
        yield from held.sent()

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part with the counts first: the questions are answered as they stream by
        part, key, count, replies = -1, np.zeros(0, np.uint64), np.zeros(0, np.int64), _Replies()
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == b"row":
                    yield pa.RecordBatch.from_pylist([{"bucket": row["part"], "whole": True, **{c: row[c] for c in ("ids", "marks", "values")}}], schema=_BACK)
                    continue
                if row["part"] != part:
                    part, key, count = row["part"], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if row["kind"] == b"counts":
                    key, count = np.frombuffer(row["key"], dtype=np.uint64), np.frombuffer(row["times"], dtype=np.int64)
                    order = np.argsort(key)
                    key, count = key[order], count[order]
                    continue
                asked, times = np.frombuffer(row["key"], dtype=np.uint64), np.frombuffer(row["times"], dtype=np.int32)
                of = np.frombuffer(row["row"], dtype=np.uint32)
                hit, c = _looked_up(key, count, asked)
                ids, marks = (np.frombuffer(row[x], dtype=np.int64) for x in ("ids", "marks"))
                values = np.zeros((len(ids), WIDTH))
                values[:, 0] = np.bincount(of, weights=(np.log10(c + 1.0) - divisor) * times, minlength=len(ids))
                values[:, 1] = np.bincount(of, weights=hit * times, minlength=len(ids))
                replies.add(ids, marks, values)
                if replies.rows >= FLUSH:
                    yield from replies.sent(n_parts, bucket_of)
        yield from replies.sent(n_parts, bucket_of)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, values, whole = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                ids.append(np.frombuffer(row["ids"], dtype=np.int64))
                marks.append(np.frombuffer(row["marks"], dtype=np.int64))
                values.append(np.frombuffer(row["values"]).reshape(-1, WIDTH))
                whole.append(np.full(len(ids[-1]), row["whole"]))
        if not ids:
            return
        ids, marks, values, whole = (np.concatenate(x) for x in (ids, marks, values, whole))
        order = np.lexsort((marks, ids))
        ids, marks, values, whole = ids[order], marks[order], values[order], whole[order]
        begin = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
        copies = np.add.reduceat(whole.astype(np.int64), begin)  # equal rows: each asked for itself
        sums = np.add.reduceat(values, begin, axis=0) / copies[:, None]
        rows = np.repeat(np.arange(len(begin)), copies)
        out, sums = ids[begin][rows], sums[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, pa.int64(), mask=out == NO_ID), pa.array(np.rint(sums[:, 2]), pa.int64()), pa.array(np.rint(sums[:, 1]), pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 3])],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), mark()).mapInArrow(scored, _SENT_SQL)
    nothing = F.lit(None).cast("binary")
    known = counts.select("part", F.lit(b"counts").alias("kind"), "key", nothing.alias("row"), F.col("count").alias("times"), nothing.alias("ids"), nothing.alias("marks"), nothing.alias("values"))
    order = F.when(F.col("kind") == F.lit(b"counts"), 0).otherwise(1)
    dealt = known.union(sent).repartition(n_parts, "part").sortWithinPartitions("part", order)
    return dealt.mapInArrow(answered, _BACK_SQL).repartition(n_parts, "bucket").mapInArrow(summed, RESULT)
