"""Token ids with the tokenizers library, written as ORC in document order and read back stripe by stripe.

A slice of texts is cut into chunks at places where the tokenizer's own splitting always cuts: at white space, and between an
ASCII letter and another ASCII character in words without apostrophe. Different chunks of a slice are encoded once by the
library and kept by the worker, up to MAX_KEPT; the ids of a text are those of its chunks. Texts that may hold a special
token's string are encoded whole.

Defined cases: null and empty text give only the end id; null ids come first; rows of equal doc_id are ordered by the hash of
their text; an empty table gives an empty file set; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.scratch import parts
from ledgerspark.llm.words import LOWER, Words, slices

MAX_KEPT = 1_000_000
MAX_KEPT_BYTES = 64_000_000

#: Class of a byte (white space, ASCII letter, other ASCII, beyond ASCII) and the pairs of classes between which a chunk ends.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[:128] = 2
_CLASS[97:123] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CUT = np.zeros(16, dtype=bool)
_CUT[[1 * 4 + 2, 2 * 4 + 1]] = True


class Ragged:
    """Growing list of integer lists, gathered by index with numpy."""

    def __init__(self):
        self.values = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.rows = 0

    def extend(self, values: np.ndarray, counts: np.ndarray) -> None:
        total, n = len(values), len(counts)
        while self.used + total > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.rows + n > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.values[self.used : self.used + total] = values
        self.begin[self.rows : self.rows + n] = self.used + np.cumsum(counts) - counts
        self.count[self.rows : self.rows + n] = counts
        self.used += total
        self.rows += n

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows one after the other, and the offsets of the rows in them."""
        counts = self.count[rows]
        offsets = np.r_[0, np.cumsum(counts)]
        at = np.arange(offsets[-1]) + np.repeat(self.begin[rows] - offsets[:-1], counts)
        return self.values[at], offsets


class Kept:
    """What the worker keeps of chunks seen: their bytes to row of a Ragged; cleared when it holds MAX_KEPT or MAX_KEPT_BYTES."""

    def __init__(self, encode, most: int = MAX_KEPT):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.size = 0
        self.ids = Ragged()

    def ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of the words; words of equal bytes, and no others, share an entry."""
        if len(self.rows) >= self.most or self.size >= MAX_KEPT_BYTES:
            self.clear()
        codes, first = words.codes()
        names = words.raw(first)
        rows = np.fromiter((self.rows.get(x, -1) for x in names), dtype=np.int64, count=len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            base = self.ids.rows
            self.ids.extend(*self.encode(fresh))
            rows[new] = base + np.arange(len(new))
            self.rows.update(zip(fresh, rows[new].tolist()))
            self.size += sum(map(len, fresh))
        return self.ids.gather(rows[codes])


class Chunks(Words):
    """Words cut further between ASCII letters and other ASCII characters, save those with an apostrophe."""

    def edges(self, inside: np.ndarray) -> np.ndarray:
        kind = _CLASS[self.data]
        cut = np.zeros(len(kind) + 1, dtype=bool)
        cut[1:-1] = _CUT[kind[:-1] * 4 + kind[1:]]
        for at in np.flatnonzero(self.data == 39).tolist():
            a = b = at
            while a > 0 and inside[a - 1]:
                a -= 1
            while b < len(kind) and inside[b]:
                b += 1
            cut[a : b + 1] = False
        return cut


def _letters(text: str) -> bool:
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).lower().isalpha())


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _kept(path: str) -> Kept:
    tokenizer = _tokenizer(path)

    closing = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1, dtype=bool)
    closing[[i for x, i in tokenizer.get_vocab(with_added_tokens=False).items() if x.endswith("</w>")]] = True

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode() for x in pieces]
        # a chunk of letters alone is one word to the tokenizer, and each word's last token is marked: many go in one call
        alone = np.fromiter(map(_letters, texts), dtype=bool, count=len(texts))
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for places in np.array_split(np.flatnonzero(alone), 1 + len(texts) // 512):
            got = np.array(tokenizer.encode(" ".join([texts[i] for i in places.tolist()]), add_special_tokens=False).ids, dtype=np.int32)
            stops = np.flatnonzero(closing[got]) + 1
            if len(stops) != len(places):
                alone[places] = False
                continue
            for i, a, b in zip(places.tolist(), [0, *stops[:-1].tolist()], stops.tolist()):
                ids[i] = got[a:b]
        rest = np.flatnonzero(~alone).tolist()
        for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, dtype=np.int32)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    return Kept(encode)


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many texts and their offsets."""
    chunks = Chunks(column, lower=True)
    ids, offsets = _kept(path).ids_of(chunks)
    bounds = offsets[chunks.first]
    marked = _holding(chunks.data.tobytes(), chunks.offsets, b"<|")
    if not marked:
        return ids, bounds
    whole = {i: np.array(_tokenizer(path).encode(column[i].as_py(), add_special_tokens=False).ids, dtype=np.int32) for i in marked}
    pieces = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(column))]
    return np.concatenate(pieces), np.r_[0, np.cumsum([len(x) for x in pieces])]


def _holding(raw: bytes, offsets: np.ndarray, mark: bytes) -> list[int]:
    out, at = [], raw.find(mark)
    while at >= 0:
        i = int(np.searchsorted(offsets, at, side="right")) - 1
        if at + len(mark) <= offsets[i + 1]:
            out.append(i)
            at = raw.find(mark, int(offsets[i + 1]))
        else:
            at = raw.find(mark, at + 1)
    return out


def _with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


FILE_SCHEMA = "part int, place long, doc_id long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, **options: str) -> None:
    """Write ``docs(doc_id, text)`` as token ids in ascending doc_id order, one ORC file set.

    Integer columns are run-length encoded by the format; row indexes stand for every 1,000 documents and Bloom filters on
    doc_id, so readers skip stripes and row groups. Ranges of doc_id are dealt to the tasks; equal ids are split by the hash
    of their text and their place in the input, so no id makes a task too large.
    """
    spark = docs.sparkSession

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = _with_end(*encode_texts(piece.column("text"), tokenizer), end)
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(place, place + n)),
                        piece.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32())),
                    ],
                    ["part", "place", "doc_id", "n_tokens", "ids"],
                )
                place += n

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    settings = {"orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
    rows.mapInArrow(encoded, FILE_SCHEMA).write.options(**settings | options).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``part, place, doc_id, n_tokens, ids``; given ids are looked up through stripe and row-group metadata."""
    rows = spark.read.schema(FILE_SCHEMA).orc(folder)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files' rows: start counts the ids of all documents before.

    Ids are summed per file first, so only one row per file meets in the running sum over files.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "place", "doc_id")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "place", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = tokens.select("part", "place", "doc_id", "ids").mapInArrow(summed, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    return rows


def starts(rows: DataFrame) -> DataFrame:
    """Turn per-file rows of checksums() into running starts over all files."""
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = files.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    rows = rows.withColumn("_inside", inside)
    out = rows.join(before, F.col("part") == F.col("_part"))
    return out.select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
