"""Passages of documents and nearest neighbours of question vectors."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators import ivf
from ledgerspark.session import staged

# Passage size, overlap, separators from coarse to fine, neighbours per question.
CHUNK, OVERLAP = 500, 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
NEIGHBOURS = 4
MAX_QUESTIONS = 4096  # questions sent to every task
BLOCK = 256  # questions compared with a batch at once
WIDTH = 128  # places of a passage's vector
VECTOR_ROWS = 4096  # texts whose vectors are made at once
CHUNK_BITS = 20  # passages of a document that its ids leave room for


def _parts(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Text cut at the coarsest separator that occurs (it starts the following part), and the finer separators."""
    here = next(i for i, s in enumerate(separators) if s in text)
    mark, finer = separators[here], separators[here + 1 :]
    if mark == "":
        return list(text), finer
    first, *others = text.split(mark)
    return [p for p in (first, *(mark + o for o in others)) if p], finer


def _joined(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts up to ``size`` characters; a passage starts with up to ``overlap`` of the one before."""
    window, length = [], 0
    for part in parts:
        if window and length + len(part) > size:
            yield "".join(window).strip()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    yield "".join(window).strip()


def chunk_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Passages of a text. A part that is still too long is cut with finer separators, apart from its neighbours."""
    out, run = [], []
    parts, finer = _parts(text, separators)
    for part in parts:
        if len(part) < size or not finer:
            run.append(part)
            continue
        out.extend(_joined(run, size, overlap))
        out.extend(chunk_text(part, size, overlap, finer))
        run = []
    out.extend(_joined(run, size, overlap))
    return [p for p in out if p]


def chunks(documents: DataFrame) -> DataFrame:
    """One row per passage of the whole text; the text is cut on the executors, batch by batch."""
    def cut(batches):
        for batch in batches:
            lists = [chunk_text(t or "") for t in batch["text"]]
            counts = [len(c) for c in lists]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].repeat(counts).to_numpy(),
                    "source": batch["source"].repeat(counts).to_numpy(),
                    "chunk_no": [i for n in counts for i in range(n)],
                    "chunk": [c for cs in lists for c in cs],
                }
            )

    return documents.select("doc_id", "source", "text").mapInPandas(cut, "doc_id bigint, source string, chunk_no int, chunk string")


def label_questions(vectors: DataFrame) -> DataFrame:
    """Mean vector of every label, place by place, as long as its longest vector."""
    places = vectors.select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("place", "x"))
    means = places.groupBy("query_id", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "mean")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda p: p["mean"]).alias("query"))


def nearest(vectors: DataFrame, questions: DataFrame, k: int = NEIGHBOURS, limit: int = MAX_QUESTIONS) -> DataFrame:
    """The k most similar vectors (cosine) of every question; ties go to the smaller id, and only the result is rounded.

    Vectors that are null, hold a null, have no length or another number of places than the question have no similarity
    and are no neighbours; questions of that kind have none.

    The questions travel to every task, so their number is checked: up to ``limit`` go at once, more are processed
    in blocks by a hash of their id. A task keeps k candidates per question and batch, and the final choice sees
    those only; pairs of all vectors with all questions are never written.
    """
    def unit(vector) -> np.ndarray | None:
        if vector is None or any(x is None for x in vector):
            return None
        v = np.asarray(vector, dtype=np.float64)
        size = np.linalg.norm(v)
        return v / size if len(v) and np.isfinite(size) and size > 0 else None

    total = questions.count()
    blocks = max(1, -(-total // limit))
    schema = "query_id int, vec_id bigint, similarity double"

    def block(part: int) -> DataFrame:
        wanted = questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part).collect()
        asked: dict[int, tuple[list, list]] = {}
        for row in wanted:
            v = unit(row.query)
            if v is not None:
                ids, rows = asked.setdefault(len(v), ([], []))
                ids.append(row.query_id)
                rows.append(v)
        matrices = {size: (np.array(ids, dtype=np.int64), np.array(rows)) for size, (ids, rows) in asked.items()}

        def best(batches):
            for batch in batches:
                units = [unit(v) for v in batch["embedding"]]
                for size, (ids, matrix) in matrices.items():
                    fit = [i for i, v in enumerate(units) if v is not None and len(v) == size]
                    if not fit:
                        continue
                    rows, keys = np.array([units[i] for i in fit]), batch["vec_id"].to_numpy()[fit]
                    keep = min(k, len(keys))
                    for start in range(0, len(ids), BLOCK):
                        cosine = rows @ matrix[start : start + BLOCK].T
                        for j, query in enumerate(ids[start : start + BLOCK]):
                            column = cosine[:, j]
                            near = np.flatnonzero(column >= np.partition(column, -keep)[-keep])
                            near = near[np.lexsort((keys[near], -column[near]))[:keep]]
                            yield pd.DataFrame({"query_id": query, "vec_id": keys[near], "similarity": column[near]})

        return vectors.select("vec_id", "embedding").mapInPandas(best, schema)

    found = block(0)
    for part in range(1, blocks):
        found = found.unionByName(block(part))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", 6))


class _Crc(dict):
    """Hash of each word met, kept for a batch of texts."""

    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode())
        return h


def text_vectors(texts: list[str]) -> np.ndarray:
    """Hashed words of each text: each word adds or takes 1 + log of its count at a place of its own."""
    words = [t.lower().split() for t in texts]
    hashes = np.fromiter(map(_Crc().__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    codes, pairs = pd.factorize(owner << 32 | hashes)  # in the order met, so that a text's sums do not depend on its batch
    counts, which = np.unique(np.bincount(codes, minlength=len(pairs)), return_inverse=True)
    added = np.array([1 + np.log(n) for n in counts.tolist()])[which]
    h = pairs & 0xFFFFFFFF
    places = np.bincount((pairs >> 32) * WIDTH + h % WIDTH, weights=(1 - 2 * (h >> 31)) * added, minlength=len(texts) * WIDTH)
    return places.reshape(len(texts), WIDTH)


def text_vector(text: str) -> np.ndarray:
    """The vector of one text."""
    return text_vectors([text])[0]


def with_vector(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the vector of a text column; null for null and blank texts."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, VECTOR_ROWS):
                batch = whole.slice(k, VECTOR_ROWS)
                texts = batch.column(text).to_pylist()
                blank = np.array([not t or t.isspace() for t in texts])
                found = text_vectors([t for t, no in zip(texts, blank.tolist()) if not no])
                offsets = np.r_[0, np.cumsum(~blank) * WIDTH].astype(np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()), mask=pa.array(blank))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(added, f"{kinds}, `{name}` array<double>")


def passage_table(documents: DataFrame) -> DataFrame:
    """Every passage of all documents with its vector: ``id`` (document and passage number in one), ``doc_id, source, chunk_no, chunk, vector``."""
    rows = with_vector(chunks(documents), "chunk", "vector")
    return rows.withColumn("id", F.shiftleft("doc_id", CHUNK_BITS).bitwiseOR(F.col("chunk_no").cast("long")))


def passage_answers(documents: DataFrame, questions: DataFrame, k: int = NEIGHBOURS, probes: int = ivf.PROBES) -> DataFrame:
    """The k passages nearest to each of ``questions(query_id, text)``, by an index over the passages of all documents."""
    passages = staged(passage_table(documents))
    asked = with_vector(questions.select("query_id", "text"), "text", "query")
    found = ivf.search(ivf.build(passages.select("id", "vector")), asked, k, probes)
    return found.join(passages.select("id", "doc_id", "chunk_no", "source"), "id").select("query_id", "rank", "doc_id", "chunk_no", "source", F.round("similarity", 6).alias("similarity"))


def indexed_nearest(vectors: DataFrame, questions: DataFrame, k: int = NEIGHBOURS, probes: int = ivf.PROBES) -> DataFrame:
    """``nearest`` by an index: the questions are joined, not sent to every task."""
    found = ivf.search(ivf.build(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))), questions, k, probes)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def answer_sources(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct sorted sources of the passages behind every question."""
    j = found.join(documents.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    return j.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("passages")
    )
