"""Inverted-file index over vectors: every vector lies in the cell of its nearest centroid, a question looks into a few cells.

Centroids come from SAMPLE vectors at most, taken in the order of a hash of their ids (so a sample of all rows, the same one in each
run), by LLOYD rounds of spherical k-means; all vectors are then put into cells. A cell is stored in parts of about PART_ROWS rows, so that a
crowded cell (equal vectors of a third of all rows) is many parts. Questions are a DataFrame: each is sent to the parts of
its PROBES nearest cells by an equi-join and compared there exactly; a part gives k rows for each of its questions, and the best k of all parts
stay. Pairs of questions and vectors are never written. How many of the true neighbours are found depends on PROBES; with as
many probes as cells all are.

Vectors that are null, hold a null or a value that is not finite, or have no direction are in no cell; so are those of
another length than the centroids. Ties go to the smaller id.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import staged

SAMPLE = 20_000
SPARE = 2
LLOYD = 6
CELLS = 256  # at most; and no more than the root of the sample's rows
PROBES = 32
PART_ROWS = 20_000
ASKED_ROWS = 4_096  # questions that meet a part at once


def units(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that have a direction, of the given length or the first one met."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if size is None:
        size = int(next(iter(lengths[lengths > 0]), 0))
    places = np.flatnonzero(lengths == size) if size else np.zeros(0, dtype=np.int64)
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null is not finite here
    if len(matrix) != len(places) * size:
        matrix = matrix[np.repeat(lengths == size, lengths)]
    matrix = matrix.reshape(len(places), size)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((matrix * matrix).sum(axis=1)) if size else np.zeros(0)
    good = np.isfinite(length) & (length > 0)
    return places[good], matrix[good] / length[good][:, None]


def least(vectors: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` vectors that come first in the order of a hash of their ids."""
    return vectors.filter("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector")


def among(vectors: DataFrame, sample: int) -> DataFrame:
    """The rows of least hashes, about SPARE times ``sample`` of them."""
    share = min(1.0, SPARE * sample / max(1, vectors.count()))
    return vectors.filter(F.xxhash64("id") <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))


def sampled(vectors: DataFrame, sample: int) -> DataFrame:
    """``least`` where at least ``sample`` rows are found ``among`` them: what meets in one task does not grow with the table."""
    return least(among(vectors, sample), sample)


def centroids(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of ``vectors(id, vector)``, fitted on ``sample`` rows at most: ``cells``, or the root of the sample's rows if less."""
    rows = sampled(vectors, sample).toArrow()
    if len(rows) < sample:  # few rows, or ids that do not spread
        rows = least(vectors, sample).toArrow()
    column = rows["vector"].combine_chunks()
    sizes = collections.Counter(pc.list_value_length(column).to_pylist())
    sizes.pop(0, None)
    if not sizes:
        return np.zeros((0, 0))
    _, x = units(column, max(sizes, key=lambda s: (sizes[s], s)))
    found = np.unique(x, axis=0)
    centre = found[np.random.default_rng(1).permutation(len(found))[: min(cells, math.isqrt(len(found)) + 1)]]
    for _ in range(LLOYD):
        best = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, best, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centre)
    return centre


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # cell, part, id, vector
    sizes: DataFrame  # cell, parts
    centre: np.ndarray


def build(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> Index:
    """Index of ``vectors(id, vector)``, stored; the id is a number."""
    vectors = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    centre = centroids(vectors, cells, sample)
    size = centre.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = units(batch.column("vector"), size)
            if size and len(places):
                cell = (x @ centre.T).argmax(axis=1).astype(np.int32)
                some = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *some.columns], ["cell", "id", "vector"])

    rows = staged(vectors.mapInArrow(placed, "cell int, id long, vector array<double>"))
    sizes = staged(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")))
    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))
    return Index(dealt.select("cell", "part", "id", "vector"), sizes, centre)


def search(index: Index, questions: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """``query_id, id, similarity, rank``: the k most similar indexed vectors of ``questions(query_id, query)`` in their nearest cells."""
    centre = index.centre
    size, probes = centre.shape[1], min(probes, len(centre))
    kind = questions.schema["query_id"].dataType.simpleString()

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = units(batch.column("query"), size)
            if probes and len(places):
                near = np.argpartition(-(x @ centre.T), probes - 1, axis=1)[:, :probes].astype(np.int32)
                some = batch.take(pa.array(np.repeat(places, probes)))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *some.columns], ["cell", "query_id", "query"])

    def compared(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            _, x = units(held["vector"].combine_chunks(), size)
            ids = held["id"].to_numpy()
            for batch in asked.to_batches(ASKED_ROWS):
                _, q = units(batch.column("query"), size)
                cosine = q @ x.T
                keep = min(k, len(ids))
                least = np.partition(cosine, -keep, axis=1)[:, -keep]
                for row in range(len(q)):
                    near = np.flatnonzero(cosine[row] >= least[row])
                    near = near[np.lexsort((ids[near], -cosine[row][near]))[:keep]]
                    out.append((np.full(len(near), row), ids[near], cosine[row][near], batch))
        tables = [pa.table({"query_id": b.column("query_id").take(pa.array(r)), "id": i, "similarity": s}) for r, i, s, b in out]
        return pa.concat_tables(tables) if tables else pa.table({"query_id": asked["query_id"].slice(0, 0), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    asked = questions.select("query_id", F.col("query").cast("array<double>")).mapInArrow(aimed, f"cell int, query_id {kind}, query array<double>")
    asked = asked.join(index.sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "query")
    found = asked.groupBy("cell", "part").cogroup(index.rows.groupBy("cell", "part")).applyInArrow(compared, f"query_id {kind}, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
