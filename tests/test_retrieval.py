"""Indexed nearest neighbours and passage retrieval against brute force, with the recall that is claimed."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerspark.operators import ivf
from ledgerspark.plans import retrieval

SF = "/root/testdata/sf0.001"


def exact(ids, x, q, k):
    cosine = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q))
    return [ids[i] for i in np.lexsort((ids, -cosine))[:k]]


def test_index_recall_and_all_probes_exact(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 12)) * 3
    x = np.concatenate([centre[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 12)), np.tile(centre[0], (700, 1))])
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(90001, None), (90002, [0.0] * 12), (90003, [1.0]), (90004, [None] * 12), (90005, [float("nan")] * 12)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = centre[rng.integers(0, 30, 40)] + rng.normal(size=(40, 12))
    questions = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(900, None), (901, [0.0] * 12)], "query_id int, query array<double>")
    index = ivf.build(vectors, cells=32, sample=800, part_rows=200)
    assert index.rows.count() == len(x)  # every vector is indexed, the sample only places the cells
    assert index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 1000
    want = {k: exact(ids, x, v, 4) for k, v in enumerate(q)}
    for probes, least in ((32, 1.0), (8, 0.9)):
        got = {}
        for r in ivf.search(index, questions, 4, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got.keys() == want.keys()
        share = np.mean([len(set(got[k]) & set(want[k])) / 4 for k in want])
        assert share >= least and (probes < 32 or got == want)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    assert ivf.search(ivf.build(none), asked, 4).count() == 0


def test_knn_indexed_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    questions = retrieval.label_questions(vectors)
    want = {(r.query_id, r.vec_id) for r in retrieval.nearest(vectors, questions).collect()}
    got = {(r.query_id, r.vec_id) for r in retrieval.indexed_nearest(vectors, questions).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_passages_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    questions = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(40)
    passages = [(r.id, r.vector) for r in retrieval.passage_table(docs).select("id", "vector").collect() if r.vector]
    ids, x = np.array([i for i, _ in passages]), np.array([v for _, v in passages])
    assert len(set(ids.tolist())) == len(ids) > docs.count()
    got = {}
    for r in retrieval.passage_answers(docs, questions).collect():
        got.setdefault(r.query_id, []).append((r.rank, (r.doc_id << retrieval.CHUNK_BITS) | r.chunk_no))
    hits = total = 0
    for r in questions.collect():
        want = exact(ids, x, retrieval.text_vector(r.text), 4)
        hits += len(set(want) & {i for _, i in got[r.query_id]})
        total += 4
    print("recall", hits / total)
    assert hits >= 0.9 * total


def test_units_make_no_python_numbers():
    x = np.random.default_rng(2).normal(size=(20_000, 64))
    column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64), pa.array(x.ravel()))
    tracemalloc.start()
    places, unit = ivf.units(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.5 * x.nbytes
    assert len(places) == len(x) and np.array_equal(unit, x / np.sqrt((x * x).sum(axis=1))[:, None])
    odd = pa.array([None, [], [1.0], [None, 1.0], [3.0, 4.0], [float("nan"), 1.0], [0.0, 0.0], [float("inf"), 1.0], [0.0, 2.0]], pa.list_(pa.float64()))
    for column, first in ((odd, 0), (odd.slice(3), 3)):
        places, unit = ivf.units(column, 2)
        assert (places + first).tolist() == [4, 8] and unit.tolist() == [[0.6, 0.8], [0.0, 1.0]]
    assert ivf.units(odd)[0].tolist() == [2]


def test_sample_of_many_rows_meets_in_one_task_as_few(spark):
    vectors = spark.range(30_000, numPartitions=60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    want = [r.vector for r in ivf.least(vectors, 200).collect()]
    assert [r.vector for r in ivf.sampled(vectors, 200).collect()] == want
    assert 200 <= ivf.among(vectors, 200).count() < 1_000
    same_id = vectors.withColumn("id", F.lit(7).cast("long"))  # ids that do not spread: all rows or none are among them
    assert len(ivf.centroids(same_id, 16, 200)) == 15


def test_vectors_of_texts_one_by_one():
    def plain(text):
        counts, out = {}, np.zeros(retrieval.WIDTH)
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            counts[h] = counts.get(h, 0) + 1
        for h, n in counts.items():
            out[h % retrieval.WIDTH] += (1 - 2 * (h >> 31)) * (1 + np.log(n))
        return out

    texts = ["a b a A c", "", " \n", "É é x\u2003y", "zz " * 900 + "b a", "the cat the dog " * 20]
    assert np.array_equal(retrieval.text_vectors(texts), np.array([plain(t) for t in texts]))
    assert retrieval.text_vectors([]).shape == (0, retrieval.WIDTH)
