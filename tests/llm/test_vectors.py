"""Whitening and vector codes against plain numpy."""

import hashlib
import math
import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from conftest import SF

from ledgerspark.llm import codes, vectors, whitening

ODD = [(None, [0.5] * 6), (3, None), (4, []), (5, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6, [math.nan] * 6), (7, [math.inf] + [0.0] * 5), (8, [1.0, 2.0])]
SCHEMA = "vec_id long, embedding array<float>, label int, `_row` string, n string, code string"


def draw(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * spread
    return [(int(k), [float(np.float32(v)) for v in row]) for k, row in zip(rng.permutation(n), x)]


def frame(spark, rows, labels=None):
    random.seed(1)
    labels = labels or (lambda k: [None, 0, 1, 2][(k or 0) % 4])
    full = [(i, v, labels(i), "x", "y", "z") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def usable(rows):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    return [(i, v) for i, v in good if len(v) == size]


def test_matrices():
    import pyarrow as pa

    column = pa.array([v for _, v in ODD] + [[1.0, 2.0, 3.0]], pa.list_(pa.float32())).slice(1)
    assert [(p.tolist(), m.tolist()) for p, m in vectors.matrices(column)] == [([5], [[1.0, 2.0]]), ([6], [[1.0, 2.0, 3.0]])]


def check_whitened(rows, out, most=32):
    kept = usable(rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array((n * x - s), dtype=float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    held = min(most, int((values > values[0] * 1e-12).sum()))
    got = {}
    for r in out.collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-6 * values[r.component - 1] / values.sum() + 1e-15
        assert r.identity_error < 1e-9
    want = {}
    for (i, _), row, c in zip(kept, x, centred):
        key = (i, sum((n * a - b) ** 2 for a, b in zip(row, s)))
        want.setdefault(key, []).append(c @ basis[:, :held] / np.sqrt(values[:held]))
    assert got.keys() == want.keys()
    turn = None
    for key, rows_of in want.items():
        a = np.array([got[key][k + 1] for k in range(held)]).T
        assert a.shape == (len(rows_of), held)
        b = np.array(rows_of)
        if turn is None and np.abs(b[0]).min() > 1e-3:
            turn = np.sign(a[0] * b[0])
    for key, rows_of in want.items():
        a = np.sort(np.array([got[key][k + 1] for k in range(held)]).T * turn, axis=0)
        assert np.allclose(a, np.sort(np.array(rows_of), axis=0), atol=1e-6)


def test_whitening(spark):
    rows = draw(2, 90, 6) + ODD
    check_whitened(rows, whitening.whiten(frame(spark, rows)))
    check_whitened(rows, whitening.whiten(frame(spark, rows), most=2), most=2)
    # directions without variance, and a condition that a Gram matrix alone would lose
    flat = [(i, [*v, v[0], 0.25]) for i, v in draw(4, 80, 4, 50.0)]
    check_whitened(flat, whitening.whiten(frame(spark, flat)))


def test_whitening_keeps_small_directions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3)) * [1e9, 1e4, 0.5]
    x[:, 1] += x[:, 0]
    x[:, 2] += x[:, 0]
    data = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    fitted = whitening.fit(data.select("embedding"))
    whole = np.floor(x * 64)
    exact = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert np.allclose(fitted.eigenvalues, exact, rtol=1e-4) and whitening.identity_error(data.select("embedding"), fitted) < 1e-4


def test_whitening_of_nothing(spark):
    for rows in ([], ODD[1:6], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_whitening_of_embeddings(spark):
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table()
    check_whitened(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist())), whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")))


def plain_codes(rows, labels, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(c))) for c in v], labels(i)) for i, v in usable(rows)]
    if not kept:
        return [], None
    size = len(kept[0][1])
    width = -(-size // 4)
    kept = [(i, v, lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    x = np.zeros((len(kept), 4 * width), dtype=np.int64)
    x[:, :size] = [v for _, v, _ in kept]
    books = np.zeros((len(first), 4 * width), dtype=np.int64)
    books[:, :size] = [v for _, v, _ in first]
    x, books = x.reshape(len(kept), 4, width), books.reshape(len(first), 4, width).copy()

    def nearest():
        apart = ((x[:, None] - books[None]) ** 2).sum(axis=3)  # rows, entries, parts
        return apart.argmin(axis=1), apart.min(axis=1)

    for _ in range(rounds):
        best, _ = nearest()
        for p in range(4):
            for e in range(len(first)):
                own = x[best[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(axis=0) // len(own)
    best, error = nearest()
    error = error.sum(axis=1)
    by_label = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    out = [(i, "".join(f"{b:02x}" for b in row), e, by_label[label]) for (i, _, label), row, e in zip(kept, best.tolist(), error.tolist())]
    return out, hashlib.sha256(",".join(str(v) for p in range(4) for row in books[:, p].tolist() for v in row).encode()).hexdigest()


@pytest.mark.parametrize("size", [8, 6, 3])
def test_codes(spark, size):
    rows = draw(5, 700, size, 0.2) + [(i, v) for i, v in ODD if not v or len(v) != size] + [(9, [0.0] * size), (9, [0.5] * size), (None, [0.25] * size)]
    labels = lambda k: [None, 0, 1, 2][(k or 0) % 4]
    got = codes.codes(frame(spark, rows, labels)).collect()
    want, digest = plain_codes(rows, labels)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_few_and_none(spark):
    labels = lambda k: [None, 0, 1, 2][(k or 0) % 4]
    rows = [(2, [1.0, 2.0, 3.0, 4.0]), (1, [-1.5, 0.0, 0.25, 7.0]), (2, [1.0, 2.0, 3.0, 4.0])]
    got = codes.codes(frame(spark, rows)).collect()
    want, digest = plain_codes(rows, labels)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want) and {r.codebooks_sha256 for r in got} == {digest}
    assert codes.codes(frame(spark, [])).count() == codes.codes(frame(spark, ODD[1:6])).count() == 0


def test_shortlists_and_kernel():
    rng = np.random.default_rng(3)
    for scale in (10, 3000, 1 << 27):
        x, entries = rng.integers(-scale, scale, (300, 5)), rng.integers(-scale, scale, (40, 5))
        entries[7] = entries[3]
        distance = ((x[:, None].astype(object) - entries) ** 2).sum(axis=2)
        best, error = codes.nearest(x, entries)
        assert best.tolist() == distance.argmin(axis=1).tolist() and error.tolist() == distance.min(axis=1).tolist()
        groups = x[np.argsort(x[:, 0])].reshape(30, 10, 5)
        short = codes.shortlists(np.stack([groups.min(axis=1), groups.max(axis=1)], axis=1), entries)
        for points, row in zip(groups, short):
            near = ((points[:, None].astype(object) - entries) ** 2).sum(axis=2)
            assert all(row[k] for r in near for k in np.flatnonzero(r == r.min()))


def test_hilbert_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = codes.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
