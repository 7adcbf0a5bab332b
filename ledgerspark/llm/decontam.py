"""Benchmark decontamination by latent semantic retrieval.

Terms (lower-cased runs of letters and digits) fall into FEATURES columns by hash. Three passes over all texts:
1. in how many passages of WINDOW words each column occurs (inverse document frequencies, squared: with them as they are the
   words that all texts share fill the latent space);
2. the randomised range finder B = A'A R over the TF-IDF rows A of all passages of the corpus and, with equal total weight, of all
   items of the benchmark; every task sums its own share of B, and the shares are added slice by slice in the order of the tasks.
   From B the singular values and right singular vectors of A follow in one pass (the Nystroem form of the randomised SVD: B = C R for
   C = A'A, so C is about B (R'B)^-1 B', whose factor is decomposed); the vectors span the latent space;
3. every window of WINDOW words, one each STEP words, is projected and compared with all projected benchmark items. Windows whose
   cosine with an item reaches CANDIDATE are candidates; so are, as a second way in, windows that hold (with MARGIN words on
   both sides) MIN_ANSWER of an item's answer, the quarter of its words that the corpus has least often. For candidates the
   longest common subsequence of item and window, with the margins, is taken. Who holds MIN_ANSWER of the answer needs MIN_COMMON of the
   item's words in order; where the cosine does not reach MIN_COSINE they must lie close together, in a stretch of the
   item's length divided by MIN_COMMON: an item that many rows hold has small weights and hardly a direction of its own, but its
   words still stand there one after the other. A paraphrase that has lost more of the answer needs PARAPHRASE of the words in
   order, close together, and is found by its cosine alone.

Items of more than WINDOW terms are looked for by their passages of at most WINDOW terms, each with its part of the item's
answer: who holds MIN_ANSWER of the whole answer holds as much of one part. The item is then judged as a whole, over as much
text around the window as its terms before and after the passage, divided by MIN_COMMON, may take; so much text is close together
for its length whatever the cosine.

The benchmark is the stated query set; it is taken in blocks of ``block`` items, each against all rows. The latent space comes from all
items, so the blocks do not change a cosine. Nothing else is collected but vectors of fixed size (FEATURES, and FEATURES x RANK
for the basis).

Defined cases: null and empty text holds no passage and leaks nothing; a text shorter than WINDOW is one passage; items with
fewer than MIN_ITEM terms are left out, since any text holds them; a null doc_id is returned as null; equal rows give equal
rows; empty tables give an empty result; only ``doc_id``, ``text`` and ``item_id``, ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.words import Words, slices

FEATURES = 1 << 15
RANK = 48
WINDOW = 64
STEP = 32
MARGIN = 64
MIN_COSINE = 0.4
CANDIDATE = 0.85
MIN_COMMON = 0.7
PARAPHRASE = 0.8
MIN_ANSWER = 0.6
MIN_ITEM = 5
BLOCK = 2048
SLICES = 64
_RUN = 1 << 15  # words that are projected at a time

_TERM = np.zeros(256, dtype=bool)
_TERM[128:] = True
for _a, _b in ((48, 58), (97, 123)):
    _TERM[_a:_b] = True


class Terms(Words):
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII; all letters are lower-cased."""

    member = _TERM

    def __init__(self, column: pa.Array):
        super().__init__(pc.utf8_lower(column.cast(pa.large_string())))

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each term and its column."""
        hashes = self.hashes(3)
        return hashes, (hashes >> np.uint64(40)).astype(np.int64) % FEATURES

    def chunks(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk of ``size`` terms begins, and for each text the number of chunks before it."""
        n = -(-self.counts // size)
        before = np.r_[0, np.cumsum(n)]
        inside = np.arange(before[-1]) - np.repeat(before[:-1], n)
        return np.repeat(self.first[:-1], n) + inside * size, before


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(x, dtype=np.float64)
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["slice", "sums"])


def _added(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' arrays, which come in SLICES binary rows each."""
    total = np.zeros(int(np.prod(shape)), dtype=np.float64)
    bounds = np.linspace(0, len(total), SLICES + 1).astype(int)
    rows = rows.repartition(SLICES, "slice").sortWithinPartitions("slice", "task")
    for row in rows.mapInArrow(_summed, "slice int, sums binary").collect():
        total[bounds[row.slice] : bounds[row.slice + 1]] = np.frombuffer(bytes(row.sums), dtype=np.float64)
    return total.reshape(shape)


_SHARES = "slice int, task int, sums binary"


def _cut(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.ascontiguousarray(total, dtype=np.float64).reshape(-1)
    task = TaskContext.get().partitionId()
    bounds = np.linspace(0, len(flat), SLICES + 1).astype(int)
    for k in range(SLICES):
        if flat[bounds[k] : bounds[k + 1]].any():
            body = pa.array([flat[bounds[k] : bounds[k + 1]].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), body], ["slice", "task", "sums"])


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Passages that hold each column, and all passages."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.float64)
        for batch in batches:
            for piece in slices(batch):
                terms = Terms(piece.column("text"))
                starts, _ = terms.chunks(WINDOW)
                if len(starts):
                    _, column = terms.columns()
                    passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(column)]))
                    pairs = np.unique(passage * FEATURES + column)
                    total[:-1] += np.bincount(pairs % FEATURES, minlength=FEATURES)
                    total[-1] += len(starts)
        yield from _cut(total)

    total = _added(docs.select("text").mapInArrow(counted, _SHARES), (FEATURES + 1,))
    return total[:-1], float(total[-1])


def _project(column: np.ndarray, basis: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the basis rows of each chunk's columns; chunks end where the next begins."""
    out = np.zeros((len(starts), basis.shape[1]), dtype=np.float32)
    stops = np.r_[starts[1:], len(column)]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + _RUN, side="right")))
        rows = basis[column[starts[a] : stops[b - 1]]]
        out[a:b] = np.add.reduceat(rows, starts[a:b] - starts[a], axis=0)
        a = b
    return out


def _range(column: np.ndarray, starts: np.ndarray, weighted: np.ndarray, idf: np.ndarray, into: np.ndarray) -> None:
    """Add A'(A R) of some passages to ``into``: weighted holds the rows of R times idf."""
    x = _project(column, weighted, starts)
    order = np.argsort(column.astype(np.uint16), kind="stable")
    passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(column)]))[order]
    ordered = column[order]
    for a in range(0, len(column), _RUN):
        own = ordered[a : a + _RUN]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums = np.add.reduceat(x[passage[a : a + _RUN]], begin, axis=0)
        into[own[begin]] += sums * idf[own[begin], None]


def singular_vectors(sums: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A, from B = A'A R and R."""
    shift = np.sqrt(len(sums)) * np.finfo(float).eps * np.linalg.norm(sums, 2)
    moved = sums + shift * random
    small = random.T @ moved
    values, turn = np.linalg.eigh((small + small.T) / 2)
    held = values > values[-1] * 1e-12
    vectors, found, _ = np.linalg.svd(moved @ (turn[:, held] / np.sqrt(values[held])), full_matrices=False)
    return vectors, np.sqrt(np.maximum(found**2 - shift, 0))


def latent_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The latent space of the corpus and all items: right singular vectors, FEATURES x RANK (fewer where there are no more)."""
    spark = docs.sparkSession
    random = np.random.default_rng(7).standard_normal((FEATURES, RANK)).astype(np.float32)
    weighted = spark.sparkContext.broadcast((random * idf[:, None], idf))

    def shares(size: int):
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, weights = weighted.value
            total = np.zeros((FEATURES, RANK), dtype=np.float64)
            for batch in batches:
                for piece in slices(batch):
                    terms = Terms(piece.column("text"))
                    starts, _ = terms.chunks(size)
                    if len(starts):
                        # a slice adds up in half the memory, and the slices in full precision
                        own = np.zeros((FEATURES, RANK), dtype=np.float32)
                        _range(terms.columns()[1], starts, rows, weights, own)
                        total += own
            yield from _cut(total)

        return added

    corpus, own = (_added(x.select("text").mapInArrow(shares(WINDOW), _SHARES), (FEATURES, RANK)) for x in (docs, items))
    scale = [np.linalg.norm(x) or 1.0 for x in (corpus, own)]
    vectors, _ = singular_vectors(corpus / scale[0] + own / scale[1], random.astype(float))
    return vectors.astype(np.float32)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, all places of ``item`` at a time as bits of one number."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(item)) - 1
    row = every
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(item) - row.bit_count()


def lies_close(item: list[int], text: list[int], least: int) -> bool:
    """Whether ``least`` of the item's terms stand in order in a stretch of the item's length divided by MIN_COMMON."""
    size = int(np.ceil(len(item) / MIN_COMMON))
    if len(text) <= size:
        return common_subsequence(item, text) >= least
    own = set(item)
    held = np.r_[0, np.cumsum([w in own for w in text])]
    # a stretch may as well begin with one of the item's terms
    return any(text[a] in own and held[min(a + size, len(text))] - held[a] >= least and common_subsequence(item, text[a : a + size]) >= least for a in range(len(text)))


class Items:
    """A block of benchmark items as terms, and what the candidate search needs of them."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        terms = Terms(pa.array([t for _, t in rows], pa.string()))
        hashes, column = terms.columns()
        bounds = terms.first
        keep = [i for i in range(len(rows)) if terms.counts[i] >= MIN_ITEM]
        self.ids = [rows[i][0] for i in keep]
        self.columns = [column[bounds[i] : bounds[i + 1]] for i in keep]
        self.terms = [hashes[bounds[i] : bounds[i + 1]].tolist() for i in keep]

    def ready(self, idf: np.ndarray, basis: np.ndarray) -> dict:
        vectors, answers, parts, places = [], [], [], []
        for i, (columns, terms) in enumerate(zip(self.columns, self.terms)):
            rarest = np.argsort(-idf[columns], kind="stable")[: max(1, len(columns) // 4)]
            answers.append({terms[k] for k in rarest.tolist()})
            left = set(answers[-1])
            bounds = np.linspace(0, len(terms), -(-len(terms) // WINDOW) + 1).astype(int).tolist()
            for a, b in zip(bounds, bounds[1:]):
                part = left & set(terms[a:b])
                left -= part
                if part:
                    vectors.append((basis[columns[a:b]] * idf[columns[a:b], None]).sum(axis=0))
                    parts.append(part)
                    places.append((i, a, len(terms) - b))
        vectors = np.array(vectors, dtype=np.float32).reshape(len(vectors), basis.shape[1])
        owner = np.repeat(np.arange(len(parts)), [len(a) for a in parts])
        term = np.array([t for a in parts for t in a], dtype=np.uint64)
        order = np.argsort(term, kind="stable")
        need = np.ceil(MIN_ANSWER * np.array([len(a) for a in parts]) - 1e-9)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        return {"asked": (term[order], owner[order], need), "ids": self.ids, "terms": self.terms, "answers": answers, "places": places, "vectors": vectors}


RESULT = "doc_id long, item_id long, first_word long, cosine double, common double, answer double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), *((c, pa.float64()) for c in ("cosine", "common", "answer"))])


def _windows(terms: Terms, chunk_sums: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of windows, the text of each and the term that it begins with."""
    per, each = WINDOW // STEP, np.diff(before)
    n = np.where(each > 0, np.maximum(1, each - per + 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    first = before[text] + inside
    total = np.zeros((len(chunk_sums) + 1, chunk_sums.shape[1]))
    np.cumsum(chunk_sums, axis=0, out=total[1:])
    rows = (total[np.minimum(first + per, before[text + 1])] - total[first]).astype(np.float32)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows, text, terms.first[text] + inside * STEP


def _answered(terms: Terms, hashes: np.ndarray, text: np.ndarray, asked: tuple) -> np.ndarray:
    """Numbers window * items + item of the pairs whose window, with its margins, holds enough of the item's answer."""
    term, owner, need = asked
    begin, stop = np.searchsorted(term, hashes, side="left"), np.searchsorted(term, hashes, side="right")
    word = np.flatnonzero(stop > begin)
    n_windows = np.bincount(text, minlength=len(terms.counts))
    first = np.r_[0, np.cumsum(n_windows)]
    of = np.searchsorted(terms.first, word, side="right") - 1
    inside = word - terms.first[of]
    pairs = [np.zeros(0, np.int64)]
    for back in range((WINDOW + 2 * MARGIN) // STEP + 1):
        k = (inside + MARGIN) // STEP - back  # windows that may reach the word, from the last on
        ok = (k >= 0) & (k < n_windows[of]) & (inside >= k * STEP - MARGIN) & (inside < k * STEP + WINDOW + MARGIN)
        pairs.append((first[of[ok]] + k[ok]) * len(term) + begin[word[ok]])
    pairs = np.unique(np.concatenate(pairs))
    window, at = pairs // len(term), pairs % len(term)
    size = np.searchsorted(term, term[at], side="right") - at
    item = owner[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    found, counts = np.unique(np.repeat(window, size) * len(need) + item, return_counts=True)
    return found[counts >= need[found % len(need)]]


def _near(rows: np.ndarray, items: np.ndarray, candidate: float) -> np.ndarray:
    """Numbers window * items + item of the pairs whose cosine reaches ``candidate``."""
    out, step = [np.zeros(0, np.int64)], max(1, (1 << 21) // max(1, len(items)))
    for a in range(0, len(rows), step):
        window, item = np.nonzero(rows[a : a + step] @ items.T >= candidate)
        out.append((window + a) * len(items) + item)
    return np.concatenate(out)


def _confirmed(piece: pa.RecordBatch, items: dict, weighted: np.ndarray, candidate: float = CANDIDATE) -> pa.RecordBatch:
    terms = Terms(piece.column("text"))
    starts, before = terms.chunks(STEP)
    best: dict[tuple[int, int], tuple] = {}
    if len(starts) and items["ids"]:
        hashes, column = terms.columns()
        rows, text, first = _windows(terms, _project(column, weighted, starts), before)
        n = len(items["places"])
        answered = np.union1d(_answered(terms, hashes, text, items["asked"]), _near(rows, items["vectors"], candidate))
        known, around, held_terms, judged = None, [], set(), set()
        window, of = answered // n, answered % n
        cosines = np.concatenate([np.zeros(0, np.float32)] + [np.einsum("ij,ij->i", rows[window[a : a + _RUN]], items["vectors"][of[a : a + _RUN]]) for a in range(0, len(window), _RUN)])
        for w, k, cosine in zip(window.tolist(), of.tolist(), cosines.tolist()):
            t, at = int(text[w]), int(first[w])
            i, ahead, behind = items["places"][k]
            before_it, after_it = MARGIN, WINDOW + MARGIN
            if ahead or behind:
                # passages and windows that place the item within the same WINDOW terms are judged once, with WINDOW terms more
                place = (t, i, (at - ahead) // WINDOW)
                if place in judged:
                    continue
                judged.add(place)
                before_it += WINDOW + int(ahead / MIN_COMMON)
                after_it += WINDOW + int(behind / MIN_COMMON)
            begin, stop = max(int(terms.first[t]), at - before_it), min(int(terms.first[t + 1]), at + after_it)
            if known != (begin, stop):
                known, around = (begin, stop), hashes[begin:stop].tolist()
                held_terms = set(around)
            item, answer = items["terms"][i], items["answers"][i]
            least = int(np.ceil(MIN_COMMON * len(item) - 1e-9))
            if sum(map(held_terms.__contains__, item)) < least:
                continue
            held = len(answer & held_terms) / len(answer)
            if held < MIN_ANSWER:
                if cosine < candidate:
                    continue
                least = int(np.ceil(PARAPHRASE * len(item) - 1e-9))
            common = common_subsequence(item, around)
            if common >= least and (held >= MIN_ANSWER and (cosine >= MIN_COSINE or ahead or behind) or lies_close(item, around, least)):
                found = (common / len(item), held, cosine, -(at - int(terms.first[t])))
                if found > best.get((t, i), (0.0,)):
                    best[t, i] = found
    ids = piece.column("doc_id").to_pylist()
    out = [
        {"doc_id": ids[t], "item_id": items["ids"][i], "first_word": -at, "cosine": c, "common": common, "answer": held}
        for (t, i), (common, held, c, at) in best.items()
    ]
    return pa.RecordBatch.from_pylist(out, schema=_RESULT)


def _blocks(docs: DataFrame, benchmark: DataFrame, size: int) -> Iterator[Broadcast]:
    """The benchmark's blocks, ready for the search over all rows of ``docs``."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    if items.isEmpty():
        return
    docs = docs.select(F.col("text").cast("string"))
    seen, passages = _frequencies(docs)
    idf = (np.log((1.0 + passages) / (1.0 + seen)) ** 2).astype(np.float32)
    basis = latent_basis(docs, items.filter(F.col("text") != ""), idf)
    last = None
    while True:
        some = items if last is None else items.filter(F.col("item_id") > last)
        rows = [(r.item_id, r.text) for r in some.orderBy("item_id").limit(size).collect()]
        if not rows:
            return
        last = rows[-1][0]
        if len(rows) == size:  # items that share the last id belong to this block
            rows = [x for x in rows if x[0] != last] + [(r.item_id, r.text) for r in items.filter(F.col("item_id") == last).collect()]
        yield docs.sparkSession.sparkContext.broadcast((Items(rows).ready(idf, basis), basis * idf[:, None]))


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, candidate: float = CANDIDATE) -> DataFrame:
    """``doc_id, item_id, first_word, cosine, common, answer`` of the items that rows of ``docs`` hold.

    ``candidate`` is the cosine from which a window is looked at for its cosine alone (above 1: never).
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], RESULT)
    for ready in _blocks(docs, benchmark, block):

        def search(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            found, weighted = ready.value
            for batch in batches:
                for piece in slices(batch):
                    yield _confirmed(piece, found, weighted, candidate)

        out = out.union(docs.mapInArrow(search, RESULT))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they came with; each row is judged by its text."""
    out = docs
    for ready in _blocks(docs, benchmark, BLOCK):

        def keep(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            found, weighted = ready.value
            for batch in batches:
                for piece in slices(batch):
                    rows = pa.RecordBatch.from_arrays([pa.array(range(piece.num_rows), pa.int64()), piece.column("text")], ["doc_id", "text"])
                    held = set(_confirmed(rows, found, weighted).column("doc_id").to_pylist())
                    yield piece.filter(pa.array([i not in held for i in range(piece.num_rows)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
