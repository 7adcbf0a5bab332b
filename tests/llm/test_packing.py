"""Packing against plain token ids, bin completion against small exact packings."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import sort_plain, sorted_rows
from tokenizers import Tokenizer

from ledgerspark.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def exact(lengths, size):
    """Least number of sequences, by search over all of them."""

    @functools.lru_cache(maxsize=None)
    def least(left, rooms):
        if not left:
            return 0
        out = len(left)
        for room in {r for r in rooms if r >= left[0]}:
            rest = list(rooms)
            rest.remove(room)
            out = min(out, least(left[1:], tuple(sorted([*rest, room - left[0]]))))
        return min(out, 1 + least(left[1:], tuple(sorted([*rooms, size - left[0]]))))

    return least(tuple(sorted(lengths, reverse=True)), ())


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_is_exact_on_small_groups(seed):
    rng = random.Random(seed)
    size = rng.choice([20, 50, 100])
    lengths = [rng.randrange(1, size) for _ in range(rng.randrange(1, 11))]
    bins = packing.packed(lengths, size, nodes=1000)
    assert sorted(sum(bins, [])) == sorted(lengths) and max(map(sum, bins)) <= size
    assert len(bins) == exact(lengths, size)
    assert packing.least_sequences(np.bincount(lengths, minlength=size + 1), size) <= len(bins)


def test_search_beats_best_fit():
    # best fit puts 6 beside 4 and is left with pieces that no longer fit
    lengths = [6, 5, 4, 3, 3, 3] * 4
    assert len(packing.best_fit(lengths, 12)) >= len(packing.packed(lengths, 12, nodes=500)) == 8
    assert packing.packed([], 10) == []
    tiny = packing.packed([1] * 9000 + [2] * 500, 4096)
    assert len(tiny) == 3 and sum(map(sum, tiny)) == 10_000


def test_fillings_are_undominated():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randrange(1, 40) for _ in range(12)]
        left, room = packing._Left(lengths, 60), rng.randrange(5, 60)
        for waste, filling in packing.fillings(left, room)[1:]:
            rest = list(lengths)
            for x in filling:
                rest.remove(x)
            assert waste == room - sum(filling) >= 0
            assert not any(x <= waste for x in rest)  # nothing fits any more
            assert not any(y < x <= y + waste for y in filling for x in rest)
        assert sorted(left.lengths()) == sorted(lengths)


def check(rows, packed, size):
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for number, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), size)):
            part = np.array(ids[start : start + size], dtype="<u4")
            want.append((number, k, start, len(part), zlib.crc32(part)))
    assert sorted_rows(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sort_plain(want)
    sequences = {}
    for r in packed.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(w[3] for w in want) // size)


@pytest.mark.parametrize("size, group", [(4096, 4096), (64, 12), (7, 40)])
def test_pack(spark, odd, size, group):
    frame, rows = odd
    n, least = check(rows, packing.pack(frame, WORDS, 1, size, group), size)
    assert n <= least + 2


def test_pack_documents(spark, documents, empty):
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    for group in (4096, 40):  # one group, and several rounds of small ones
        n, least = check(documents, packing.pack(frame, WORDS, 1, group=group), 4096)
        assert n <= least + 1
    assert packing.pack(empty, WORDS, 1).count() == 0
