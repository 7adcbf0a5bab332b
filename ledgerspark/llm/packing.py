"""Best-fit packing by bin completion: documents as token pieces in as few sequences as the search finds.

Documents become token ids with an end id, and only those above the sequence size are cut. Whole pieces of that size are sequences by
themselves. The others are dealt by a hash of their number into groups of about GROUP pieces, whatever their number or
lengths, and each group is packed by branch and bound in one task:

- A node fills one sequence: the largest piece left, completed by an undominated filling (no piece fits any more, no piece can be replaced by a
  longer one that is left, and no two pieces by one of their joint length). Fillings are tried in the order of their waste.
- The waste bound prunes: with a target of b sequences, all fillings together may waste b * size - sum at most.
- Best-fit solutions are the incumbents: the first before the search, others whenever a branch ends that got further than
  those before. A group is done at its lower bound, or after NODES nodes with the best incumbent. Of two solutions with as many sequences
  the one with the more unequal waste is better.

A group's waste ends up in few sequences. Their pieces, a quarter of the group's at most, are dealt again with those of other
groups, round after round, until one group is left; so sums over all groups, not over each, decide how many are needed. Only numbers travel; texts stay
where they are read.

Defined cases: null and empty texts hold the end id alone; a null doc_id and rows of equal doc_id are documents of their own; equal lengths
are taken in the order of the pieces' numbers; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.scratch import stored
from ledgerspark.llm.tokens import encode_texts
from ledgerspark.llm.words import slices

SIZE = 4096
GROUP = 4096  # pieces of a group
NODES = 4  # nodes of the search for each sequence of a group
STEPS = 48  # partial fillings looked at for a node
CHOICES = 4  # fillings kept for a node

_PIECES = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32"))])
PIECES = "number long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE) -> DataFrame:
    """``number, doc_id, piece, start, length, ids_crc32`` of each document's pieces; number tells them apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        closing = np.array([end], dtype="<u4")
        for batch in batches:
            for some in slices(batch):
                ids, offsets = encode_texts(some.column("text"), tokenizer)
                ids = ids.astype("<u4")
                out: list[list[int]] = [[], [], [], [], []]
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    whole = np.concatenate([ids[a:b], closing])
                    for k, start in enumerate(range(0, len(whole), size)):
                        part = whole[start : start + size]
                        for column, x in zip(out, (row, k, start, len(part), zlib.crc32(part))):
                            column.append(x)
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(n)), some.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                        *(pa.array(x, pa.int64()) for x in out[2:]),
                    ],
                    schema=_PIECES,
                )
                number += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def least_sequences(count: np.ndarray, size: int) -> int:
    """A lower bound for the number of sequences, from ``count`` pieces of each length: for every k the pieces above size - k
    have one of their own, those above half take one each, and those from k to half must fit beside the latter or need more."""
    length = np.arange(len(count))
    n, total = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * length)]
    half = size // 2
    k = np.arange(1, half + 1)
    large = n[-1] - n[size - k + 1]
    middle, middle_sum = n[size - k + 1] - n[half + 1], total[size - k + 1] - total[half + 1]
    small_sum = total[half + 1] - total[k]
    over = np.maximum(small_sum - (middle * size - middle_sum), 0)
    best = int((large + middle + -(-over // size)).max(initial=0))
    return max(best, -(-int(total[-1]) // size))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Lengths, longest first, each put where the least room is left that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # sorted: room left, sequence
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, (x, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(x)
        else:
            left, k = size, len(bins)
            bins.append([x])
        if left > x:
            bisect.insort(room, (left - x, k))
    return bins


class _Left:
    """Lengths that are left, with their counts."""

    def __init__(self, lengths: list[int], size: int):
        self.count = np.bincount(np.array(lengths, dtype=np.int64), minlength=size + 1)
        self.there = self.count > 0
        self.sizes = np.flatnonzero(self.there).tolist()  # sorted

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.there[x] = False
            del self.sizes[bisect.bisect_left(self.sizes, x)]

    def give(self, x: int) -> None:
        if not self.count[x]:
            self.there[x] = True
            bisect.insort(self.sizes, x)
        self.count[x] += 1

    def upto(self, x: int) -> int:
        """The greatest length left that is at most x, or 0."""
        at = bisect.bisect_right(self.sizes, x)
        return self.sizes[at - 1] if at else 0

    def between(self, low: int, high: int) -> bool:
        """Whether a length above low and at most high is left."""
        return self.upto(high) > low

    def lengths(self) -> list[int]:
        return np.repeat(np.arange(len(self.count)), self.count).tolist()


def fillings(left: _Left, room: int) -> list[tuple[int, list[int]]]:
    """Undominated fillings of ``room``, the least waste first; lengths are tried longest first.

    STEPS partial fillings are looked at; with more, the search goes on with the fillings found (one at least).
    """
    found: list[tuple[int, list[int]]] = []
    steps = perfect = 0

    def undominated(chosen: list[int], waste: int) -> bool:
        times = Counter(chosen)
        if any(left.between(x, x + waste) for x in times):
            return False
        sums = {a + b for a in times for b in times if a != b or times[a] > 1}
        return not any(left.between(s - 1, s + waste) for s in sums)

    def keep(chosen: list[int], waste: int) -> None:
        nonlocal perfect
        if undominated(chosen, waste) or not found:
            found.append((waste, list(chosen)))
            perfect += not waste

    def grow(chosen: list[int], rest: int, most: int) -> None:
        """Fillings that go on with lengths of at most ``most``; chosen ones are already taken."""
        nonlocal steps
        steps += 1
        if not rest:
            keep(chosen, 0)
            return
        top = min(rest, most)
        if rest <= most and left.there[rest]:
            keep([*chosen, rest], 0)
        # two that fill the rest exactly, the longer one as long as possible
        a = np.arange(-(-rest // 2), min(top, rest - 1) + 1)
        both = a[left.there[a] & left.there[rest - a]]
        if len(both) and 2 * both[0] == rest and left.count[both[0]] < 2:
            both = both[1:]
        if len(both):
            keep([*chosen, int(both[-1]), int(rest - both[-1])], 0)
        x = left.upto(top)
        if not x:
            keep(chosen, rest)
            return
        while x and steps < STEPS and perfect < CHOICES:
            left.take(x)
            grow([*chosen, x], rest - x, x)
            left.give(x)
            x = left.upto(x - 1)
        if not found:  # out of steps: the longest that fit, one after the other
            filling = list(chosen)
            while x:
                times = min(int(left.count[x]), rest // x)
                filling += [x] * times
                rest -= x * times
                x = left.upto(min(rest, x - 1))
            found.append((rest, filling))

    grow([], room, room)
    found.sort(key=lambda f: f[0])
    return found[:CHOICES]


def _uneven(bins: list[list[int]], size: int) -> int:
    return sum((size - sum(b)) ** 2 for b in bins)


def packed(lengths: list[int], size: int = SIZE, nodes: int = NODES) -> list[list[int]]:
    """Lengths dealt into sequences by bin completion."""
    best = best_fit(lengths, size)
    if not lengths:
        return best
    left = _Left(lengths, size)
    least = least_sequences(left.count, size)
    total = sum(lengths)
    score = (len(best), -_uneven(best, size))
    done: list[list[int]] = []
    stack: list[list[list[int]]] = []  # fillings still to be tried at each depth
    waste, deepest = 0, -1
    budget = nodes * len(best)

    def open_node() -> None:
        first = left.sizes[-1]
        left.take(first)
        stack.append([[first, *x] for _, x in reversed(fillings(left, size - first))])
        left.give(first)

    def close(bins: list[list[int]]) -> None:
        nonlocal best, score
        found = (len(bins), -_uneven(bins, size))
        if found < score:
            best, score = bins, found

    open_node()
    while stack and budget > 0:
        budget -= 1
        # the first way down may match the incumbent, later ones have to be better
        target = max(least, score[0] - (deepest >= 0))
        if not stack[-1]:
            stack.pop()
            if done:
                for x in done.pop():
                    left.give(x)
                waste = sum(size - sum(b) for b in done)
            continue
        filling = stack[-1].pop()
        lost = size - sum(filling)
        if waste + lost > target * size - total:
            if len(done) > deepest:
                deepest = len(done)
                close([*map(list, done), *best_fit(left.lengths(), size)])
            continue
        for x in filling:
            left.take(x)
        done.append(filling)
        waste += lost
        if not left.sizes:
            close(list(map(list, done)))
            if score[0] == least:
                break
            stack.append([])
        else:
            open_node()
    return best


_ROUND = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("again", pa.bool_())])
_ROUND_SQL = PIECES + ", sequence_id long, offset long, again boolean"


def _again(bins: list[list[int]], size: int) -> list[bool]:
    """Which sequences of a group are dealt again: the emptiest ones that waste anything, with a quarter of its pieces at most."""
    out, held = [False] * len(bins), sum(map(len, bins)) // 4
    for k in sorted(range(len(bins)), key=lambda k: sum(bins[k])):
        if sum(bins[k]) == size or held < len(bins[k]):
            break
        out[k] = True
        held -= len(bins[k])
    return out


def pack_round(pieces: DataFrame, number: int, groups: int, size: int, nodes: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` in their group's packing, and whether they are to be dealt again."""
    last = groups == 1

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).sort_by("number")
        lengths = table["length"].to_numpy()
        waiting: dict[int, list[int]] = {}
        for k in reversed(range(len(lengths))):
            waiting.setdefault(int(lengths[k]), []).append(k)
        bins = packed(lengths.tolist(), size, nodes)
        again = [False] * len(bins) if last else _again(bins, size)
        sequence, offset, back = (np.zeros(len(lengths), dtype=t) for t in (np.int64, np.int64, bool))
        base = ((number << 28 | key[0].as_py()) << 24) + 1
        for b, (filling, open_) in enumerate(zip(bins, again)):
            at = 0
            for x in filling:
                row = waiting[x].pop()
                sequence[row], offset[row], back[row] = base + b, at, open_
                at += x
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("again", pa.array(back))
        return table.cast(_ROUND)

    group = F.pmod(F.xxhash64("number", F.lit(number)), F.lit(groups)).alias("group")
    return pieces.select(*_PIECES.names, group).groupBy("group").applyInArrow(solve, _ROUND_SQL)


PACKED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """Each piece of ``docs(doc_id, text)`` with its sequence and its place there (columns of PACKED)."""
    pieces = stored(token_pieces(docs, tokenizer, end, size), "pieces")
    whole = pieces.filter(F.col("length") == size)
    out = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).select(*PACKED)
    rest, number = pieces.filter(F.col("length") < size), 0
    while True:
        count = rest.count()
        if not count:
            return out
        groups = -(-count // group)
        dealt = stored(pack_round(rest, number, groups, size, nodes), f"packed-{number}")
        out = out.union(dealt.filter("not again").select(*PACKED))
        rest, number = dealt.filter("again").select(*_PIECES.names), number + 1
