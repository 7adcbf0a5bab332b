"""Quality rules: repetition inside a text, from a suffix array over its words.

``quality(docs)`` gives one row per input row. Words are runs of bytes other than space and 0x09-0x0D. For each text the
suffixes of its word sequence are sorted, the common prefixes of neighbours give the LCP intervals, and an interval whose
occurrences are preceded by different words is a maximal repeated substring. The spans of those of MIN_WORDS or more are
united: a text is refused when they cover too large a share of its characters or when one repeat is too long, by itself or for the
text. The base rule allows a fifth of the words in repeated windows, so these limits also refuse texts that it lets pass: long words
repeated among short ones, and one long passage given twice.

Defined cases: null or empty text has no words, so the base rule refuses it; equal rows each give their row; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.words import Words, slices, text_bytes, window_starts, windows

MIN_WORDS = 5
MIN_COUNT = 10
MAX_REPEAT_PERCENT = 20  # words in repeated windows of MIN_WORDS
MAX_COVERED_PERCENT = 15  # characters of words that maximal repeats cover
MAX_LONGEST_WORDS = 200
MAX_LONGEST_PERCENT = 8  # words of the longest repeat, of the text's
LONG_REPEAT = 20  # words from which that share counts

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_chars long, longest_repeat long, n_maximal_repeats long, base_failed boolean, kept boolean"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_POINT = np.ones(256, dtype=bool)
_POINT[0x80:0xC0] = False  # continuation bytes
_DENSE = 1 << 31


def ranks(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``groups`` and, for each element, the place at which its equals begin in that order."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = begin
    return order, out


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of many sequences at once and the common prefix of each suffix with the one before it.

    ``symbols`` are numbers that differ between sequences; ``ends[i]`` is where the sequence of place i stops.
    Prefix doubling: each round doubles the compared length and sorts only suffixes that still have an equal.
    """
    n = len(symbols)
    order, rank = ranks(symbols)
    levels, step = [rank], 1
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    active = order[_shared(rank[order])]
    while len(active):
        following = active + step
        inside = following < ends[active]
        second = np.where(inside, rank[np.where(inside, following, 0)] + 1, 0)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        # the members of a group fill the places from the group's first place on
        base = np.ones(len(active), dtype=bool)
        base[1:] = first[1:] != first[:-1]
        begin = np.flatnonzero(base)[np.cumsum(base) - 1]
        spot = first + np.arange(len(active)) - begin
        order[spot] = active
        differs = base.copy()
        differs[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[active] = spot[np.flatnonzero(differs)[np.cumsum(differs) - 1]]
        levels.append(rank)
        step *= 2
        active = active[_shared(rank[active])]
    return order, _common(order, levels, ends)


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Whether a neighbour in sorted ranks is equal."""
    same = np.zeros(len(ordered) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    return same[1:] | same[:-1]


def _common(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Common prefix of neighbours, taken from the rounds' ranks, longest step first."""
    out = np.zeros(len(order), dtype=np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    stop_a, stop_b = ends[a], ends[b]
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < stop_a) & (b < stop_b)
        same = np.zeros(len(pairs), dtype=bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[same] += 1 << k
        b[same] += 1 << k
        out[pairs[same]] += 1 << k
    return out


def maximal_intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats as (length, first place, last place) in a suffix array, found with a stack over its LCP values.

    ``left`` is the symbol before each sorted suffix; an interval counts if these are not all the same.
    """
    n = len(common)
    changed = np.zeros(n + 1, dtype=np.int64)
    changed[1:] = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    out: list[tuple[int, int, int]] = []
    near = np.flatnonzero(common >= least)
    if not len(near):
        return out
    for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
        stack: list[tuple[int, int]] = []
        for k, value in zip([*run.tolist(), int(run[-1]) + 1], [*common[run].tolist(), 0]):
            begin = k - 1
            while stack and stack[-1][0] > value:
                length, begin = stack.pop()
                if changed[k] > changed[begin + 1]:
                    out.append((length, begin, k - 1))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, begin))
    return out


def _dup_lines(column: pa.Array, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    if not len(starts):
        return np.zeros(len(column), dtype=np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.minimum(np.r_[starts[1:], len(data)], offsets[owner + 1])
    stops -= (data[np.maximum(stops - 1, 0)] == 10) & (stops > starts)
    holds = np.searchsorted(words.starts, stops) > np.searchsorted(words.starts, starts)
    keep = np.flatnonzero(holds)
    seen: set[tuple[int, bytes]] = set()
    out = np.zeros(len(column), dtype=np.int64)
    raw = data.tobytes()
    for i, a, b in zip(owner[keep].tolist(), starts[keep].tolist(), stops[keep].tolist()):
        line = (i, raw[a:b])
        if line in seen:
            out[i] += 1
        seen.add(line)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return np.diff(total[bounds])


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column("text")
    words = Words(column)
    n, counts = len(words.starts), words.counts
    hashes = words.hashes()
    points = np.r_[0, np.cumsum(_POINT[words.data], dtype=np.int64)]
    chars = points[words.ends] - points[words.starts]
    repeated = np.zeros(n, dtype=bool)
    covered = np.zeros(n, dtype=bool)
    longest = np.zeros(len(column), dtype=np.int64)
    maximal = np.zeros(len(column), dtype=np.int64)
    if n >= MIN_WORDS:
        # words in windows found twice or more in their text
        ok = np.flatnonzero(window_starts(words, MIN_WORDS))
        key = windows(hashes, MIN_WORDS)[ok] ^ (words.owner[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order, rank = ranks(key)
        again = ok[order[_shared(rank[order])]]
        repeated = _covered(n, again, np.full(len(again), MIN_WORDS))
        # only texts with a repeated window can have a repeat of MIN_WORDS: their suffixes are sorted
        texts = np.unique(words.owner[again])
        place = np.flatnonzero(np.isin(words.owner, texts))
        if len(place):
            owner = words.owner[place]
            word = np.unique(hashes[place], return_inverse=True)[1]
            ends = np.searchsorted(owner, owner, side="right")
            order, common = suffix_array(owner * _DENSE + word, ends)
            reach = np.maximum(common, np.r_[common[1:], 0])
            long = reach >= MIN_WORDS
            covered[place] = _covered(len(place), order[long], reach[long])
            np.maximum.at(longest, owner[order[long]], reach[long])
            first = np.r_[True, owner[1:] != owner[:-1]]
            left = np.where(first, -1, np.r_[0, word[:-1]])
            for _, begin, _ in maximal_intervals(common, left[order], MIN_WORDS):
                maximal[owner[order[begin]]] += 1
    word_chars = _sums(chars, words.first)
    covered_chars = _sums(chars * covered, words.first)
    repeat_words = _sums(repeated, words.first)
    failed = (counts < MIN_COUNT) | (100 * repeat_words > MAX_REPEAT_PERCENT * counts)
    kept = ~failed & (100 * covered_chars <= MAX_COVERED_PERCENT * word_chars) & (longest <= MAX_LONGEST_WORDS)
    kept &= (longest < LONG_REPEAT) | (100 * longest <= MAX_LONGEST_PERCENT * counts)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").cast(pa.int64()),
            *(
                pa.array(x, pa.int64())
                for x in (
                    counts, word_chars, _sums(_SYMBOL[words.data], words.offsets), _dup_lines(column, words),
                    repeat_words, covered_chars, longest, maximal,
                )
            ),
            pa.array(failed),
            pa.array(kept),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield _judged(part)


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judge, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with the columns they came with (null or repeated ids do no harm)."""
    columns = docs.columns
    schema = docs.schema

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept = _judged(pa.RecordBatch.from_arrays([pa.array([0] * part.num_rows, pa.int64()), part.column("text")], ["doc_id", "text"]))
                yield part.filter(kept.column("kept"))

    return docs.select(*columns).mapInArrow(filtered, schema)
