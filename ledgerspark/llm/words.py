"""Words of many texts at once, as byte positions and 64-bit hashes (numpy, used inside Spark tasks).

A word is a run of bytes other than space and 0x09-0x0D. These bytes are ASCII, so the rule on UTF-8 bytes is the
rule ``[^\\x20\\x09-\\x0D]+`` on code points. Null and empty texts have no words; a word never crosses two texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes, so a task's memory does not follow the batch (one text is never cut).
SLICE_BYTES = 1_000_000

#: Words of more bytes are hashed by a digest of their bytes.
LONG_WORD = 64

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5  # 5 modulo 8: its powers have the longest period modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept by the worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(base & _MASK)
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about SLICE_BYTES of text."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a run of texts: byte positions, owners and hashes.

    ``first[i] : first[i + 1]`` are the words of text i; ``starts`` and ``ends`` are byte positions in ``data``.
    """

    #: Bytes that words consist of.
    member = ~_SPACE

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        inside = self.member[self.data]
        edge = self.edges(inside)
        edge[self.offsets] = True
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        finish[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def edges(self, inside: np.ndarray) -> np.ndarray:
        """Places, besides the texts' ends, at which a word ends although no white space follows: none."""
        return np.zeros(len(self.data) + 1, dtype=bool)

    @functools.cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @functools.cached_property
    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on, as numbers (zeros follow the data)."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def _eight(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of words that are longer than 8 k, zeros after their ends."""
        at = self.starts[words] + 8 * k
        return self._eights[at] & _WHOLE[np.minimum(self.ends[words] - at, 8)]

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit hash of each word's bytes, the same for equal words anywhere.

        Eight bytes after eight pass through a bijection of all bits: words of one length up to eight have different hashes,
        and longer ones no structure that makes them fall together. Words above LONG_WORD bytes take a BLAKE2 digest.
        """
        size = self.ends - self.starts
        out = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & _MASK))
        some, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(some):
            out[some] = mixed(out[some] ^ self._eight(some, k))
            k += 1
            some = some[size[some] > 8 * k]
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            key = seed.to_bytes(8, "little")
            digests = b"".join(hashlib.blake2b(x, digest_size=8, key=key).digest() for x in self.raw(long))
            out[long] = np.frombuffer(digests, dtype="<u8")
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` (places) hold the same bytes."""
        size = self.ends - self.starts
        out = size[a] == size[b]
        some, k = np.flatnonzero(out & (size[a] <= LONG_WORD)), 0
        while len(some):
            out[some] = self._eight(a[some], k) == self._eight(b[some], k)
            k += 1
            some = some[out[some] & (size[a[some]] > 8 * k)]
        long = np.flatnonzero(out & (size[a] > LONG_WORD))
        if len(long):
            out[long] = [x == y for x, y in zip(self.raw(a[long]), self.raw(b[long]))]
        return out

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, the same for words of equal bytes and for no others, and the word at which each is met first."""
        codes, first = _factorized(self.hashes())
        if not self.same(np.arange(len(codes)), first[codes]).all():
            numbers: dict[bytes, int] = {}
            codes, first = _factorized(np.array([numbers.setdefault(x, len(numbers)) for x in self.raw(np.arange(len(codes)))]))
        return codes, first

    @functools.cached_property
    def _body(self) -> bytes:
        return self.data.tobytes()

    def raw(self, words: np.ndarray) -> list[bytes]:
        """Bytes of some words."""
        body = self._body
        return [body[a:b] for a, b in zip(self.starts[words].tolist(), self.ends[words].tolist())]

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


#: Masks that keep the first n bytes of eight.
_WHOLE = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _factorized(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key in the order in which different ones are met, and where each is met first."""
    codes, unique = pd.factorize(keys)
    first = np.full(len(unique), len(codes), dtype=np.int64)
    np.minimum.at(first, codes, np.arange(len(codes)))
    return codes, first


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each place on (the last size - 1 places are left out); owners are not looked at.

    The upper bits are folded in at each word, so the hash is no polynomial of the words' hashes.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = np.uint64((0xC2B2AE3D27D4EB4F + 2 * seed) & _MASK | 1)
    for k in range(size):
        total = (total ^ (total >> np.uint64(31))) * factor + hashes[k : k + n]
    return mixed(total)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Whether ``size`` words of one text start at each word (over the places that windows() returns)."""
    n = len(words.starts) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return left[:n] >= size
