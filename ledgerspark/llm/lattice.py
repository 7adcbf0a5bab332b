"""Probability of words under a subword lattice (numpy, used inside Spark tasks).

A word is spelled as the mark of a word's begin and its bytes. Its lattice has an edge for every piece of the vocabulary found
in it and one for every single byte. The forward recursion, in logarithms, sums over all segmentations; with the backward
recursion it gives how often each piece is expected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ledgerspark.llm.words import _byte_values, _powers, mixed

MARK = 256  # symbol of a word's begin
_FILTER_BITS = 22


def read_vocabulary(path: str) -> tuple[list[bytes | None], np.ndarray]:
    """Pieces that can occur inside a word, as bytes after an optional mark (b"\\xff"), and weights from the file's scores.

    A file of a unigram model holds logarithms; one of merges holds negative ranks, which count by Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        inner = text[1:] if text.startswith("▁") else text
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or "▁" in inner:
            continue
        pieces.append((b"\xff" if inner != text else b"") + inner.encode())
        weights.append(model.get_score(i))
    scores = np.array(weights)
    if scores.min() < -500:
        return pieces, 1.0 / (2.0 - scores)
    return pieces, np.exp(scores)


@dataclass
class Pieces:
    """A vocabulary ready for lookups; edges are numbered by piece, then 256 single bytes."""

    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    filter: np.ndarray
    n: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        symbols = [np.frombuffer(p, dtype=np.uint8).astype(np.int16) for p in pieces]
        for s in symbols:
            s[s == 255] = MARK  # 0xFF is no byte of UTF-8
        flat, counts = np.concatenate(symbols), np.array([len(s) for s in symbols])
        total, down = _prefix(flat)
        ends = np.cumsum(counts)
        hashes = mixed((total[ends] - total[ends - counts]) * down[ends - counts])
        order = np.argsort(hashes)
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(hashes[order], order, int(counts.max()), bits, len(pieces))

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, keys[maybe]), self.n - 1)
        hit = self.hashes[at] == keys[maybe]
        out[maybe[hit]] = self.ids[at[hit]]
        return out


def _symbol_values() -> np.ndarray:
    return np.r_[_byte_values(7), np.uint64(0x2545F4914F6CDD1D)]


def _prefix(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_symbol_values()[flat] * up[: len(flat)], out=total[1:])
    return total, down


class Lattice:
    """Lattices of many words: edge[p, k] is the edge of k + 1 symbols that ends at place p, the last column a single byte."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        self.pieces = pieces
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        flat = np.frombuffer(b"".join(b"\xff" + words[i] for i in self.order.tolist()), dtype=np.uint8).astype(np.int16)
        base = np.r_[0, np.cumsum(self.lengths)]
        flat[base[:-1]] = MARK
        self.base = base[:-1] + np.arange(len(words))  # each word has one place more than symbols
        inside = np.arange(len(flat)) - np.repeat(base[:-1], self.lengths)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), self.lengths) + 1
        total, down = _prefix(flat)
        n = len(flat) + len(words)
        self.edge = np.full((n, pieces.longest + 1), -1, dtype=np.int32)
        for k in range(1, pieces.longest + 1):
            at = np.flatnonzero(inside >= k - 1)
            start = at - k + 1
            self.edge[place[at], k - 1] = pieces.found(mixed((total[at + 1] - total[start]) * down[start]))
        single = flat < 256
        self.edge[place[single], pieces.longest] = pieces.n + flat[single]
        self.n = n

    def _step(self) -> np.ndarray:
        return np.r_[np.arange(1, self.pieces.longest + 1), 1]

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each place; the last column of logs is for missing edges."""
        step, out = self._step(), np.full(self.n, -np.inf)
        out[self.base] = 0.0
        active = len(self.base)
        for j in range(1, int(self.lengths[0]) + 1 if active else 0):
            active = int(np.searchsorted(-self.lengths, -j, side="right"))
            at = self.base[:active] + j
            fits = step <= j
            value = out[at[:, None] - step[None, fits]] + logs[self.edge[at][:, fits]]
            top = value.max(axis=1)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                out[at] = safe + np.log(np.exp(value - safe[:, None]).sum(axis=1))
        return out

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of each word, in the order given."""
        out = np.empty(len(self.order))
        out[self.order] = self.forward(logs)[self.base + self.lengths]
        return out

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each edge number is expected in words that occur ``counts`` times."""
        step, ahead = self._step(), self.forward(logs)
        back = np.full(self.n, -np.inf)
        back[self.base + self.lengths] = 0.0
        words = len(self.base)
        for left in range(int(self.lengths[0]) if words else 0):
            # places that are ``left`` symbols before their word's end hand on to those further left
            active = int(np.searchsorted(-self.lengths, -(left + 1), side="right"))
            at = self.base[:active] + self.lengths[:active] - left
            for k, s in enumerate(step.tolist()):
                edge = self.edge[at, k]
                ok = np.flatnonzero(edge >= 0)
                to = at[ok] - s
                back[to] = np.logaddexp(back[to], back[at[ok]] + logs[edge[ok]])
        whole = np.repeat(ahead[self.base + self.lengths], self.lengths + 1)
        times = np.repeat(np.asarray(counts, dtype=float)[self.order], self.lengths + 1)
        out = np.zeros(self.pieces.n + 256)
        for k, s in enumerate(step.tolist()):
            at = np.flatnonzero(self.edge[:, k] >= 0)
            edge = self.edge[at, k]
            share = np.exp(ahead[at - s] + logs[edge] + back[at] - whole[at])
            out += np.bincount(edge, weights=share * times[at], minlength=len(out))
        return out


def logs_of(weights: np.ndarray) -> np.ndarray:
    """Logs of weights that sum to one, with -inf at the end for missing edges (index -1)."""
    with np.errstate(divide="ignore"):
        return np.r_[np.log(weights), -np.inf]
