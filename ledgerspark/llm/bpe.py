"""Byte-level BPE as a streaming transducer, and decoding with an incremental byte-to-text machine.

Encoding. Text is split the way byte-level vocabularies do (contractions, an optional space and letters, numbers or other
signs, white space), with classes of characters looked up for whole slices at once. A piece that ends before LONG bytes is
merged when its end is seen. A longer piece runs through ``Transducer``: for every prefix there is one last token, found from
the prefix before it and the rule that two neighbouring tokens must not merge differently; a boundary that all prefixes of the
last ``lookahead`` bytes go back to can no longer change, so its tokens leave and their state is dropped. The lookahead is the
longest token of the merge list: a later prefix steps back at most that far.

Decoding. Bytes of the ids pass through a UTF-8 machine that keeps at most three bytes between blocks; broken sequences become
the replacement character, as in the tokenizers library.

Defined cases: null and empty text have no ids and decode to the empty text; equal rows each give their row; an empty table
gives an empty result; texts of any length are encoded in blocks of BLOCK bytes; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.tokens import Kept, Ragged
from ledgerspark.llm.words import Words, slices, text_bytes

LONG = 48
BLOCK = 4_000_000

LETTER, NUMBER, SPACE, SIGN = 1, 2, 0, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other sign."""
    import regex

    out = np.full(sys.maxunicode + 1, SIGN, dtype=np.uint8)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    index = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        flags = np.zeros(len(points), dtype=bool)
        flags[[m.start() for m in regex.finditer(pattern, every)]] = True
        out[index[flags]] = kind
    for c in range(0x1C, 0x20):  # separators that are no White_Space
        out[c] = SIGN
    return out


@functools.cache
def byte_of_letter() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary file's tokens as bytes, ranks of its merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = byte_of_letter()
        vocabulary = read["model"]["vocab"]
        size = max([*vocabulary.values(), *(t["id"] for t in read["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in read["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content
        self.single = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        made = {x[1] for x in self.rank.values()} | set(self.single)
        self.of = {self.bytes[i]: i for i in made}
        #: A prefix of a text goes back at most this far to the prefix before its last token.
        self.lookahead = max(map(len, self.of))
        self.neighbours: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merge a piece whose end is known: lowest rank first, leftmost among equals."""
        whole = self.of.get(piece)
        if whole is not None and len(piece) == 1:
            return [whole]
        ids, rank = [self.single[b] for b in piece], self.rank
        while len(ids) > 1:
            found = [rank.get(p) for p in zip(ids, ids[1:])]
            best = min((x for x in found if x), default=None)
            if best is None:
                break
            out, k, n = [], 0, len(ids)
            while k < n:
                if k + 1 < n and found[k] is best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    @functools.cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges as sorted pair numbers with their ranks and results."""
        size = len(self.bytes)
        pairs = np.array([a * size + b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(pairs)
        return pairs[order], *(np.array([x[k] for x in self.rank.values()], dtype=np.int64)[order] for k in (0, 1))

    def merged_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, one after the other, and how many each has: a round merges each piece's best pair everywhere."""
        pairs, ranks, results = self._table
        size, none = len(self.bytes), len(self.rank)
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.array(self.single, dtype=np.int64)[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = ids[:-1] * size + ids[1:]
            at = np.minimum(np.searchsorted(pairs, key), none - 1)
            rank = np.full(len(ids), none, dtype=np.int64)
            fits = (pairs[at] == key) & (owner[1:] == owner[:-1])
            rank[:-1][fits] = ranks[at[fits]]
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(ids)]))
            over = best == none
            if over.any():
                done.append((owner[over], ids[over]))
            chosen = (rank == best) & ~over
            # of equal pairs that overlap, the first, third, ... are merged
            places = np.flatnonzero(chosen)
            run = np.r_[True, np.diff(places) > 1] if len(places) else np.zeros(0, bool)
            lead = np.flatnonzero(run)[np.cumsum(run) - 1]
            places = places[(np.arange(len(places)) - lead) % 2 == 0]
            ids[places] = results[at[places]]
            stay = ~over
            stay[places + 1] = False
            ids, owner = ids[stay], owner[stay]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        owner, ids = np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done])
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        known = self.neighbours.get((left, right))
        if known is None:
            if len(self.neighbours) > 1_000_000:
                self.neighbours.clear()
            known = self.neighbours[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known


class Transducer:
    """Bytes in, tokens out as soon as no further byte can change them; one piece from first byte to finish()."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.bytes = bytearray()  # bytes not given out yet
        self.last: list[int] = [-1]  # last token of each prefix of them; -1 where everything before is out
        self.before = -1  # the token that went out last

    def feed(self, data: bytes) -> Iterator[int]:
        m, lookahead = self.merges, self.merges.lookahead
        for byte in data:
            self.bytes.append(byte)
            end = len(self.bytes)
            for start in range(max(0, end - lookahead), end):
                token = m.of.get(bytes(self.bytes[start:end]))
                if token is None:
                    continue
                previous = self.last[start] if start else self.before
                if previous < 0 or m.fit(previous, token):
                    self.last.append(token)
                    break
            if end >= 2 * lookahead and end % lookahead == 0:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        """Give out the tokens up to the last boundary that every recent prefix goes back to."""
        m, end = self.merges, len(self.bytes)
        common: set[int] | None = None
        for prefix in range(end - m.lookahead + 1, end + 1):
            chain, at = set(), prefix
            while at > 0:
                chain.add(at)
                at -= len(m.bytes[self.last[at]])
            common = chain if common is None else common & chain
        if common:
            yield from self._out(max(common))

    def _out(self, stop: int) -> Iterator[int]:
        tokens, at = [], stop
        while at > 0:
            tokens.append(self.last[at])
            at -= len(self.merges.bytes[self.last[at]])
        self.before = tokens[0]
        del self.bytes[:stop]
        self.last = [-1, *self.last[stop + 1 :]]
        yield from reversed(tokens)

    def finish(self) -> Iterator[int]:
        if self.bytes:
            yield from self._out(len(self.bytes))


class Pieces(Words):
    """Pieces of a run of texts that are merged by themselves; ``special`` are the places of special tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]):
        self.data, self.offsets = data, offsets
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.special = {}
            return
        raw = data.tobytes()
        spans = _special_spans(raw, offsets, special)
        cuts = np.array([x for a, b, _ in spans for x in (a, b)], dtype=np.int64)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        edge[cuts] = True
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32) if len(lead) < len(data) else data
        kind = _classes()[point]
        cut = edge[lead]
        n = len(lead)
        begin = cut.copy()
        begin[0] = True
        begin[1:] |= kind[1:] != kind[:-1]
        # the last of white space before something else: a blank joins it, any other stands alone
        final = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~cut[1:])
        begin[final] = True
        begin[final[point[final] == 32] + 1] = False
        self._contractions(begin, point, kind, cut, n)
        self.starts = lead[begin]
        self.ends = np.r_[self.starts[1:], len(data)]
        self.special = {int(np.searchsorted(self.starts, a)): i for a, b, i in spans}
        if spans:
            inside = np.zeros(len(data) + 1, dtype=bool)
            for a, b, _ in spans:
                inside[a + 1 : b] = True
            keep = ~inside[self.starts]
            self.starts = self.starts[keep]
            self.ends = np.r_[self.starts[1:], len(data)]
            self.special = {int(np.searchsorted(self.starts, a)): i for a, b, i in spans}

    @staticmethod
    def _contractions(begin, point, kind, cut, n) -> None:
        """'s 't 're 've 'm 'll 'd after anything but a joined blank are pieces of their own."""
        for k in np.flatnonzero((point == 39) & begin).tolist():
            follow = ""
            while len(follow) < 2 and k + 1 + len(follow) < n and not cut[k + 1 + len(follow)]:
                follow += chr(point[k + 1 + len(follow)])
            size = 1 if follow[:1] in ("s", "t", "m", "d") and follow else 2 if follow in ("re", "ve", "ll") else 0
            if size:
                begin[k + 1] = False
                if k + 1 + size < n:
                    begin[k + 1 + size] = True
                    # a blank before the rest keeps to it, as at any other place
                    # (the rest of the letters begins a piece of its own)


def _special_spans(raw: bytes, offsets: np.ndarray, special: dict[bytes, int]) -> list[tuple[int, int, int]]:
    out = []
    for content, i in special.items():
        at = raw.find(content)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(content) <= offsets[text + 1]:
                out.append((at, at + len(content), i))
                at = raw.find(content, at + len(content))
            else:
                at = raw.find(content, at + 1)
    return sorted(out)


@functools.lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=2)
def _kept(path: str) -> Kept:
    merges = _merges(path)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short = [x if len(x) < LONG else b"" for x in pieces]
        ids, counts = merges.merged_many(short)
        long = [k for k, x in enumerate(pieces) if len(x) >= LONG]
        if not long:
            return ids, counts
        split = np.split(ids, np.cumsum(counts)[:-1])
        for k in long:
            machine = Transducer(merges)
            split[k] = np.array([*machine.feed(pieces[k]), *machine.finish()], dtype=np.int32)
        return np.concatenate(split), np.array([len(x) for x in split])

    return Kept(encode)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run of texts as it is, or one long text in blocks that end where a piece surely ends."""
    if len(offsets) > 2 or len(data) <= BLOCK:
        yield data, offsets
        return
    start = 0
    blank = np.zeros(256, dtype=bool)
    blank[[*range(97, 123), *range(65, 91)]] = True
    while start < len(data):
        stop = len(data)
        if stop - start > BLOCK:
            # before a blank between two ASCII letters
            for a in range(start + BLOCK, len(data) - 2, 1 << 16):
                b = data[a - 1 : a + (1 << 16) + 1]
                at = np.flatnonzero(blank[b[:-2]] & (b[1:-1] == 32) & blank[b[2:]])
                if len(at):
                    stop = a + int(at[0])
                    break
        yield data[start:stop], np.array([0, stop - start])
        start = stop


def encode_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts and their offsets."""
    merges, kept = _merges(path), _kept(path)
    data, offsets = text_bytes(column)
    out, bounds = [], None
    for block, some in _blocks(data, offsets):
        pieces = Pieces(block, some, merges.special)
        ids, at = kept.ids_of(pieces)
        first = np.searchsorted(pieces.starts, some)
        if pieces.special:
            parts = np.split(ids, at[1:-1])
            for k, i in pieces.special.items():
                parts[k] = np.array([i], dtype=np.int32)
            at = np.r_[0, np.cumsum([len(x) for x in parts])]
            ids = np.concatenate(parts)
        out.append(ids)
        bounds = at[first] if bounds is None else np.array([0, bounds[-1] + len(ids)])
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), bounds if bounds is not None else np.zeros(1, np.int64)


@functools.lru_cache(maxsize=4)
def _spelled(path: str, as_bytes: bool) -> Ragged:
    """Bytes of each id, or its decimal digits and a comma."""
    merges = _merges(path)
    texts = merges.bytes if as_bytes else [f"{i},".encode() for i in range(len(merges.bytes))]
    table = Ragged()
    table.extend(np.frombuffer(b"".join(texts), np.uint8).astype(np.int32), np.array([len(x) for x in texts]))
    table.values = table.values.astype(np.uint8)
    return table


class ToText:
    """Bytes in, text out; a character's first bytes wait for the rest."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def decode_ids(ids: np.ndarray, path: str) -> str:
    """Text of ids, special tokens spelled out."""
    table, machine, out = _spelled(path, True), ToText(), []
    for k in range(0, len(ids), BLOCK):
        out.append(machine.feed(table.gather(ids[k : k + BLOCK])[0].tobytes()))
    return "".join([*out, machine.finish()])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = encode_texts(piece.column("text"), path)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` for each row of ``tokens(doc_id, ids)``."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(x.as_py() or [], dtype=np.int32), path) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, text string")


TOKENIZED = "doc_id long, text string, n_tokens long, ids array<int>"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, text, n_tokens, ids``: each text's ids, and the text as those ids spell it."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = encode_texts(piece.column("text"), path)
                texts = [decode_ids(ids[a:b], path) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(texts, pa.string()), pa.array(np.diff(offsets), pa.int64()), lists], ["doc_id", "text", "n_tokens", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(both, TOKENIZED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode each text, decode its ids again and give the digests of both, in one pass over the texts."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = encode_texts(piece.column("text"), path)
                digits, d = _spelled(path, False).gather(ids)
                raw, r = _spelled(path, True).gather(ids)
                digits, raw = digits.tobytes(), raw.tobytes()
                n = piece.num_rows
                spelled, texts = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    spelled.append(hashlib.sha256(digits[d[a] : max(d[a], d[b] - 1)]).hexdigest())
                    machine, digest = ToText(), hashlib.sha256()
                    for k in range(int(r[a]), int(r[b]), 1 << 20):
                        digest.update(machine.feed(raw[k : min(k + (1 << 20), int(r[b]))]).encode())
                    digest.update(machine.finish().encode())
                    texts.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spelled, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digested, DIGESTS)
