"""Words that fall together under a polynomial hash: the parity sequence of 1,024 letters and its complement."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import sort_plain, sorted_rows
from test_corpus import plain_windows
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, jaccard, lm, quality, tokens, windows
from ledgerspark.llm.words import Words

A = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
B = A.translate(str.maketrans("ab", "ba"))
C = A * 2
BASE = [f"w{k}" for k in range(14)]


@pytest.fixture(scope="module")
def rows():
    with_word = lambda x: " ".join([*BASE[:6], x, *BASE[6:12]])
    return [(1, with_word(A)), (2, with_word(B)), (3, A), (4, B), (5, f"{A} {B} {A}"), (6, C), (7, A + B), (8, with_word(A)), (9, "ab ba " * 20)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_words_and_codes():
    rng = random.Random(4)
    some = [A, B, C, A + B, B + A, "x", "xx", "x\0", "é", "字" * 30, "字" * 31] + ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(3000)]
    text = pa.array([" ".join(some), None, " ".join(reversed(some))])
    words = Words(text)
    plain = [w for t in text.to_pylist() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    for seed in (1, 2, 3):
        named = dict(zip(plain, words.hashes(seed).tolist()))
        assert len(set(named.values())) == len(set(plain))
        assert [named[w] for w in plain] == words.hashes(seed).tolist()
    codes, first = words.codes()
    assert [plain[first[c]] for c in codes.tolist()] == plain and len(first) == len(set(plain))
    a = np.arange(len(plain))
    assert words.same(a, np.roll(a, 1)).tolist() == [plain[k] == plain[k - 1] for k in range(len(plain))]


def test_codes_of_equal_hashes(monkeypatch):
    words = Words(pa.array(["one two one three " + A]))
    monkeypatch.setattr(Words, "hashes", lambda self, seed=1: np.zeros(len(self.starts), np.uint64))
    assert words.codes()[0].tolist() == [0, 1, 0, 2, 3]


def test_quality(spark):
    # only one of the two words is repeated: no window of five occurs twice
    text = " ".join(["p", "q", A, "r", "s", "p", "q", B, "r", "s"])
    got = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_repeat_words == 0 and got.kept


@pytest.mark.parametrize("encode, path", [(tokens.encode_texts, "word_bpe_49k.json"), (bpe.encode_texts, "byte_bpe_50k.json")])
def test_token_ids(rows, encode, path):
    path = public_tokenizers.path(path)
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    ids, offsets = encode(pa.array([t for _, t in rows]), path)
    for k, (_, text) in enumerate(rows):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_windows(frame, rows):
    got = sorted_rows(windows.removed(frame), "doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    assert got == sort_plain(plain_windows(rows))


def test_jaccard(frame):
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1, 9: 9}


def test_scores(frame):
    model, counts = lm.train(frame, public_tokenizers.path("piece_bpe_32k.model"))
    plain = {w for k in (A, B, C, A + B, "ab", "ba", *BASE[:12]) for w in [k]}
    assert model.types == len(plain) + 1  # and the end
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in lm.score(frame, model, counts).collect()}
    assert got[5] == (4, 4) and got[1] == (14, 14)


def test_digest_of_decoded(frame, rows):
    got = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in rows}
