"""Operators on texts of their own against plain Python: quality, token ids, byte-level BPE, URL rules, personal data."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import sort_plain, sorted_rows
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, pii, quality, tokens, urls
from ledgerspark.llm.scratch import place
from ledgerspark.session import app_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def plain_quality(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    longest, size = 0, 5
    while any(c > 1 for c in collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)).values()):
        longest, size = size, size + 1
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    covered = sum(len(words[p]) for p in repeated)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    kept = not failed and 100 * covered <= quality.MAX_COVERED_PERCENT * chars and longest <= quality.MAX_LONGEST_WORDS
    kept = kept and (longest < quality.LONG_REPEAT or 100 * longest <= quality.MAX_LONGEST_PERCENT * len(words))
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), covered, longest, failed, kept)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat", "base_failed", "kept")


def test_quality_against_plain(odd, empty):
    frame, rows = odd
    assert sorted_rows(quality.quality(frame), *COLUMNS) == sort_plain([(i, *plain_quality(t)) for i, t in rows])
    assert quality.quality(empty).count() == 0


def test_quality_keeps_rows_with_their_columns(odd, empty):
    frame, rows = odd
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    assert sorted_rows(kept, "doc_id", "text") == sort_plain([(i, t) for i, t in rows if plain_quality(t)[-1]])
    assert quality.keep_good(empty).count() == 0


def test_maximal_intervals_against_all_substrings():
    rng = random.Random(2)
    for _ in range(60):
        word = np.array([rng.randrange(3) for _ in range(rng.randrange(2, 40))])
        order, common = quality.suffix_array(word, np.full(len(word), len(word)))
        assert [tuple(word[i:]) for i in order] == sorted(tuple(word[i:]) for i in range(len(word)))
        left = np.r_[-1, word[:-1]]
        got = sorted((n, sorted(order[a : b + 1].tolist())) for n, a, b in quality.maximal_intervals(common, left[order], 2))
        want = []
        for n in range(2, len(word)):
            at = collections.defaultdict(list)
            for i in range(len(word) - n + 1):
                at[tuple(word[i : i + n])].append(i)
            for places in at.values():
                after = {word[i + n] if i + n < len(word) else -1 for i in places}
                if len(places) > 1 and len({left[i] for i in places}) > 1 and len(after) > 1:
                    want.append((n, places))
        assert got == sorted(want)


def test_orc_tokens(spark, odd, empty):
    frame, rows = odd
    folder = place(spark, "t.orc")
    tokens.write_tokens(frame, folder, WORD_BPE, 2)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    got = tokens.starts(tokens.checksums(tokens.read_tokens(spark, folder))).collect()
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert sort_plain([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]) == sort_plain([(i, len(x), crc(x)) for i, x in ids])
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.r_[0, np.cumsum([r.n_tokens for r in by_start])[:-1]].tolist()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in by_start]
    assert order == sorted(order)
    assert [r.ids for r in tokens.read_tokens(spark, folder, [20]).collect()] == [dict(ids)[20]]
    nothing = place(spark, "e.orc")
    tokens.write_tokens(empty, nothing, WORD_BPE, 2)
    assert tokens.starts(tokens.checksums(tokens.read_tokens(spark, nothing))).count() == 0


def test_word_tokens_equal_the_library():
    rng = random.Random(1)
    pieces = ["the", " of", "ing", "  ", "\n", "'s", "'re", "'sall", "<|endoftext|>", "<|", "é", "É", "İ", "क़", "12", "a1", "--", "…,", "\u0301", "\x85", "字", "Σ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + [None]
    ids, at = tokens.encode_texts(pa.array(texts), WORD_BPE)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(4)
    pieces = ["the", " of", "ing", "   ", "\n\n", "'s", "'re", "'sall", "<|endoftext|>", " '", "''", "é", "====", "12", "٣", "\u3000", "\x1c", "字", "🙂", "\u200b", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(40, 700))) for _ in range(25)]
    return [*texts, None, "", "a" * 2000, "ab" * 600, " " * 900, "\n" * 200 + " x", "=" * 777]


def test_byte_bpe_equals_the_library(mixed_texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids, at = bpe.encode_texts(pa.array(mixed_texts), BYTE_BPE)
    for i, t in enumerate(mixed_texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
        assert bpe.decode_ids(own, BYTE_BPE) == tokenizer.decode(own.tolist(), skip_special_tokens=False)
    rng = random.Random(6)
    for _ in range(300):
        own = [rng.randrange(50257) for _ in range(30)]
        assert bpe.decode_ids(np.array(own), BYTE_BPE) == tokenizer.decode(own, skip_special_tokens=False)


def test_transducer_gives_out_before_the_end():
    merges, rng = bpe.Merges(BYTE_BPE), random.Random(8)
    data = "".join(rng.choice("abcdefghilmnorstu") for _ in range(4000)).encode()
    machine, out, most = bpe.Transducer(merges), [], 0
    for byte in data:
        out += machine.feed(bytes([byte]))
        most = max(most, len(machine.bytes))
    assert most <= 4 * merges.lookahead
    assert [*out, *machine.finish()] == merges.merged(data)


def test_long_texts_go_in_blocks(monkeypatch, documents):
    text = " ".join(t for _, t in documents[:30])
    want = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    ids, at = bpe.encode_texts(pa.array([text]), BYTE_BPE)
    assert ids.tolist() == want and at.tolist() == [0, len(want)]


def test_bpe_frames(odd, empty):
    frame, rows = odd
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, t or "", tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    got = sorted_rows(bpe.round_trip(frame, BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sort_plain([(i, len(x), sha(",".join(map(str, x))), sha(t)) for i, t, x in ids])
    assert sorted_rows(bpe.tokenized(frame, BYTE_BPE), "doc_id", "text", "n_tokens") == sort_plain([(i, t, len(x)) for i, t, x in ids])
    assert sorted_rows(bpe.decode(bpe.encode(frame, BYTE_BPE), BYTE_BPE), "doc_id", "text") == sort_plain([(i, t) for i, t, _ in ids])
    assert bpe.round_trip(empty, BYTE_BPE).count() == 0


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("com", "", "allow"), ("a.com", "", "block"), ("a.com", "", "allow"), (None, "/", "block"), ("org", None, "block")]
    addresses = [None, "", "no scheme", "http://org", "http://org/", "https://X.EXAMPLE.org/es/1?q#f", "http://notexample.org/es/", "http://b.a.com?x", "http://a.com./", "x://com", "http://a.com/" + "p" * 5000, "http://example.org/es/", "http://example.org/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(addresses)] + [(None, "http://q.com/", "y")], "page_id long, url string, rule string")
    good = [(h.lower(), p, v) for h, p, v in rules if h is not None and p is not None]

    def plain(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in good if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, False, None, "allow"))
        return host, path, best[2], best[3]

    for rows in (rules, []):
        good = [(h.lower(), p, v) for h, p, v in rows if h is not None and p is not None]
        got = urls.judge(pages, spark.createDataFrame(rows, "host string, path string, verdict string"))
        want = [(r.page_id, *plain(r.url)) for r in pages.collect()]
        assert sorted_rows(got, "page_id", "host", "path", "rule", "verdict") == sort_plain(want)
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            worth = [int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(worth) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [f"{KINDS[n][0]}:{a}:{b}" for a, n, b in sorted(found)]


def test_base_spans(spark, odd, empty):
    rng = random.Random(3)
    draw = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randrange(a, b)))
    texts = [draw("aB1.@-_%+ 0129()é🙂\n", 0, 120) for _ in range(400)] + [draw("0123456789 -", 14, 40) for _ in range(400)]
    texts += ["+" + draw("0123456789 -().", 8, 24) for _ in range(200)]
    texts += ["4" * 20000, "1 " * 6000, "a@b.c@d.e", "a@b.com_x@y.z", "1.2.3.4.5.6.7.8", "a" * 3000, "+1" * 3000, "1.2.3.256 01.002.3.4", "4\ue00012345678901234"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(frame).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i].spans.split(","))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in want) for k, _ in KINDS)
    frame, rows = odd
    assert pii.spans(frame).count() == len(rows)
    assert pii.spans(empty).count() == 0


def test_context_finds_unseen_identifiers(spark):
    cards = [x for x in range(4000000000000000, 4000000000000400) if plain_spans(str(x))]
    rows = [f"call the account {x} today" for x in cards[:12]] + ["the account 4000000000000001 is new", "order 4000000000000001 is none", "the account holder came"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.spans(frame).collect()}
    assert got[12] == "context:12:28" and got[13] == "" and got[14] == ""
    texts = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert texts[12] == "the account <context> is new" and texts[0] == "call the account <card> today" and texts[14] == rows[14]


def test_context_finds_each_kind(spark):
    cards = [x for x in range(4000000000000000, 4000000000000400) if plain_spans(str(x))]
    rows = [f"my mail: user{k}@example.org now" for k in range(12)] + [f"from ip: 10.0.0.{k} today" for k in range(12)]
    rows += [f"my phone: +49 711 12345{k} thanks" for k in range(10, 22)] + [f"the card {str(x)[:4]} {str(x)[4:8]} {str(x)[8:12]} {str(x)[12:]} here" for x in cards[:12]]
    unseen = {"my mail: someone@localhost now": 9, "from ip: 2001:db8:0:0:1 today": 9, "from ip: 300.400.10.77 now": 9, "my phone: 0711-1234567 or so": 10, "the card 4000 0000 0000 0001 is void": 9, "the card 400012345678 here": 9}
    none = ["order 0711-1234567 or so", "see someone@localhost there", "the card holder came"]
    frame = spark.createDataFrame(list(enumerate(rows + list(unseen) + none)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.spans(frame).collect()}
    stops = {"my mail: someone@localhost now": 26, "from ip: 2001:db8:0:0:1 today": 23, "from ip: 300.400.10.77 now": 22, "my phone: 0711-1234567 or so": 22, "the card 4000 0000 0000 0001 is void": 28, "the card 400012345678 here": 21}
    assert [got[len(rows) + k] for k in range(len(unseen))] == [f"context:{a}:{stops[t]}" for t, a in unseen.items()]
    assert [got[len(rows) + len(unseen) + k] for k in range(len(none))] == ["", "", ""]


def test_redaction_keeps_columns(odd, empty):
    frame, rows = odd
    done = pii.redact(frame)
    assert done.columns == frame.columns and done.count() == len(rows)
    assert sorted_rows(done, "_row", "base") == [("x", "x")] * len(rows)
    assert pii.redact(empty).count() == 0


def test_texts_that_only_the_suffix_rule_refuses(spark):
    plain = [f"w{k}" for k in range(260)]
    passage = [f"p{k}" for k in range(24)]
    twice = " ".join([*plain[:100], *passage, *plain[100:230], *passage])  # 48 of 278 words repeated, one passage of 24
    long_words = [f"{'x' * 40}{k}" for k in range(5)]
    heavy = " ".join([*long_words, *plain[:60], *long_words])  # 10 of 70 words, but half of the characters
    clean = " ".join([*plain[:100], *passage[:6], *plain[100:230], *passage[:6]])
    prose = " ".join(plain)
    frame = spark.createDataFrame([(1, twice), (2, heavy), (3, clean), (4, prose)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(frame).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True), 4: (False, True)}


def test_patterns_are_few_files(spark):
    """The tables of the graph are not written as a file for each shuffle partition, whatever their number."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    folder = app_folder(spark).removeprefix("file:")
    files = lambda: {(d, x) for d, _, names in os.walk(folder) for x in names if x.startswith("part-")}
    rows = [(k, f"key{k % 90} a{k}@b.org and key{k % 90} {700000 + 37 * k}x{k}") for k in range(300)]
    known = files()
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        done = pii.redact(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
        assert done.rdd.getNumPartitions() <= 10 and done.filter("text like 'key% <email> and%'").count() == 300
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    made = collections.Counter(d for d, _ in files() - known)
    assert len(made) > 3 and max(made.values()) <= 8
