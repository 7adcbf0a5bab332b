"""Operators over whole corpora against plain Python: window dedup, byte repeats, Jaccard groups, decontamination, LM scores."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import sort_plain, sorted_rows
from pyspark.sql import functions as F

from ledgerspark.llm import components, decontam, exchange, jaccard, lattice, lm, repeats, sketch, windows
from ledgerspark.session import app_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_sketch_never_misses_a_repeat():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    keys[3000:3200] = keys[:200]
    whole, parts = sketch.Planes(16), [sketch.Planes(16), sketch.Planes(16)]
    whole.add(keys)
    parts[0].add(keys[:2500])
    parts[1].add(keys[2500:])
    again = parts[0].again | parts[1].again | (parts[0].once & parts[1].once)
    assert (again == whole.again).all()
    assert sketch.passes(again, 16, keys[:200]).all()


@pytest.fixture(scope="module")
def copies():
    """Documents with shared passages, parts of others, near copies and templates around the limit."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, template = draw(60), draw(60)
    docs = [draw(rng.randrange(3, 260)) for _ in range(40)]
    docs += [draw(20) + passage + draw(rng.randrange(0, 30)) for _ in range(12)]
    docs += [docs[k][: len(docs[k]) // 2] + draw(15) + docs[k][len(docs[k]) // 2 :] for k in range(12)]
    docs += [template[:k] + [f"x{k}"] + template[k + 1 :] for k in range(4, 56, 3)] + [template, template]
    docs += [[*template[:30], *draw(3), *template[30:]] for _ in range(6)]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def frames(spark, odd, copies):
    frame, rows = odd
    return [(frame, rows), (spark.createDataFrame(copies, "doc_id long, text string").repartition(4), copies)]


def plain_windows(rows):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    number = [math.inf if i is None else i for i, _ in rows]
    for n, w in zip(number, words):
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            least[key] = min(n, least.get(key, math.inf))
    out = []
    for (i, _), n, w in zip(rows, number, words):
        gone = {p for a in range(len(w) - 12) if least[tuple(w[a : a + 13])] < n for p in range(a, a + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_window_dedup(spark, odd, copies, empty, monkeypatch):
    monkeypatch.setattr(windows, "FLUSH", 500)
    for frame, rows in frames(spark, odd, copies):
        got = sorted_rows(windows.removed(frame), "doc_id", "n_words", "n_removed", "kept_sha256", "kept")
        assert got == sort_plain(plain_windows(rows))
    assert windows.removed(empty).count() == 0


def plain_repeats(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    count = collections.Counter(r[a : a + size] for r in raw for a in range(len(r) - size + 1))
    out = []
    for (i, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, dtype=int)
        for a in range(len(r) - size + 1):
            if count[r[a : a + size]] > 1:
                gone[a] += 1
                gone[a + size] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(r) else 0
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1, "flush_bytes": 20_000}])
def test_byte_repeats(spark, odd, copies, empty, options):
    for frame, rows in frames(spark, odd, copies):
        rows = [r for r in rows if len(r[1] or "") < 20_000]
        frame = frame.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
        assert sorted_rows(repeats.removed(frame, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sort_plain(plain_repeats(rows, 400))
    assert repeats.removed(empty).count() == 0


def test_hot_line_with_different_text_around(spark):
    """A line shorter than LENGTH in every text, at most of its hot anchors' longer keys unshared, and some true repeats across it."""
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh") for _ in range(350))
    noise = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    rows = [(k, noise(200) + line + noise(200)) for k in range(60)]
    tail = noise(300)
    rows += [(100 + k, noise(150) + line + tail[: 40 + 60 * k] + noise(99)) for k in range(5)]
    rows += [(200 + k, tail[60 * k :] + line + noise(120)) for k in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sort_plain(plain_repeats(rows, 400))
    for hot in (5, 10**6):
        got = sorted_rows(repeats.removed(frame, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed", range(4))
def test_group_scan_of_any_size(seed, monkeypatch):
    """The interval scan itself, with short strings, in this process."""
    size, gram = 60, 20
    for name, value in (("LENGTH", size), ("GRAM", gram), ("LEFT", size - gram)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(seed)
    base = bytes(rng.randrange(97, 100) for _ in range(300))
    texts = [base[a : a + rng.randrange(80, 200)] + bytes(rng.randrange(97, 100) for _ in range(40)) for a in rng.choices(range(120), k=14)]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    at, keys = repeats.anchors(data, offsets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    for reach in (None, 500):
        before, after = repeats._sides(reach)
        room = max(before, after)
        text = np.concatenate([np.zeros(room, np.uint8), data, np.zeros(room, np.uint8)])
        left, right = np.minimum(at - offsets[owner], before), np.minimum(offsets[owner + 1] - at, after)
        spans, groups = [[] for _ in texts], collections.defaultdict(set)
        for key in set(keys.tolist()):
            own = np.flatnonzero(keys == key)
            if len(own) < 2:
                continue
            group = repeats._Group(text, at + room, left, right, own, (before, after))
            if reach is None:
                for k, a, b in zip(group.members.tolist(), *(x.tolist() for x in group.reach())):
                    if b:
                        spans[owner[k]].append((int(at[k] - offsets[owner[k]]) - a, int(at[k] - offsets[owner[k]]) + b))
            else:
                for a, b, members in group.groups():
                    for k in members.tolist():
                        groups[data[at[k] - a : at[k] + b].tobytes()].add((int(owner[k]), int(at[k] - offsets[owner[k]]) - a))
        if reach is None:
            want = plain_repeats(list(enumerate(t.decode() for t in texts)), size)
            assert [sum(b - a for a, b in repeats._united(s)) for s in spans] == [w[2] for w in want]
        else:
            assert dict(groups) == plain_groups(texts, size)


def plain_groups(texts, size):
    """Every string of ``size`` or more that occurs twice and cannot be extended at all its places, with these places."""
    out = {}
    found = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - size + 1):
            found[t[a : a + size]].append((i, a))
    level, n = [places for places in found.values() if len(places) > 1], size
    while level:
        longer = []
        for places in level:
            ahead = collections.defaultdict(list)
            for i, a in places:
                ahead[texts[i][a + n] if a + n < len(texts[i]) else None].append((i, a))
            behind = {texts[i][a - 1] if a else None for i, a in places}
            if (len(ahead) > 1 or None in ahead) and (len(behind) > 1 or None in behind):
                i, a = places[0]
                out[texts[i][a : a + n]] = set(places)
            longer += [more for x, more in ahead.items() if x is not None and len(more) > 1]
        level, n = longer, n + 1
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 1}])
def test_repeat_groups_are_all_maximal_repeats(spark, options):
    rng = random.Random(6)
    draw = lambda n: bytes(rng.randrange(97, 107) for _ in range(n)).decode()
    s, x, long = draw(450), draw(60), draw(5000)
    texts = [draw(80) + s + draw(70), draw(30) + x + s + draw(200), x + s + draw(10), s, long + draw(50), draw(33) + long, long[900:1700], draw(700), "", None, s[20:] + draw(40), draw(90) + s + s]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in repeats.repeat_groups(frame, reach=6000, **options).collect():
        got[texts[r.doc_id][r.start : r.stop].encode()].add((r.doc_id, r.start))
    want = plain_groups([(t or "").encode() for t in texts], 400)
    assert dict(got) == want and max(map(len, want)) >= 5000
    assert repeats.repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeat_groups_hold_equal_strings(spark, copies):
    texts = dict(copies)
    groups = collections.defaultdict(set)
    for r in repeats.repeat_groups(spark.createDataFrame(copies, "doc_id long, text string")).collect():
        groups[r.group].add((r.doc_id, r.start, r.stop))
    assert groups
    for members in groups.values():
        assert len({texts[i].encode()[a:b] for i, a, b in members}) == 1 and all(b - a >= 400 for _, a, b in members)
    assert max(map(len, groups.values())) > 1


def plain_jaccard(rows):
    sets = []
    for _, t in rows:
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(k)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[k] = (rows[k][0], len(sets[k]), min(ids) if ids else None)
    return out, groups


def test_jaccard_components(spark, odd, copies, empty, monkeypatch):
    for frame, rows in frames(spark, odd, copies):
        got = sorted_rows(jaccard.near_duplicates(frame), "doc_id", "n_shingles", "component_id")
        assert got == sort_plain(plain_jaccard(rows)[0])
    assert jaccard.near_duplicates(empty).count() == 0
    # without step 2 everything is left to the exact step
    monkeypatch.setattr(jaccard, "_neighbour_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    frame, rows = frames(spark, odd, copies)[1]
    assert sorted_rows(jaccard.near_duplicates(frame), "doc_id", "n_shingles", "component_id") == sort_plain(plain_jaccard(rows)[0])


def test_keep_first_leaves_one_of_each_group(odd, empty):
    frame, rows = odd
    kept = jaccard.keep_first(frame)
    assert kept.columns == frame.columns
    _, groups = plain_jaccard(rows)
    want = []
    for members in groups.values():
        best = min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        want.append((rows[best][0], rows[best][1]))
    ids = lambda pairs: sort_plain([(i, WORD.findall((t or "").translate(LOWER))[:3] != []) for i, t in pairs])
    assert ids([(r.doc_id, r.text) for r in kept.collect()]) == ids(want)
    assert jaccard.keep_first(empty).count() == 0


def test_rows_of_each_step_follow_the_members_not_the_parts(spark):
    """Near copies of one text: each step's rows grow with their number, whatever the number of parts."""
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]

    def near(n):
        rows = []
        for k in range(n):
            words = list(base)
            for p in rng.sample(range(120), 1):
                words[p] = f"x{k}.{p}"
            rows.append((k, " ".join(words)))
        return spark.createDataFrame(rows, "doc_id long, text string")

    made = {}
    for n in (200, 400):
        classes = jaccard.stored(jaccard.document_sets(near(n)).filter("shingles is not null").select("node", "shingles"), "classes")
        order = spark.sparkContext.broadcast(jaccard.shingle_order(classes))
        links = jaccard.stored(jaccard._neighbour_links(classes, order), "links")
        labels = components.components(links.union(classes.select(F.col("node").alias("a"), F.col("node").alias("b"))))
        known = jaccard.stored(classes.join(labels, "node"), "known")
        for n_parts in (64, 211):
            made[n, n_parts] = (links.count(), labels.count(), jaccard._candidates(known, order, n_parts).count())
    for n in (200, 400):
        assert made[n, 64] == made[n, 211] and made[n, 64][0] <= 5 * 16 * n and made[n, 64][2] <= n
    assert made[400, 64][0] <= 2.5 * made[200, 64][0]


def test_small_results_are_few_files(spark, odd):
    """A small table is not written as a file for each shuffle partition, whatever their number."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    folder = app_folder(spark).removeprefix("file:")
    files = lambda: {(d, x) for d, _, names in os.walk(folder) for x in names if x.startswith("part-")}
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(100)) for _ in range(300)]
    rows = [(3 * k + j, t + " end" * j) for k, t in enumerate(texts) for j in range(3)]
    known = files()
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
        assert kept.rdd.getNumPartitions() <= 8
        assert sorted(r.doc_id for r in kept.collect()) == [3 * k for k in range(300)]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    made = collections.Counter(d for d, _ in files() - known)
    assert len(made) > 8 and max(made.values()) <= 20


def test_sets_without_links_are_left_out_whatever_the_size(spark, monkeypatch):
    """As many shingles as fill a sketch's largest plane many times, which let every set pass."""
    monkeypatch.setattr(sketch, "MAX_BITS", 16)
    monkeypatch.setattr(jaccard, "PART_KEYS", 2_000, raising=False)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1_500)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k] + " tail" * k) for k in range(4)] + [(2000, "one"), (2001, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    live = {r.doc_id for r in jaccard.document_sets(frame).filter("shingles is not null").collect()}
    wanted = {*range(4), *range(1000, 1004)}
    assert wanted <= live and len(live) <= len(wanted) + 15
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert got == {i: (n, c) for i, n, c in plain_jaccard(rows)[0]}


def test_linked_sets_share_some_of_their_least_members():
    rng = np.random.default_rng(6)
    for _ in range(400):
        a = rng.permutation(10_000)[: rng.integers(1, 90)].astype(np.uint64)
        keep = rng.integers(int(0.75 * len(a)), len(a) + 1)
        b = np.unique(np.r_[a[:keep], rng.permutation(10_000)[: rng.integers(0, max(1, len(a) // 4))].astype(np.uint64) + np.uint64(rng.choice([0, 10_000]))])
        a, both = np.sort(a), len(np.intersect1d(a, b))
        if jaccard._linked(both, len(a), len(b)):
            looked, shared = jaccard._looked(np.array([len(a), len(b)]))
            assert (shared >= 1).all() and (looked <= [len(a), len(b)]).all()
            assert len(np.intersect1d(a[: looked[0]], b[: looked[1]])) >= shared.max()


def test_least_shingles_meet_over_tasks_and_flushes():
    """Counts of what is met again are those of all sets at once, wherever the sets are held and however often a task sends."""
    rng = random.Random(2)
    common = " ".join(f"c{k}" for k in range(40))
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))) + " " + common * rng.randrange(2) for _ in range(60)]
    texts += texts[:10] + ["", " ", texts[3] + " x"]
    messages, wanted = [], {}
    seen = collections.Counter()
    for task, flushes in enumerate(([texts[:20], texts[20:25]], [texts[25:60]], [texts[60:61], texts[61:]])):
        held = jaccard._Held(40, 7, task)
        for flush, own in enumerate(flushes):
            for some in (own[:3], own[3:]):
                held.add(pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["text"]))
            messages += list(held.sent())
            held.clear()
            sets = [set(jaccard.shingles(pa.array([t]))[0].tolist()) for t in own]
            looked = [sorted(x)[: int(jaccard._looked(np.array([len(x)]))[0][0])] for x in sets if x]
            wanted[task << 32 | flush] = looked, [len(x) for x in sets if x]
            seen.update(x for one in looked for x in one)
    names = {m["source"]: m for m in messages if m["cells"] is None}
    left = {s: exchange.numbers_in(m["rows"]).astype(int) for s, m in names.items()}
    for p in range(7):
        own = [m for m in messages if m["cells"] is not None and m["part"] == p]
        for m in jaccard._met_rows(own):
            rows = np.cumsum(exchange.numbers_in(m["rows"])).astype(int) - 1
            np.subtract.at(left[m["source"]], rows, 1)
    for s, (looked, sizes) in wanted.items():
        shared = jaccard._looked(np.array(sizes, dtype=np.int64))[1] if sizes else []
        again = [sum(seen[x] > 1 for x in one) for one in looked]
        assert [x <= 0 for x in left[s]] == [n >= k for n, k in zip(again, shared)]
    assert any((x <= 0).any() for x in left.values()) and any((x > 0).any() for x in left.values())


def test_numbers_in_few_bytes():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.uint64), np.zeros(9, np.uint64), np.array([2**64 - 1, 0, 1], np.uint64), rng.integers(0, 40_000, 5_000).astype(np.uint64)):
        body = exchange.numbers_out(x)
        assert np.array_equal(exchange.numbers_in(body), x) and len(body) <= 40 + 2.1 * len(x) * (1 if len(x) != 3 else 5)


def test_sets_are_deleted_when_links_are_known(spark, odd):
    folder = app_folder(spark).removeprefix("file:")
    found = lambda: {(d, n) for d, names, _ in os.walk(folder) for n in names if n in ("sets", "classes", "pairs")}
    known = found()
    assert jaccard.keep_first(odd[0]).count() and found() <= known


def test_order_cuts_sets_alike(spark):
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**64, 50, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 2**64, 60, dtype=np.uint64)]) for _ in range(80)]
    frame = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, shingles binary")
    order = jaccard.shingle_order(frame)
    assert set(order.first(sets[0], 60).tolist()).isdisjoint(common.tolist())  # rare ones first
    for a in sets[:10]:
        cut = order.fragments(a)
        assert sorted(np.concatenate(cut).tolist()) == sorted(a.tolist())
        for b in sets[:10]:
            both = len(np.intersect1d(a, b))
            assert sum(jaccard._overlap(x, y) for x, y in zip(cut, order.fragments(b))) == both
            assert jaccard._fragments_linked(cut, order.fragments(b)) == jaccard._linked(both, len(a), len(b))
    assert min(sum(len(order.fragments(s)[f]) for s in sets) for f in range(jaccard.FRAGMENTS)) > 0


def test_sets_without_company_are_not_sent(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5_000)]
    base = " ".join(words[k] for k in rng.integers(0, 5_000, 300))
    # each shingle is held by two rows, but no two rows share more than a half
    texts = [" ".join(words[k] for k in rng.integers(0, 5_000, 150)) for _ in range(80)]
    rows = [(k, f"{texts[k]} . {texts[(k + 1) % 80]}") for k in range(80)] + [(900, base), (901, base + " end"), (902, base)]
    sets = jaccard.stored(jaccard.document_sets(spark.createDataFrame(rows, "doc_id long, text string")).filter("shingles is not null"), "sets")
    assert sets.count() == 83
    classes = jaccard.stored(jaccard.set_classes(sets), "classes")
    assert classes.count() == 82 and classes.select("node").distinct().count() == 82
    sent = jaccard._near_rows(classes).groupBy("node").count().collect()
    own = {r.node for r in sets.filter("doc_id >= 900").collect()}
    both = {r.node: r["count"] for r in sent}
    assert all(both[n] >= jaccard.ROUNDS - 2 for n in own)
    assert sum(both.values()) < 0.8 * jaccard.ROUNDS * 82
    order = spark.sparkContext.broadcast(jaccard.shingle_order(classes))
    held = [np.frombuffer(r.rarest, dtype=np.uint64) for r in jaccard._rarest_rows(classes, order).collect()]
    met, times = np.unique(np.concatenate(held), return_counts=True)
    assert (times > 1).mean() > 0.95  # those met once only are left out, but for shared cells


def test_bits_of_planes_in_few_bytes():
    rng = np.random.default_rng(9)
    for n, size, most in ((0, 4096, 40), (1, 4096, 60), (3_000, 1 << 16, 1.45 * 3_000), (40_000, 4096, 4200), (400, 1 << 19, 2.2 * 400)):
        block = np.packbits(np.bincount(rng.integers(0, 8 * size, n), minlength=8 * size).astype(bool), bitorder="little")
        body = sketch.bits_out(block)
        assert np.array_equal(sketch.bits_in(body, size), block) and len(body) <= most


def test_rounds_of_a_chain_in_order(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
    labels, rounds = components.rounds(links)
    rows = labels.collect()
    assert {r.node for r in rows} == set(range(401)) and len({r.label for r in rows}) == 1 and 0 <= rows[0].label <= 400
    assert rounds <= 14
    negative = components.components(spark.createDataFrame([(-5, 2**62), (2**62, -(2**63))], "a long, b long")).collect()
    assert {r.node for r in negative} == {-5, 2**62, -(2**63)} and len({r.label for r in negative}) == 1


def test_components_of_random_links(spark):
    rng = random.Random(9)
    order = rng.sample(range(10**6), 120)
    links = list(zip(order, order[1:])) + [(10**7, 10**7 + k) for k in range(50)] + [(5 * 10**7, 5 * 10**7)]
    links += [(2 * 10**7 + rng.randrange(60), 2 * 10**7 + rng.randrange(60)) for _ in range(50)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    sides = [collections.defaultdict(set) for _ in range(2)]
    for x in parent:
        sides[0][top(x)].add(x)
        sides[1][got[x]].add(x)
    assert sorted(map(sorted, sides[0].values())) == sorted(map(sorted, sides[1].values()))


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert decontam.common_subsequence(a, b) == row[-1]


def test_leaks_exact_and_changed(spark, odd):
    rng = random.Random(21)
    vocabulary = [f"t{k}" for k in range(900)]
    weights = [1 / (k + 1) for k in range(900)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(rng.randrange(18, 70)) for _ in range(25)]
    docs, truth = [draw(rng.randrange(0, 400)) for _ in range(150)], set()
    for d in range(0, 75):
        i = d % 25
        body = list(items[i])
        if d >= 25:  # paraphrases: words changed or left out
            for _ in range(len(body) // 10):
                body[rng.randrange(len(body))] = rng.choice(vocabulary[100:])
        if d >= 50:
            del body[len(body) // 2]
        at = rng.randrange(len(docs[d]) + 1)
        docs[d] = docs[d][:at] + body + docs[d][at:]
        truth.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in enumerate(docs)] + [(None, " ".join(items[0])), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)] + [(70, None), (None, "x y z a b c"), (71, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame, bench).collect()}
    assert (None, 0) in got and {p for p in truth if p[0] < 25} <= got
    assert len(truth & got) >= 0.9 * len(truth) and not got - truth - {(None, 0)}
    clean = decontam.clean(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in frame.collect()} - {d for d, _ in got}
    assert decontam.leaks(frame.limit(0), bench).count() == 0
    assert decontam.clean(frame, bench.limit(0)).count() == frame.count()
    odd_frame, rows = odd
    assert decontam.clean(odd_frame, bench).count() == len(rows)


def test_leaks_of_an_item_that_many_rows_hold(spark):
    rng = random.Random(22)
    vocabulary = [f"t{k}" for k in range(900)]
    weights = [1 / (k + 1) for k in range(900)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [[f"q{k}x{j}" for j in range(5)] + draw(10) for k in range(5)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for share, longest in ((3, 60), (1, 400)):
        docs, truth = [draw(rng.randrange(5, longest)) for _ in range(300)], set()
        for d in range(0, 300, share):
            at = rng.randrange(len(docs[d]) + 1)
            docs[d] = docs[d][:at] + items[0] + docs[d][at:]
            truth.add((d, 0))
        frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(3)
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(frame, bench).collect()} == truth


def test_leaks_of_long_items(spark):
    rng = random.Random(23)
    vocabulary = [f"t{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(n) for n in (500, 500, 230, 1500, 30)]
    docs, truth = [draw(rng.randrange(0, 2500)) for _ in range(60)], set()
    for d in range(30):
        body = list(items[d % 5])
        if d >= 10:  # a tenth of the words changed, and a twentieth left out
            for _ in range(len(body) // 10):
                body[rng.randrange(len(body))] = rng.choice(vocabulary[100:])
        if d >= 20:
            for _ in range(len(body) // 20):
                del body[rng.randrange(len(body))]
        at = rng.randrange(len(docs[d]) + 1)
        docs[d] = docs[d][:at] + body + docs[d][at:]
        truth.add((d, d % 5))
    for d in range(30, 40):  # a third of a long item is no leak of it
        docs[d] = docs[d] + items[d % 4][: len(items[d % 4]) // 3]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame, bench).collect()}
    assert set(got) == truth and all(got[d, d % 5].common == 1.0 for d in range(10))


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    raw, weights = lattice.read_vocabulary(path)
    pieces, number = lattice.Pieces.of(raw), {p: k for k, p in enumerate(raw)}
    share = np.r_[weights / weights.sum() * 0.99, np.full(256, 0.01 / 256)]
    logs = lattice.logs_of(share)
    words = ["the", "thatinger", "éau", "x" * 60, "字🙂", "###", "a", "\x00\x01"]

    def plain(word):
        s = b"\xff" + word.encode()
        ways = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(j):
                ways[j] += ways[i] * share[number[s[i:j]]] if s[i:j] in number else 0.0
            ways[j] += ways[j - 1] * share[len(raw) + s[j - 1]] if s[j - 1] != 255 else 0.0
        return math.log(ways[-1])

    whole = lattice.Lattice([w.encode() for w in words], pieces)
    scores = whole.scores(logs)
    assert np.allclose(scores, [plain(w) for w in words])
    expected = whole.expected(logs, np.arange(1, len(words) + 1))
    for piece in (b"\xffthe", b"x", b"th", b"##"):
        more = logs.copy()
        more[number[piece]] += 1e-6
        slope = ((whole.scores(more) - scores) * np.arange(1, len(words) + 1)).sum() / 1e-6
        assert math.isclose(expected[number[piece]], slope, rel_tol=1e-3, abs_tol=1e-6)


def test_lm_scores(spark, odd, empty):
    frame, rows = odd
    path = public_tokenizers.path("piece_bpe_32k.model")
    training = frame.filter(~lm.held_out(F.col("doc_id")))
    model, counts = lm.train(training, path)
    got = sorted_rows(lm.score(frame, model, counts), "doc_id", "n_tokens", "n_known", "base_score", "score")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [[w.translate(LOWER) for w in WORD.findall(t or "")] for _, t in rows]
    count = collections.Counter(w for (i, _), ws in zip(rows, words) if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in rows)
    total, types = sum(count.values()) + ends, len(count) + 1
    assert (model.tokens, model.types) == (total, types)
    divisor = math.log10(total + types + 1)
    lat = lattice.Lattice([w.encode() for w in sorted({w for ws in words for w in ws})], model.pieces.value)
    logs = dict(zip(sorted({w for ws in words for w in ws}), lat.scores(model.logs)))
    want = []
    for (i, _), ws in zip(rows, words):
        base = sum(math.log10(count[w] + 1) - divisor for w in ws) + math.log10(ends + 1) - divisor
        want.append((i, len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, base, (sum(logs[w] for w in ws) + model.end_log) / math.log(10)))
    want = sort_plain(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want])
    nothing, none = lm.train(empty, path)
    assert lm.score(empty, nothing, none).count() == 0
    assert lm.score(frame, nothing, none).filter("n_known = 0").count() == len(rows)


def test_singular_vectors_of_one_pass():
    rng = np.random.default_rng(2)
    left, right = np.linalg.qr(rng.normal(size=(200, 10)))[0], np.linalg.qr(rng.normal(size=(60, 10)))[0]
    a = left * (2.0 ** -np.arange(10)) @ right.T
    random_ = rng.normal(size=(60, 16))
    vectors, values = decontam.singular_vectors(a.T @ (a @ random_), random_)
    assert np.allclose(values[:8], 2.0 ** -np.arange(8), rtol=1e-3)
    assert np.allclose(np.abs((vectors[:, :8] * right[:, :8]).sum(axis=0)), 1, atol=1e-4)


def paraphrased(docs, items, share, seed):
    """Items whose rarest words, ``share`` of all, are others, in the middle of unrelated texts; the plain texts beside them."""
    rng = random.Random(seed)
    seen = collections.Counter(w for _, t in docs for w in set(re.findall(r"\w+", (t or "").lower())))
    texts, truth = [], set()
    for k, (i, t) in enumerate(items):
        words = re.findall(r"\w+", t.lower())
        for p in sorted(range(len(words)), key=lambda p: seen[words[p]])[: int(share * len(words))]:
            words[p] = f"other{rng.randrange(10**6)}"
        around = re.findall(r"\S+", docs[rng.randrange(len(docs))][1] or "")[:30]
        texts.append((10**6 + k, " ".join([*around, *words, *around])))
        truth.add((10**6 + k, i))
    return texts, truth


def test_paraphrases_without_the_rare_words(spark):
    """Found by their cosine alone: without it they are lost. Blocks of any size give the same rows and cosines."""
    docs = ds_rows("documents", "doc_id", "text")
    items = [(i, t) for i, t in ds_rows("benchmark", "item_id", "text") if len(t.split()) >= 15][:60]
    texts, truth = paraphrased(docs, items, 0.18, 3)
    frame = spark.createDataFrame([*docs, *texts], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: {(r.doc_id, r.item_id): r.cosine for r in decontam.leaks(frame, bench, **k).collect()}
    whole = rows()
    recall = len(truth & whole.keys()) / len(truth)
    without = len(truth & rows(candidate=2.0).keys()) / len(truth)
    print("recall of paraphrases", recall, "without the cosine", without)
    assert recall >= 0.9 and without < 0.5
    assert {p for p in whole if p[0] >= 10**6} <= truth
    parts = rows(block=7)
    assert parts.keys() == whole.keys() and all(abs(parts[p] - whole[p]) < 1e-6 for p in whole)


def ds_rows(name, *columns):
    import pyarrow.dataset as ds
    from conftest import SF

    table = ds.dataset(f"{SF}/{name}.parquet").to_table(columns=list(columns))
    return list(zip(*(table[c].to_pylist() for c in columns)))


def test_spread_ids_have_no_order_and_come_back(spark):
    from ledgerspark.operators import components as general

    ids = [*range(400), -(1 << 63), (1 << 63) - 1, -1, *(k << 32 for k in range(1, 200)), None]
    frame = spark.createDataFrame([(k, k) for k in ids], "a long, b long")
    spread = [r.a for r in general._spread(frame).collect()]
    assert len(set(spread)) == len(ids) and [r.b for r in general._gathered(general._spread(frame)).collect()] == ids
    for part in (spread[:400], spread[403:602]):
        ups = sum(x < y for x, y in zip(part, part[1:]))
        assert 0.35 < ups / (len(part) - 1) < 0.65
