import datetime
import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from ledgerspark.operators import ladder as ladder_module
from ledgerspark.operators import matching
from ledgerspark.operators.keyed import keep_one
from ledgerspark.operators.ladder import ladder, quantiles, with_rank
from ledgerspark.operators.matching import assign_one_to_one, contained_ids, match_in_window
from ledgerspark.operators.prefix import with_leaf_flag


def sample(seed, n=600):
    """Groups with a null group, a value that holds a third of the rows, narrow and wide spreads, and both signs."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        g = r.choice(["a", "b", None])
        kind = r.random()
        v = 42.0 if kind < 0.34 else r.choice([r.uniform(-1e9, 1e9), r.uniform(100, 101), round(r.gauss(0, 1), 2), 0.0])
        rows.append((g, v))
    return rows + [("a", None), ("c", 5.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_and_percent_rank(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, v double")
    got = {r.id: (r.rk, r.pr) for r in with_rank(df, ["g"], "v", "rk", "pr").collect()}
    for i, (g, v) in enumerate(rows):
        if v is None:
            assert i not in got
            continue
        peers = [x for h, x in rows if h == g and x is not None]
        below = sum(x < v for x in peers)
        assert got[i][0] == 1 + sum(x > v for x in peers)
        assert got[i][1] == (below / (len(peers) - 1) if len(peers) > 1 else 0.0)


def test_ladder_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 1, -5, 3, 3)], "v double")
    got = sorted((r.v, r.n, r.below, r.total) for r in ladder(df, [], "v").collect())
    assert got == [(-5.0, 1, 0, 6), (1.0, 2, 1, 6), (3.0, 3, 3, 6)]


@pytest.mark.parametrize("seed", [3, 4])
def test_quantiles(spark, seed):
    rows = [r for r in sample(seed) if r[1] is not None]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "lo": 0.0, "hi": 1.0}
    for r in quantiles(df, ["g"], "v", points).collect():
        values = [v for g, v in rows if g == r.g]
        assert r.group_rows == len(values)
        for name, p in points.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_leaves(spark, seed):
    r = random.Random(seed)
    codes = {"".join(r.choice("123.") for _ in range(r.randint(1, 4))) for _ in range(120)}
    rows = [(g, c) for g in ("x", "y") for c in codes if r.random() < 0.6]
    df = spark.createDataFrame(rows, "g string, account_code string")
    got = {(x.g, x.account_code): x.is_leaf for x in with_leaf_flag(df, ["g"]).collect()}
    for g, c in rows:
        assert got[g, c] == (not any(h == g and d != c and d.startswith(c) for h, d in rows))


def test_keep_one(spark):
    rows = [("k", i, f"v{i}") for i in range(100)] + [(None, 1, "n1"), (None, 0, "n0")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(4)
    first = {r.k: r.v for r in keep_one(df, ["k"], ["o"], "first").collect()}
    last = {r.k: r.v for r in keep_one(df, ["k"], ["o"], "last").collect()}
    assert first == {"k": "v0", None: "n0"} and last == {"k": "v99", None: "n1"}
    with pytest.raises(ValueError):
        keep_one(df, ["k"], ["o"], "any")


def digest(key):
    return hashlib.md5(str(key).encode()).hexdigest(), key


def greedy(left, right, days):
    """Plain walk: every left row takes the first unused right row of the same amount within the window."""
    left = sorted(left, key=lambda r: (r[2], digest(r[0])))
    right = sorted(right, key=lambda r: (r[2], digest(r[0])))
    used, pairs = set(), set()
    for lid, amount, day in left:
        for rid, a, d in right:
            if rid not in used and a == amount and abs((d - day).days) <= days:
                used.add(rid)
                pairs.add((lid, rid))
                break
    return pairs


@pytest.mark.parametrize("seed, part_rows", [(s, n) for s in range(6) for n in (65_536, 2)])
def test_match_in_window(spark, monkeypatch, seed, part_rows):
    monkeypatch.setattr(matching, "PART_ROWS", part_rows)
    r = random.Random(seed)
    span = r.choice([5, 20, 60])

    def rows(n):
        return [
            (i, float(r.choice([100, 100, 100, r.randint(1, 8)])), datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randrange(span)))
            for i in range(n)
        ]

    left, right = rows(80), rows(70)
    to = lambda rows, k, d: spark.createDataFrame(rows, f"{k} long, monto double, {d} date")
    got = match_in_window(to(left, "l", "dl"), to(right, "r", "dr"), "monto", "dl", "dr", "l", "r", 3)
    assert {tuple(x) for x in got.collect()} == greedy(left, right, 3)


@pytest.mark.parametrize("seed", range(5))
def test_assign_equals_sequential_walk(spark, seed):
    r = random.Random(seed)
    ids = [f"{i:02d}" for i in range(12)]
    pairs = sorted({(r.choice(ids), f"f{r.randrange(10)}") for _ in range(40)})
    free, want = {f for _, f in pairs}, {}
    for i in ids:
        mine = sorted(f for j, f in pairs if j == i and f in free)
        if mine:
            want[i] = mine[0]
            free.discard(mine[0])
    got = assign_one_to_one(spark.createDataFrame(pairs, "i string, f string"), "i", "f")
    assert {x.i: x.f for x in got.collect()} == want


def walk(pairs):
    free, out = {f for _, f in pairs}, {}
    for i in sorted({i for i, _ in pairs}):
        mine = sorted(f for j, f in pairs if j == i and f in free)
        if mine:
            out[i] = mine[0]
            free.discard(mine[0])
    return out


def test_assign_along_a_chain(spark, monkeypatch):
    """Every choice depends on the one before; the rounds stay within twice the logarithm of the chain."""
    from ledgerspark.operators import components

    made, plain = [], components.rounds

    def counted(links):
        out = plain(links)
        made.append(out[1])
        return out

    monkeypatch.setattr(components, "rounds", counted)
    pairs = [("i0000", "f0000")] + [(f"i{k:04d}", f"f{k + d:04d}") for k in range(1, 1000) for d in (-1, 0)]
    got = assign_one_to_one(spark.createDataFrame(pairs, "i string, f string"), "i", "f")
    assert {x.i: x.f for x in got.collect()} == {f"i{k:04d}": f"f{k:04d}" for k in range(1000)}
    assert len(made) == 1 and made[0] <= 20


def test_assign_in_large_components(spark):
    r = random.Random(1)
    pairs = sorted({(r.randrange(40), f"f{r.randrange(35)}") for _ in range(90)} | {(500 + k, f"own{k}") for k in range(5)})
    frame = spark.createDataFrame(pairs, "i int, f string")
    for group_pairs in (30, 10_000):
        got = assign_one_to_one(frame, "i", "f", group_pairs)
        assert {x.i: x.f for x in got.collect()} == walk(pairs)


def test_components_of_negative_and_large_ids(spark):
    from ledgerspark.operators.components import components

    links = spark.createDataFrame([(-5, 2**62), (2**62, -(2**63)), (0, 0), (7, 8)], "a long, b long")
    groups = {}
    for x in components(links).collect():
        groups.setdefault(x.label, set()).add(x.node)
    assert sorted(map(sorted, groups.values())) == [[-(2**63), -5, 2**62], [0], [7, 8]]


def test_contained_ids(spark):
    files = spark.createDataFrame([("a_0123456789_b.pdf",), ("x12345678901y.pdf",), ("short_123.pdf",)], "f string")
    ids = spark.createDataFrame([("0123456789",), ("1234567890",), ("2345678901",), ("9999999999",)], "i string")
    got = {tuple(r) for r in contained_ids(files, ids, "f", "i").select("i", "f").collect()}
    assert got == {("0123456789", "a_0123456789_b.pdf"), ("1234567890", "x12345678901y.pdf"), ("2345678901", "x12345678901y.pdf")}


def test_contained_ids_of_any_kind(spark):
    files = spark.createDataFrame([("rol_A1234567.pdf",), ("x_0991290915001_y.pdf",), ("z0123456789.pdf",), ("a",)], "f string")
    ids = spark.createDataFrame([("A1234567",), ("0991290915001",), ("0123456789",), ("",), (None,), ("A12345678",)], "i string")
    got = {tuple(r) for r in contained_ids(files, ids, "f", "i").select("i", "f").collect()}
    assert got == {("A1234567", "rol_A1234567.pdf"), ("0991290915001", "x_0991290915001_y.pdf"), ("0123456789", "z0123456789.pdf")}


def test_ladder_of_narrow_tied_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(ladder_module, "PART_ROWS", 20)
    r = random.Random(5)
    values = [1000.0 + r.random() * 0.2 for _ in range(600)] + [1000.1] * 300 + [float("nan"), float("inf"), float("-inf"), -3.0, 0.0, None]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 5.0), (None, 5.0)], "g string, v double")
    got = {(x.g, repr(x.v)): (x.n, x.below, x.total) for x in ladder_module.ladder(df, ["g"], "v").collect()}
    order = sorted((v for v in values if v is not None), key=lambda v: (v != v, 0 if v != v else v))
    known = [repr(v) for v in order]
    want = {("g", x): (known.count(x), known.index(x), len(known)) for x in set(known)} | {(None, "5.0"): (2, 0, 2)}
    assert got == want
    rows = df.filter("g = 'g' and v is not null and v <> 1000.1").distinct()
    parted = ladder_module._parted(rows, ladder_module._splitters(rows, ["g"], "v"), ["g"], "v")
    sizes = [x["count"] for x in parted.groupBy("_part").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("kind", ["narrow", "tied", "outlier"])
def test_parts_are_even_and_ranks_exact(spark, monkeypatch, kind):
    """No part holds above twice the mean, a tied value is dealt to several tasks, and both ranks equal a plain count."""
    monkeypatch.setattr(ladder_module, "PART_ROWS", 25)
    r = random.Random(7)
    draw = {
        "narrow": lambda: 5e9 + r.random() * 1e-3,
        "tied": lambda: r.choice([7.0, 7.0, r.gauss(7, 1)]),
        "outlier": lambda: r.choice([1e300, -1e300]) if r.random() < 0.01 else r.random() * 1e-6,
    }[kind]
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y"]), draw()) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, s string, v double")
    got = with_rank(df, ["g"], "v", "rk", "pr", ["s"], "rs")
    by_id = {x.id: (x.rk, x.pr, x.rs) for x in got.collect()}
    for i, g, s, v in rows:
        peers = [x for _, h, _, x in rows if h == g]
        inside = [x for _, h, t, x in rows if h == g and t == s]
        assert by_id[i] == (1 + sum(x > v for x in peers), sum(x < v for x in peers) / (len(peers) - 1), 1 + sum(x > v for x in inside))
    splitters = ladder_module._splitters(df, ["g"], "v")
    parts = ladder_module._parted(df, splitters, ["g"], "v").groupBy("g", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    mixed = [x.n for x in parts if x.lo != x.hi]
    assert len(parts) > 3 and max(mixed, default=0) <= 2 * 25


def test_ranks_of_decimals_that_one_double_stands_for(spark, monkeypatch):
    monkeypatch.setattr(ladder_module, "PART_ROWS", 10)
    rows = [(i, f"9007199254740993.{i % 7:04d}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string").select("id", F.col("t").cast("decimal(28,4)").alias("v"))
    got = {x.id: x.rk for x in with_rank(df, [], "v", "rk").collect()}
    for i, t in rows:
        assert got[i] == 1 + sum(u > t for _, u in rows)
