"""Keyed table: results as a plain dictionary's, and files read by an upsert."""

import random

import pytest

from ledgerspark.operators.keyed_table import KeyedTable

SCHEMA = "period string, id int, v int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def content(table):
    rows = table.read().collect()
    out = {(r.period, r.id): r.v for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("wins", ["first", "last"])
def test_loads_as_a_dictionary(spark, tmp_path, wins):
    rng = random.Random(4)
    table, want = KeyedTable(spark, str(tmp_path / "t"), ("period", "id"), file_rows=40), {}
    for batch in range(3):
        rows = {(rng.choice(["2023", "2024", None]), rng.randrange(120)): rng.randrange(10**6) for _ in range(80)}
        table.upsert(frame(spark, [(*k, v) for k, v in rows.items()]), batch, wins)
        want = {**rows, **want} if wins == "first" else {**want, **rows}
        assert content(table) == want
    commits = {r.version: r for r in table.commits().collect()}
    assert sorted(commits) == list(range(3)) and commits[2].rows_live == len(want)
    table.upsert(frame(spark, [("2023", 1, -1)]), 1, wins)  # a repeated batch
    assert content(table) == want and table.commits().count() == 3
    table.compact(99)
    assert content(table) == want and table.latest().live_files == round(len(want) / 40)
    with pytest.raises(ValueError):
        table.upsert(frame(spark, []), 7, "any")


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("period", "id"), file_rows=100)
    table.upsert(frame(spark, [(f"20{y}", 2 * k, y) for y in range(10, 20) for k in range(100)]), 0)
    assert table.latest().live_files == 10
    # one known key: its file; a new period: none; keys between known ones, inside the files' ranges: the filters rule them out
    known = table.upsert(frame(spark, [("2013", 8, -1)]), 1)
    assert (known.files_read, known.files_written) == (1, 1) and known.rows_live == 1000
    fresh = table.upsert(frame(spark, [("2030", k, 0) for k in range(50)]), 2)
    assert fresh.files_read == 0 and fresh.rows_live == 1050
    odd = table.upsert(frame(spark, [(f"20{y}", 2 * k + 1, 0) for y in range(10, 20) for k in range(0, 100, 25)]), 3)
    assert odd.files_read <= 1 and odd.rows_live == 1090
    kept = table.upsert(frame(spark, [("2013", 8, 5), ("2018", 4, 5), ("2018", 5, 5)]), 4, "first")
    assert kept.files_read <= 3 and kept.rows_live == 1091
    got = content(table)
    assert got["2013", 8] == -1 and got["2018", 4] == 18 and got["2018", 5] == 5
    assert table.files(4).count() == kept.live_files


def test_empty_loads(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("id",))
    with pytest.raises(ValueError):
        table.read()
    empty = spark.createDataFrame([], SCHEMA)
    table.upsert(empty, 0)
    assert table.read().count() == 0 and table.read().columns == ["period", "id", "v"]
    table.upsert(frame(spark, [("a", 1, 1)]), 1)
    table.upsert(empty, 2, "first")
    assert content(table) == {("a", 1): 1}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("id",))
    table.upsert(frame(spark, [("a", 1, 1)]), 0)
    frame(spark, [("b", 2, 2)]).write.parquet(str(tmp_path / "t/data/v=1"))  # the load ended before its commit
    assert content(table) == {("a", 1): 1}
    table.upsert(frame(spark, [("c", 3, 3)]), 1)
    assert content(table) == {("a", 1): 1, ("c", 3): 3}
