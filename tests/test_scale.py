"""What is shuffled, sorted and read by one task as tables grow."""

import datetime
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from ledgerspark import session
from ledgerspark.registry import QUERIES
from ledgerspark.sources import adapters
from ledgerspark.sources.tables import derive_statements


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A few lines of three suppliers, one of them without a number and one row twice."""
    folder = str(tmp_path_factory.mktemp("given"))
    day = datetime.date(1995, 1, 15)
    lines = [(k, 1 + k % 3, k % 7, k % 4, 100.25 * (k + 1), 0.05, 0.02, "AN"[k % 2], "OF"[k % 2], day + datetime.timedelta(40 * k)) for k in range(40)]
    lines += [lines[0], (50, 1, 3, None, 10.0, 0.0, 0.0, "R", "O", day)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate date"),
        "supplier": ([(k, f"S{k}", 0) for k in range(4)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_large_tables_are_not_dealt_out(spark, given, monkeypatch):
    lines = spark.read.parquet(f"{given}/lineitem.parquet")
    assert "Exchange" in plan(session.spread(lines, "l_suppkey"))
    monkeypatch.setattr(session, "SPLIT", 1)  # as if the file were long enough for Spark to cut it
    assert "Exchange" not in plan(session.spread(lines, "l_suppkey"))


def test_lines_become_texts_without_a_shuffle(spark, given, monkeypatch):
    monkeypatch.setattr(session, "SPLIT", 1)
    made = []
    monkeypatch.setattr(adapters, "written_once", lambda spark, name, source, build: made.append(build()) or made[0])
    assert adapters.load(spark, given, "raw_statements").count() == 42
    assert "Exchange" not in plan(made[0])


def test_partitioned_tables_are_written_without_a_sort(spark):
    seen = []

    def build():
        seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return spark.range(60).select("id", F.when(F.col("id") % 20 > 0, F.col("id") % 20).alias("p")).coalesce(1)

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    stored = session.written_once(spark, "partitioned", "test", build, ("p",))
    assert seen == [str(session.FOLDERS)] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    # more folders than files that are open at once, and rows without a folder
    assert sorted((r.id, r.p or 0) for r in stored.collect()) == [(k, k % 20) for k in range(60)]


def test_periods_are_summed_where_the_months_of_a_supplier_meet(spark, given):
    rows = derive_statements(spark, given)
    exchanges = [line for line in plan(rows).splitlines() if " Exchange " in line]
    assert exchanges and not any("period_type" in line for line in exchanges)
    total = {r.period_type: r.n for r in rows.groupBy("period_type").agg(F.count("*").alias("n")).collect()}
    assert set(total) == {"ANUAL", "TRIMESTRAL", "MENSUAL"}


def test_fact_rows_are_not_shuffled_by_account(spark, given):
    assert "hashpartitioning(account_code" not in plan(QUERIES["fact_financial"](spark, given))


def test_long_methods_are_cut_while_tables_are_stored(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(key, None), []
    session.written_once(spark, "limit", "test", lambda: seen.append(spark.conf.get(key)) or spark.range(3))
    assert seen == ["8000"] and spark.conf.get(key, None) == before
    session.staged(spark.range(3))
    assert spark.conf.get(key, None) == before
