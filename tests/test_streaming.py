from pyspark.sql import functions as F

from ledgerspark.plans import ingest
from ledgerspark.streaming import sales as live
from test_ingest import LINES, write

SF = "/root/testdata/sf0.001"


def split_events(spark, folder, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(parts):
        part = events.filter(F.least(F.floor((F.dayofyear("ts") - 1) / 10), F.lit(parts - 1)) == i)
        part.coalesce(1).write.parquet(f"{folder}/p{i}")
    return events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_streams_equal_batch(spark, tmp_path):
    events = split_events(spark, str(tmp_path / "in"))
    batch = live.sales_of(events)

    def stream():
        return live.sales_of(live.event_stream(spark, str(tmp_path / "in/*"), "*.parquet", files_per_trigger=1))

    day = live.run_updates(spark, live.day_totals(stream()), ["fecha"], str(tmp_path / "day"))
    assert rows(day) == rows(live.day_totals(batch))
    hour = live.run_updates(spark, live.hourly(stream()), ["hora", "zona", "vendedor_id"], str(tmp_path / "hour"))
    assert rows(hour) == rows(live.hourly(batch))
    twice = stream().withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c")
    unique = live.run_append(spark, live.unique_invoices(twice), str(tmp_path / "unique"))
    assert rows(unique) == rows(batch) and rows(live.unique_invoices(batch)) == rows(batch)


def test_late_sales_count(spark, tmp_path):
    schema = "factura_id long, ts timestamp, vendedor_id long, zona string, total decimal(12,2)"
    days = [(1, "2024-03-10 10:00:00"), (2, "2024-03-20 10:00:00"), (3, "2024-03-01 09:00:00")]
    for i, ts in days:
        one = spark.createDataFrame([(i, ts, 1, "Zona 1", 10.0)], "factura_id long, ts string, vendedor_id long, zona string, total double")
        one.withColumns({"ts": F.to_timestamp("ts"), "total": F.col("total").cast("decimal(12,2)")}).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    day = live.run_updates(spark, live.day_totals(stream), ["fecha"], str(tmp_path / "day"))
    assert {str(r.fecha): r.ventas for r in day.collect()} == {"2024-03-10": 1, "2024-03-20": 1, "2024-03-01": 1}
    hour = live.run_updates(spark, live.hourly(stream), ["hora", "zona", "vendedor_id"], str(tmp_path / "hour"))
    assert hour.count() == 3


SALES = "factura_id long, ts timestamp, vendedor_id long, zona string, total decimal(12,2)"


def sales_files(spark, folder, batches):
    """One file for each batch of (invoice, time); the stream reads them one after the other."""
    for k, batch in enumerate(batches):
        rows = [(i, ts, 1 + i % 2, "Zona 1", 10.0 * i) for i, ts in batch]
        one = spark.createDataFrame(rows, "factura_id long, ts string, vendedor_id long, zona string, total double")
        one.withColumns({"ts": F.to_timestamp("ts"), "total": F.col("total").cast("decimal(12,2)")}).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(SALES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), spark.read.schema(SALES).parquet(f"{folder}/*")


LATE = [
    [(1, "2024-03-10 10:00:00"), (2, "2024-03-10 11:30:00")],
    [(3, "2024-04-20 10:00:00"), (1, "2024-03-10 10:00:00")],
    [(4, "2024-01-01 09:00:00"), (1, "2024-03-10 10:00:00"), (3, "2024-04-20 10:00:00"), (3, "2024-04-20 10:00:00")],
]


def test_repeats_after_weeks_and_late_sales_as_in_the_batch(spark, tmp_path):
    stream, batch = sales_files(spark, str(tmp_path / "in"), LATE)
    unique = live.run_unique(spark, stream, str(tmp_path / "unique"))
    assert rows(unique.select(*batch.columns)) == rows(live.unique_invoices(batch)) and unique.count() == 4
    day = live.run_partials(spark, stream, live.day_partials, live.merged_days, str(tmp_path / "day"))
    assert rows(day) == rows(live.day_totals(batch))
    hour = live.run_partials(spark, stream, live.hour_partials, live.merged_hours, str(tmp_path / "hour"))
    assert rows(hour) == rows(live.hourly(batch))
    # what comes later is added to what is stored
    more = [(5, "2024-03-10 12:00:00", 1, "Zona 1", 7.0)]
    one = spark.createDataFrame(more, "factura_id long, ts string, vendedor_id long, zona string, total double")
    one.withColumns({"ts": F.to_timestamp("ts"), "total": F.col("total").cast("decimal(12,2)")}).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    day = live.run_partials(spark, stream, live.day_partials, live.merged_days, str(tmp_path / "day"))
    assert rows(day) == rows(live.day_totals(batch.unionByName(spark.read.parquet(str(tmp_path / "in/9")))))


def test_table_upsert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    write(source / "1.tsv", LINES)
    assert live.run_table_upsert(spark, str(source), table, check, files_per_trigger=1).count() == 6
    write(source / "2.tsv", [LINES[0].replace("1.188.854,66", "1,00"), LINES[0].replace("1.188.854,66", "2,00"), "broken\tline" + "\t" * 8])
    got = {r.account_code: r.value for r in live.run_table_upsert(spark, str(source), table, check, files_per_trigger=1).collect()}
    assert len(got) == 6 and got["1"] == 2.0


def test_statement_upsert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    write(source / "1.tsv", LINES)
    live.run_statement_upsert(spark, str(source), log, check, files_per_trigger=1)
    assert ingest.current_rows(spark, log).count() == 6
    write(source / "2.tsv", [LINES[0].replace("1.188.854,66", "1,00"), LINES[0].replace("1.188.854,66", "2,00"), "broken\tline" + "\t" * 8])
    live.run_statement_upsert(spark, str(source), log, check, files_per_trigger=1)
    got = {r.account_code: r.value for r in ingest.current_rows(spark, log).collect()}
    assert len(got) == 6 and got["1"] == 2.0


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    from ledgerspark.sources.files import read_statements

    raw = read_statements(spark, write(tmp_path / "a.tsv", LINES)).drop("row_in_block")
    merge = live.merge_into(str(tmp_path / "log"))
    merge(raw, 7)
    merge(raw, 7)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
