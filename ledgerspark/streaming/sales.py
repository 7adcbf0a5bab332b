"""Live sales and incremental statement loads with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ledgerspark.functions.numbers import cents
from ledgerspark.operators.keyed import keep_one
from ledgerspark.operators.keyed_table import KeyedTable
from ledgerspark.plans.ingest import KEY, append_batch, cleaned, usable
from ledgerspark.plans.sales import DAILY_TARGET
from ledgerspark.sources.files import DATA_FILES, STATEMENT_COLUMNS

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def sales_of(events: DataFrame) -> DataFrame:
    """Sales lines: purchases with seller and zone."""
    zone = F.concat(F.lit("Zona "), (F.col("user_id") % 6).cast("string"))
    return events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("factura_id"), "ts", F.col("user_id").alias("vendedor_id"), zone.alias("zona"),
        F.col("value").cast("decimal(12,2)").alias("total"),
    )


def _watched(sales: DataFrame, delay: str | None) -> DataFrame:
    return sales.withWatermark("ts", delay) if delay and sales.isStreaming else sales


def day_totals(sales: DataFrame, delay: str | None = None) -> DataFrame:
    """Running total of every day against the daily target; the same function serves streams and stored tables.

    The state is one row per day, so it is kept and a sale counts however late it comes. With a ``delay``, days older than
    that leave the state and their late sales are lost.
    """
    rows = _watched(sales, delay)
    g = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("total").alias("_v"), F.count(F.lit(1)).alias("ventas"))
    return g.select(
        F.to_date("w.start").alias("fecha"), cents("_v").alias("total"), "ventas",
        F.round(cents("_v") / DAILY_TARGET * 100, 1).alias("pct_meta"),
    )


def hourly(sales: DataFrame, delay: str | None = None) -> DataFrame:
    """Totals per hour, zone and seller; late sales as in ``day_totals``."""
    rows = _watched(sales, delay)
    g = rows.groupBy(F.window("ts", "1 hour").alias("w"), "zona", "vendedor_id").agg(F.sum("total").alias("_v"), F.count(F.lit(1)).alias("ventas"))
    return g.select(F.col("w.start").alias("hora"), "zona", "vendedor_id", cents("_v").alias("total"), "ventas")


def unique_invoices(sales: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per invoice. On a stream the state is bounded by the watermark: a repeat within ``delay`` is dropped, and a sale
    that comes later than that is lost; where none may be, use ``run_unique``."""
    if sales.isStreaming:
        return sales.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["factura_id"])
    return sales.dropDuplicates(["factura_id"])


def _drain(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_updates(spark: SparkSession, result: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run an updating aggregate to the end of its input and return the latest row of every key.

    Each micro-batch writes its changed rows under its own number with overwrite, so a repeated batch changes
    nothing; the reader takes the row of the highest batch.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    _drain(result.writeStream.outputMode("update").foreachBatch(store), f"{folder}/checkpoint")
    columns = result.columns
    log = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return keep_one(log, keys, ["batch"], "last").select(*columns)


def run_partials(spark: SparkSession, rows: DataFrame, partial: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Run a stream of rows into sums that never close: each micro-batch stores its own partial aggregate under its number, and
    ``merged`` adds all of them up when read.

    No state is kept between batches, so nothing grows with time and no row is late: a sale of last year makes a partial row for
    its day like any other. A repeated batch overwrites its own partials.
    """

    def store(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    _drain(rows.writeStream.foreachBatch(store), f"{folder}/checkpoint")
    return merged(spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").drop("batch"))


def day_partials(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.to_date("ts").alias("fecha")).agg(F.sum("total").alias("_v"), F.count(F.lit(1)).alias("_n"))


def merged_days(partials: DataFrame) -> DataFrame:
    """The table of ``day_totals`` from the partial sums of many batches."""
    g = partials.groupBy("fecha").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("ventas"))
    return g.select("fecha", cents("_v").alias("total"), "ventas", F.round(cents("_v") / DAILY_TARGET * 100, 1).alias("pct_meta"))


def hour_partials(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.date_trunc("hour", "ts").alias("hora"), "zona", "vendedor_id").agg(F.sum("total").alias("_v"), F.count(F.lit(1)).alias("_n"))


def merged_hours(partials: DataFrame) -> DataFrame:
    """The table of ``hourly`` from the partial sums of many batches."""
    g = partials.groupBy("hora", "zona", "vendedor_id").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("ventas"))
    return g.select("hora", "zona", "vendedor_id", cents("_v").alias("total"), "ventas")


def run_unique(spark: SparkSession, sales: DataFrame, folder: str, keys: tuple[str, ...] = ("factura_id",)) -> DataFrame:
    """Run a stream into a table with one row per invoice, however late a sale or a repeat comes.

    What has been seen is the table itself: a micro-batch looks its invoices up in the index of the stored files, so neither a watermark
    nor state that grows is needed, and only files that may hold one of its invoices are read. The first row of an invoice stays; of
    equal ones in a micro-batch the earliest.
    """
    table = KeyedTable(spark, f"{folder}/table", keys)

    def store(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys and c != "ts"]
        table.upsert(keep_one(batch, list(keys), ["ts", *rest], "first"), number, "first")

    _drain(sales.writeStream.foreachBatch(store), f"{folder}/checkpoint")
    return table.read()


def run_append(spark: SparkSession, result: DataFrame, folder: str) -> DataFrame:
    """Run an append-only result to the end of its input into a parquet table."""
    writer = result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data")
    _drain(writer, f"{folder}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{folder}/data")


def statement_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New statement files as text columns with their order in the batch."""
    schema = ", ".join(f"{c} string" for c in STATEMENT_COLUMNS)
    reader = spark.readStream.schema(schema).option("sep", "\t").option("pathGlobFilter", DATA_FILES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(folder).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"))


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch sink: clean, one row per key, append under the batch number (idempotent by that number)."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("row_in_block", F.monotonically_increasing_id())
        good = cleaned(rows)
        order = ["source_file", "block_start", "row_in_block"]
        reduced = keep_one(good.filter(usable(good)), KEY, order, "last")
        append_batch(reduced.select(*STATEMENT_COLUMNS), path, number)

    return merge


#: The key of a statement row as a file order: period first, so that a new period's rows touch few stored files.
TABLE_KEY = ("period_type", "date", "ruc", "account_code")


def statement_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, TABLE_KEY)


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch sink: clean, one row per key, and only stored files that may hold one of the keys are read and replaced."""

    def merge(batch: DataFrame, number: int) -> None:
        good = cleaned(batch.withColumn("row_in_block", F.monotonically_increasing_id()))
        reduced = keep_one(good.filter(usable(good)), KEY, ["source_file", "block_start", "row_in_block"], "last")
        statement_table(batch.sparkSession, path).upsert(reduced.select(*STATEMENT_COLUMNS), number, "last")

    return merge


def run_table_upsert(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """New statement files into the keyed table at ``target``; the table's rows."""
    stream = statement_stream(spark, source, files_per_trigger)
    _drain(stream.writeStream.foreachBatch(upsert_into(target)), checkpoint)
    return statement_table(spark, target).read()


def run_statement_upsert(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    stream = statement_stream(spark, source, files_per_trigger)
    _drain(stream.writeStream.foreachBatch(merge_into(target)), checkpoint)
