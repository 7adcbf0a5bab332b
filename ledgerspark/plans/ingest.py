"""From raw statement text to the stored table: clean, filter, one row per key, keyed load, run metrics."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import clean_date, clean_number, email_valid
from ledgerspark.operators.keyed import keep_one
from ledgerspark.sources.files import FILE_ORDER, STATEMENT_COLUMNS

KEY = ["ruc", "account_code", "date", "period_type"]
TEXT = [c for c in STATEMENT_COLUMNS if c not in ("date", "value")]


def cleaned(raw: DataFrame) -> DataFrame:
    """All columns in their final form; nothing is dropped yet."""
    return raw.withColumns(
        {
            **{c: F.trim(c) for c in TEXT if c != "sector_code"},
            "sector_code": F.replace(F.trim("sector_code"), F.lit("."), F.lit("")),
            "date": clean_date("date"),
            "value": clean_number("value"),
        }
    )


def usable(df: DataFrame) -> Column:
    """Critical columns are present and the tax number has 13 digits."""
    return (
        F.coalesce(F.col("ruc").rlike("^[0-9]{13}$"), F.lit(False))
        & (F.coalesce(F.length("account_code"), F.lit(0)) > 0)
        & F.col("value").isNotNull()
    )


def sector(df: DataFrame, wanted: str) -> DataFrame:
    """Rows whose upper-case entity type contains the text; applied before any shuffle."""
    return df.filter(F.upper("entity_type").contains(wanted.upper()))


def clean_statements(
    raw: DataFrame,
    order: list[str] = FILE_ORDER,
    keep: str = "first",
    sector_text: str | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """One clean row per key. The same path serves the first load (``first``) and corrections (``last``).

    The sector filter runs on the raw text, the row checks on cleaned columns, and the key comparison last, so
    values that differ only in blanks or date format count as the same key. An observation, when given, receives
    the number of rows read on the same pass.
    """
    if observation is not None:
        raw = raw.observe(observation, F.count(F.lit(1)).alias("rows_read"))
    if sector_text:
        raw = sector(raw, sector_text)
    good = cleaned(raw)
    return keep_one(good.filter(usable(good)), KEY, order, keep)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Add one load to the statement log; writing the same batch again replaces it, so a repeated run is harmless."""
    out = df.drop("batch").withColumn("fiscal_year", F.year("date"))
    out.write.mode("overwrite").partitionBy("period_type", "fiscal_year").parquet(f"{path.rstrip('/')}/batch={batch}")


def current_rows(spark: SparkSession, path: str, wins: str = "last") -> DataFrame:
    """The table as of the last load. ``first`` keeps what was stored first, ``last`` lets corrections win.

    Loads are only appended; the winner of a key is found when reading, by an aggregate over the log.
    """
    log = spark.read.option("basePath", path).parquet(path).drop("fiscal_year")
    return keep_one(log, KEY, ["batch"], wins).drop("batch")


def compact(spark: SparkSession, path: str, target: str, wins: str = "last") -> None:
    """Write the current rows as the first batch of a new log, so that reading no longer walks old loads."""
    append_batch(current_rows(spark, path, wins), target, 0)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read there; only a missing path counts as no."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def high_water_mark(df: DataFrame) -> DataFrame:
    """Latest date and number of rows; null and 0 for an empty table."""
    return df.agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("records"))


def stored_high_water_mark(spark: SparkSession, path: str) -> DataFrame:
    if not table_exists(spark, path):
        return spark.createDataFrame([(None, 0)], "last_date date, records bigint")
    return high_water_mark(current_rows(spark, path))


def run_metrics(raw: DataFrame) -> DataFrame:
    """Rows read, kept and discarded, with the reason, from one aggregate over the cleaned rows."""
    c = cleaned(raw)
    ok = usable(c)
    per_key = c.withColumn("_ok", ok).groupBy(*KEY, "_ok").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("value").isNull()).alias("_v"))
    total = per_key.agg(
        F.sum("_n").alias("rows_read"),
        F.count_if("_ok").alias("rows_loaded"),
        F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("_n"))), F.lit(0)).alias("rows_unusable"),
        F.coalesce(F.sum("_v"), F.lit(0)).alias("rows_without_value"),
    )
    return total.withColumn("rows_discarded", F.col("rows_read") - F.col("rows_loaded"))


def timed_load(raw: DataFrame, path: str, batch: int, keep: str = "first", order: list[str] = FILE_ORDER) -> dict[str, float]:
    """Clean, store as one batch and report rows read, loaded and discarded with the elapsed seconds, from one pass."""
    spark, start, seen = raw.sparkSession, time.perf_counter(), Observation("timed_load")
    append_batch(clean_statements(raw, order, keep, observation=seen), path, batch)
    loaded = spark.read.parquet(f"{path.rstrip('/')}/batch={batch}").count()
    read = seen.get["rows_read"]
    return {"rows_read": read, "rows_loaded": loaded, "rows_discarded": read - loaded, "seconds": time.perf_counter() - start}


def roster_import(rows: DataFrame, existing: DataFrame, groups: DataFrame, default_group: int | None = None) -> DataFrame:
    """Outcome of every non-blank roster row: inserted, omitted (known or repeated id) or error with its text.

    The first line of an id wins; it is found by an aggregate, and known ids by a left join on the distinct ids.
    """
    fields = ("cedula", "nombre", "apellido", "email", "grupo_id")
    r = rows.select("fila", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in fields])
    r = r.filter(F.concat(*fields) != "")
    complete = (F.col("cedula") != "") & (F.col("nombre") != "") & (F.col("apellido") != "")
    first = r.filter(complete).groupBy("cedula").agg(F.min("fila").alias("_first"))
    known = existing.select("cedula").distinct().withColumn("_known", F.lit(True))
    valid = groups.select(F.col("grupo_id").alias("_gid")).distinct()
    wanted = F.when(F.col("grupo_id") != "", F.col("grupo_id").try_cast("int"))
    joined = (
        r.join(first, "cedula", "left")
        .join(known, "cedula", "left")
        .withColumn("_wanted", wanted)
        .join(valid, F.col("_wanted") == F.col("_gid"), "left")
    )
    omitted = F.coalesce(F.col("_known"), F.lit(False)) | (F.col("fila") != F.col("_first"))
    outcome = F.when(~complete, "error").when(omitted, "omitido").otherwise("insertado")
    message = F.concat(F.lit("Fila "), F.col("fila").cast("string"), F.lit(": cedula, nombre y apellido son obligatorios."))
    return joined.withColumn("resultado", outcome).select(
        "fila", "cedula", "nombre", "apellido",
        F.when(F.col("email") != "", F.col("email")).alias("email"),
        F.when(F.col("resultado") == "insertado", F.coalesce("_gid", F.lit(default_group).cast("int"))).alias("grupo_id"),
        "resultado",
        F.when(F.col("resultado") == "error", message).alias("mensaje"),
    )


def roster_counts(outcome: DataFrame) -> DataFrame:
    return outcome.agg(
        F.count_if(F.col("resultado") == "insertado").alias("insertados"),
        F.count_if(F.col("resultado") == "omitido").alias("omitidos"),
        F.count_if(F.col("resultado") == "error").alias("errores"),
    )


def visible_rows(rows: DataFrame, assignments: DataFrame, user: int, supervisor: bool = False) -> DataFrame:
    """What one user may see: a supervisor all rows, an operator those of the assigned groups, without groups none."""
    if supervisor:
        return rows
    return rows.join(assignments.filter(F.col("usuario") == user), "grupo_id", "left_semi")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.filter(test)


def with_email_flag(df: DataFrame, column: str = "email") -> DataFrame:
    return df.withColumn("email_valido", email_valid(column))
