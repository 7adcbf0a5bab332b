"""Uploaded files to people, and the outcome of a mailing batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import email_valid
from ledgerspark.operators.matching import assign_one_to_one, contained_ids
from ledgerspark.session import staged

UNKNOWN = "DESCONOCIDO"


def map_files(people: DataFrame, files: DataFrame) -> DataFrame:
    """Preview table: every person with the assigned file, and every file nobody took."""
    pairs = contained_ids(files, people, "archivo", "cedula")
    assigned = staged(assign_one_to_one(pairs, "cedula", "archivo"))
    ok = email_valid("email")
    warning = F.concat(F.lit("Email '"), F.coalesce("email", F.lit("")), F.lit("' inválido/en blanco."))
    mine = people.join(assigned, "cedula", "left").select(
        F.concat_ws(" ", "nombres", "apellidos").alias("empleado"),
        "cedula",
        F.coalesce("archivo", F.lit("FALTANTE")).alias("pdf_asignado"),
        F.when(F.col("archivo").isNull(), "error").when(ok, "ok").otherwise("advertencia").alias("estado"),
        F.when(F.col("archivo").isNull(), "Ningún PDF con esta cédula fue subido").when(ok, "Ninguna").otherwise(warning).alias("advertencias"),
    )
    left = files.join(assigned, "archivo", "left_anti").select(
        F.lit(UNKNOWN).alias("empleado"), F.lit(UNKNOWN).alias("cedula"), F.col("archivo").alias("pdf_asignado"),
        F.lit("error").alias("estado"), F.lit("PDF no matchea con ninguna cédula del grupo").alias("advertencias"),
    )
    return mine.unionByName(left)


def mapping_status(preview: DataFrame) -> DataFrame:
    """Counts per state, and whether the batch may run: no person and no file is left over."""
    unknown = F.col("cedula") == UNKNOWN
    missing = F.col("pdf_asignado") == "FALTANTE"
    one = preview.agg(
        F.count_if(~unknown & ~missing).alias("asignados"),
        F.count_if(F.col("estado") == "advertencia").alias("con_advertencia"),
        F.count_if(missing).alias("sin_pdf"),
        F.count_if(unknown).alias("sin_empleado"),
    )
    return one.withColumn("puede_ejecutar", (F.col("sin_pdf") == 0) & (F.col("sin_empleado") == 0))


def send_log(people: DataFrame) -> DataFrame:
    """Outcome per person of a batch (one batch per group): an invalid address fails, everything else is ready to go."""
    address = F.trim(F.coalesce("email", F.lit("")))
    good = email_valid(address)
    return people.select(
        F.col("grupo_id").alias("envio_id"), F.col("id").alias("empleado_id"),
        F.when(good, "ok").otherwise("fallo").alias("estado"), F.when(~good, "Email inválido o vacío").alias("error_message"),
    )


def batch_outcome(log: DataFrame) -> DataFrame:
    return log.groupBy("envio_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("estado") == "ok").alias("enviados_ok"), F.count_if(F.col("estado") == "fallo").alias("enviados_fallo")
    )
