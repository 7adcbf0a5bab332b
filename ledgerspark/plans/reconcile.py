"""Bank statement against ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, ratio
from ledgerspark.operators.matching import match_in_window
from ledgerspark.session import staged

# Result states, words that mark a deposit, amount bands, light limits.
MATCHED = "Conciliado"
NOT_IN_BANK = "Partida en tránsito (no está en banco)"
NOT_IN_LEDGER = "No registrada en contabilidad"
DEPOSIT_WORDS = ("Depósito", "recibida", "Cobro", "Abono")
BANDS = ((500, "0 - 500"), (2000, "500 - 2,000"), (5000, "2,000 - 5,000"), (15000, "5,000 - 15,000"))
TOP_BAND = "Mayor a 15,000"


def reconcile(bank: DataFrame, ledger: DataFrame, days: int = 3) -> DataFrame:
    """Every bank and ledger row with its state; matched pairs carry both sides and the gap in days."""
    pairs = staged(
        match_in_window(
            bank.select(F.col("id").alias("banco_id"), "fecha_transaccion", "monto"),
            ledger.select(F.col("id").alias("libro_id"), "fecha_registro", "monto"),
            "monto", "fecha_transaccion", "fecha_registro", "banco_id", "libro_id", days,
        )
    )
    b = bank.withColumnRenamed("id", "banco_id")
    c = ledger.withColumnRenamed("id", "libro_id").withColumnRenamed("monto", "monto_libro")
    both = (
        b.join(pairs, "banco_id", "left")
        .join(c, "libro_id", "left")
        .select(
            "banco_id", "libro_id", "referencia", "comprobante", "monto", "fecha_transaccion", "fecha_registro", "descripcion", "concepto",
            F.abs(F.datediff("fecha_transaccion", "fecha_registro")).alias("desfase_dias"),
            F.when(F.col("libro_id").isNull(), NOT_IN_LEDGER).otherwise(MATCHED).alias("estado"),
        )
    )
    unused = c.join(pairs, "libro_id", "left_anti").withColumnRenamed("monto_libro", "monto")
    return both.unionByName(unused.withColumn("estado", F.lit(NOT_IN_BANK)), allowMissingColumns=True)


def result_rows(result: DataFrame) -> DataFrame:
    return result.select(
        "banco_id", "libro_id", "referencia", "comprobante", as_double("monto").alias("monto"), "fecha_transaccion", "fecha_registro",
        "descripcion", "concepto", "desfase_dias", "estado",
    )


def measures(result: DataFrame) -> DataFrame:
    """Counts, amounts, rates and light as one row from one aggregate."""
    matched, in_bank, in_ledger = (F.col("estado") == s for s in (MATCHED, NOT_IN_BANK, NOT_IN_LEDGER))
    gap = F.col("desfase_dias")
    deposit = F.lit(False)
    for word in DEPOSIT_WORDS:
        deposit = deposit | F.lower("descripcion").contains(word.lower())

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("monto"))), F.lit(0).cast("decimal(28,2)"))

    one = result.agg(
        F.count(F.lit(1)).alias("total_transacciones"),
        F.count_if(matched).alias("conciliadas"),
        F.count_if(in_bank).alias("faltantes_banco"),
        F.count_if(in_ledger).alias("faltantes_contabilidad"),
        as_double(total(matched)).alias("monto_conciliado"),
        as_double(total(in_bank)).alias("monto_faltante_banco"),
        as_double(total(in_ledger)).alias("monto_faltante_contabilidad"),
        as_double(total(in_bank) + total(in_ledger)).alias("monto_en_riesgo"),
        as_double(total(F.lit(True))).alias("_all"),
        F.round(F.avg(F.when(matched, gap)), 4).alias("promedio_desfase"),
        F.count_if(matched & (gap > 2)).alias("desfase_mayor_2"),
        F.count_if(matched & deposit).alias("conciliadas_deposito"),
    )
    rate = ratio("conciliadas", "total_transacciones")
    return one.withColumns(
        {
            "tasa_conciliacion": F.round(F.coalesce(rate, F.lit(0.0)), 6),
            "pct_monto_conciliado": F.round(F.coalesce(ratio("monto_conciliado", "_all"), F.lit(0.0)), 6),
            "semaforo": F.when(rate > 0.90, "Óptimo").when(rate > 0.75, "Aceptable").otherwise("Crítico"),
        }
    ).drop("_all")


def gap_histogram(result: DataFrame) -> DataFrame:
    rows = result.filter(F.col("estado") == MATCHED)
    return rows.groupBy("desfase_dias").agg(F.count(F.lit(1)).alias("cantidad"))


def running_totals(result: DataFrame) -> DataFrame:
    """Matched count and amount up to every bank date; the running window sees one row per date."""
    by_day = result.filter(F.col("estado") == MATCHED).groupBy("fecha_transaccion").agg(F.count(F.lit(1)).alias("_n"), F.sum("monto").alias("_m"))
    run = Window.orderBy("fecha_transaccion").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select(
        "fecha_transaccion", F.sum("_n").over(run).alias("acumulado"), as_double(F.sum("_m").over(run)).alias("acumulado_monto")
    )


def amount_bands(result: DataFrame) -> DataFrame:
    band = F.lit(TOP_BAND)
    for limit, label in reversed(BANDS):
        band = F.when(F.col("monto") <= limit, label).otherwise(band)
    rows = result.filter(F.col("estado") == MATCHED)
    return rows.groupBy(band.alias("rango_monto")).agg(F.count(F.lit(1)).alias("cantidad"), as_double(F.sum("monto")).alias("monto"))
