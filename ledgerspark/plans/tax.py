"""Tax work: invoices against withholdings, purchase validation, annex rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import comma_number, ruc_problem
from ledgerspark.functions.numbers import as_double, two_decimals

# Rounding tolerance, and the annex column of each exact rate (there is none for 50 %).
TOLERANCE = 0.02
RATE_COLUMNS = {
    "valRetBien10": "0.10", "valRetServ20": "0.20", "valorRetBienes": "0.30", "valorRetServicios": "0.70", "valRetServ100": "1.00",
}


def invoice_withholding(invoices: DataFrame, withholdings: DataFrame) -> DataFrame:
    """Left join on the access key; the other side falls back to its own access key without a supporting document.

    A missing key never matches a missing key.
    """
    key = "doc_sustento" if "doc_sustento" in withholdings.columns else "clave_acceso"
    right = withholdings.select(*[F.col(c).alias(f"ret_{c}") for c in withholdings.columns])
    joined = invoices.join(right, F.col("clave_acceso") == F.col(f"ret_{key}"), "left")
    return joined.withColumn("sin_retencion", F.col(f"ret_{key}").isNull())


def tax_cross(invoices: DataFrame, withholdings: DataFrame) -> DataFrame:
    """Invoices with flags for a missing withholding and for a base that differs by more than 0.01."""
    inv = invoices.withColumns({c: comma_number(c) for c in ("valor_sin_impuestos", "iva", "importe_total")})
    ret = withholdings.withColumns({c: comma_number(c) for c in ("base_imponible", "valor_retenido")})
    zero = F.lit(0.0)
    gap = F.abs(F.coalesce("valor_sin_impuestos", zero) - F.coalesce("ret_base_imponible", zero))
    return invoice_withholding(inv, ret).select(
        "clave_acceso", "ruc_emisor", "numero", "valor_sin_impuestos", "iva", "importe_total", "ret_base_imponible",
        "ret_valor_retenido", "sin_retencion", ((F.round(gap, 6) > 0.01) & ~F.col("sin_retencion")).alias("diff_monto"),
    )


def cross_counts(crossed: DataFrame) -> DataFrame:
    return crossed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("sin_retencion").alias("sin_retencion"), F.count_if("diff_monto").alias("diff_monto")
    )


def validate(purchases: DataFrame) -> DataFrame:
    """Every purchase with the reasons against it; a row without a reason is valid."""
    expected = F.round(F.col("monto_iva") * F.col("porcentaje_retencion_iva"), 2)
    gap = F.abs(F.col("valor_retenido_iva") - expected)
    rate = (F.col("porcentaje_retencion_iva") * 100).cast("int").cast("string")
    withheld = F.concat(
        F.lit("Retención IVA no cuadra: esperado $"), two_decimals(expected),
        F.lit(" (IVA $"), two_decimals("monto_iva"), F.lit(" × "), rate, F.lit("%), registrado $"),
        two_decimals("valor_retenido_iva"), F.lit(" (diferencia $"), two_decimals(gap), F.lit(").")
    )
    reasons = F.concat_ws(" | ", ruc_problem("ruc_proveedor"), F.when(gap > TOLERANCE, withheld))
    return purchases.withColumn("motivo_error", F.when(reasons != "", reasons)).withColumn("valido", F.col("motivo_error").isNull())


def validation_summary(validated: DataFrame) -> DataFrame:
    good = F.count_if("valido")
    return validated.agg(
        F.count(F.lit(1)).alias("procesados"), good.alias("validos"), F.count_if(~F.col("valido")).alias("con_errores"),
        F.round(good * 100.0 / F.count(F.lit(1)), 1).alias("tasa_aprobacion"),
    )


def annex_rows(purchases: DataFrame) -> DataFrame:
    """Twenty text fields per valid purchase; the withheld amount goes to the column of its exact rate."""
    rate = F.col("porcentaje_retencion_iva")

    def routed(exact: str) -> Column:
        return F.when(rate == F.lit(exact).cast("decimal(4,2)"), two_decimals("valor_retenido_iva")).otherwise("0.00")

    r = {name: routed(exact).alias(name) for name, exact in RATE_COLUMNS.items()}
    return purchases.select(
        F.col("codigo_sustento").alias("codSustento"),
        F.lit("01").alias("tpIdProv"),
        F.col("ruc_proveedor").alias("idProv"),
        F.col("tipo_comprobante").alias("tipoComprobante"),
        F.col("fecha_emision").alias("fechaRegistro"),
        "establecimiento",
        F.col("punto_emision").alias("puntoEmision"),
        "secuencial",
        "autorizacion",
        two_decimals("base_no_gravada").alias("baseNoGraIva"),
        two_decimals("base_imponible").alias("baseImponible"),
        two_decimals("base_imponible").alias("baseImpGrav"),
        two_decimals("monto_iva").alias("montoIva"),
        r["valRetBien10"],
        r["valRetServ20"],
        r["valorRetBienes"],
        F.lit("0.00").alias("valRetServ50"),
        r["valorRetServicios"],
        r["valRetServ100"],
        two_decimals("valor_retenido_renta").alias("valorRetRenta"),
    )


def annex_header(purchases: DataFrame, informant: str, name: str) -> DataFrame:
    """Header of the annex per fiscal month: informant, period and number of purchases."""
    period = F.to_date("fecha_emision", "dd/MM/yyyy")
    return purchases.groupBy(F.year(period).cast("string").alias("Anio"), F.date_format(period, "MM").alias("Mes")).agg(
        F.count(F.lit(1)).alias("compras")
    ).select(F.lit("R").alias("TipoIDInformante"), F.lit(informant).alias("IdInformante"), F.lit(name).alias("razonSocial"), "Anio", "Mes", "compras")


def money_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: as_double(n) for n in names})
