"""Aging of receivables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import month_label, quarter_label
from ledgerspark.functions.numbers import as_double, cents, percent, ratio

# Aging buckets in order, the overdue ones with their provision rate, and amount bands.
BUCKETS = ("Pagada", "Vigente", "1-30 días", "31-60 días", "61-90 días", "+90 días")
PROVISION = {"1-30 días": "0.01", "31-60 días": "0.05", "61-90 días": "0.20", "+90 días": "0.50"}
BANDS = ((1000, "< $1,000"), (5000, "$1,000 - $4,999"), (20000, "$5,000 - $19,999"), (50000, "$20,000 - $49,999"))
TOP_BAND = ">= $50,000"

COLUMNS = (
    "id_factura", "id_cliente", "nombre_comercial", "segmento", "fecha_emision", "fecha_vencimiento", "termino_dias",
    "monto_total", "saldo_pendiente", "estado", "dias_vencido", "aging_bucket", "alerta_por_vencer",
)


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def aging(invoices: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """Every invoice with its customer, days overdue, bucket and due-in-seven-days flag.

    Days are null unless something is owed and never negative; a negative balance is current, only zero is paid.
    """
    owed = F.col("saldo_pendiente") > 0
    late = F.when(owed, F.greatest(F.datediff(_day(as_of), F.col("fecha_vencimiento")), F.lit(0)))
    d = F.col("dias_vencido")
    bucket = (
        F.when(F.col("saldo_pendiente") == 0, BUCKETS[0])
        .when(d.isNull() | (d == 0), BUCKETS[1])
        .when(d <= 30, BUCKETS[2])
        .when(d <= 60, BUCKETS[3])
        .when(d <= 90, BUCKETS[4])
        .otherwise(BUCKETS[5])
    )
    due = owed & F.col("fecha_vencimiento").between(_day(as_of), F.date_add(_day(as_of), 7))
    return (
        invoices.join(customers.select("id_cliente", "nombre_comercial", "segmento"), "id_cliente", "left")
        .withColumn("dias_vencido", late)
        .withColumn("aging_bucket", bucket)
        .withColumn("alerta_por_vencer", due)
        .select(*COLUMNS)
    )


def overdue() -> Column:
    return F.col("aging_bucket").isin(*PROVISION)


def flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: as_double(c) for c in ("monto_total", "saldo_pendiente")})


def summary(aged: DataFrame) -> DataFrame:
    """Invoices and balance per bucket with shares; the windows run over at most six rows."""
    g = aged.groupBy("aging_bucket").agg(F.count(F.lit(1)).alias("n_facturas"), F.sum("saldo_pendiente").alias("_s"))
    whole = Window.partitionBy()
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("aging_bucket")).cast("int")
    return g.select(
        "aging_bucket", order.alias("bucket_order"), "n_facturas", as_double("_s").alias("saldo_total"),
        percent("_s", F.sum("_s").over(whole)).alias("pct_saldo"),
    )


def by_segment(aged: DataFrame) -> DataFrame:
    g = aged.filter("saldo_pendiente > 0").groupBy("segmento", "aging_bucket").agg(F.sum("saldo_pendiente").alias("_s"))
    return g.select("segmento", "aging_bucket", as_double("_s").alias("saldo"))


def top_debtors(aged: DataFrame, n: int = 10) -> DataFrame:
    """Largest overdue balances of known customers, by distributed top-k."""
    g = (
        aged.filter(overdue())
        .filter("nombre_comercial is not null and segmento is not null")
        .groupBy("id_cliente", "nombre_comercial", "segmento")
        .agg(F.sum("saldo_pendiente").alias("_s"), F.count(F.lit(1)).alias("n_facturas_vencidas"))
    )
    return g.orderBy(F.desc("_s"), "id_cliente").limit(n).select(
        "id_cliente", "nombre_comercial", "segmento", as_double("_s").alias("saldo_vencido_total"), "n_facturas_vencidas"
    )


def due_soon(aged: DataFrame) -> DataFrame:
    return flat(aged.filter("alerta_por_vencer")).select(
        "id_factura", "id_cliente", "nombre_comercial", "segmento", "fecha_vencimiento", "monto_total", "saldo_pendiente"
    )


def measures(aged: DataFrame, as_of: str, top: int = 10) -> DataFrame:
    """All receivable measures as one row.

    A narrow aggregate per bucket and flag reads the invoices; the many measures are then taken from its few rows.
    """
    s, late = F.col("saldo_pendiente"), F.col("dias_vencido")
    age = F.datediff(_day(as_of), F.col("fecha_emision"))
    per = aged.groupBy("aging_bucket", "alerta_por_vencer").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(s).alias("s"),
        F.sum(F.when(late > 0, late)).alias("late"),
        F.count_if(late > 0).alias("late_n"),
        F.sum(F.when(s > 0, age)).alias("age"),
        F.count_if(s > 0).alias("age_n"),
    )

    def when_sum(test: Column, column: str = "s") -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0).cast("decimal(24,2)" if column == "s" else "bigint"))

    in_bucket = {b: F.col("aging_bucket") == b for b in BUCKETS}
    provision = sum(when_sum(in_bucket[b]) * F.lit(rate).cast("decimal(4,2)") for b, rate in PROVISION.items())
    one = per.agg(
        F.sum("n").alias("total_facturas"),
        when_sum(overdue(), "n").alias("facturas_vencidas"),
        when_sum(in_bucket["Vigente"], "n").alias("facturas_vigentes"),
        when_sum(in_bucket["Pagada"], "n").alias("facturas_pagadas"),
        as_double(F.sum("s")).alias("saldo_total"),
        as_double(when_sum(overdue())).alias("saldo_vencido"),
        as_double(when_sum(in_bucket["Vigente"])).alias("saldo_vigente"),
        *[as_double(when_sum(in_bucket[b])).alias(n) for b, n in zip(PROVISION, ("saldo_1_30", "saldo_31_60", "saldo_61_90", "saldo_mas_90"))],
        cents(provision).alias("provision_estimada"),
        ratio(F.sum(F.when(overdue(), F.col("late"))), F.sum(F.when(overdue(), F.col("late_n"))), 4).alias("dias_promedio_mora"),
        ratio(F.sum("age"), F.sum("age_n"), 4).alias("antiguedad_promedio"),
        when_sum(F.col("alerta_por_vencer"), "n").alias("facturas_por_vencer_7d"),
        as_double(when_sum(F.col("alerta_por_vencer"))).alias("saldo_por_vencer_7d"),
    )
    debtors = (
        aged.filter(overdue()).groupBy("nombre_comercial").agg(F.sum("saldo_pendiente").alias("_s"))
        .orderBy(F.desc("_s"), "nombre_comercial").limit(top)
        .agg(as_double(F.sum("_s")).alias("top_n_deudores_saldo"))
    )
    share = ratio("saldo_vencido", "saldo_total")
    out = one.withColumn("_k", F.lit(1)).join(debtors.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumns(
        {
            "pct_morosidad": F.round(share, 6),
            "indice_recuperacion": ratio("facturas_pagadas", "total_facturas", 6),
            "semaforo": F.when(share <= 0.10, "Verde").when(share <= 0.25, "Amarillo").otherwise("Rojo"),
            "semaforo_valor": F.when(share <= 0.10, 1).when(share <= 0.25, 2).otherwise(3),
        }
    )


def by_month(aged: DataFrame) -> DataFrame:
    """Issued amount and count per month and quarter label and amount band."""
    band = F.lit(TOP_BAND)
    for limit, label in reversed(BANDS):
        band = F.when(F.col("monto_total") < limit, label).otherwise(band)
    g = aged.groupBy(
        month_label("fecha_emision").alias("mes"), quarter_label("fecha_emision").alias("trimestre"), band.alias("rango_monto")
    ).agg(F.sum("monto_total").alias("_m"), F.count(F.lit(1)).alias("cantidad"))
    return g.select("mes", "trimestre", "rango_monto", as_double("_m").alias("monto"), "cantidad")
