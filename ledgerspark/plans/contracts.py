"""Expiry of contracts and obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import month_label, quarter_label, shortened
from ledgerspark.functions.numbers import as_double, ratio

# Alert days, display order of the lights, overall states.
ALERT_DAYS = (7, 15, 30)
LIGHT_ORDER = ("Rojo", "Amarillo", "Verde")
OVERALL = ((0.30, "CRITICO - Mas del 30% en rojo"), (0.15, "ALERTA - Entre 15% y 30% en rojo"), (0.05, "PRECAUCION - Entre 5% y 15% en rojo"))
STABLE = "ESTABLE - Menos del 5% en rojo"


def semaphore(df: DataFrame, as_of: str) -> DataFrame:
    """Days left and light: below 15 red, up to 30 amber, above green."""
    left = F.datediff("fecha_vencimiento", F.lit(as_of).cast("date"))
    light = F.when(F.col("dias_para_vencer") < 15, "Rojo").when(F.col("dias_para_vencer") <= 30, "Amarillo").otherwise("Verde")
    order = F.array_position(F.array(*[F.lit(x) for x in LIGHT_ORDER]), F.col("estado_semaforo")).cast("int") - 1
    return df.withColumn("dias_para_vencer", left).withColumn("estado_semaforo", light).withColumn("orden", order)


def report(df: DataFrame) -> DataFrame:
    return df.withColumn("valor_usd", as_double("valor_usd"))


def alerts(df: DataFrame) -> DataFrame:
    """Obligations exactly 7, 15 or 30 days before expiry with subject and message text; nothing is sent."""
    days = F.col("dias_para_vencer").cast("string")
    amount = F.format_number(F.col("valor_usd"), 2)
    due = F.date_format("fecha_vencimiento", "yyyy-MM-dd")
    subject = F.concat(F.lit("[ALERTA "), days, F.lit("d] Vence '"), F.col("tipo"), F.lit("' — "), F.col("entidad_relacionada"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Para: "), F.col("responsable_interno")),
        F.concat(F.lit("ID de Obligación: "), F.col("id_obligacion")),
        F.concat(F.lit("Tipo: "), F.col("tipo")),
        F.concat(F.lit("Entidad: "), F.col("entidad_relacionada")),
        F.concat(F.lit("Fecha de Vencimiento: "), due),
        F.concat(F.lit("Días Restantes: "), days),
        F.concat(F.lit("Valor en Riesgo: USD "), amount),
    )
    return df.filter(F.col("dias_para_vencer").isin(*ALERT_DAYS)).select(
        "id_obligacion", "tipo", "responsable_interno", "fecha_vencimiento", "dias_para_vencer",
        as_double("valor_usd").alias("valor_usd"), subject.alias("asunto"), shortened(subject, 40, "…").alias("asunto_corto"), body.alias("mensaje"),
    )


def alert_counts(df: DataFrame, mode: str = "dry_run") -> DataFrame:
    """Alerts per threshold and run mode; without sending every alert counts as delivered to the log."""
    return (
        df.filter(F.col("dias_para_vencer").isin(*ALERT_DAYS))
        .groupBy("dias_para_vencer")
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("modo", F.lit(mode))
    )


def by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("tipo", "estado_semaforo").agg(F.count(F.lit(1)).alias("cantidad"))


def next_months(df: DataFrame, days: int = 90) -> DataFrame:
    return (
        df.filter(F.col("dias_para_vencer").between(0, days))
        .groupBy(month_label("fecha_vencimiento").alias("mes"), "estado_semaforo")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_red(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        df.filter("estado_semaforo = 'Rojo'")
        .orderBy(F.desc("valor_usd"), "id_obligacion")
        .limit(n)
        .select("id_obligacion", "tipo", "entidad_relacionada", "dias_para_vencer", as_double("valor_usd").alias("valor_usd"), "responsable_interno")
    )


def cards(df: DataFrame) -> DataFrame:
    """Dashboard cards: lights, value at risk and critical share."""
    red = F.count_if(F.col("estado_semaforo") == "Rojo")
    risk = F.sum(F.when(F.col("estado_semaforo") != "Verde", F.col("valor_usd")))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        red.alias("rojos"),
        F.count_if(F.col("estado_semaforo") == "Amarillo").alias("amarillos"),
        F.count_if(F.col("estado_semaforo") == "Verde").alias("verdes"),
        as_double(risk).alias("valor_riesgo"),
        F.round(red * 100.0 / F.count(F.lit(1)), 1).alias("pct_critico"),
    )


def measures(df: DataFrame, as_of: str) -> DataFrame:
    """All contract measures as one row from one aggregate."""
    d, v = F.col("dias_para_vencer"), F.col("valor_usd")
    today = F.lit(as_of).cast("date")
    week_end = F.date_add(today, 6 - F.weekday(today))
    expiry = F.col("fecha_vencimiento")
    red, amber = d < 15, d.between(15, 30)

    def when_sum(test: Column) -> Column:
        return as_double(F.coalesce(F.sum(F.when(test, v)), F.lit(0).cast("decimal(24,2)")))

    one = df.agg(
        F.count(F.lit(1)).alias("total_contratos"),
        F.count_if(d >= 0).alias("contratos_activos"),
        F.count_if(d < 0).alias("contratos_vencidos"),
        F.count_if(red).alias("contratos_rojo"),
        F.count_if(amber).alias("contratos_amarillo"),
        F.count_if(d > 30).alias("contratos_verde"),
        F.round(F.avg(d), 4).alias("dias_promedio"),
        F.round(F.avg(F.when(d >= 0, d)), 4).alias("dias_promedio_activos"),
        as_double(F.sum(v)).alias("monto_total"),
        when_sum(red).alias("monto_en_riesgo"),
        when_sum(amber).alias("monto_alerta"),
        when_sum(red | amber).alias("monto_rojo_y_amarillo"),
        F.count_if(expiry.between(today, week_end)).alias("vencen_esta_semana"),
        F.count_if(expiry.between(today, F.last_day(today))).alias("vencen_este_mes"),
    )
    share = ratio("contratos_rojo", "total_contratos")
    state = F.lit(STABLE)
    for limit, label in reversed(OVERALL):
        state = F.when(share > limit, label).otherwise(state)
    return one.withColumns(
        {
            "pct_en_riesgo": F.round(ratio(F.col("contratos_rojo") + F.col("contratos_amarillo"), "total_contratos"), 6),
            "estado_general": state,
            "color_general": F.when(share > 0.30, "Rojo").when(share > 0.15, "Amarillo").otherwise("Verde"),
        }
    )


def grouped_measures(df: DataFrame) -> DataFrame:
    """Counts and amounts by type and by owner in one long table."""
    d = F.col("dias_para_vencer")
    pairs = F.array(
        F.struct(F.lit("tipo").alias("dimension"), F.col("tipo").alias("valor")),
        F.struct(F.lit("responsable").alias("dimension"), F.col("responsable_interno").alias("valor")),
    )
    return (
        df.select(F.inline(pairs), "dias_para_vencer", "valor_usd")
        .groupBy("dimension", "valor")
        .agg(
            F.count(F.lit(1)).alias("contratos"),
            F.count_if(d < 15).alias("rojo"),
            F.count_if(d.between(15, 30)).alias("amarillo"),
            F.count_if(d > 30).alias("verde"),
            as_double(F.sum("valor_usd")).alias("monto"),
        )
    )


def by_month(df: DataFrame) -> DataFrame:
    """Expiries per month with running totals of expired contracts; the running window sees one row per month."""
    d = F.col("dias_para_vencer")
    zero = F.lit(0).cast("decimal(24,2)")
    g = df.groupBy(month_label("fecha_vencimiento").alias("mes"), quarter_label("fecha_vencimiento").alias("trimestre")).agg(
        F.count(F.lit(1)).alias("vencimientos"),
        F.sum("valor_usd").alias("_m"),
        F.count_if(d >= 0).alias("futuros"),
        F.count_if(d < 0).alias("_expired"),
        F.sum(F.when(d < 0, F.col("valor_usd")).otherwise(zero)).alias("_amount"),
    )
    run = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(
        "mes", "trimestre", "vencimientos", as_double("_m").alias("monto"), "futuros",
        F.sum("_expired").over(run).alias("acumulado_vencidos"),
        as_double(F.sum("_amount").over(run)).alias("acumulado_monto_vencido"),
    )
