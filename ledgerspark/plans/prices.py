"""Own prices against a competitor's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import price_clean, stock_label
from ledgerspark.functions.numbers import as_double, bands, ratio

# Alert threshold in percent and monthly units per product.
ALERT_PCT = 3.0
MONTHLY_UNITS = 50


def compare(own: DataFrame, rival: DataFrame) -> DataFrame:
    """Products in both lists with absolute and relative difference on the own price."""
    j = own.select("nombre", "precio_empresa").join(rival.select("nombre", "precio_competidor", "disponibilidad"), "nombre")
    diff = F.col("precio_empresa") - F.col("precio_competidor")
    return j.select(
        "nombre", as_double("precio_empresa").alias("precio_empresa"), as_double("precio_competidor").alias("precio_competidor"),
        "disponibilidad", as_double(diff).alias("diff_absoluta"),
        F.round(F.try_divide(as_double(diff), as_double("precio_empresa")) * 100, 2).alias("diff_porcentual"),
    )


def alerts(compared: DataFrame, limit: float = ALERT_PCT) -> DataFrame:
    """Products dearer by strictly more than the threshold, with the monthly loss and the urgency."""
    p = F.col("diff_porcentual")
    return compared.filter(p > limit).select(
        "*",
        F.round(F.col("diff_absoluta") * MONTHLY_UNITS, 2).alias("perdida_mensual"),
        bands(p, [(10, "Alta"), (3, "Media"), (0, "Baja")], "Sin accion", strict=False).alias("urgencia"),
    )


def _level(critical: Column, labels: tuple[str, str, str]) -> Column:
    return F.when(critical >= 3, labels[0]).when(critical >= 1, labels[1]).otherwise(labels[2])


def alert_impact(alerted: DataFrame) -> DataFrame:
    """Total loss, the product that loses most, and the alert level by the number of gaps of 10 % and more."""
    loss = F.round(F.col("diff_absoluta") * 100).cast("bigint") * MONTHLY_UNITS
    one = alerted.agg(
        F.count(F.lit(1)).alias("alertas"),
        (F.sum(loss) / 100.0).alias("perdida_total"),
        F.max_by("nombre", F.struct("perdida_mensual", "nombre")).alias("mayor_perdida_sku"),
        F.max("perdida_mensual").alias("mayor_perdida_monto"),
        F.count_if(F.col("diff_porcentual") >= 10).alias("criticos"),
    )
    return one.withColumn("nivel_alerta", _level(F.col("criticos"), ("CRÍTICA", "MODERADA", "BAJA"))).withColumn(
        "perdida_promedio", F.round(ratio("perdida_total", "alertas"), 4)
    )


def labelled(compared: DataFrame) -> DataFrame:
    p = F.col("diff_porcentual")
    return compared.withColumns(
        {
            "clasificacion": F.when(p > 1, "Desventaja").when(p < -1, "Ventaja").otherwise("Neutral"),
            "rango_diferencia": bands(
                p,
                [(10, "10%+ (Critico)"), (5, "5% a 9.9%"), (3, "3% a 4.9% (Alerta)"), (0, "0% a 2.9% (Aceptable)"), (-5, "-5% a -0.1% (Ventaja)")],
                "Mas de -5% (Gran Ventaja)",
                strict=False,
            ),
            "urgencia": bands(p, [(10, "Alta"), (3, "Media"), (0, "Baja")], "Sin accion", strict=False),
        }
    )


def measures(compared: DataFrame) -> DataFrame:
    """All price measures as one row; amounts are summed in whole cents."""
    p = F.col("diff_porcentual")

    def whole(c: str) -> Column:
        return F.round(F.col(c) * 100).cast("bigint")

    diff = whole("diff_absoluta")
    n = F.count(F.lit(1))

    def mean(c: str) -> Column:
        return F.round(F.sum(whole(c)) / 100.0 / n, 4)

    one = compared.agg(
        n.alias("total_productos"),
        F.count_if(p > 0).alias("mas_caros"),
        F.count_if(p < 0).alias("mas_baratos"),
        mean("diff_absoluta").alias("diferencia_promedio_usd"),
        mean("diff_porcentual").alias("diferencia_promedio_pct"),
        (F.sum(F.when(p > 0, diff)) * MONTHLY_UNITS / 100.0).alias("impacto_mensual"),
        F.count_if(p > ALERT_PCT).alias("alerta_critica"),
        F.count_if(p <= 0).alias("_cheap"),
        (F.sum(F.when(diff > 0, diff)) * MONTHLY_UNITS / 100.0).alias("ahorro_potencial"),
        mean("precio_empresa").alias("precio_promedio_propio"),
        mean("precio_competidor").alias("precio_promedio_competidor"),
        F.max(p).alias("mayor_diferencia_positiva"),
        F.min(p).alias("mayor_diferencia_negativa"),
        F.min_by("nombre", F.struct(-p, "nombre")).alias("producto_mayor_sobrecoste"),
        F.min_by("nombre", F.struct(p, "nombre")).alias("producto_mayor_ventaja"),
        F.count_if(p >= 10).alias("rango_critico"),
        F.count_if((p >= 3) & (p < 10)).alias("rango_moderado"),
        F.count_if((p >= 0) & (p < 3)).alias("rango_aceptable"),
    )
    share = ratio("_cheap", "total_productos")
    return one.withColumns(
        {
            "con_ventaja": F.col("mas_baratos"),
            "pct_competitividad": F.round(share, 6),
            "semaforo": F.when(share >= 0.70, "Verde").when(share >= 0.50, "Amarillo").otherwise("Rojo"),
            "semaforo_valor": F.when(share >= 0.70, 3).when(share >= 0.50, 2).otherwise(1),
            "nivel_alerta": _level(F.col("rango_critico"), ("CRITICA", "MODERADA", "BAJA")),
        }
    ).drop("_cheap")


# Fixed value: the product card of a listing page with its name, price and stock text.
CARD = r"(?s)<article class=\"product_pod\">(.*?)</article>"
NAME = r"(?s)<h3>.*?<a[^>]*title=\"([^\"]*)\""
PRICE = r"(?s)class=\"price_color\">([^<]*)<"
STOCK = r"(?s)class=\"[^\"]*availability[^\"]*\">(.*?)</p>"


def page_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """Products on listing pages; cards without a name, price or stock text are left out.

    Extraction runs on the executors inside generated code, one row per card.
    """
    cards = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(CARD), F.lit(1))).alias("pos", "card"))
    text = F.regexp_replace(F.regexp_extract("card", STOCK, 1), "<[^>]*>", "")
    return cards.select(
        "page_id",
        "pos",
        F.regexp_extract("card", NAME, 1).alias("nombre"),
        price_clean(F.regexp_extract("card", PRICE, 1)).alias("precio_competidor"),
        stock_label(F.trim(F.regexp_replace(text, r"\s+", " "))).alias("disponibilidad"),
    ).filter("nombre <> '' and precio_competidor is not null and disponibilidad <> ''")
