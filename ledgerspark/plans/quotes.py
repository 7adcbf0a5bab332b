"""Price quotes of service requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hourly rates in USD, urgency surcharge and margin.
RATES = {"Básico": 50, "Estándar": 80, "Premium": 120}
URGENT_SURCHARGE = "0.20"
MARGIN = "0.30"


def quote(requests: DataFrame) -> DataFrame:
    """Breakdown of every request; an unknown service gives a row with an error instead of a price."""
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair]), F.col("tipo_servicio"))
    base = F.col("tarifa_hora") * F.col("horas")
    surcharge = F.when(F.col("nivel_urgencia") == "Alto", F.col("costo_base") * F.lit(URGENT_SURCHARGE).cast("decimal(3,2)")).otherwise(F.lit(0).cast("decimal(3,2)"))
    priced = requests.withColumn("tarifa_hora", rate.cast("decimal(10,0)")).withColumn("costo_base", base.cast("decimal(12,2)"))
    priced = priced.withColumn("recargo", surcharge.cast("decimal(12,2)")).withColumn("subtotal", F.col("costo_base") + F.col("recargo"))
    priced = priced.withColumn("ganancia", (F.col("subtotal") * F.lit(MARGIN).cast("decimal(3,2)")).cast("decimal(14,4)"))
    final = F.round(F.col("subtotal") + F.col("ganancia"), 2)
    known = F.col("tarifa_hora").isNotNull()

    def shown(c):
        return F.when(known, c.cast("double"))

    return priced.select(
        "id", "tipo_servicio", "horas", "nivel_urgencia", shown(F.col("tarifa_hora")).alias("tarifa_hora"),
        *[shown(F.col(c)).alias(c) for c in ("costo_base", "recargo", "subtotal", "ganancia")],
        shown(final).alias("precio_final"),
        F.when(~known, F.concat(F.lit("Tipo de servicio desconocido: "), "tipo_servicio")).alias("error"),
    )
