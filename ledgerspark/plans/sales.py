"""Sales measures of a day, and the calendar they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import cents, ratio
from ledgerspark.operators.ladder import ladder, null_safe_join
from ledgerspark.session import staged

# Sales targets in USD.
DAILY_TARGET = 8500.0
MONTHLY_TARGET = 220000.0


def week_number(d: Column) -> Column:
    """Week of the year with weeks from Sunday; the week of January 1st is the first."""
    return F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7).cast("int") + 1


def calendar(dates: DataFrame, column: str, as_of: str) -> DataFrame:
    """Every day between the first and the last date."""
    today = F.lit(as_of).cast("date")
    d = F.col("fecha")
    days = dates.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(F.explode(F.sequence("a", "b")).alias("fecha"))
    return days.select(
        "fecha", F.year(d).alias("anio"), F.month(d).alias("mes"), F.date_format(d, "MMMM").alias("mes_nombre"), week_number(d).alias("semana"),
        F.date_format(d, "EEEE").alias("dia_semana"), (F.weekday(d) + 1).alias("dia_semana_num"), (d == today).alias("es_hoy"),
        ((week_number(d) == week_number(today)) & (F.year(d) == F.year(today))).alias("es_esta_semana"),
    )


def measures(sales: DataFrame, as_of: str) -> DataFrame:
    """Totals, targets, invoices and ticket of a day as one row.

    Invoices are counted distinct for the day only, so no other day takes part in that shuffle.
    """
    today = F.lit(as_of).cast("date")
    d, v = F.col("fecha"), F.col("total")

    def total(test: Column) -> Column:
        return cents(F.coalesce(F.sum(F.when(test, v)), F.lit(0).cast("decimal(34,6)")))

    one = sales.agg(
        cents(F.sum(v)).alias("venta_total"),
        total(d == today).alias("ventas_hoy"),
        total((week_number(d) == week_number(today)) & (F.year(d) == F.year(today))).alias("ventas_semana"),
        total(F.trunc(d, "month") == F.trunc(today, "month")).alias("ventas_mes"),
        total(d == F.date_sub(today, 1)).alias("ventas_ayer"),
    )
    invoices = sales.filter(d == today).agg(F.count_distinct("factura_id").alias("facturas_hoy"))
    j = one.withColumn("_k", F.lit(1)).join(invoices.withColumn("_k", F.lit(1)), "_k").drop("_k")
    zero = F.lit(0.0)
    return j.withColumns(
        {
            "meta_diaria": F.lit(DAILY_TARGET),
            "pct_avance_diario": F.round(F.col("ventas_hoy") / DAILY_TARGET, 6),
            "meta_mensual": F.lit(MONTHLY_TARGET),
            "pct_avance_mensual": F.round(F.col("ventas_mes") / MONTHLY_TARGET, 6),
            "ticket_promedio": F.coalesce(cents(ratio("ventas_hoy", "facturas_hoy")), zero),
            "variacion_ayer": F.coalesce(F.round(ratio(F.col("ventas_hoy") - F.col("ventas_ayer"), "ventas_ayer"), 6), zero),
        }
    )


def seller_rank(sales: DataFrame, as_of: str) -> DataFrame:
    """Dense rank of all sellers by their sales of the day; a seller without sales counts as 0.

    The dense rank is the number of larger distinct totals plus one, taken from the value buckets, so the sellers
    are not sorted in one task.
    """
    today = F.lit(as_of).cast("date")
    none = F.lit(0).cast("decimal(34,6)")
    day = sales.groupBy("vendedor_id").agg(F.coalesce(F.sum(F.when(F.col("fecha") == today, F.col("total"))), none).alias("_v"))
    day = staged(day)
    steps = ladder(day.select("_v").distinct(), [], "_v")
    ranked = null_safe_join(day, steps.select("_v", (F.col("total") - F.col("below")).alias("ranking")), [], ["_v"])
    return ranked.select("vendedor_id", cents("_v").alias("ventas_hoy"), "ranking")


def products(sales: DataFrame, parts: DataFrame, n: int = 5) -> DataFrame:
    """Best and worst products; sums come first and only the chosen products meet the product table."""
    g = staged(sales.groupBy("producto_id").agg(F.sum("total").alias("_v")))
    best = g.orderBy(F.desc("_v"), "producto_id").limit(n).withColumn("grupo", F.lit("top"))
    worst = g.orderBy("_v", "producto_id").limit(n).withColumn("grupo", F.lit("bottom"))
    names = parts.select(F.col("p_partkey").alias("producto_id"), F.col("p_name").alias("producto"))
    return best.unionByName(worst).join(names, "producto_id").select("grupo", "producto_id", "producto", cents("_v").alias("total"))


def by_category(sales: DataFrame, parts: DataFrame) -> DataFrame:
    g = sales.groupBy("producto_id").agg(F.sum("total").alias("_v"))
    j = g.join(parts.select(F.col("p_partkey").alias("producto_id"), F.col("p_type").alias("categoria")), "producto_id")
    return j.groupBy("categoria").agg(cents(F.sum("_v")).alias("total"))


def by_zone(sales: DataFrame, sellers: DataFrame) -> DataFrame:
    """Sales and lines per zone of the seller; lines are summed per seller before the join."""
    g = sales.groupBy("vendedor_id").agg(F.sum("total").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return g.join(sellers, "vendedor_id").groupBy("zona").agg(cents(F.sum("_v")).alias("total"), F.sum("_n").alias("lineas"))


def trend(sales: DataFrame) -> DataFrame:
    g = sales.groupBy("fecha").agg(F.sum("total").alias("_v"))
    return g.select("fecha", cents("_v").alias("total"), F.lit(DAILY_TARGET).alias("meta"))
