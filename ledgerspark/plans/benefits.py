"""Yearly benefits: thirteenth and fourteenth pay, vacation, profit share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import full_years
from ledgerspark.functions.numbers import as_double, cents, ratio
from ledgerspark.plans.payroll import Rules

COMMERCIAL_YEAR = 360


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def worked_days(start: Column, end: Column) -> Column:
    """Days of the period worked, at most 360; someone hired after its end has none."""
    hired = F.col("fecha_ingreso")
    partial = F.least(F.greatest(F.datediff(end, hired), F.lit(0)), F.lit(COMMERCIAL_YEAR))
    return F.when(hired > start, partial).otherwise(COMMERCIAL_YEAR)


def thirteenth(employees: DataFrame, slips: DataFrame, year: int) -> DataFrame:
    """One twelfth of the income of December to November, drafts left out."""
    period = ((F.col("anio") == year - 1) & (F.col("mes") == 12)) | ((F.col("anio") == year) & (F.col("mes") <= 11))
    paid = slips.filter((F.col("estado") != "Borrador") & period).groupBy("empleado_id").agg(F.sum("total_ingresos").alias("_t"))
    j = employees.join(paid, employees.id == paid.empleado_id, "left").drop("empleado_id")
    total = F.coalesce(as_double("_t"), F.lit(0.0))
    return j.select(
        F.col("id").alias("empleado_id"), F.concat_ws(" ", "apellidos", "nombres").alias("empleado"),
        F.lit(f"Dic {year - 1} - Nov {year}").alias("periodo"), cents(total).alias("total_percibido"),
        worked_days(_day(f"{year - 1}-12-01"), _day(f"{year}-11-30")).alias("dias_trabajados"), cents(total / 12).alias("valor"),
    )


def fourteenth(employees: DataFrame, rules: Rules, year: int) -> DataFrame:
    """Base wage in proportion to the days of the regional period."""
    coast = F.col("region") == "Costa/Galápagos"
    days = F.when(coast, worked_days(_day(f"{year - 1}-03-01"), _day(f"{year}-02-28"))).otherwise(
        worked_days(_day(f"{year - 1}-08-01"), _day(f"{year}-07-31"))
    )
    label = F.when(coast, f"Mar {year - 1} - Feb {year}").otherwise(f"Ago {year - 1} - Jul {year}")
    sbu = F.lit(rules["sbu"])
    return employees.withColumn("dias_trabajados", days).select(
        F.col("id").alias("empleado_id"), F.concat_ws(" ", "apellidos", "nombres").alias("empleado"), "region", label.alias("periodo"),
        sbu.alias("sbu"), "dias_trabajados", cents(sbu * F.col("dias_trabajados") / COMMERCIAL_YEAR).alias("valor"),
    )


def vacation(employees: DataFrame, leave: DataFrame, rules: Rules, as_of: str) -> DataFrame:
    """Entitled, taken and remaining days; the value uses the remainder before it is floored at zero."""
    today = _day(as_of)
    taken = (
        leave.filter((F.col("tipo") == "Vacaciones") & (F.col("estado") == "Aprobado") & (F.col("fecha_inicio") >= F.add_months(today, -12)))
        .groupBy("empleado_id")
        .agg(F.sum("dias").alias("_taken"))
    )
    base, extra_from = int(rules["vacaciones_dias_base"]), int(rules["vacaciones_dia_extra_desde_anio"])
    years = full_years("fecha_ingreso", today)
    extra = F.when(F.col("anios_servicio") >= extra_from, F.least(F.col("anios_servicio") - extra_from + 1, F.lit(15))).otherwise(0)
    j = employees.join(taken, employees.id == taken.empleado_id, "left").drop("empleado_id").withColumn("anios_servicio", years)
    j = j.withColumns({"dias_derecho": extra + base, "dias_tomados": F.coalesce("_taken", F.lit(0))})
    left, daily = F.col("dias_derecho") - F.col("dias_tomados"), as_double("sueldo_base") / 30
    return j.select(
        F.col("id").alias("empleado_id"), F.concat_ws(" ", "apellidos", "nombres").alias("empleado"), "anios_servicio", "dias_derecho",
        "dias_tomados", F.greatest(left, F.lit(0)).alias("dias_disponibles"), cents(daily).alias("valor_diario"), cents(left * daily).alias("valor_total"),
    )


def profit_share(employees: DataFrame, profit: float, year: int) -> DataFrame:
    """Ten percent by days worked and five percent by dependants times days.

    The totals come from an aggregate joined back on the year, not from a window over all employees.
    """
    start, end = _day(f"{year}-01-01"), _day(f"{year}-12-31")
    present = employees.filter((F.col("fecha_ingreso") <= end) & (F.col("fecha_salida").isNull() | (F.col("fecha_salida") >= start)))
    span = F.datediff(F.least(F.coalesce("fecha_salida", end), end), F.greatest("fecha_ingreso", start))
    days = F.least(F.greatest(span, F.lit(0)), F.lit(COMMERCIAL_YEAR))
    d = present.select(
        F.col("id").alias("empleado_id"), F.concat_ws(" ", "apellidos", "nombres").alias("empleado"), F.lit(year).alias("anio"),
        days.alias("dias_trabajados"), F.coalesce("cargas_familiares", F.lit(0)).alias("cargas_familiares"),
    )
    weighted = F.col("cargas_familiares") * F.col("dias_trabajados")
    totals = d.groupBy("anio").agg(F.sum("dias_trabajados").alias("_days"), F.sum(weighted).alias("_loads"))
    ten = F.coalesce(cents(ratio(F.lit(profit * 0.10) * F.col("dias_trabajados"), "_days")), F.lit(0.0))
    five = F.coalesce(cents(ratio(F.lit(profit * 0.05) * weighted, "_loads")), F.lit(0.0))
    out = d.join(totals, "anio").withColumns({"valor_10": ten, "valor_5": five})
    return out.withColumn("total", cents(F.col("valor_10") + F.col("valor_5"))).drop("_days", "_loads")
