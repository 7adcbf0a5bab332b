"""Attendance and the monthly payroll as one plan for all employees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import calendar_months
from ledgerspark.functions.numbers import as_double, cents, two_decimals

# Income tax brackets (lower bound, upper bound, tax at the lower bound, percent above it).
TAX_BRACKETS = (
    (0.0, 11902.0, 0.0, 0.0),
    (11902.0, 15159.0, 0.0, 5.0),
    (15159.0, 19682.0, 163.0, 10.0),
    (19682.0, 26031.0, 615.0, 12.0),
    (26031.0, 34255.0, 1377.0, 15.0),
    (34255.0, 45407.0, 2611.0, 20.0),
    (45407.0, 60538.0, 4841.0, 25.0),
    (60538.0, 80717.0, 8624.0, 30.0),
    (80717.0, 107623.0, 14678.0, 35.0),
    (107623.0, 999999999.0, 24095.0, 37.0),
)
# Yearly configuration (key, text value, year).
CONFIG = (
    ("sbu", "470.00", 2026),
    ("aporte_personal_pct", "9.45", 2026),
    ("aporte_patronal_pct", "11.15", 2026),
    ("fondos_reserva_pct", "8.33", 2026),
    ("hora_suplementaria_recargo", "50", 2026),
    ("hora_extraordinaria_recargo", "100", 2026),
    ("vacaciones_dias_base", "15", 2026),
    ("vacaciones_dia_extra_desde_anio", "5", 2026),
)
EXPECTED_START, LUNCH, WORKDAY = 480, 60, 480  # minutes


@dataclass(frozen=True)
class Rules:
    """Numbers of one configuration year; unknown keys are None."""

    values: dict[str, float]
    brackets: tuple = TAX_BRACKETS

    @classmethod
    def of_year(cls, year: int, config=CONFIG) -> "Rules":
        return cls({key: float(text) for key, text, y in config if y == year})

    def __getitem__(self, key: str) -> float | None:
        return self.values.get(key)


def config_lookup(key: str, year: Column, config=CONFIG) -> Column:
    """Numeric setting of a key and year; null when it is not configured."""
    out = F.lit(None).cast("double")
    for k, text, y in config:
        if k == key:
            out = F.when(year == y, F.lit(float(text))).otherwise(out)
    return out


def bracket_value(base: Column, brackets=TAX_BRACKETS) -> Column:
    """Progressive amount of a base. Bounds are closed and touch, so the lowest bracket that holds the base wins;
    a base below or above all brackets gives 0. The table is a parameter, so the lookup is a chain of conditions
    and needs no join."""
    out = None
    for low, high, amount, pct in sorted(brackets):
        value = F.lit(amount) + (base - F.lit(low)) * F.lit(pct) / F.lit(100.0)
        test = base.between(low, high)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(0.0))


def attendance_hours(attendance: DataFrame, holidays: list[str]) -> DataFrame:
    """Normal, supplementary and extraordinary hours and lateness per person and day.

    An hour of lunch is taken off. On weekends and holidays everything is extraordinary; on workdays everything
    above eight hours is supplementary (a clock time never reaches the extraordinary branch after midnight).
    """
    worked = F.greatest(F.lit(0), F.col("salida_min") - F.col("entrada_min") - LUNCH)
    free = (F.weekday("fecha") >= 5) | F.coalesce(F.date_format("fecha", "yyyy-MM-dd").isin(*holidays), F.lit(False))
    normal = F.when(free, 0).otherwise(F.least(worked, F.lit(WORKDAY)))
    extra = F.when(free, 0).otherwise(F.greatest(worked - WORKDAY, F.lit(0)))
    return attendance.select(
        "empleado_id", "fecha",
        cents(normal / F.lit(60.0)).alias("horas_normales"),
        cents(extra / F.lit(60.0)).alias("horas_suplementarias"),
        cents(F.when(free, worked).otherwise(0) / F.lit(60.0)).alias("horas_extraordinarias"),
        F.greatest(F.col("entrada_min") - EXPECTED_START, F.lit(0)).alias("atraso_minutos"),
    )


def income_tax(monthly: Column, rules: Rules) -> Column:
    """Monthly withholding on twelve times the income less twelve times the personal contribution."""
    contribution = cents(monthly * F.lit(rules["aporte_personal_pct"] / 100))
    base = monthly * 12 - contribution * 12
    return F.when(base <= 0, F.lit(0.0)).otherwise(cents(bracket_value(base, rules.brackets) / 12))


def payroll_month(
    employees: DataFrame, hours: DataFrame, loans: DataFrame, drafts: DataFrame, rules: Rules, year: int, month: int
) -> DataFrame:
    """One payslip per active employee of the month.

    Attendance and loans are reduced to one row per employee before the joins, settings and brackets are constants
    of the plan, and every amount is a column; there is no loop over employees. The last active loan of a type
    counts. The reserve fund is taken on total income once thirteen months are completed.
    """
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    month_end = F.last_day(first)
    worked = (
        hours.filter(F.col("fecha").between(first, month_end))
        .groupBy("empleado_id")
        .agg(
            F.sum("horas_suplementarias").alias("_sup"),
            F.sum("horas_extraordinarias").alias("_ext"),
            F.sum("atraso_minutos").alias("_late"),
        )
    )

    def last_loan(kind: str) -> Column:
        return F.max_by("cuota_mensual", F.when(F.col("tipo") == kind, F.col("id")))

    owed = loans.filter("activo").groupBy("empleado_id").agg(
        last_loan("Quirografario").alias("_quiro"), last_loan("Hipotecario").alias("_hipo")
    )
    # drafts of the month only, the latest of each person
    others = [c for c in drafts.columns if c not in ("empleado_id", "anio", "mes", "id")]
    own = drafts.filter((F.col("anio") == year) & (F.col("mes") == month))
    drafts = own.groupBy("empleado_id").agg(F.max_by(F.struct(*others), "id").alias("_draft")).select("empleado_id", "_draft.*")
    zero = F.lit(0.0)

    def amount(name: str) -> Column:
        return F.coalesce(as_double(name), zero)

    e = employees.filter("activo").select("id", "cedula", "sueldo_base", "fecha_ingreso")
    j = (
        e.join(worked, e.id == worked.empleado_id, "left").drop("empleado_id")
        .join(owed, e.id == owed.empleado_id, "left").drop("empleado_id")
        .join(drafts, e.id == drafts.empleado_id, "left").drop("empleado_id")
    )
    wage = as_double("sueldo_base")
    hour = wage / 240
    j = j.withColumns(
        {
            "_supv": amount("_sup") * hour * F.lit(1 + rules["hora_suplementaria_recargo"] / 100),
            "_extv": amount("_ext") * hour * F.lit(1 + rules["hora_extraordinaria_recargo"] / 100),
            "_fine": amount("_late") * (wage / 240 / 60),
        }
    )
    j = j.withColumn(
        "_in", wage + F.col("_supv") + F.col("_extv") + amount("comisiones") + amount("bonos") + amount("otros_ingresos")
    )
    income = F.col("_in")
    j = j.withColumns({"aporte_iess": cents(income * F.lit(rules["aporte_personal_pct"] / 100)), "retencion_ir": income_tax(income, rules)})
    j = j.withColumn(
        "_out",
        F.col("aporte_iess") + F.col("retencion_ir") + F.col("_fine") + amount("_quiro") + amount("_hipo")
        + amount("anticipo_sueldo") + amount("pension_alimenticia") + amount("otras_deducciones"),
    )
    months = calendar_months("fecha_ingreso", month_end)
    return j.select(
        F.col("id").alias("empleado_id"), "cedula", F.lit(f"{year}-{month:02d}").alias("periodo"), F.lit(month).alias("mes"), F.lit(year).alias("anio"),
        wage.alias("sueldo_base"),
        cents("_supv").alias("horas_suplementarias_valor"), cents("_extv").alias("horas_extraordinarias_valor"),
        amount("comisiones").alias("comisiones"), amount("bonos").alias("bonos"), amount("otros_ingresos").alias("otros_ingresos"),
        cents("_in").alias("total_ingresos"), "aporte_iess",
        amount("_quiro").alias("prestamo_quirografario"), amount("_hipo").alias("prestamo_hipotecario"),
        amount("anticipo_sueldo").alias("anticipo_sueldo"), amount("pension_alimenticia").alias("pension_alimenticia"),
        "retencion_ir", cents("_fine").alias("multas"), amount("otras_deducciones").alias("otras_deducciones"),
        cents("_out").alias("total_deducciones"), cents(income - F.col("_out")).alias("neto_a_recibir"),
        cents(income * F.lit(rules["aporte_patronal_pct"] / 100)).alias("aporte_patronal"),
        cents(income / 12).alias("decimo_tercero_prov"),
        F.round(F.lit(rules["sbu"] / 12), 2).alias("decimo_cuarto_prov"),
        F.when(months >= 13, cents(income * F.lit(rules["fondos_reserva_pct"] / 100))).otherwise(zero).alias("fondos_reserva_prov"),
        cents(wage * 15 / 360).alias("vacaciones_prov"),
        F.lit("Calculado").alias("estado"),
    )


def payroll_totals(slips: DataFrame) -> DataFrame:
    """Totals and head count of every month."""
    return slips.groupBy("anio", "mes").agg(
        *[
            cents(F.sum(F.col(src).cast("decimal(18,2)"))).alias(name)
            for src, name in (
                ("total_ingresos", "total_ingresos"), ("total_deducciones", "total_deducciones"),
                ("neto_a_recibir", "total_neto"), ("aporte_patronal", "total_patronal"),
            )
        ],
        F.count(F.lit(1)).alias("num_empleados"),
    )


def hr_dashboard(employees: DataFrame, slips: DataFrame, leave: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Head count, pay of the current month, contracts ending within the span and pending leave, one row."""
    today = F.lit(as_of).cast("date")
    people = employees.filter("activo").agg(
        F.count(F.lit(1)).alias("total_empleados"),
        F.count_if((F.col("tipo_contrato") == "Plazo Fijo") & F.col("fecha_fin_contrato").between(today, F.date_add(today, days))).alias("contratos_por_vencer"),
    )
    pay = slips.filter((F.col("anio") == F.year(today)) & (F.col("mes") == F.month(today))).agg(
        cents(F.sum("total_ingresos")).alias("ingresos"), cents(F.sum("neto_a_recibir")).alias("neto"), cents(F.sum("aporte_patronal")).alias("patronal")
    )
    pending = leave.agg(F.count_if(F.col("estado") == "Pendiente").alias("permisos_pendientes"))
    key = F.lit(1)
    return people.withColumn("_k", key).join(pay.withColumn("_k", key), "_k").join(pending.withColumn("_k", key), "_k").drop("_k")


def social_security_file(slips: DataFrame, employees: DataFrame) -> DataFrame:
    """Eleven text fields per payslip; worked days are always 30."""
    j = slips.join(employees.select(F.col("id").alias("empleado_id"), "cedula", "apellidos", "nombres"), "empleado_id")
    return j.select(
        F.col("cedula").alias("CEDULA"), F.col("apellidos").alias("APELLIDOS"), F.col("nombres").alias("NOMBRES"),
        two_decimals("sueldo_base").alias("SUELDO"), F.lit("30").alias("DIAS_TRABAJADOS"),
        two_decimals("horas_suplementarias_valor").alias("HORAS_SUPL"), two_decimals("horas_extraordinarias_valor").alias("HORAS_EXTR"),
        two_decimals("total_ingresos").alias("TOTAL_INGRESOS"), two_decimals("aporte_iess").alias("APORTE_PERSONAL"),
        two_decimals("aporte_patronal").alias("APORTE_PATRONAL"), two_decimals("fondos_reserva_prov").alias("FONDOS_RESERVA"),
    )


def bank_file(slips: DataFrame, employees: DataFrame) -> DataFrame:
    """Transfer lines of approved payslips."""
    people = employees.select(F.col("id").alias("empleado_id"), "cedula", "apellidos", "nombres", "tipo_cuenta", "cuenta_bancaria")
    j = slips.filter("estado = 'Aprobado'").join(people, "empleado_id")
    return j.select(
        F.when(F.col("tipo_cuenta") == "Ahorros", "AHO").otherwise("CTE").alias("TIPO_CUENTA"),
        F.coalesce("cuenta_bancaria", F.lit("")).alias("NUMERO_CUENTA"),
        F.col("cedula").alias("CEDULA"), F.concat_ws(" ", "apellidos", "nombres").alias("NOMBRES"),
        two_decimals("neto_a_recibir").alias("MONTO"), F.concat(F.lit("NOMINA "), F.col("periodo")).alias("REFERENCIA"),
    )


def hr_list(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Rows of any personnel table with the identity of the employee."""
    who = employees.select(F.col("id").alias("empleado_id"), "cedula", "apellidos", "nombres", "cargo")
    return rows.join(who, "empleado_id")


def latest_per_employee(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows of every employee; tasks keep n per employee before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("empleado_id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("orden", F.row_number().over(w)).filter(F.col("orden") <= n)
