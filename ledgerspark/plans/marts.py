"""Marts straight on the flat statement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, cents, growth, percent, ratio
from ledgerspark.operators.ladder import with_rank
from ledgerspark.operators.prefix import code_depth, with_leaf_flag
from ledgerspark.plans.star import class_of
from ledgerspark.session import staged

REPORT = ["ruc", "date", "period_type"]
# Spanish class labels of the mart.
CLASS_LABELS = {"1": "Activos", "2": "Pasivos", "3": "Patrimonio", "4": "Ingresos", "5": "Gastos"}


def yearly_summary(fs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        fs.filter("date is not null")
        .groupBy("sector_code", "entity_type", "ruc", "company_name", F.year("date").alias("fiscal_year"), "period_type")
        .agg(
            F.count_distinct("account_code").alias("accounts_reported"),
            as_double(F.sum("value")).alias("total_value"),
            as_double(F.sum(F.greatest("value", zero))).alias("total_positive"),
            as_double(F.sum(F.least("value", zero))).alias("total_negative"),
            as_double(F.min("value")).alias("min_value"),
            as_double(F.max("value")).alias("max_value"),
        )
    )


def assets_vs_liabilities(fs: DataFrame) -> DataFrame:
    """Class totals of a report from its class rows, or from its leaves where it has no class row at all.

    One window finds the leaves and tells whether the report has class rows, so the flat table is shuffled once
    and needs no self join.
    """
    digit = F.left("account_code", F.lit(1))
    rows = fs.filter(F.col("date").isNotNull())
    rows = with_leaf_flag(rows, REPORT).filter(digit.isin(*CLASS_LABELS))
    rows = rows.withColumn("_root", F.length("account_code") == 1)
    has_root = F.max("_root").over(Window.partitionBy(*REPORT))
    rows = rows.withColumn("_has", has_root).filter(F.when(F.col("_has"), F.col("_root")).otherwise(F.col("is_leaf")))
    names = {"1": "total_activos", "2": "total_pasivos", "3": "total_patrimonio", "4": "total_ingresos", "5": "total_gastos"}
    zero = F.lit(0).cast("decimal(18,2)")
    sums = [F.sum(F.when(digit == d, F.col("value")).otherwise(zero)).alias(n) for d, n in names.items()]
    total = rows.groupBy(
        "ruc", "company_name", "entity_type", "entity_subtype", F.year("date").alias("fiscal_year"), "period_type"
    ).agg(*sums)
    return total.select(
        "ruc", "company_name", "entity_type", "entity_subtype", "fiscal_year", "period_type",
        *[as_double(n).alias(n) for n in names.values()],
        as_double(F.col("total_activos") - F.col("total_pasivos")).alias("patrimonio_neto"),
        ratio("total_pasivos", "total_activos", 4).alias("razon_apalancamiento"),
        as_double(F.col("total_ingresos") - F.col("total_gastos")).alias("resultado_neto"),
    )


def account_categories(fs: DataFrame) -> DataFrame:
    parsed = fs.filter("date is not null").select(
        F.year("date").alias("fiscal_year"),
        "period_type", "entity_type", "entity_subtype", "account_code", "account_name", "value",
        class_of("account_code", CLASS_LABELS, "Especiales").alias("account_class"),
        F.substring_index("account_code", ".", 1).alias("root_segment"),
        code_depth().alias("_depth"),
    )
    keys = ["fiscal_year", "period_type", "entity_type", "entity_subtype", "account_class", "root_segment"]
    # one row per account first: a hash aggregate that leaves only chart-sized groups to the ordered first name
    accounts = parsed.groupBy(*keys, "account_code", "account_name", "_depth").agg(
        F.sum("value").alias("_v"), F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    grouped = accounts.groupBy(*keys).agg(
        F.min_by("account_name", F.struct("_depth", "account_code")).alias("root_name"),
        F.count_distinct("account_code").alias("cuentas_distintas"),
        F.sum("_n").alias("filas"),
        F.sum("_v").alias("_total"),
        F.min("_lo").alias("_min"),
        F.max("_hi").alias("_max"),
    )
    whole = F.sum("_total").over(Window.partitionBy("fiscal_year", "period_type", "account_class"))
    return grouped.select(
        "fiscal_year", "period_type", "entity_type", "entity_subtype", "account_class", "root_segment", "root_name",
        "cuentas_distintas", "filas",
        as_double("_total").alias("total_valor"),
        cents(as_double("_total") / F.col("filas")).alias("promedio_valor"),
        as_double("_min").alias("valor_minimo"),
        as_double("_max").alias("valor_maximo"),
        percent("_total", whole).alias("pct_dentro_de_clase"),
    )


def company_ranking(fs: DataFrame) -> DataFrame:
    """Assets per report (account 1, else its asset leaves) with ranks, percentile and change.

    The earlier value follows the order of year and date, because one year may hold several reports.
    """
    rows = fs.filter(F.col("date").isNotNull() & F.col("account_code").startswith("1"))
    rows = with_leaf_flag(rows, REPORT)
    root = F.max(F.when(F.col("account_code") == "1", F.col("value")))
    leaves = F.sum(F.when(F.col("is_leaf"), F.col("value")))
    names = ("company_name", "entity_type", "entity_subtype")
    totals = rows.groupBy(*REPORT).agg(F.coalesce(root, leaves).alias("_a"), *[F.max(n).alias(n) for n in names])
    totals = staged(totals.withColumn("fiscal_year", F.year("date")))
    ranked = with_rank(totals, ["fiscal_year", "period_type"], "_a", "ranking_global", "_pct", ["entity_type"], "ranking_por_sector")
    before = F.lag("_a").over(Window.partitionBy("ruc", "period_type").orderBy("fiscal_year", "date"))
    return ranked.withColumn("_prev", before).select(
        "ruc", "company_name", "entity_type", "entity_subtype", "fiscal_year", "period_type",
        as_double("_a").alias("total_activos"),
        "ranking_global", "ranking_por_sector",
        F.round(F.col("_pct") * 100, 1).alias("percentil"),
        as_double("_prev").alias("activos_anio_anterior"),
        as_double(F.col("_a") - F.col("_prev")).alias("variacion_absoluta"),
        growth("_a", "_prev").alias("variacion_pct_yoy"),
    )
