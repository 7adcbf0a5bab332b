"""Figures of an entity report: largest entities, latest period, main accounts, history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import shortened
from ledgerspark.functions.numbers import as_double


@dataclass(frozen=True)
class ReportAccounts:
    """Codes that carry total income, total expenses and equity in the statements at hand."""

    income: str = "6999"
    expenses: str = "7992"
    equity: str = "698"

    @property
    def totals(self) -> tuple[str, str, str]:
        return self.income, self.expenses, self.equity


def top_entities(fs: DataFrame, n: int = 10) -> DataFrame:
    """Names with the largest sum of absolute values."""
    g = fs.groupBy("company_name").agg(F.sum(F.abs("value")).alias("_v"))
    return g.orderBy(F.desc("_v"), "company_name").limit(n).select("company_name", as_double("_v").alias("volumen"))


def _of_top(fs: DataFrame, n: int) -> DataFrame:
    return fs.filter("date is not null").join(top_entities(fs, n).select("company_name"), "company_name", "left_semi")


def _at_reference(rows: DataFrame, codes: ReportAccounts) -> DataFrame:
    """Rows of the latest date with an income account, or of the latest date of an entity without one."""
    ref = rows.groupBy("company_name").agg(
        F.coalesce(F.max(F.when(F.col("account_code") == codes.income, F.col("date"))), F.max("date")).alias("periodo_ref")
    )
    return rows.join(ref, "company_name").filter(F.col("date") == F.col("periodo_ref"))


def metrics(fs: DataFrame, codes: ReportAccounts = ReportAccounts(), n: int = 10) -> DataFrame:
    at = _at_reference(_of_top(fs, n), codes)

    def total(code: str):
        return F.coalesce(F.sum(F.when(F.col("account_code") == code, F.col("value"))), F.lit(0).cast("decimal(28,2)"))

    g = at.groupBy("company_name", "periodo_ref").agg(
        F.min("ruc").alias("ruc"), F.min("entity_type").alias("tipo_entidad"),
        total(codes.income).alias("i"), total(codes.expenses).alias("g"), total(codes.equity).alias("p"),
    )
    return g.select(
        F.col("company_name").alias("empresa"), "ruc", "tipo_entidad", "periodo_ref", as_double("i").alias("ingresos"),
        as_double("g").alias("gastos"), as_double(F.col("i") - F.col("g")).alias("resultado"), as_double("p").alias("patrimonio"),
    )


def main_accounts(fs: DataFrame, codes: ReportAccounts = ReportAccounts(), n: int = 10, rows: int = 6) -> DataFrame:
    """The largest other accounts of the reference date."""
    at = _at_reference(_of_top(fs, n), codes).filter(~F.col("account_code").isin(*codes.totals))
    order = Window.partitionBy("company_name").orderBy(F.desc(F.abs("value")), "account_code", "period_type")
    return at.withColumn("orden", F.row_number().over(order)).filter(F.col("orden") <= rows).select(
        F.col("company_name").alias("empresa"), "orden", shortened("account_name", 55, "...").alias("cuenta"), "account_code",
        F.col("date").alias("periodo"), as_double("value").alias("valor"),
    )


def history(fs: DataFrame, codes: ReportAccounts = ReportAccounts(), n: int = 10, periods: int = 8) -> DataFrame:
    """Income, expenses and result of the last dates that have either; the other side counts as 0."""
    rows = _of_top(fs, n).filter(F.col("account_code").isin(codes.income, codes.expenses))
    zero = F.lit(0).cast("decimal(28,2)")

    def side(code: str):
        return F.coalesce(F.sum(F.when(F.col("account_code") == code, F.col("value"))), zero)

    g = rows.groupBy("company_name", "date").agg(side(codes.income).alias("i"), side(codes.expenses).alias("g"))
    order = Window.partitionBy("company_name").orderBy(F.desc("date"))
    return g.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= periods).select(
        F.col("company_name").alias("empresa"), F.col("date").alias("periodo"), as_double("i").alias("ingresos"),
        as_double("g").alias("gastos"), as_double(F.col("i") - F.col("g")).alias("resultado"),
    )
