"""Data-quality checks on the statement table, the raw text form and the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import clean_number
from ledgerspark.functions.numbers import as_double
from ledgerspark.plans import anomaly, marts

# Allowed period types, year range, and accepted share per anomaly level in percent.
PERIOD_TYPES = ("ANUAL", "MENSUAL", "TRIMESTRAL", "SEMESTRAL")
YEAR_RANGE = (2000, 2030)
LEVEL_LIMITS = {"Normal": 90.0, "Watch": 8.0, "Suspicious": 2.0, "Critical": 0.5}


def _metric(df: DataFrame, metric: str, item: Column, n: Column) -> DataFrame:
    return df.groupBy(item.alias("item")).agg(n.alias("n")).select(F.lit(metric).alias("metric"), "item", "n")


def counts(fs: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    return (
        _metric(fs, "rows", F.lit("total"), rows)
        .unionByName(_metric(fs, "rows by period", F.col("period_type"), rows))
        .unionByName(_metric(fs.filter("date is not null"), "rows by year", F.year("date").cast("string"), rows))
        .unionByName(_metric(fs, "companies by sector", F.col("entity_type"), F.count_distinct("ruc")))
    )


def nulls(raw: DataFrame) -> DataFrame:
    """Missing tax numbers, values and codes in one pass, and tax numbers of the wrong length with their frequency."""
    empty = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("ruc", "value", "account_code")}
    one = raw.agg(*[F.count_if(t).alias(c) for c, t in empty.items()])
    missing = one.select(
        F.inline(F.array(*[F.struct(F.lit(f"missing {c}").alias("metric"), F.lit("").alias("item"), F.col(c).alias("n")) for c in empty]))
    )
    wrong = (
        raw.filter(F.length("ruc") != 13)
        .groupBy(F.col("ruc").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("ruc length").alias("metric"), "item", "n")
    )
    return missing.unionByName(wrong)


def dates(raw: DataFrame) -> DataFrame:
    """Date texts that are not yyyy-MM-dd, and years outside the range among those that are."""
    iso = F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    year = F.year(F.try_to_date("date", "yyyy-MM-dd"))
    bad = raw.filter("date is not null").agg(F.count_if(~iso).alias("n"))
    outside = (
        raw.filter(iso & ~year.between(*YEAR_RANGE))
        .groupBy(F.col("date").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("year outside range").alias("metric"), "item", "n")
    )
    return bad.select(F.lit("not ISO").alias("metric"), F.lit("").alias("item"), "n").unionByName(outside)


def codes(fs: DataFrame) -> DataFrame:
    digit = F.left("account_code", F.lit(1))
    outside = fs.filter(~digit.isin("1", "2", "3", "4", "5")).groupBy("account_code", "account_name").agg(F.count(F.lit(1)).alias("n"))
    classes = fs.groupBy(digit.alias("item")).agg(F.count_distinct("account_code").alias("n"))
    return outside.select(
        F.lit("outside 1-5").alias("metric"), F.col("account_code").alias("item"), "account_name", "n"
    ).unionByName(
        classes.select(F.lit("accounts per class").alias("metric"), "item", F.lit(None).cast("string").alias("account_name"), "n")
    )


def hierarchy_top(fs: DataFrame, n: int = 20) -> DataFrame:
    over = anomaly.group_over_class(fs).withColumn("_x", (F.col("excess") * 100).cast("decimal(38,0)"))
    return over.orderBy(F.desc("_x"), "ruc", "date", "child_code", "period_type").limit(n).select(
        "ruc", "company_name", "date", F.col("parent_code").alias("cod_padre"), F.col("parent_value").alias("valor_padre"),
        F.col("child_code").alias("cod_hijo"), F.col("child_value").alias("valor_hijo"), F.col("excess").alias("exceso"),
    )


def duplicates(fs: DataFrame) -> DataFrame:
    keys = ["ruc", "account_code", "date", "period_type"]
    return fs.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def domains(raw: DataFrame) -> DataFrame:
    """Number of rows with an unknown period type and with a value that is missing or not finite."""
    value = clean_number("value")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    known = F.coalesce(F.trim("period_type").isin(*PERIOD_TYPES), F.lit(False))
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~known).alias("unknown_period_type"),
        F.count_if(value.isNull()).alias("value_missing"),
        F.count_if(value.isNotNull() & ~finite).alias("value_not_finite"),
    )


def mart_checks(fs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    summary = marts.yearly_summary(fs).agg(F.count(F.lit(1)).alias("n"))
    balance = marts.assets_vs_liabilities(fs).agg(F.count_if(F.col("total_activos") < 0).alias("n"))
    ranks = (
        marts.company_ranking(fs)
        .filter("period_type = 'ANUAL'")
        .groupBy("fiscal_year")
        .agg(F.min("ranking_global").alias("n"), F.max("ranking_global").alias("max_rank"))
    )

    def line(df: DataFrame, metric: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), none.alias("fiscal_year"), "n", none.cast("bigint").alias("max_rank"))

    return (
        line(summary, "mart_yearly_summary rows")
        .unionByName(line(balance, "negative assets"))
        .unionByName(ranks.select(F.lit("rank range").alias("metric"), "fiscal_year", "n", "max_rank"))
    )


def anomaly_levels(fs: DataFrame) -> DataFrame:
    """Share of every level against its accepted share; Normal is a floor, the others are ceilings."""
    n = anomaly.composite(fs).groupBy("anomaly_level").agg(F.count(F.lit(1)).alias("entities"))
    share = as_double("entities") * 100 / F.sum("entities").over(Window.partitionBy())
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_LIMITS.items() for x in pair]), F.col("anomaly_level"))
    return n.withColumns({"_share": share, "limit_pct": limit}).select(
        "anomaly_level", "entities", F.round("_share", 2).alias("pct"), "limit_pct",
        F.when(F.col("anomaly_level") == "Normal", F.col("_share") > F.col("limit_pct"))
        .otherwise(F.col("_share") < F.col("limit_pct"))
        .alias("acceptable"),
    )


def critical_entities(fs: DataFrame) -> DataFrame:
    return anomaly.composite(fs).filter("anomaly_level in ('Critical', 'Suspicious')").select(
        "ruc", "company_name", "entity_type", "fiscal_year", "period_type", "anomaly_score", "anomaly_level"
    )
