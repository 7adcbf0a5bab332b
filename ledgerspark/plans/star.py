"""Star schema over the statement table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, growth, ratio
from ledgerspark.operators.ladder import with_rank
from ledgerspark.operators.prefix import code_depth, group_code, subgroup_code, with_leaf_flag
from ledgerspark.session import staged, written_once
from ledgerspark.sources.tables import statements

# Class of the first digit of an account code.
CLASS_NAMES = {"1": "Assets", "2": "Liabilities", "3": "Equity", "4": "Income", "5": "Expenses"}
MEASURES = {
    "total_assets": "1",
    "total_liabilities": "2",
    "total_equity": "3",
    "total_income": "4",
    "total_expenses": "5",
}


def class_of(code: str, names: dict[str, str], other: str) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.left(F.col(code), F.lit(1))), F.lit(other))


def dim_date(fs: DataFrame) -> DataFrame:
    """One row per reporting date; weekday is ISO (1 = Monday). The period type stays on the fact."""
    d = F.col("full_date")
    return (
        fs.filter("date is not null")
        .select(F.col("date").alias("full_date"))
        .distinct()
        .select(
            F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
            "full_date",
            F.dayofmonth(d).alias("day_of_month"),
            (F.weekday(d) + 1).alias("day_of_week"),
            F.date_format(d, "EEEE").alias("day_name"),
            F.weekofyear(d).alias("week_of_year"),
            F.month(d).alias("month_num"),
            F.date_format(d, "MMMM").alias("month_name"),
            F.quarter(d).alias("quarter"),
            F.when(F.month(d) <= 6, 1).otherwise(2).alias("semester"),
            F.year(d).alias("fiscal_year"),
            (d == F.last_day(d)).alias("is_month_end"),
            ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        )
    )


def _latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Most recent value of each column per key; equal dates are settled by the larger value.

    The combinations are counted down to their last date first (a hash aggregate on the map side), so choosing the
    latest only sees one row per combination.
    """
    seen = df.filter(F.col(key).isNotNull()).groupBy(key, *columns).agg(
        F.max(F.coalesce("date", F.lit("0001-01-01").cast("date"))).alias("_seen")
    )
    return seen.groupBy(key).agg(*[F.max_by(c, F.struct("_seen", c)).alias(c) for c in columns])


def dim_sector(fs: DataFrame) -> DataFrame:
    """Sectors carry a running number; there are as many rows as sectors, so the global order is cheap."""
    named = _latest(fs, "sector_code", "entity_type")
    key = F.row_number().over(Window.orderBy("sector_code"))
    return named.select(key.alias("sector_key"), "sector_code", F.col("entity_type").alias("sector_name"))


def dim_company(fs: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """Companies keyed by their 13-digit tax number read as a number: unique, stable and free of a global sort."""
    company = _latest(fs, "ruc", "company_name", "sector_code")
    return company.join(dim_sector(fs) if sectors is None else sectors, "sector_code").select(
        F.col("ruc").cast("bigint").alias("company_key"), "ruc", "company_name", "sector_key", "sector_code", "sector_name"
    )


def dim_account(fs: DataFrame) -> DataFrame:
    """Chart of accounts with flattened class, group and subgroup; its size is that of the chart."""
    codes = _latest(fs, "account_code", "account_name")
    flat = with_leaf_flag(codes, [F.left("account_code", F.lit(1))]).select(
        F.row_number().over(Window.orderBy("account_code")).alias("account_key"),
        "account_code",
        "account_name",
        code_depth().alias("account_level"),
        F.left("account_code", F.lit(1)).alias("class_code"),
        group_code().alias("group_code"),
        subgroup_code().alias("subgroup_code"),
        class_of("account_code", CLASS_NAMES, "Other").alias("account_class"),
        "is_leaf",
    )
    for part in ("class", "group", "subgroup"):
        names = codes.select(F.col("account_code").alias(f"{part}_code"), F.col("account_name").alias(f"{part}_name"))
        flat = flat.join(names, f"{part}_code", "left")
    return flat.select(
        "account_key", "account_code", "account_name", "account_level", "class_code", "class_name", "group_code",
        "group_name", "subgroup_code", "subgroup_name", "account_class", "is_leaf",
    )


def fact_financial(fs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fact rows with the semi-additive class measures, which are set on class-level accounts only."""
    value = F.col("value")
    return (
        fs.filter("date is not null")
        .join(accounts.select("account_code", "account_key"), "account_code")
        .select(
            F.md5(F.concat_ws("|", "ruc", "account_code", F.col("date").cast("string"), "period_type")).alias("fact_id"),
            F.col("ruc").cast("bigint").alias("company_key"),
            "account_key",
            F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
            "period_type",
            "value",
            *[F.when(F.col("account_code") == code, value).alias(name) for name, code in MEASURES.items()],
        )
    )


@dataclass(frozen=True)
class Star:
    date: DataFrame
    sector: DataFrame
    company: DataFrame
    account: DataFrame
    fact: DataFrame


def star(spark: SparkSession, sf_dir: str) -> Star:
    """Stored star schema; dimensions and fact are written once and read with pruning afterwards."""
    fs = statements(spark, sf_dir)
    account = written_once(spark, "dim_account", sf_dir, lambda: dim_account(fs))
    sector = written_once(spark, "dim_sector", sf_dir, lambda: dim_sector(fs))
    return Star(
        date=written_once(spark, "dim_date", sf_dir, lambda: dim_date(fs)),
        sector=sector,
        company=written_once(spark, "dim_company", sf_dir, lambda: dim_company(fs, sector)),
        account=account,
        fact=written_once(spark, "fact_financial", sf_dir, lambda: fact_financial(fs, account), ("period_type",)),
    )


def class_totals(s: Star, by_date: bool = False, period: str | None = None) -> DataFrame:
    """Class measures per company, fiscal year (and date) and period type; company names are added later."""
    fact = s.fact if period is None else s.fact.filter(F.col("period_type") == period)
    any_measure = " or ".join(f"{m} is not null" for m in MEASURES)
    keys = ["company_key", "fiscal_year", "period_type"] + (["date_key"] if by_date else [])
    return (
        fact.filter(any_measure)
        .join(s.date.select("date_key", "fiscal_year"), "date_key")
        .groupBy(*keys)
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
    )


def named(s: Star, df: DataFrame, *columns: str) -> DataFrame:
    wanted = columns or ("ruc", "company_name", "sector_name")
    return df.join(s.company.select("company_key", *wanted), "company_key")


def annual(s: Star) -> DataFrame:
    """Annual class totals per company with names: the base of the dashboard and KPI queries."""
    return named(s, class_totals(s, period="ANUAL"))


def money(*names: str) -> list[Column]:
    return [as_double(n).alias(n) for n in names]


def star_join(s: Star) -> DataFrame:
    """Totals over the full fact-to-dimension join."""
    return (
        s.fact.select("company_key", "account_key", "date_key", "period_type", "value")
        .join(s.date.select("date_key", "fiscal_year"), "date_key")
        .join(s.company.select("company_key", "sector_name"), "company_key")
        .join(s.account.select("account_key", "account_class"), "account_key")
        .groupBy("sector_name", "fiscal_year", "period_type", "account_class")
        .agg(as_double(F.sum("value")).alias("total_value"), F.count(F.lit(1)).alias("rows"))
    )


def balance_sheet(s: Star) -> DataFrame:
    """Company balance by year and period type.

    All class rows are summed before the condition on assets or liabilities is applied, so equity, income and
    expenses are filled (a filter on the fact rows would leave them null).
    """
    t = class_totals(s).filter("total_assets is not null or total_liabilities is not null")
    return named(s, t).select(
        "ruc", "company_name", "sector_name", "fiscal_year", "period_type",
        *money(*MEASURES),
        as_double(F.col("total_income") - F.col("total_expenses")).alias("net_result"),
        as_double(F.col("total_assets") - F.col("total_liabilities")).alias("net_worth"),
        ratio("total_liabilities", "total_assets", 4).alias("leverage_ratio"),
    )


def account_drilldown(s: Star) -> DataFrame:
    return (
        s.fact.select("company_key", "account_key", "date_key", "period_type", "value")
        .join(s.date.select("date_key", "fiscal_year"), "date_key")
        .join(s.company.select("company_key", "ruc", "company_name", "sector_name"), "company_key")
        .join(s.account, "account_key")
        .select(
            "ruc", "company_name", "sector_name", "fiscal_year", "period_type", "account_class", "class_code",
            "class_name", "group_code", "group_name", "subgroup_code", "subgroup_name", "account_code", "account_name",
            "account_level", "is_leaf", as_double("value").alias("value"),
        )
    )


def sector_aggregates(s: Star) -> DataFrame:
    """Sector totals with the mean of the company ratios, and the ratio of the totals beside it.

    The number of companies counts those with any account in the period, not only those with a class account.
    """
    reporting = (
        s.fact.select("company_key", "date_key", "period_type")
        .join(s.date.select("date_key", "fiscal_year"), "date_key")
        .groupBy("company_key", "fiscal_year", "period_type")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    t = reporting.join(class_totals(s), ["company_key", "fiscal_year", "period_type"], "left")
    t = named(s, t, "sector_code", "sector_name").withColumn("_lev", ratio("total_liabilities", "total_assets"))
    out = {
        "sector_assets": "total_assets", "sector_liabilities": "total_liabilities", "sector_equity": "total_equity",
        "sector_income": "total_income", "sector_expenses": "total_expenses",
    }
    return (
        t.groupBy("sector_code", "sector_name", "fiscal_year", "period_type")
        .agg(
            F.count(F.lit(1)).alias("companies_count"),
            *[as_double(F.sum(src)).alias(name) for name, src in out.items()],
            F.round(F.avg("_lev"), 6).alias("avg_leverage_ratio"),
        )
        .withColumn("sector_leverage_ratio", ratio("sector_liabilities", "sector_assets", 6))
    )


def company_ranking(s: Star) -> DataFrame:
    """Rank by assets in the year and in the sector, percentile and change on the previous reported year."""
    base = named(
        s,
        class_totals(s).filter("total_assets is not null").select("company_key", "fiscal_year", "period_type", "total_assets"),
    )
    base = staged(base)
    ranked = with_rank(base, ["fiscal_year", "period_type"], "total_assets", "rank_global", "_pct", ["sector_name"], "rank_in_sector")
    before = F.lag("total_assets").over(Window.partitionBy("ruc", "period_type").orderBy("fiscal_year"))
    return ranked.withColumn("_prev", before).select(
        "ruc", "company_name", "sector_name", "fiscal_year", "period_type",
        *money("total_assets"),
        "rank_global", "rank_in_sector",
        F.round(F.col("_pct") * 100, 1).alias("percentile"),
        as_double("_prev").alias("prev_year_assets"),
        growth("total_assets", "_prev").alias("yoy_growth_pct"),
    )


def norm_tables(fs: DataFrame) -> dict[str, DataFrame]:
    """Third-normal-form tables; the parent of an account is its longest existing proper prefix."""
    accounts = dim_account(fs).select("account_code", "account_name", "account_class", "account_level")
    size = F.length("account_code")
    prefixes = accounts.filter(size > 1).select(
        "account_code",
        F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.left(F.col("account_code"), n))).alias("prefix"),
    )
    known = accounts.select(F.col("account_code").alias("prefix"))
    parents = prefixes.join(known, "prefix").groupBy("account_code").agg(F.max_by("prefix", F.length("prefix")).alias("parent_code"))
    dated = fs.filter("date is not null")
    return {
        "sector": dim_sector(fs).select("sector_code", "sector_name"),
        "company": dim_company(fs).select("ruc", "company_name", "sector_code"),
        "account": accounts.join(parents, "account_code", "left"),
        "reporting_period": dated.select("date", "period_type").distinct(),
        "financial_statement": dated.select("ruc", "account_code", "date", "period_type", "value"),
    }
