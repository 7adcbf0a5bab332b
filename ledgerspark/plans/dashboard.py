"""Dashboard queries on annual (and quarterly) class totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, bands, cents, growth, percent, ratio
from ledgerspark.operators.ladder import with_rank
from ledgerspark.plans.star import Star, annual, class_totals, money, named
from ledgerspark.session import staged

def by_year():
    return Window.partitionBy("ruc").orderBy("fiscal_year")


def with_assets(s: Star) -> DataFrame:
    return annual(s).filter("total_assets is not null")


def with_balance(s: Star) -> DataFrame:
    return annual(s).filter("total_assets is not null or total_liabilities is not null")


def latest_only(df: DataFrame) -> DataFrame:
    """Rows of the last fiscal year; the one-row maximum joins on the year."""
    return df.join(df.agg(F.max("fiscal_year").alias("fiscal_year")), "fiscal_year", "left_semi")


def assets_by_year(s: Star) -> DataFrame:
    return (
        with_assets(s)
        .groupBy("fiscal_year", "period_type")
        .agg(
            F.count(F.lit(1)).alias("companies_reporting"),
            as_double(F.sum("total_assets")).alias("total_assets"),
            cents(as_double(F.sum("total_assets")) / F.count(F.lit(1))).alias("avg_assets_per_company"),
            as_double(F.min("total_assets")).alias("min_company_assets"),
            as_double(F.max("total_assets")).alias("max_company_assets"),
        )
    )


def assets_by_sector(s: Star) -> DataFrame:
    grouped = (
        with_assets(s)
        .groupBy("fiscal_year", "sector_name")
        .agg(F.sum("total_assets").alias("_a"), F.count(F.lit(1)).alias("companies_count"))
    )
    whole = F.sum("_a").over(Window.partitionBy("fiscal_year"))
    return grouped.select(
        "fiscal_year", "sector_name", as_double("_a").alias("sector_assets"), "companies_count",
        percent("_a", whole).alias("pct_of_total"),
    )


def assets_by_group(s: Star) -> DataFrame:
    """Exact group rows (code equal to its group code) of the asset class and their share in the class."""
    groups = s.account.filter("account_class = 'Assets' and account_code = group_code").select(
        "account_key", "class_name", "group_code", "group_name"
    )
    grouped = (
        s.fact.filter("period_type = 'ANUAL'")
        .join(groups, "account_key")
        .join(s.date.select("date_key", "fiscal_year"), "date_key")
        .groupBy("fiscal_year", "class_name", "group_code", "group_name")
        .agg(F.sum("value").alias("_v"), F.count_distinct("company_key").alias("companies_count"))
    )
    whole = F.sum("_v").over(Window.partitionBy("fiscal_year", "class_name"))
    return grouped.select(
        "fiscal_year", "class_name", "group_code", "group_name", as_double("_v").alias("group_total"), "companies_count",
        percent("_v", whole).alias("pct_within_class"),
    )


def system_balance(s: Star) -> DataFrame:
    t = (
        class_totals(s, period="ANUAL")
        .filter("total_assets is not null or total_liabilities is not null")
        .groupBy("fiscal_year")
        .agg(*[F.sum(m).alias(m) for m in ("total_assets", "total_liabilities", "total_equity")])
    )
    return t.select(
        "fiscal_year",
        *money("total_assets", "total_liabilities", "total_equity"),
        as_double(F.col("total_assets") - F.col("total_liabilities")).alias("net_worth"),
        ratio("total_liabilities", "total_assets", 4).alias("system_leverage_ratio"),
    )


def sector_solvency(s: Star) -> DataFrame:
    t = (
        with_balance(s)
        .groupBy("fiscal_year", "sector_name")
        .agg(*[F.sum(m).alias(m) for m in ("total_assets", "total_liabilities", "total_equity")])
    )
    lev = ratio("total_liabilities", "total_assets")
    return t.select(
        "fiscal_year", "sector_name",
        *money("total_assets", "total_liabilities", "total_equity"),
        F.round(lev, 4).alias("leverage_ratio"),
        bands(lev, [(0.90, "High Risk"), (0.70, "Moderate")], "Healthy").alias("solvency_flag"),
    )


def company_latest(s: Star) -> DataFrame:
    return latest_only(with_balance(s)).select(
        "ruc", "company_name", "sector_name", "fiscal_year",
        *money("total_assets", "total_liabilities", "total_equity"),
        ratio("total_liabilities", "total_assets", 4).alias("leverage_ratio"),
    )


def leaderboard(s: Star, n: int = 20) -> DataFrame:
    """Largest companies of the last year with share and cumulative share.

    The top ``n`` come from a distributed top-k and the system total from one aggregate, so the running sum only
    sees ``n`` rows; every larger company is among them, which keeps rank and running share exact.
    """
    last = latest_only(with_assets(s))
    total = last.groupBy("fiscal_year").agg(F.sum("total_assets").alias("_total"))
    top = last.orderBy(F.desc("total_assets"), "ruc").limit(n)
    order = Window.orderBy(F.desc("total_assets"), "ruc")
    return top.join(total, "fiscal_year").select(
        F.rank().over(Window.orderBy(F.desc("total_assets"))).alias("rank_global"),
        "ruc", "company_name", "sector_name", "fiscal_year",
        *money("total_assets", "total_liabilities", "total_equity"),
        percent("total_assets", "_total").alias("pct_of_system"),
        percent(F.sum("total_assets").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_total").alias("cumulative_pct"),
    )


def top_in_sector(s: Star, n: int = 5) -> DataFrame:
    """Ties at the limit stay; the rank filter is applied per task before the shuffle."""
    order = Window.partitionBy("sector_name", "fiscal_year").orderBy(F.desc("total_assets"))
    return (
        with_assets(s)
        .withColumn("rank_in_sector", F.rank().over(order))
        .filter(F.col("rank_in_sector") <= n)
        .select("fiscal_year", "sector_name", "rank_in_sector", "ruc", "company_name", *money("total_assets"))
    )


def rank_moves(s: Star, places: int = 10) -> DataFrame:
    """Companies whose rank moved by at least ``places`` against exactly the year before."""
    ranked = staged(with_rank(staged(with_assets(s)), ["fiscal_year"], "total_assets", "rank_curr_year"))
    prev = ranked.select(
        "ruc",
        (F.col("fiscal_year") + 1).alias("fiscal_year"),
        F.col("rank_curr_year").alias("rank_prev_year"),
        F.col("total_assets").alias("prev_total_assets"),
    )
    move = F.col("rank_prev_year") - F.col("rank_curr_year")
    return (
        ranked.join(prev, ["ruc", "fiscal_year"])
        .filter(F.abs(move) >= places)
        .select(
            "fiscal_year", "ruc", "company_name", "sector_name", "rank_prev_year", "rank_curr_year",
            move.alias("rank_change"), *money("total_assets", "prev_total_assets"),
        )
    )


def yoy_company(s: Star) -> DataFrame:
    """Change on the previous reported year and the mean of the last three reported years."""
    prev = F.lag("total_assets").over(by_year())
    last3 = by_year().rowsBetween(-2, 0)
    mean3 = as_double(F.sum("total_assets").over(last3)) / F.count("total_assets").over(last3)
    return (
        with_assets(s)
        .withColumns({"_prev": prev, "_mean": mean3})
        .select(
            "fiscal_year", "ruc", "company_name", "sector_name",
            *money("total_assets"),
            as_double("_prev").alias("prev_year_assets"),
            as_double(F.col("total_assets") - F.col("_prev")).alias("yoy_change"),
            growth("total_assets", "_prev").alias("yoy_growth_pct"),
            cents("_mean").alias("moving_avg_3yr"),
        )
    )


def sector_cagr(s: Star) -> DataFrame:
    """Compound growth between the first and the last reported year of a sector."""
    years = with_assets(s).groupBy("sector_name", "fiscal_year").agg(F.sum("total_assets").alias("_a"))
    ends = years.groupBy("sector_name").agg(
        F.min("fiscal_year").alias("first_year"),
        F.max("fiscal_year").alias("last_year"),
        F.min_by("_a", "fiscal_year").alias("_first"),
        F.max_by("_a", "fiscal_year").alias("_last"),
    )
    span = F.col("last_year") - F.col("first_year")
    rate = F.pow(ratio("_last", "_first"), F.try_divide(F.lit(1.0), span.cast("double")))
    return ends.select(
        "sector_name", "first_year", "last_year", span.alias("years_span"),
        as_double("_first").alias("assets_first_year"), as_double("_last").alias("assets_last_year"),
        F.round((rate - 1) * 100, 2).alias("cagr_pct"),
    )


def quarterly_growth(s: Star) -> DataFrame:
    """Sector assets by quarter against the previous quarter and the same quarter of the year before.

    The earlier quarters are found by their number, so a missing quarter yields null, not a wrong neighbour.
    """
    by_quarter = (
        named(s, class_totals(s, by_date=True, period="TRIMESTRAL").filter("total_assets is not null"), "sector_name")
        .join(s.date.select("date_key", "quarter"), "date_key")
        .groupBy("sector_name", "fiscal_year", "quarter")
        .agg(F.sum("total_assets").alias("_a"))
        .withColumn("_q", F.col("fiscal_year") * 4 + F.col("quarter"))
    )
    w = Window.partitionBy("sector_name").orderBy("_q")

    def back(n: int):
        return F.max("_a").over(w.rangeBetween(-n, -n))

    return by_quarter.withColumns({"_p1": back(1), "_p4": back(4)}).select(
        "sector_name", "fiscal_year", "quarter",
        F.concat(F.col("fiscal_year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string")).alias("period_label"),
        as_double("_a").alias("total_assets"),
        as_double(F.col("_a") - F.col("_p1")).alias("qoq_change"),
        growth("_a", "_p1").alias("qoq_growth_pct"),
        as_double(F.col("_a") - F.col("_p4")).alias("yoy_same_quarter_change"),
    )


def net_result(s: Star) -> DataFrame:
    base = (
        annual(s)
        .filter("total_income is not null or total_expenses is not null")
        .withColumn("_net", F.col("total_income") - F.col("total_expenses"))
        .withColumn("_prev", F.lag("_net").over(by_year()))
    )
    return base.select(
        "fiscal_year", "ruc", "company_name", "sector_name",
        *money("total_income", "total_expenses"),
        as_double("_net").alias("net_result"),
        F.when(F.col("_net") > 0, "Profit").otherwise("Loss").alias("result_flag"),
        as_double(F.col("_net") - F.col("_prev")).alias("net_result_change"),
        growth("_net", "_prev").alias("net_result_growth_pct"),
    )
