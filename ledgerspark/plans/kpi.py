"""Financial indicators per company and sector, on annual class totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, bands, flag, growth, percent, ratio
from ledgerspark.operators.ladder import quantiles
from ledgerspark.operators.prefix import with_leaf_flag
from ledgerspark.plans.dashboard import by_year, latest_only, with_assets, with_balance
from ledgerspark.plans.star import Star, annual, money, named
from ledgerspark.session import staged

WHO = ("ruc", "company_name", "sector_name", "fiscal_year")


def leverage(s: Star) -> DataFrame:
    lev = ratio("total_liabilities", "total_assets")
    return with_balance(s).select(
        *WHO,
        *money("total_assets", "total_liabilities", "total_equity"),
        F.round(lev, 4).alias("leverage_ratio"),
        ratio("total_liabilities", "total_equity", 4).alias("debt_to_equity"),
        ratio("total_assets", "total_equity", 4).alias("equity_multiplier"),
        bands(lev, [(0.90, "Critical"), (0.75, "High"), (0.50, "Moderate")], "Healthy").alias("solvency_band"),
    )


def solvency_histogram(s: Star) -> DataFrame:
    lev = ratio("total_liabilities", "total_assets")
    band = bands(
        lev, [(0.90, "4_Critical  (>90%)"), (0.75, "3_High      (75–90%)"), (0.50, "2_Moderate  (50–75%)")], "1_Healthy   (<50%)"
    )
    counted = (
        with_assets(s).filter(lev.isNotNull()).groupBy("fiscal_year", band.alias("solvency_band"))
        .agg(F.count(F.lit(1)).alias("entity_count"))
    )
    whole = F.sum("entity_count").over(Window.partitionBy("fiscal_year"))
    return counted.withColumn("pct_of_total", percent("entity_count", whole, 1))


def liquidity(s: Star) -> DataFrame:
    """Current and cash ratio from the exact group row; where it is missing, from the leaves below it.

    Adding every row whose group is 101 would count group, subgroup and detail together.
    """
    accounts = s.account.select("account_key", "account_code", "group_code", "subgroup_code")
    rows = (
        s.fact.filter("period_type = 'ANUAL'")
        .select("company_key", "date_key", "account_key", "value")
        .join(accounts, "account_key")
        .filter("group_code in ('101', '102', '201', '202')")
    )
    rows = with_leaf_flag(rows, ["company_key", "date_key"])

    def amount(level: str, code: str):
        exact = F.max(F.when(F.col("account_code") == code, F.col("value")))
        below = F.sum(F.when((F.col(level) == code) & F.col("is_leaf"), F.col("value")))
        return F.coalesce(exact, below, F.lit(0).cast("decimal(18,2)"))

    parts = rows.groupBy("company_key", "date_key").agg(
        amount("group_code", "101").alias("current_assets"),
        amount("group_code", "102").alias("noncurrent_assets"),
        amount("group_code", "201").alias("current_liabilities"),
        amount("group_code", "202").alias("noncurrent_liabilities"),
        amount("subgroup_code", "10101").alias("cash_and_equivalents"),
    )
    current = ratio("current_assets", "current_liabilities")
    return named(s, parts.join(s.date.select("date_key", "fiscal_year"), "date_key")).select(
        *WHO,
        *money("current_assets", "noncurrent_assets", "current_liabilities", "noncurrent_liabilities", "cash_and_equivalents"),
        F.round(current, 4).alias("current_ratio"),
        ratio("cash_and_equivalents", "current_liabilities", 4).alias("cash_ratio"),
        F.when(current < 1.0, "Illiquid").when(current < 1.5, "Adequate").otherwise("Strong").alias("liquidity_flag"),
    )


def _net():
    return F.col("total_income") - F.col("total_expenses")


def profitability(s: Star) -> DataFrame:
    """Returns and margins; all classes are summed first, so ROA and ROE are filled."""
    base = annual(s).filter("total_income is not null or total_expenses is not null").withColumn("net_result", _net())
    return base.select(
        *WHO,
        *money("total_assets", "total_income", "total_expenses", "net_result"),
        percent("net_result", "total_assets").alias("roa_pct"),
        percent("net_result", "total_equity").alias("roe_pct"),
        percent("net_result", "total_income").alias("net_margin_pct"),
        percent("total_expenses", "total_income").alias("expense_ratio_pct"),
        F.when(F.col("net_result") > 0, "Profitable")
        .when(F.col("net_result") == 0, "Break-even")
        .otherwise("Loss")
        .alias("profitability_flag"),
    )


def roa_box(s: Star) -> DataFrame:
    """Five-number summary of the return on assets; the quartiles are exact and found without collecting a sector."""
    roa = staged(
        annual(s)
        .select("fiscal_year", "sector_name", F.try_divide(as_double(_net()), as_double("total_assets")).alias("_r"))
        .select("fiscal_year", "sector_name", (F.col("_r") * 100).alias("roa_pct"))
        .filter("roa_pct is not null")
    )
    keys = ["fiscal_year", "sector_name"]
    basic = roa.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entity_count"),
        F.round(F.min("roa_pct"), 2).alias("roa_min"),
        F.round(F.max("roa_pct"), 2).alias("roa_max"),
        F.round(F.avg("roa_pct"), 2).alias("roa_avg"),
    )
    q = quantiles(roa, keys, "roa_pct", {"roa_p25": 0.25, "roa_median": 0.5, "roa_p75": 0.75})
    return basic.join(q, keys).select(
        *keys, "entity_count", "roa_min",
        *[F.round(c, 2).alias(c) for c in ("roa_p25", "roa_median", "roa_p75")],
        "roa_max", "roa_avg",
    )


def turnover(s: Star) -> DataFrame:
    return annual(s).filter("total_income is not null").select(
        *WHO,
        *money("total_income", "total_assets", "total_expenses"),
        ratio("total_income", "total_assets", 4).alias("asset_turnover"),
        percent("total_expenses", "total_income").alias("cost_efficiency_pct"),
        ratio("total_income", "total_equity", 4).alias("income_on_equity"),
    )


def _cagr3(now: str, before: str):
    return F.round((F.pow(ratio(now, before), F.lit(1.0 / 3)) - 1) * 100, 2)


def growth_table(s: Star) -> DataFrame:
    """Year-over-year growth and three-row compound growth of assets; a negative quotient has no real root: null."""
    base = annual(s).withColumn("net_result", _net())
    lags = {f"_{c}": F.lag(c).over(by_year()) for c in ("total_assets", "total_income", "total_equity", "net_result")}
    base = base.withColumns({**lags, "_a3": F.lag("total_assets", 3).over(by_year())})
    return base.select(
        "fiscal_year", "ruc", "company_name", "sector_name",
        *money("total_assets", "total_income", "net_result"),
        growth("total_assets", "_total_assets").alias("asset_growth_pct"),
        growth("total_income", "_total_income").alias("income_growth_pct"),
        growth("total_equity", "_total_equity").alias("equity_growth_pct"),
        as_double(F.col("net_result") - F.col("_net_result")).alias("net_result_change"),
        F.when(ratio("total_assets", "_a3") >= 0, _cagr3("total_assets", "_a3")).alias("asset_cagr_3yr_pct"),
    )


def fastest(s: Star, n: int = 10) -> DataFrame:
    lagged = with_assets(s).withColumn("_a3", F.lag("total_assets", 3).over(by_year()))
    last = latest_only(lagged).filter(F.col("_a3") > 0)
    return (
        last.select(
            *WHO,
            as_double("total_assets").alias("current_assets"),
            as_double("_a3").alias("assets_3yr_ago"),
            F.when(ratio("total_assets", "_a3") >= 0, _cagr3("total_assets", "_a3")).alias("cagr_3yr_pct"),
        )
        .orderBy(F.desc_nulls_last("cagr_3yr_pct"), "ruc")
        .limit(n)
    )


def concentration(s: Star) -> DataFrame:
    """Herfindahl index in one aggregate: sum of squares over the square of the sum."""
    a = as_double("total_assets")
    grouped = (
        with_assets(s)
        .groupBy("fiscal_year", "sector_name")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.sum("total_assets").alias("_total"),
            F.sum(a * a).alias("_squares"),
        )
    )
    total = as_double("_total")
    hhi = F.try_divide(F.col("_squares"), total * total) * 10000
    return grouped.select(
        "fiscal_year", "sector_name", "entities", total.alias("sector_assets"),
        F.round(hhi, 0).alias("hhi"),
        bands(hhi, [(2500, "Highly Concentrated"), (1500, "Moderately Concentrated")], "Competitive").alias("concentration_level"),
    )


def top5_share(s: Star, n: int = 5) -> DataFrame:
    keys = ["sector_name", "fiscal_year"]
    base = with_assets(s)
    top = (
        base.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("total_assets"))))
        .filter(F.col("_r") <= n)
        .groupBy(*keys)
        .agg(F.sum("total_assets").alias("_top"))
    )
    total = base.groupBy(*keys).agg(F.sum("total_assets").alias("_total"))
    return top.join(total, keys).select(
        "fiscal_year", "sector_name", as_double("_top").alias("cr5_assets"), percent("_top", "_total").alias("cr5_pct")
    )


def risk_score(s: Star) -> DataFrame:
    """Five flags and their sum; an unknown flag counts as 0 and is reported in ``unknown_flags``."""
    base = annual(s).withColumn("net_result", _net()).withColumn("_prev", F.lag("total_assets").over(by_year()))
    tests = {
        "flag_high_leverage": ratio("total_liabilities", "total_assets") > 0.90,
        "flag_loss": F.col("net_result") < 0,
        "flag_negative_equity": F.col("total_equity") < 0,
        "flag_cost_overrun": as_double("total_income") < as_double("total_expenses") * 0.80,
        "flag_asset_decline": F.col("_prev").isNotNull() & (F.col("total_assets") < F.col("_prev")),
    }
    out = base.withColumns({name: flag(test) for name, test in tests.items()})
    out = out.withColumn("unknown_flags", sum(test.isNull().cast("int") for test in tests.values()))
    score = sum(F.col(name) for name in tests)
    return out.withColumn("risk_score", score).select(
        "fiscal_year", "ruc", "company_name", "sector_name",
        *money("total_assets", "total_liabilities", "net_result"),
        *tests, "unknown_flags", "risk_score",
        F.when(F.col("risk_score") == 0, "Low")
        .when(F.col("risk_score") == 1, "Watch")
        .when(F.col("risk_score") == 2, "Elevated")
        .otherwise("Critical")
        .alias("risk_level"),
    )
