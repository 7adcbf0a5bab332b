"""Anomaly rules on the flat statement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import as_double, bands, cents, flag, ratio
from ledgerspark.operators.ladder import quantiles
from ledgerspark.session import staged

COMPANY = ["ruc", "company_name", "entity_type"]
REPORT = [*COMPANY, "date", "period_type"]
CLASSES = ("1", "2", "3", "4", "5")
# Texts of the findings.
NEGATIVE_ASSETS = "Negative total assets"
EXCESS_LIABILITIES = "Liabilities > 120% of assets"
NEGATIVE_EQUITY = "Negative equity"
ZERO_INCOME = "Zero income with real expenses"
ZERO_EXPENSES = "Real income with zero expenses"
ZSCORE = "Z-score outlier"
IQR_SMALL = "IQR outlier — unusually small"
IQR_LARGE = "IQR outlier — unusually large"
SPIKE = "Abnormal spike"
DROP = "Abnormal drop"
SIGN_FLIP = "Sign flip on class account"
GROUP_OVER_CLASS = "Child > parent (group vs class)"
SUBGROUP_OVER_GROUP = "Child > parent (subgroup vs group)"
MISSING_YEAR = "Missing annual report"
SINGLE_YEAR = "Single year only — no trend possible"
ROUND_VALUE = "Suspiciously round value"
CONSTANT_PERIOD = "All accounts share same value"
FUTURE_DATE = "Future report date"
OLD_DATE = "Date before year 2000"
PEER_LEVERAGE = "Leverage far above sector peers"


def _tag(kind: str, severity: str | Column) -> list[Column]:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return [F.lit(kind).alias("anomaly_type"), level.alias("severity")]


def _on(code: str) -> Column:
    return F.when(F.col("account_code") == code, F.col("value"))


def negative_assets(fs: DataFrame) -> DataFrame:
    rows = fs.filter("account_code = '1' and value < 0")
    return rows.select(*REPORT, as_double("value").alias("total_assets"), *_tag(NEGATIVE_ASSETS, "CRITICAL"))


def excess_liabilities(fs: DataFrame, limit: float = 1.20) -> DataFrame:
    b = fs.filter("account_code in ('1', '2')").groupBy(*REPORT).agg(F.sum(_on("1")).alias("a"), F.sum(_on("2")).alias("l"))
    lev = ratio("l", "a")
    return b.filter(lev > limit).select(
        *REPORT, as_double("a").alias("total_assets"), as_double("l").alias("total_liabilities"),
        F.round(lev, 4).alias("leverage_ratio"), *_tag(EXCESS_LIABILITIES, "CRITICAL"),
    )


def negative_equity(fs: DataFrame) -> DataFrame:
    rows = fs.filter("account_code = '3' and value < 0")
    return rows.select(*REPORT, as_double("value").alias("total_equity"), *_tag(NEGATIVE_EQUITY, "HIGH"))


def income_expense_gap(fs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    b = (
        fs.filter("account_code in ('4', '5')")
        .groupBy(*REPORT)
        .agg(F.sum(F.coalesce(_on("4"), zero)).alias("i"), F.sum(F.coalesce(_on("5"), zero)).alias("e"))
        .filter("(i = 0 and e > 0) or (e = 0 and i > 0)")
    )
    kind = F.when(F.col("i") == 0, ZERO_INCOME).otherwise(ZERO_EXPENSES)
    return b.select(
        *REPORT, as_double("i").alias("income"), as_double("e").alias("expenses"),
        kind.alias("anomaly_type"), F.lit("MEDIUM").alias("severity"),
    )


def zscore(fs: DataFrame, peers: int = 5, limit: float = 3.0) -> DataFrame:
    """Values far from the mean of the same account, year and period type.

    The statistics, one row per account and year, are staged: Catalyst then knows their size and broadcasts them
    when they are small, so the statement table is not shuffled by an account that every company reports. Peers
    are counted per code, whatever its name.
    """
    rows = fs.filter("date is not null").withColumn("fiscal_year", F.year("date"))
    keys = ["account_code", "fiscal_year", "period_type"]
    v = as_double("value")
    stats = staged(
        rows.groupBy(*keys)
        .agg(
            (as_double(F.sum("value")) / F.count(F.lit(1))).alias("_m"),
            F.stddev_samp(v).alias("_s"),
            F.count(F.lit(1)).alias("peer_count"),
        )
        .filter(F.col("peer_count") >= peers)
    )
    z = F.round(F.try_divide(v - F.col("_m"), F.col("_s")), 2)
    scored = rows.join(stats, keys).withColumn("z_score", z).filter(F.abs("z_score") > limit)
    return scored.select(
        *REPORT, "account_code", "account_name", v.alias("value"),
        cents("_m").alias("peer_mean"), cents("_s").alias("peer_std"), "z_score", "peer_count",
        *_tag(ZSCORE, bands(F.abs("z_score"), [(5, "CRITICAL"), (4, "HIGH")], "MEDIUM")),
    )


def iqr_outliers(fs: DataFrame, peers: int = 5, reach: float = 3.0) -> DataFrame:
    """Assets outside Q1 - 3 IQR .. Q3 + 3 IQR of sector, year and period type; compared after rounding."""
    rows = fs.filter("account_code = '1' and date is not null").withColumn("fiscal_year", F.year("date"))
    rows = rows.withColumn("total_assets", as_double("value"))
    keys = ["entity_type", "fiscal_year", "period_type"]
    q = quantiles(rows, keys, "total_assets", {"_q1": 0.25, "_q3": 0.75}).filter(F.col("group_rows") >= peers)
    gap = F.col("_q3") - F.col("_q1")
    fences = staged(q.select(
        *keys,
        cents("_q1").alias("q1"),
        cents("_q3").alias("q3"),
        cents(gap).alias("iqr"),
        cents(F.col("_q1") - gap * reach).alias("lower_fence"),
        cents(F.col("_q3") + gap * reach).alias("upper_fence"),
    ))
    small = F.col("total_assets") < F.col("lower_fence")
    large = F.col("total_assets") > F.col("upper_fence")
    return rows.join(fences, keys).filter(small | large).select(
        *REPORT, "total_assets", "q1", "q3", "iqr", "lower_fence", "upper_fence",
        F.when(small, IQR_SMALL).otherwise(IQR_LARGE).alias("anomaly_type"),
        F.lit("HIGH").alias("severity"),
    )


def spikes(fs: DataFrame, times: float = 3.0, critical: float = 5.0) -> DataFrame:
    """Changes larger than three times the sector median of absolute changes."""
    years = (
        fs.filter("account_code = '1' and date is not null")
        .groupBy(*COMPANY, F.year("date").alias("fiscal_year"), "period_type")
        .agg(F.sum("value").alias("_a"))
    )
    w = Window.partitionBy("ruc", "period_type").orderBy("fiscal_year")
    years = staged(
        years.withColumn("_prev", F.lag("_a").over(w))
        .withColumn("_change", as_double(F.col("_a") - F.col("_prev")))
        .withColumn("_size", F.abs("_change"))
        .filter("_change is not null")
    )
    keys = ["entity_type", "fiscal_year", "period_type"]
    median = staged(quantiles(years, keys, "_size", {"_median": 0.5}).drop("group_rows"))
    out = years.join(median, keys).filter(F.col("_size") > F.col("_median") * times)
    return out.select(
        *COMPANY, "fiscal_year", "period_type",
        as_double("_prev").alias("prev_year_assets"), as_double("_a").alias("current_assets"),
        F.col("_change").alias("yoy_change"),
        F.round(F.try_divide(F.col("_change"), as_double("_prev")) * 100, 2).alias("yoy_pct"),
        cents("_median").alias("sector_median_abs_change"),
        F.when(F.col("_change") > 0, SPIKE).otherwise(DROP).alias("anomaly_type"),
        F.when(F.col("_size") > F.col("_median") * critical, "CRITICAL").otherwise("HIGH").alias("severity"),
    )


def sign_flips(fs: DataFrame) -> DataFrame:
    """Class accounts whose sign differs from exactly the year before."""
    years = (
        fs.filter(F.col("account_code").isin(*CLASSES) & F.col("date").isNotNull())
        .groupBy(*COMPANY, "account_code", "account_name", F.year("date").alias("fiscal_year"), "period_type")
        .agg(F.sum("value").alias("_v"))
    )
    keys = ["ruc", "account_code", "period_type", "fiscal_year"]
    prev = years.select(
        "ruc", "account_code", "period_type", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("_v").alias("_p")
    )
    return years.join(prev, keys).filter(F.signum("_v") != F.signum("_p")).select(
        *COMPANY, "account_code", "account_name", "fiscal_year", "period_type",
        as_double("_p").alias("prev_value"), as_double("_v").alias("curr_value"),
        *_tag(SIGN_FLIP, "HIGH"),
    )


def child_over_parent(fs: DataFrame, parent_size: int, child_size: int, kind: str, severity: str) -> DataFrame:
    """Children larger than the account their leading digits name; both sides share the report keys."""
    positive = fs.filter("value > 0 and date is not null")
    child = positive.filter(F.length("account_code") == child_size).withColumn(
        "_parent", F.left("account_code", F.lit(parent_size))
    )
    parent = positive.filter(F.length("account_code") == parent_size).select(
        "ruc", "date", "period_type",
        F.col("account_code").alias("_parent"), F.col("account_name").alias("parent_name"), F.col("value").alias("_pv"),
    )
    return child.join(parent, ["ruc", "date", "period_type", "_parent"]).filter(F.col("value") > F.col("_pv")).select(
        *REPORT,
        F.col("_parent").alias("parent_code"), "parent_name", as_double("_pv").alias("parent_value"),
        F.col("account_code").alias("child_code"), F.col("account_name").alias("child_name"),
        as_double("value").alias("child_value"), as_double(F.col("value") - F.col("_pv")).alias("excess"),
        *_tag(kind, severity),
    )


def group_over_class(fs: DataFrame) -> DataFrame:
    return child_over_parent(fs, 1, 3, GROUP_OVER_CLASS, "HIGH")


def subgroup_over_group(fs: DataFrame) -> DataFrame:
    return child_over_parent(fs, 3, 5, SUBGROUP_OVER_GROUP, "MEDIUM")


def missing_years(fs: DataFrame) -> DataFrame:
    """Years inside a company's span that other companies reported and it did not."""
    names = (
        fs.filter("date is not null and period_type = 'ANUAL'")
        .groupBy("ruc", F.year("date").alias("missing_year"), "company_name", "entity_type")
        .agg(F.max("date").alias("_seen"))
    )
    reported = staged(
        names.groupBy("ruc", "missing_year").agg(
            F.max_by("company_name", "_seen").alias("company_name"), F.max_by("entity_type", "_seen").alias("entity_type")
        )
    )
    span = reported.groupBy("ruc").agg(
        F.max_by("company_name", "missing_year").alias("company_name"),
        F.max_by("entity_type", "missing_year").alias("entity_type"),
        F.sequence(F.min("missing_year"), F.max("missing_year")).alias("_years"),
    )
    expected = span.select(*COMPANY, F.explode("_years").alias("missing_year"))
    known = reported.select("missing_year").distinct()
    return (
        expected.join(known, "missing_year", "left_semi")
        .join(reported, ["ruc", "missing_year"], "left_anti")
        .select(*COMPANY, "missing_year", *_tag(MISSING_YEAR, "HIGH"))
    )


def single_year(fs: DataFrame) -> DataFrame:
    first, last = F.min("date"), F.max("date")
    return (
        fs.filter("date is not null and period_type = 'ANUAL'")
        .groupBy(*COMPANY)
        .agg(first.alias("first_report"), last.alias("last_report"))
        .filter("year(first_report) = year(last_report)")
        .select(
            *COMPANY, F.lit(1).alias("years_reported"), "first_report", "last_report",
            *_tag(SINGLE_YEAR, "LOW"),
        )
    )


def round_values(fs: DataFrame, unit: int = 1_000_000) -> DataFrame:
    v = F.col("value")
    rows = fs.filter((F.length("account_code") >= 3) & (F.abs(v) >= unit) & (v % unit == 0))
    return rows.select(
        *REPORT, "account_code", "account_name", as_double("value").alias("value"), *_tag(ROUND_VALUE, "LOW")
    )


def constant_period(fs: DataFrame, rows: int = 3) -> DataFrame:
    """Reports in which every account has the same value; lowest = highest says it without a distinct count."""
    return (
        fs.groupBy(*REPORT)
        .agg(F.count(F.lit(1)).alias("total_accounts"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        .filter((F.col("total_accounts") >= rows) & (F.col("_lo") == F.col("_hi")))
        .select(*REPORT, "total_accounts", as_double("_lo").alias("repeated_value"), *_tag(CONSTANT_PERIOD, "HIGH"))
    )


def future_dates(fs: DataFrame, as_of: str) -> DataFrame:
    rows = fs.filter(F.col("date") > F.lit(as_of).cast("date"))
    return rows.select(*REPORT, "account_code", as_double("value").alias("value"), *_tag(FUTURE_DATE, "HIGH"))


def old_dates(fs: DataFrame, year: int = 2000) -> DataFrame:
    rows = fs.filter(F.col("date") < F.make_date(F.lit(year), F.lit(1), F.lit(1)))
    return rows.select(*REPORT, "account_code", as_double("value").alias("value"), *_tag(OLD_DATE, "MEDIUM"))


def peer_leverage(fs: DataFrame, peers: int = 3, limit: float = 2.0) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    entity = staged(
        fs.filter("account_code in ('1', '2') and date is not null")
        .groupBy(*COMPANY, F.year("date").alias("fiscal_year"), "period_type")
        .agg(
            ratio(F.sum(F.coalesce(_on("2"), zero)), F.sum(F.coalesce(_on("1"), zero))).alias("_lev"),
        )
        .filter("_lev is not null")
    )
    keys = ["entity_type", "fiscal_year", "period_type"]
    stats = (
        entity.groupBy(*keys)
        .agg(F.avg("_lev").alias("_m"), F.stddev_samp("_lev").alias("_s"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= peers)
    )
    z = F.try_divide(F.col("_lev") - F.col("_m"), F.col("_s"))
    return entity.join(stats, keys).withColumn("_z", z).filter(F.col("_z") > limit).select(
        *COMPANY, "fiscal_year", "period_type",
        F.round("_lev", 4).alias("entity_leverage"),
        F.round("_m", 4).alias("sector_mean_leverage"),
        F.round("_s", 4).alias("sector_std_leverage"),
        F.round("_z", 2).alias("leverage_z_score"),
        *_tag(PEER_LEVERAGE, bands(F.col("_z"), [(4, "CRITICAL")], "HIGH")),
    )


def composite(fs: DataFrame) -> DataFrame:
    """Seven flags per company, year and period type.

    The previous values are taken first and averaged afterwards (a window cannot stand inside an aggregate), the
    income drop compares with the previous income, and unknown flags count as 0 and are reported.
    """
    base = (
        fs.filter(F.col("date").isNotNull() & F.col("account_code").isin(*CLASSES))
        .groupBy(*COMPANY, F.year("date").alias("fiscal_year"), "period_type")
        .agg(*[F.sum(_on(c)).alias(n) for c, n in zip(CLASSES, ("a", "l", "q", "i", "e"))])
    )
    w = Window.partitionBy("ruc", "period_type").orderBy("fiscal_year")
    base = base.withColumns({"pa": F.lag("a").over(w), "pi": F.lag("i").over(w)})
    base = staged(base.withColumn("_move", F.abs(F.col("a") - F.col("pa"))))
    keys = ["entity_type", "fiscal_year", "period_type"]
    usual = base.groupBy(*keys).agg(F.try_divide(as_double(F.sum("_move")), F.count("_move")).alias("_usual"))
    c = F.col
    tests = {
        "flag_negative_assets": c("a") < 0,
        "flag_extreme_leverage": ratio("l", "a") > 1.20,
        "flag_negative_equity": c("q") < 0,
        "flag_zero_income_with_costs": (c("i") == 0) & (c("e") > 0),
        "flag_income_halved": (as_double("i") < as_double("pi") * 0.5) & (c("pi") > 0),
        "flag_abnormal_asset_change": c("pa").isNotNull() & (as_double("_move") > c("_usual") * 3),
        "flag_zero_expenses_with_income": (c("i") > 0) & (c("e") == 0),
    }
    out = base.join(usual, keys)
    out = out.withColumns({n: flag(t) for n, t in tests.items()})
    out = out.withColumn("unknown_flags", sum(t.isNull().cast("int") for t in tests.values()))
    out = out.withColumn("anomaly_score", sum(c(n) for n in tests))
    sums = (("a", "total_assets"), ("l", "total_liabilities"), ("q", "total_equity"), ("i", "total_income"), ("e", "total_expenses"))
    return out.select(
        *COMPANY, "fiscal_year", "period_type",
        *[as_double(src).alias(name) for src, name in sums],
        *tests, "unknown_flags", "anomaly_score",
        F.when(c("anomaly_score") == 0, "Normal")
        .when(c("anomaly_score") == 1, "Watch")
        .when(c("anomaly_score") == 2, "Suspicious")
        .otherwise("Critical")
        .alias("anomaly_level"),
    )
