"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
``--all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_statements", "load_last_wins", "run_metrics", "star_join", "v_balance_sheet", "v_company_ranking",
    "mart_yearly_summary", "mart_assets_vs_liabilities", "mart_account_categories", "mart_company_ranking",
    "a2_assets_sector", "c1_leaderboard", "c3_rank_moves", "d1_yoy_company", "k1a_leverage", "k2a_liquidity", "k3b_roa_box",
    "k6a_hhi", "k7a_risk_score", "n2a_zscore", "n2b_iqr", "n3a_spikes", "n4a_group_gt_class", "n8_composite", "aging_buckets",
    "bi_aging", "bi_contracts", "bi_prices", "tax_cross", "purchase_validation", "payroll_month", "profit_share", "eval_report",
    "document_mapping", "bank_reconcile", "entity_report_metrics", "bi_sales", "bi_sales_rank", "knn_topk", "rag_chunks",
    "stream_day_total",
)


def main() -> None:
    from ledgerspark.plans.star import star
    from ledgerspark.registry import QUERIES
    from ledgerspark.session import build_session, release
    from ledgerspark.sources.adapters import TABLES, load
    from ledgerspark.sources.tables import statements

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    times = {"etl_statements": timed(lambda: statements(spark, folder).count()), "etl_star": timed(lambda: star(spark, folder))}
    times["etl_domain_tables"] = timed(lambda: [load(spark, folder, name) for name in TABLES])
    for name in names:
        times[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    release(spark)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
