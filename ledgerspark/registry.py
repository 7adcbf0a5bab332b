"""Registered queries: name -> callable(spark, folder of the given tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning
from ledgerspark.functions.numbers import as_double
from ledgerspark.operators.keyed import keep_one, merge_batches
from ledgerspark.operators.prefix import code_depth, code_depth_label, with_leaf_flag
from ledgerspark.plans import (
    anomaly,
    benefits,
    contracts,
    dashboard,
    entity_report,
    evaluation,
    ingest,
    kpi,
    mapping,
    marts,
    payroll,
    prices,
    quotes,
    receivables,
    reconcile,
    retrieval,
    sales,
    tax,
    validation,
)
from ledgerspark.plans import star as st
from ledgerspark.session import app_folder, staged, text_once
from ledgerspark.sources.adapters import AS_OF, PAY_MONTH, PAY_YEAR, load
from ledgerspark.sources import files
from ledgerspark.sources.files import STATEMENT_COLUMNS, read_statements
from ledgerspark.sources.tables import statements, table
from ledgerspark.streaming import sales as live

Query = Callable[[SparkSession, str], DataFrame]


def _on_statements(fn, *args) -> Query:
    return lambda spark, sf: fn(statements(spark, sf), *args)


def _on_star(fn, *args) -> Query:
    return lambda spark, sf: fn(st.star(spark, sf), *args)


def _leaf_accounts(fs: DataFrame) -> DataFrame:
    keys = ["ruc", "date", "period_type"]
    rows = with_leaf_flag(fs.filter("date is not null"), keys)
    return rows.filter("is_leaf").select(*keys, "account_code", as_double("value").alias("value"))


def _norm_counts(fs: DataFrame) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in st.norm_tables(fs).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    fs = statements(spark, sf)
    fact = st.fact_financial(fs, staged(st.dim_account(fs)))  # of known size, so the fact rows are not shuffled by account
    amounts = ("value", *st.MEASURES)
    return fact.select(*[c for c in fact.columns if c not in amounts], *st.money(*amounts))


FINANCE: dict[str, Query] = {
    "dim_date": _on_statements(st.dim_date),
    "dim_sector": _on_statements(st.dim_sector),
    "dim_company": _on_statements(st.dim_company),
    "dim_account": _on_statements(st.dim_account),
    "fact_financial": _fact,
    "star_join": _on_star(st.star_join),
    "norm_tables": _on_statements(_norm_counts),
    "norm_account": _on_statements(lambda fs: st.norm_tables(fs)["account"]),
    "leaf_accounts": _on_statements(_leaf_accounts),
    "v_balance_sheet": _on_star(st.balance_sheet),
    "v_account_drilldown": _on_star(st.account_drilldown),
    "v_sector_aggregates": _on_star(st.sector_aggregates),
    "v_company_ranking": _on_star(st.company_ranking),
    "mart_yearly_summary": _on_statements(marts.yearly_summary),
    "mart_assets_vs_liabilities": _on_statements(marts.assets_vs_liabilities),
    "mart_account_categories": _on_statements(marts.account_categories),
    "mart_company_ranking": _on_statements(marts.company_ranking),
    "a1_assets_year": _on_star(dashboard.assets_by_year),
    "a2_assets_sector": _on_star(dashboard.assets_by_sector),
    "a3_assets_group": _on_star(dashboard.assets_by_group),
    "b1_system_balance": _on_star(dashboard.system_balance),
    "b2_sector_solvency": _on_star(dashboard.sector_solvency),
    "b3_company_latest": _on_star(dashboard.company_latest),
    "c1_leaderboard": _on_star(dashboard.leaderboard),
    "c2_top5_sector": _on_star(dashboard.top_in_sector),
    "c3_rank_moves": _on_star(dashboard.rank_moves),
    "d1_yoy_company": _on_star(dashboard.yoy_company),
    "d2_sector_cagr": _on_star(dashboard.sector_cagr),
    "d3_quarterly": _on_star(dashboard.quarterly_growth),
    "d4_net_result": _on_star(dashboard.net_result),
    "k1a_leverage": _on_star(kpi.leverage),
    "k1b_solvency_hist": _on_star(kpi.solvency_histogram),
    "k2a_liquidity": _on_star(kpi.liquidity),
    "k3a_profitability": _on_star(kpi.profitability),
    "k3b_roa_box": _on_star(kpi.roa_box),
    "k4a_turnover": _on_star(kpi.turnover),
    "k5a_growth": _on_star(kpi.growth_table),
    "k5b_fastest": _on_star(kpi.fastest),
    "k6a_hhi": _on_star(kpi.concentration),
    "k6b_cr5": _on_star(kpi.top5_share),
    "k7a_risk_score": _on_star(kpi.risk_score),
    "n1a_negative_assets": _on_statements(anomaly.negative_assets),
    "n1b_excess_liabilities": _on_statements(anomaly.excess_liabilities),
    "n1c_negative_equity": _on_statements(anomaly.negative_equity),
    "n1d_income_expense_gap": _on_statements(anomaly.income_expense_gap),
    "n2a_zscore": _on_statements(anomaly.zscore),
    "n2b_iqr": _on_statements(anomaly.iqr_outliers),
    "n3a_spikes": _on_statements(anomaly.spikes),
    "n3b_sign_flip": _on_statements(anomaly.sign_flips),
    "n4a_group_gt_class": _on_statements(anomaly.group_over_class),
    "n4b_subgroup_gt_group": _on_statements(anomaly.subgroup_over_group),
    "n5a_missing_years": _on_statements(anomaly.missing_years),
    "n5b_single_year": _on_statements(anomaly.single_year),
    "n6a_round_values": _on_statements(anomaly.round_values),
    "n6b_constant_period": _on_statements(anomaly.constant_period),
    "n6c_future_dates": _on_statements(anomaly.future_dates, "2000-06-30"),
    "n6d_old_dates": _on_statements(anomaly.old_dates),
    "n7a_peer_leverage": _on_statements(anomaly.peer_leverage),
    "n8_composite": _on_statements(anomaly.composite),
    "q_counts": _on_statements(validation.counts),
    "q_codes": _on_statements(validation.codes),
    "q_hierarchy_top": _on_statements(validation.hierarchy_top),
    "q_duplicates": _on_statements(validation.duplicates),
    "q_anomaly_levels": _on_statements(validation.anomaly_levels),
    "q_critical_entities": _on_statements(validation.critical_entities),
    "q_mart_checks": _on_statements(validation.mart_checks),
}

RAW_ORDER = ["line_no", "part_no"]


def _raw_files(spark: SparkSession, sf: str) -> str:
    """Tab-separated statement files written from the raw rows, as a user would receive them."""
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in STATEMENT_COLUMNS)).alias("value")
    return text_once(spark, "raw_statement_files", sf, lambda: load(spark, sf, "raw_statements").select(line))


def _read_statements(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_statements(spark, _raw_files(spark, sf))
    return rows.groupBy(*STATEMENT_COLUMNS).agg(F.count(F.lit(1)).alias("copies"))


def _on(fn, *names: str, **params) -> Query:
    """Query on adapter tables, in the order of the function's arguments."""
    return lambda spark, sf: fn(*[load(spark, sf, n) for n in names], **params)


def _clean(raw: DataFrame, keep: str, sector_text: str | None = None) -> DataFrame:
    return ingest.clean_statements(raw, RAW_ORDER, keep, sector_text).select(*STATEMENT_COLUMNS)


def _keyed_load(raw: DataFrame, wins: str) -> DataFrame:
    """Two loads merged by key in one aggregate; batch and line decide which row stays."""
    first, second = (_usable(raw.filter(F.col("batch_seq") == b)) for b in (1, 2))
    return merge_batches(first, second, ingest.KEY, ["batch_seq", *RAW_ORDER], wins).select(*STATEMENT_COLUMNS, "batch_seq")


def _table_load(wins: str) -> Query:
    """Two loads into a keyed table, of which the second reads only files that may hold its keys."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        table_ = live.statement_table(spark, _folder(spark, "table"))
        for batch in (1, 2):
            rows = _usable(load(spark, sf, "raw_statements").filter(F.col("batch_seq") == batch))
            one = keep_one(rows, ingest.KEY, RAW_ORDER, wins)
            table_.upsert(one.select(*STATEMENT_COLUMNS, "batch_seq"), batch, wins)
        return table_.read()

    return run


def _distinct_counts(raw: DataFrame, column: str, clean) -> DataFrame:
    counted = raw.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col(column).alias(f"raw_{column}"), clean(column).alias(column), "n")


def _usable(raw: DataFrame) -> DataFrame:
    good = ingest.cleaned(raw)
    return good.filter(ingest.usable(good))


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    known = load(spark, sf, "empleados").filter("not activo")
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("grupo_id"))
    return ingest.roster_import(load(spark, sf, "nomina_csv"), known, groups, default_group=24)


def _visibility(spark: SparkSession, sf: str) -> DataFrame:
    assigned = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("usuario"), F.col("s_nationkey").alias("grupo_id"))
    people = load(spark, sf, "empleados").select("id", "cedula", "grupo_id")
    seen = [ingest.visible_rows(people, assigned, user, boss).withColumn("usuario", F.lit(user).cast("long")) for user, boss in ((1, False), (-1, False), (0, True))]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


def _account_depth(raw: DataFrame) -> DataFrame:
    codes = raw.filter("account_code <> ''").select("account_code").distinct()
    return codes.select(
        "account_code", code_depth().alias("depth"), code_depth_label().alias("label"),
        F.substring_index("account_code", ".", 1).alias("root_segment"),
    )


def _service_span(people: DataFrame, as_of: str) -> DataFrame:
    ref = F.lit(as_of).cast("date")
    return people.select(
        "id", "fecha_ingreso", cleaning.full_years("fecha_ingreso", ref).alias("anios"),
        cleaning.calendar_months("fecha_ingreso", ref).alias("meses"), cleaning.days_apart("fecha_ingreso", ref).alias("dias"),
    )


def _file_keys(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit(" & Cía."))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), cleaning.file_key(name).alias("clave"))


def _notices(people: DataFrame) -> DataFrame:
    values = {"nombre": F.concat_ws(" ", "nombres", "apellidos"), "mes": F.lit("enero 2024"), "empresa": F.lit("Empresa Demo")}
    return people.select(
        "id",
        cleaning.fill_template("Nómina – [mes] | [empresa]", values).alias("asunto"),
        cleaning.fill_template("Estimado/a [nombre], adjuntamos tu documento del período [mes]. [empresa]", values).alias("cuerpo"),
    )


def _aging(fn, **params) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        aged = receivables.aging(load(spark, sf, "facturas"), load(spark, sf, "clientes"), AS_OF)
        return fn(aged, **params)

    return run


def _aging_join(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    joined = invoices.join(customers, "id_cliente", "left")
    return joined.select(
        "id_factura", "id_cliente", "nombre_comercial", "segmento", as_double("limite_credito").alias("limite_credito"),
        as_double("saldo_pendiente").alias("saldo_pendiente"),
    )


def _contracts(fn, **params) -> Query:
    return lambda spark, sf: fn(contracts.semaphore(load(spark, sf, "obligaciones"), AS_OF), **params)


def _prices(*steps) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = prices.compare(load(spark, sf, "precios_propios"), load(spark, sf, "precios_competidor"))
        for step in steps:
            df = step(df)
        return df

    return run


def _cross(*steps) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = tax.tax_cross(load(spark, sf, "comprobantes"), load(spark, sf, "retenciones"))
        for step in steps:
            df = step(df)
        return df

    return run


def _valid_purchases(df: DataFrame) -> DataFrame:
    return tax.validate(df).filter("valido")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{app_folder(spark)}/files/{name}-{uuid.uuid4().hex[:8]}"


def _mixed_folder(spark: SparkSession, sf: str) -> str:
    """Statement files of two separators below one folder: first loads by tab, second loads by semicolon."""
    folder = _folder(spark, "mixed")
    for batch, mark in ((1, "\t"), (2, ";")):
        rows = load(spark, sf, "raw_statements").filter(F.col("batch_seq") == batch)
        rows.select(F.concat_ws(mark, *(F.coalesce(c, F.lit("")) for c in STATEMENT_COLUMNS)).alias("value")).write.text(f"{folder}/{batch}")
    return f"{folder}/*"


def _read_mixed(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_mixed_statements(spark, _mixed_folder(spark, sf))
    return rows.groupBy(*STATEMENT_COLUMNS).agg(F.count(F.lit(1)).alias("copies"))


def _file_profile(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_profile(spark, _mixed_folder(spark, sf)).select("encoding", "separator", "fields").distinct()


def _read_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "csv")
    files.export_csv(load(spark, sf, "facturas").select("id_factura", "id_cliente", "fecha_emision", "estado"), folder)
    return files.read_table(spark, folder, dates=("fecha_emision",))


def _read_portal(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "portal")
    rows = load(spark, sf, "comprobantes").select(F.col("ruc_emisor").alias(" ruc emisor"), "clave_acceso", "importe_total")
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).csv(folder)
    return files.read_portal_table(spark, folder)


def _read_entities(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "parquet")
    files.export_parquet(load(spark, sf, "raw_statements").select("entity_type", "company_name", "line_no", "part_no"), folder)
    return files.read_entities(spark, folder, ["Casa de Valores "])


JOBS: dict[str, Query] = {
    "read_statements": _read_statements,
    "read_mixed_statements": _read_mixed,
    "file_profile": _file_profile,
    "read_table": _read_table,
    "read_portal_table": _read_portal,
    "read_entities": _read_entities,
    "clean_number": _on(lambda raw: _distinct_counts(raw, "value", cleaning.clean_number), "raw_statements"),
    "clean_date": _on(lambda raw: _distinct_counts(raw, "date", cleaning.clean_date), "raw_statements"),
    "clean_statements": _on(lambda raw: _clean(raw, "first"), "raw_statements"),
    "dedup_key": _on(lambda raw: _clean(raw, "last"), "raw_statements"),
    "sector_filter": _on(lambda raw: _clean(raw, "last", "administradora de fondos y fideicomisos"), "raw_statements"),
    "load_first_wins": _on(lambda raw: _keyed_load(raw, "first"), "raw_statements"),
    "load_last_wins": _on(lambda raw: _keyed_load(raw, "last"), "raw_statements"),
    "table_first_wins": _table_load("first"),
    "table_last_wins": _table_load("last"),
    "high_water_mark": _on(lambda raw: ingest.high_water_mark(_usable(raw)), "raw_statements"),
    "run_metrics": _on(ingest.run_metrics, "raw_statements"),
    "q_nulls": _on(validation.nulls, "raw_statements"),
    "q_dates": _on(validation.dates, "raw_statements"),
    "q_domains": _on(validation.domains, "raw_statements"),
    "roster_import": _roster,
    "row_visibility": _visibility,
    "text_search": _on(
        lambda p: ingest.search(p, "mach", ["cedula", "apellidos", "nombres"]).select("id", "cedula", "apellidos", "nombres"), "empleados"
    ),
    "email_valid": _on(lambda p: ingest.with_email_flag(p).select("id", "email", "email_valido"), "empleados"),
    "national_id_valid": _on(lambda p: p.select("id", "cedula", cleaning.national_id_valid("cedula").alias("valida")), "empleados"),
    "ruc_valid": _on(lambda c: c.select("id", "ruc_proveedor", cleaning.ruc_problem("ruc_proveedor").alias("motivo")), "compras"),
    "service_span": _on(lambda p: _service_span(p, "2024-01-31"), "empleados"),
    "account_depth": _on(_account_depth, "raw_statements"),
    "file_keys": _file_keys,
    "notice_text": _on(_notices, "empleados"),
    "aging_join": _on(_aging_join, "facturas", "clientes"),
    "aging_buckets": _aging(receivables.flat),
    "aging_summary": _aging(receivables.summary),
    "aging_by_segment": _aging(receivables.by_segment),
    "top_debtors": _aging(receivables.top_debtors),
    "due_soon": _aging(receivables.due_soon),
    "bi_aging": _aging(receivables.measures, as_of=AS_OF),
    "bi_aging_by_month": _aging(receivables.by_month),
    "contract_semaphore": _contracts(contracts.report),
    "contract_alerts": _contracts(contracts.alerts),
    "contract_alert_counts": _contracts(contracts.alert_counts),
    "contract_dash": _contracts(contracts.cards),
    "contract_by_type": _contracts(contracts.by_type),
    "contract_next_months": _contracts(contracts.next_months),
    "contract_top_red": _contracts(contracts.top_red),
    "bi_contracts": _contracts(contracts.measures, as_of=AS_OF),
    "bi_contracts_grouped": _contracts(contracts.grouped_measures),
    "bi_contracts_by_month": _contracts(contracts.by_month),
    "price_compare": _on(
        lambda own, rival: own.join(rival, "nombre").select("nombre", "disponibilidad", "codigo"), "precios_propios", "precios_competidor"
    ),
    "price_diff": _prices(),
    "price_alerts": _prices(prices.alerts),
    "price_alert_impact": _prices(prices.alerts, prices.alert_impact),
    "price_classes": _prices(prices.labelled),
    "bi_prices": _prices(prices.measures),
    "page_products": _on(lambda p: prices.page_products(p).drop("pos"), "listados"),
    "invoice_withholding": _on(
        lambda a, b: tax.invoice_withholding(a, b).select("clave_acceso", "numero", "ret_doc_sustento", "ret_base_imponible", "sin_retencion"),
        "comprobantes", "retenciones",
    ),
    "tax_cross": _cross(),
    "tax_cross_counts": _cross(tax.cross_counts),
    "purchase_validation": _on(
        lambda c: tax.money_columns(tax.validate(c), "monto_iva", "valor_retenido_iva").select(
            "id", "ruc_proveedor", "monto_iva", "valor_retenido_iva", "motivo_error", "valido"
        ),
        "compras",
    ),
    "purchase_validation_summary": _on(lambda c: tax.validation_summary(tax.validate(c)), "compras"),
    "tax_annex_rows": _on(lambda c: tax.annex_rows(_valid_purchases(c)), "compras"),
    "tax_annex_header": _on(lambda c: tax.annex_header(_valid_purchases(c), "1790000000001", "Declarante"), "compras"),
}

RULES_YEAR = 2026
HOLIDAYS = ["2024-01-01"]
PAY_DAY = "2024-01-31"
REPORT_ACCOUNTS = entity_report.ReportAccounts(income="4", expenses="5", equity="3")


def _hours(days: DataFrame) -> DataFrame:
    return payroll.attendance_hours(days, HOLIDAYS)


def _payroll(spark: SparkSession, sf: str) -> DataFrame:
    people, days, loans, drafts = (load(spark, sf, n) for n in ("empleados", "asistencia", "prestamos", "borradores"))
    return payroll.payroll_month(people, _hours(days), loans, drafts, payroll.Rules.of_year(RULES_YEAR), PAY_YEAR, PAY_MONTH)


def _income_tax(people: DataFrame) -> DataFrame:
    rules = payroll.Rules.of_year(RULES_YEAR)
    wage = as_double("sueldo_base")
    return people.select("id", wage.alias("sueldo_base"), payroll.income_tax(wage, rules).alias("retencion_ir"))


def _benefit_config(people: DataFrame) -> DataFrame:
    """Settings of the year in which every employee completes thirteen years; null outside the configured year."""
    year = F.year("fecha_ingreso") + 13
    keys = ("sbu", "aporte_personal_pct", "aporte_patronal_pct", "fondos_reserva_pct")
    return people.select("id", year.alias("anio"), *[payroll.config_lookup(k, year).alias(k) for k in keys])


def _hr_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Payslips, leave, attendance and active loans with the identity of the employee, as one long list."""
    people = load(spark, sf, "empleados")
    rows = (
        load(spark, sf, "roles_pago").select(F.lit("rol").alias("lista"), "empleado_id", F.col("id").cast("bigint").alias("id"), "estado"),
        load(spark, sf, "permisos").select(F.lit("permiso").alias("lista"), "empleado_id", "id", "estado"),
        load(spark, sf, "asistencia").select(F.lit("asistencia").alias("lista"), "empleado_id", F.date_format("fecha", "yyyyMMdd").cast("bigint").alias("id"), F.lit("").alias("estado")),
        load(spark, sf, "prestamos").filter("activo").select(F.lit("prestamo").alias("lista"), "empleado_id", "id", F.col("tipo").alias("estado")),
    )
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return payroll.hr_list(out, people)


def _employee_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Last twelve payslips and last ten leaves of every employee."""
    slips = payroll.latest_per_employee(load(spark, sf, "roles_pago"), ["anio", "mes"], 12)
    leave = payroll.latest_per_employee(load(spark, sf, "permisos"), ["fecha_inicio", "id"], 10)
    return slips.select(F.lit("rol").alias("lista"), "empleado_id", "orden", F.col("id").cast("bigint").alias("id")).unionByName(
        leave.select(F.lit("permiso").alias("lista"), "empleado_id", "orden", "id")
    )


def _reconciled(*steps) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = reconcile.reconcile(load(spark, sf, "banco"), load(spark, sf, "libro"))
        for step in steps:
            df = step(df)
        return df

    return run


def _mapped(*steps) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = mapping.map_files(load(spark, sf, "empleados"), load(spark, sf, "archivos"))
        for step in steps:
            df = step(df)
        return df

    return run


def _sales_products(spark: SparkSession, sf: str) -> DataFrame:
    return sales.products(load(spark, sf, "ventas"), table(spark, sf, "part"))


def _sales_category(spark: SparkSession, sf: str) -> DataFrame:
    return sales.by_category(load(spark, sf, "ventas"), table(spark, sf, "part"))


def _sales_zone(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("zona"))
    sellers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vendedor_id"), "s_nationkey")
    return sales.by_zone(load(spark, sf, "ventas"), sellers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).drop("s_nationkey", "n_nationkey"))


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.nearest(vectors, retrieval.label_questions(vectors))


def _knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.indexed_nearest(vectors, retrieval.label_questions(vectors))


def _rag_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of all documents for every benchmark item."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.passage_answers(table(spark, sf, "documents"), questions)


def _rag(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.answer_sources(_knn(spark, sf), table(spark, sf, "documents"))


def _stream_folder(spark: SparkSession, name: str) -> str:
    return f"{app_folder(spark)}/stream/{name}-{uuid.uuid4().hex[:8]}"


def _sales_stream(spark: SparkSession, sf: str) -> DataFrame:
    return live.sales_of(live.event_stream(spark, sf, "events.parquet"))


def _stream_day_total(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_updates(spark, live.day_totals(_sales_stream(spark, sf)), ["fecha"], _stream_folder(spark, "day"))


def _stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["hora", "zona", "vendedor_id"]
    return live.run_updates(spark, live.hourly(_sales_stream(spark, sf)), keys, _stream_folder(spark, "hour"))


def _stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth invoice arrives twice; the stream keeps one row of each."""
    copies = F.when(F.col("factura_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = _sales_stream(spark, sf).withColumn("_copy", F.explode(copies)).drop("_copy")
    unique = live.run_unique(spark, doubled, _stream_folder(spark, "dedup"))
    return unique.select("factura_id", "ts", "vendedor_id", "zona", as_double("total").alias("total"))


def _stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    folder = _stream_folder(spark, "upsert")
    rows = live.run_table_upsert(spark, _raw_files(spark, sf), f"{folder}/table", f"{folder}/checkpoint")
    return rows.select("ruc", "account_code", "date", "period_type", "company_name")


def _batch_day_total(spark: SparkSession, sf: str) -> DataFrame:
    return live.day_totals(live.sales_of(table(spark, sf, "events")))


def _evaluations(fn) -> Query:
    return _on(fn, "evaluaciones", "respuestas")


PEOPLE: dict[str, Query] = {
    "attendance_hours": _on(_hours, "asistencia"),
    "income_tax": _on(_income_tax, "empleados"),
    "benefit_config": _on(_benefit_config, "empleados"),
    "payroll_month": _payroll,
    "payroll_totals": _on(payroll.payroll_totals, "roles_pago"),
    "hr_dashboard": _on(payroll.hr_dashboard, "empleados", "roles_pago", "permisos", as_of=AS_OF),
    "hr_lists": _hr_lists,
    "employee_detail": _employee_detail,
    "payroll_social_file": _on(payroll.social_security_file, "roles_pago", "empleados"),
    "payroll_bank_file": _on(payroll.bank_file, "roles_pago", "empleados"),
    "bonus_13th": _on(lambda e, r: benefits.thirteenth(e, r, 2000), "empleados", "roles_pago"),
    "bonus_14th": _on(lambda e: benefits.fourteenth(e, payroll.Rules.of_year(RULES_YEAR), 2024), "empleados"),
    "vacation_days": _on(lambda e, p: benefits.vacation(e, p, payroll.Rules.of_year(RULES_YEAR), PAY_DAY), "empleados", "permisos"),
    "profit_share": _on(lambda e: benefits.profit_share(e, 2500000.0, 2024), "empleados"),
    "eval_cycle_progress": _on(evaluation.cycle_progress, "evaluaciones"),
    "eval_person_progress": _on(evaluation.person_progress, "evaluaciones", "empleados"),
    "eval_report": _evaluations(evaluation.report),
    "eval_recommendations": _evaluations(evaluation.recommendations),
    "document_mapping": _mapped(),
    "document_mapping_status": _mapped(mapping.mapping_status),
    "batch_log": _on(mapping.send_log, "empleados"),
    "batch_outcome": _on(lambda p: mapping.batch_outcome(mapping.send_log(p)), "empleados"),
    "quote_pricing": _on(quotes.quote, "solicitudes"),
    "bank_reconcile": _reconciled(reconcile.result_rows),
    "bi_reconciliation": _reconciled(reconcile.measures),
    "bi_reconciliation_gaps": _reconciled(reconcile.gap_histogram),
    "bi_reconciliation_running": _reconciled(reconcile.running_totals),
    "bi_reconciliation_bands": _reconciled(reconcile.amount_bands),
    "entity_top": _on_statements(entity_report.top_entities),
    "entity_report_metrics": _on_statements(entity_report.metrics, REPORT_ACCOUNTS),
    "entity_report_accounts": _on_statements(entity_report.main_accounts, REPORT_ACCOUNTS),
    "entity_report_history": _on_statements(entity_report.history, REPORT_ACCOUNTS),
    "bi_sales": _on(lambda v: sales.measures(v, AS_OF), "ventas"),
    "bi_sales_rank": _on(lambda v: sales.seller_rank(v, AS_OF), "ventas"),
    "bi_sales_products": _sales_products,
    "bi_sales_category": _sales_category,
    "bi_sales_zone": _sales_zone,
    "bi_sales_trend": _on(sales.trend, "ventas"),
    "calendar": _on(lambda v: sales.calendar(v, "fecha", AS_OF), "ventas"),
    "rag_chunks": lambda spark, sf: retrieval.chunks(table(spark, sf, "documents")),
    "knn_topk": _knn,
    "rag_retrieve": _rag,
    "knn_indexed": _knn_indexed,
    "rag_passages": _rag_passages,
    "stream_day_total": _stream_day_total,
    "stream_hourly": _stream_hourly,
    "stream_dedup": _stream_dedup,
    "stream_statement_upsert": _stream_upsert,
    "batch_day_total": _batch_day_total,
}

QUERIES: dict[str, Query] = {**FINANCE, **JOBS, **PEOPLE}
