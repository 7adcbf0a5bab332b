"""DuckDB twins of the star, mart, dashboard, indicator and anomaly queries."""

from __future__ import annotations

from ledgerspark.oracles.base import with_fs


def D(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def R(a: str, b: str, n: int | None = None) -> str:
    q = f"{D(a)} / NULLIF({D(b)}, 0)"
    return q if n is None else f"round({q}, {n})"


def C(e: str) -> str:
    return f"CAST(round(CAST({e} AS DECIMAL(28,6)), 2) AS DOUBLE)"


def PCT(a: str, b: str, n: int = 2) -> str:
    return f"round({D(a)} * 100 / NULLIF({D(b)}, 0), {n})"


def GROW(now: str, prev: str) -> str:
    return f"round({D(f'({now}) - ({prev})')} / NULLIF({D(f'abs({prev})')}, 0) * 100, 2)"


SECT = """
sect AS (SELECT row_number() OVER (ORDER BY sector_code) AS sector_key, sector_code, sector_name FROM (
  SELECT sector_code, max({'d': coalesce(date, DATE '0001-01-01'), 'n': entity_type}).n AS sector_name
  FROM fs WHERE sector_code IS NOT NULL GROUP BY 1))"""
COMP = """
comp AS (SELECT CAST(ruc AS BIGINT) AS company_key, ruc, company_name, sector_key, sector_code, sector_name FROM (
  SELECT ruc, max({'d': coalesce(date, DATE '0001-01-01'), 'n': company_name}).n AS company_name,
         max({'d': coalesce(date, DATE '0001-01-01'), 'n': sector_code}).n AS sector_code
  FROM fs GROUP BY 1) JOIN sect USING (sector_code))"""
ACCT = """
codes AS (SELECT account_code AS c, max({'d': coalesce(date, DATE '0001-01-01'), 'n': account_name}).n AS nm FROM fs GROUP BY 1),
acct0 AS (SELECT c, nm, left(c, 1) AS class_code,
    CASE WHEN contains(c, '.') THEN split_part(c, '.', 1) WHEN length(c) >= 3 THEN left(c, 3) END AS group_code,
    CASE WHEN contains(c, '.') THEN split_part(c, '.', 1) || '.' || split_part(c, '.', 2)
         WHEN length(c) >= 5 THEN left(c, 5) END AS subgroup_code,
    CASE WHEN contains(c, '.') THEN len(string_split(c, '.'))
         ELSE CASE length(c) WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 4 END END AS account_level,
    NOT EXISTS (SELECT 1 FROM codes k WHERE k.c <> codes.c AND starts_with(k.c, codes.c)) AS is_leaf
  FROM codes),
acct AS (SELECT row_number() OVER (ORDER BY a.c) AS account_key, a.c AS account_code, a.nm AS account_name, account_level,
    class_code, k1.nm AS class_name, group_code, k2.nm AS group_name, subgroup_code, k3.nm AS subgroup_name,
    CASE class_code WHEN '1' THEN 'Assets' WHEN '2' THEN 'Liabilities' WHEN '3' THEN 'Equity' WHEN '4' THEN 'Income'
         WHEN '5' THEN 'Expenses' ELSE 'Other' END AS account_class, is_leaf
  FROM acct0 a LEFT JOIN codes k1 ON k1.c = class_code LEFT JOIN codes k2 ON k2.c = group_code
  LEFT JOIN codes k3 ON k3.c = subgroup_code)"""
TOT = """
tot AS (SELECT ruc, year(date) AS fiscal_year, period_type,
    sum(value) FILTER (account_code = '1') AS a, sum(value) FILTER (account_code = '2') AS l,
    sum(value) FILTER (account_code = '3') AS q, sum(value) FILTER (account_code = '4') AS i,
    sum(value) FILTER (account_code = '5') AS e
  FROM fs WHERE date IS NOT NULL AND account_code IN ('1', '2', '3', '4', '5') GROUP BY ALL),
nt AS (SELECT tot.*, company_name, sector_code, sector_name FROM tot JOIN comp USING (ruc)),
an AS (SELECT * FROM nt WHERE period_type = 'ANUAL')"""
BASE = (SECT, COMP, TOT)
WHO = "ruc, company_name, sector_name, fiscal_year"


def an(body: str, *ctes: str) -> str:
    return with_fs(body, *BASE, *ctes)


LEV = R("l", "a")
ALQ = f"{D('a')} AS total_assets, {D('l')} AS total_liabilities, {D('q')} AS total_equity"
NET = "(i - e)"

STAR = {
    "dim_date": with_fs("""
      SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, day(d) AS day_of_month,
             isodow(d) AS day_of_week, dayname(d) AS day_name, weekofyear(d) AS week_of_year, month(d) AS month_num,
             monthname(d) AS month_name, quarter(d) AS quarter, CASE WHEN quarter(d) <= 2 THEN 1 ELSE 2 END AS semester,
             year(d) AS fiscal_year, d = last_day(d) AS is_month_end, strftime(d, '%m%d') = '1231' AS is_year_end
      FROM (SELECT DISTINCT date AS d FROM fs WHERE date IS NOT NULL)"""),
    "dim_sector": with_fs("SELECT * FROM sect", SECT),
    "dim_company": with_fs("SELECT * FROM comp", SECT, COMP),
    "dim_account": with_fs("SELECT * FROM acct", ACCT),
    "fact_financial": with_fs(f"""
      SELECT md5(concat_ws('|', ruc, account_code, CAST(date AS VARCHAR), period_type)) AS fact_id,
             CAST(ruc AS BIGINT) AS company_key, account_key, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key,
             period_type, {D('value')} AS value,
             {D("CASE WHEN account_code = '1' THEN value END")} AS total_assets,
             {D("CASE WHEN account_code = '2' THEN value END")} AS total_liabilities,
             {D("CASE WHEN account_code = '3' THEN value END")} AS total_equity,
             {D("CASE WHEN account_code = '4' THEN value END")} AS total_income,
             {D("CASE WHEN account_code = '5' THEN value END")} AS total_expenses
      FROM fs JOIN acct USING (account_code) WHERE date IS NOT NULL""", ACCT),
    "star_join": with_fs(f"""
      SELECT sector_name, year(date) AS fiscal_year, period_type, account_class, {D('sum(value)')} AS total_value,
             count(*) AS rows
      FROM fs JOIN comp USING (ruc) JOIN acct USING (account_code) WHERE date IS NOT NULL GROUP BY 1, 2, 3, 4""",
      SECT, COMP, ACCT),
    "norm_tables": with_fs("""
      SELECT 'sector' AS table_name, count(DISTINCT sector_code) AS rows FROM fs
      UNION ALL SELECT 'company', count(DISTINCT ruc) FROM fs
      UNION ALL SELECT 'account', count(DISTINCT account_code) FROM fs
      UNION ALL SELECT 'reporting_period', count(DISTINCT (date, period_type)) FROM fs WHERE date IS NOT NULL
      UNION ALL SELECT 'financial_statement', count(*) FROM fs WHERE date IS NOT NULL"""),
    "norm_account": with_fs("""
      SELECT account_code, account_name, account_class, account_level,
             (SELECT max(p.c) FROM codes p WHERE starts_with(acct.account_code, p.c) AND p.c <> acct.account_code) AS parent_code
      FROM acct""", ACCT),
    "leaf_accounts": with_fs(f"""
      SELECT f.ruc, f.date, f.period_type, f.account_code, {D('f.value')} AS value FROM fs f
      WHERE f.date IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM fs k WHERE k.ruc = f.ruc AND k.date = f.date AND k.period_type = f.period_type
          AND k.account_code <> f.account_code AND starts_with(k.account_code, f.account_code))"""),
}

VIEWS = {
    "v_balance_sheet": an(f"""
      SELECT ruc, company_name, sector_name, fiscal_year, period_type, {ALQ}, {D('i')} AS total_income,
             {D('e')} AS total_expenses, {D('i - e')} AS net_result, {D('a - l')} AS net_worth, {R('l', 'a', 4)} AS leverage_ratio
      FROM nt WHERE a IS NOT NULL OR l IS NOT NULL"""),
    "v_account_drilldown": with_fs(f"""
      SELECT ruc, comp.company_name, sector_name, year(date) AS fiscal_year, period_type, account_class, class_code,
             class_name, group_code, group_name, subgroup_code, subgroup_name, account_code, acct.account_name,
             account_level, is_leaf, {D('value')} AS value
      FROM fs JOIN comp USING (ruc) JOIN acct USING (account_code) WHERE date IS NOT NULL""", SECT, COMP, ACCT),
    "v_sector_aggregates": an(f"""
      SELECT sector_code, sector_name, fiscal_year, period_type, count(*) AS companies_count,
             {D('sum(a)')} AS sector_assets, {D('sum(l)')} AS sector_liabilities, {D('sum(q)')} AS sector_equity,
             {D('sum(i)')} AS sector_income, {D('sum(e)')} AS sector_expenses,
             round(avg({LEV}), 6) AS avg_leverage_ratio, {R('sum(l)', 'sum(a)', 6)} AS sector_leverage_ratio
      FROM (SELECT DISTINCT ruc, year(date) AS fiscal_year, period_type FROM fs WHERE date IS NOT NULL) r
      LEFT JOIN tot USING (ruc, fiscal_year, period_type) JOIN comp USING (ruc) GROUP BY 1, 2, 3, 4"""),
    "v_company_ranking": an(f"""
      SELECT ruc, company_name, sector_name, fiscal_year, period_type, {D('a')} AS total_assets,
             rank() OVER (PARTITION BY fiscal_year, period_type ORDER BY a DESC) AS rank_global,
             rank() OVER (PARTITION BY fiscal_year, period_type, sector_name ORDER BY a DESC) AS rank_in_sector,
             round(percent_rank() OVER (PARTITION BY fiscal_year, period_type ORDER BY a) * 100, 1) AS percentile,
             {D('prev')} AS prev_year_assets, {GROW('a', 'prev')} AS yoy_growth_pct
      FROM (SELECT *, lag(a) OVER (PARTITION BY ruc, period_type ORDER BY fiscal_year) AS prev FROM nt WHERE a IS NOT NULL)"""),
}

MARTS = {
    "mart_yearly_summary": with_fs(f"""
      SELECT sector_code, entity_type, ruc, company_name, year(date) AS fiscal_year, period_type,
             count(DISTINCT account_code) AS accounts_reported, {D('sum(value)')} AS total_value,
             {D('sum(greatest(value, 0))')} AS total_positive, {D('sum(least(value, 0))')} AS total_negative,
             {D('min(value)')} AS min_value, {D('max(value)')} AS max_value
      FROM fs WHERE date IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6"""),
    "mart_assets_vs_liabilities": with_fs(f"""
      SELECT ruc, company_name, entity_type, entity_subtype, year(date) AS fiscal_year, period_type,
             {D("coalesce(sum(value) FILTER (d = '1'), 0)")} AS total_activos,
             {D("coalesce(sum(value) FILTER (d = '2'), 0)")} AS total_pasivos,
             {D("coalesce(sum(value) FILTER (d = '3'), 0)")} AS total_patrimonio,
             {D("coalesce(sum(value) FILTER (d = '4'), 0)")} AS total_ingresos,
             {D("coalesce(sum(value) FILTER (d = '5'), 0)")} AS total_gastos,
             {D("coalesce(sum(value) FILTER (d = '1'), 0) - coalesce(sum(value) FILTER (d = '2'), 0)")} AS patrimonio_neto,
             {R("coalesce(sum(value) FILTER (d = '2'), 0)", "sum(value) FILTER (d = '1')", 4)} AS razon_apalancamiento,
             {D("coalesce(sum(value) FILTER (d = '4'), 0) - coalesce(sum(value) FILTER (d = '5'), 0)")} AS resultado_neto
      FROM picked GROUP BY 1, 2, 3, 4, 5, 6""",
      """rooted AS (SELECT DISTINCT ruc, date, period_type FROM fs WHERE date IS NOT NULL AND account_code IN ('1', '2', '3', '4', '5'))""",
      """picked AS (
        SELECT f.*, left(account_code, 1) AS d FROM fs f SEMI JOIN rooted USING (ruc, date, period_type)
        WHERE account_code IN ('1', '2', '3', '4', '5')
        UNION ALL
        SELECT f.*, left(account_code, 1) FROM fs f ANTI JOIN rooted USING (ruc, date, period_type)
        WHERE f.date IS NOT NULL AND left(account_code, 1) IN ('1', '2', '3', '4', '5') AND NOT EXISTS (
          SELECT 1 FROM fs k WHERE k.ruc = f.ruc AND k.date = f.date AND k.period_type = f.period_type
            AND k.account_code <> f.account_code AND starts_with(k.account_code, f.account_code)))"""),
    "mart_account_categories": with_fs(f"""
      SELECT * EXCLUDE (t), {D('t')} AS total_valor,
             {PCT('t', 'sum(t) OVER (PARTITION BY fiscal_year, period_type, account_class)')} AS pct_dentro_de_clase
      FROM (
        SELECT fiscal_year, period_type, entity_type, entity_subtype, account_class, root_segment,
               first(account_name ORDER BY depth, account_code) AS root_name, count(DISTINCT account_code) AS cuentas_distintas,
               count(*) AS filas, sum(value) AS t, {C(D('sum(value)') + ' / count(*)')} AS promedio_valor,
               {D('min(value)')} AS valor_minimo, {D('max(value)')} AS valor_maximo
        FROM (SELECT *, year(date) AS fiscal_year, split_part(account_code, '.', 1) AS root_segment,
                CASE WHEN contains(account_code, '.') THEN len(string_split(account_code, '.'))
                     ELSE CASE length(account_code) WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 4 END END AS depth,
                CASE left(account_code, 1) WHEN '1' THEN 'Activos' WHEN '2' THEN 'Pasivos' WHEN '3' THEN 'Patrimonio'
                     WHEN '4' THEN 'Ingresos' WHEN '5' THEN 'Gastos' ELSE 'Especiales' END AS account_class
              FROM fs WHERE date IS NOT NULL) GROUP BY 1, 2, 3, 4, 5, 6)"""),
    "mart_company_ranking": with_fs(f"""
      SELECT ruc, company_name, entity_type, entity_subtype, fiscal_year, period_type, {D('a')} AS total_activos,
             rank() OVER (PARTITION BY fiscal_year, period_type ORDER BY a DESC) AS ranking_global,
             rank() OVER (PARTITION BY fiscal_year, period_type, entity_type ORDER BY a DESC) AS ranking_por_sector,
             round(percent_rank() OVER (PARTITION BY fiscal_year, period_type ORDER BY a) * 100, 1) AS percentil,
             {D('prev')} AS activos_anio_anterior, {D('a - prev')} AS variacion_absoluta, {GROW('a', 'prev')} AS variacion_pct_yoy
      FROM (SELECT *, lag(a) OVER (PARTITION BY ruc, period_type ORDER BY fiscal_year, date) AS prev FROM (
        SELECT f.ruc, f.date, f.period_type, year(f.date) AS fiscal_year, max(company_name) AS company_name,
               max(entity_type) AS entity_type, max(entity_subtype) AS entity_subtype,
               coalesce(max(value) FILTER (account_code = '1'), sum(value) FILTER (NOT EXISTS (
                 SELECT 1 FROM fs k WHERE k.ruc = f.ruc AND k.date = f.date AND k.period_type = f.period_type
                   AND k.account_code <> f.account_code AND starts_with(k.account_code, f.account_code)))) AS a
        FROM fs f WHERE date IS NOT NULL AND starts_with(account_code, '1') GROUP BY 1, 2, 3, 4))"""),
}

LATEST = "fiscal_year = (SELECT max(fiscal_year) FROM an WHERE {0})"
DASHBOARD = {
    "a1_assets_year": an(f"""
      SELECT fiscal_year, period_type, count(*) AS companies_reporting, {D('sum(a)')} AS total_assets,
             {C(D('sum(a)') + ' / count(*)')} AS avg_assets_per_company, {D('min(a)')} AS min_company_assets,
             {D('max(a)')} AS max_company_assets
      FROM an WHERE a IS NOT NULL GROUP BY 1, 2"""),
    "a2_assets_sector": an(f"""
      SELECT fiscal_year, sector_name, {D('sum(a)')} AS sector_assets, count(*) AS companies_count,
             {PCT('sum(a)', 'sum(sum(a)) OVER (PARTITION BY fiscal_year)')} AS pct_of_total
      FROM an WHERE a IS NOT NULL GROUP BY 1, 2"""),
    "a3_assets_group": with_fs(f"""
      SELECT year(date) AS fiscal_year, class_name, group_code, group_name, {D('sum(value)')} AS group_total,
             count(DISTINCT ruc) AS companies_count,
             {PCT('sum(value)', 'sum(sum(value)) OVER (PARTITION BY year(date), class_name)')} AS pct_within_class
      FROM fs JOIN acct USING (account_code)
      WHERE period_type = 'ANUAL' AND account_class = 'Assets' AND account_code = group_code GROUP BY 1, 2, 3, 4""", ACCT),
    "b1_system_balance": an(f"""
      SELECT fiscal_year, {D('sum(a)')} AS total_assets, {D('sum(l)')} AS total_liabilities, {D('sum(q)')} AS total_equity,
             {D('sum(a) - sum(l)')} AS net_worth, {R('sum(l)', 'sum(a)', 4)} AS system_leverage_ratio
      FROM an WHERE a IS NOT NULL OR l IS NOT NULL GROUP BY 1"""),
    "b2_sector_solvency": an(f"""
      SELECT fiscal_year, sector_name, {ALQ}, {R('l', 'a', 4)} AS leverage_ratio,
             CASE WHEN {LEV} > 0.9 THEN 'High Risk' WHEN {LEV} > 0.7 THEN 'Moderate' ELSE 'Healthy' END AS solvency_flag
      FROM (SELECT fiscal_year, sector_name, sum(a) AS a, sum(l) AS l, sum(q) AS q FROM an
            WHERE a IS NOT NULL OR l IS NOT NULL GROUP BY 1, 2)"""),
    "b3_company_latest": an(f"""
      SELECT {WHO}, {ALQ}, {R('l', 'a', 4)} AS leverage_ratio FROM an
      WHERE (a IS NOT NULL OR l IS NOT NULL) AND {LATEST.format('a IS NOT NULL OR l IS NOT NULL')}"""),
    "c1_leaderboard": an(f"""
      SELECT rank() OVER (ORDER BY a DESC) AS rank_global, {WHO}, {ALQ}, {PCT('a', 'sum(a) OVER ()')} AS pct_of_system,
             {PCT('sum(a) OVER (ORDER BY a DESC, ruc ROWS UNBOUNDED PRECEDING)', 'sum(a) OVER ()')} AS cumulative_pct
      FROM an WHERE a IS NOT NULL AND {LATEST.format('a IS NOT NULL')} ORDER BY a DESC, ruc LIMIT 20"""),
    "c2_top5_sector": an(f"""
      SELECT fiscal_year, sector_name, rank() OVER (PARTITION BY sector_name, fiscal_year ORDER BY a DESC) AS rank_in_sector,
             ruc, company_name, {D('a')} AS total_assets FROM an WHERE a IS NOT NULL QUALIFY rank_in_sector <= 5"""),
    "c3_rank_moves": an(f"""
      SELECT c.fiscal_year, c.ruc, c.company_name, c.sector_name, p.r AS rank_prev_year, c.r AS rank_curr_year,
             p.r - c.r AS rank_change, {D('c.a')} AS total_assets, {D('p.a')} AS prev_total_assets
      FROM rk c JOIN rk p ON p.ruc = c.ruc AND p.fiscal_year + 1 = c.fiscal_year WHERE abs(p.r - c.r) >= 10""",
      "rk AS (SELECT *, rank() OVER (PARTITION BY fiscal_year ORDER BY a DESC) AS r FROM an WHERE a IS NOT NULL)"),
    "d1_yoy_company": an(f"""
      SELECT {WHO}, {D('a')} AS total_assets, {D('p')} AS prev_year_assets, {D('a - p')} AS yoy_change,
             {GROW('a', 'p')} AS yoy_growth_pct, {C(D('s3') + ' / n3')} AS moving_avg_3yr
      FROM (SELECT *, lag(a) OVER w AS p, sum(a) OVER (w ROWS 2 PRECEDING) AS s3, count(a) OVER (w ROWS 2 PRECEDING) AS n3
            FROM an WHERE a IS NOT NULL WINDOW w AS (PARTITION BY ruc ORDER BY fiscal_year))"""),
    "d2_sector_cagr": an(f"""
      SELECT sector_name, y0 AS first_year, y1 AS last_year, y1 - y0 AS years_span, {D('a0')} AS assets_first_year,
             {D('a1')} AS assets_last_year, round((pow({R('a1', 'a0')}, 1.0 / NULLIF(y1 - y0, 0)) - 1) * 100, 2) AS cagr_pct
      FROM (SELECT sector_name, min(fiscal_year) AS y0, max(fiscal_year) AS y1, arg_min(s, fiscal_year) AS a0,
                   arg_max(s, fiscal_year) AS a1
            FROM (SELECT sector_name, fiscal_year, sum(a) AS s FROM an WHERE a IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""),
    "d3_quarterly": with_fs(f"""
      SELECT t.sector_name, t.fiscal_year, t.quarter, t.fiscal_year || '-Q' || t.quarter AS period_label,
             {D('t.s')} AS total_assets, {D('t.s - p.s')} AS qoq_change, {GROW('t.s', 'p.s')} AS qoq_growth_pct,
             {D('t.s - f.s')} AS yoy_same_quarter_change
      FROM qa t LEFT JOIN qa p ON p.sector_name = t.sector_name AND p.n = t.n - 1
      LEFT JOIN qa f ON f.sector_name = t.sector_name AND f.n = t.n - 4""", SECT, COMP,
      """qa AS (SELECT sector_name, year(date) AS fiscal_year, quarter(date) AS quarter, year(date) * 4 + quarter(date) AS n,
                sum(value) AS s FROM fs JOIN comp USING (ruc)
                WHERE period_type = 'TRIMESTRAL' AND account_code = '1' GROUP BY 1, 2, 3, 4)"""),
    "d4_net_result": an(f"""
      SELECT {WHO}, {D('i')} AS total_income, {D('e')} AS total_expenses, {D('n')} AS net_result,
             CASE WHEN n > 0 THEN 'Profit' ELSE 'Loss' END AS result_flag, {D('n - p')} AS net_result_change,
             {GROW('n', 'p')} AS net_result_growth_pct
      FROM (SELECT *, i - e AS n, lag(i - e) OVER (PARTITION BY ruc ORDER BY fiscal_year) AS p FROM an
            WHERE i IS NOT NULL OR e IS NOT NULL)"""),
}

KPI = {
    "k1a_leverage": an(f"""
      SELECT {WHO}, {ALQ}, {R('l', 'a', 4)} AS leverage_ratio, {R('l', 'q', 4)} AS debt_to_equity,
             {R('a', 'q', 4)} AS equity_multiplier,
             CASE WHEN {LEV} > 0.9 THEN 'Critical' WHEN {LEV} > 0.75 THEN 'High' WHEN {LEV} > 0.5 THEN 'Moderate'
                  ELSE 'Healthy' END AS solvency_band
      FROM an WHERE a IS NOT NULL OR l IS NOT NULL"""),
    "k1b_solvency_hist": an(f"""
      SELECT fiscal_year, solvency_band, count(*) AS entity_count,
             round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY fiscal_year), 1) AS pct_of_total
      FROM (SELECT fiscal_year, CASE WHEN v > 0.9 THEN '4_Critical  (>90%)' WHEN v > 0.75 THEN '3_High      (75–90%)'
                   WHEN v > 0.5 THEN '2_Moderate  (50–75%)' ELSE '1_Healthy   (<50%)' END AS solvency_band
            FROM (SELECT fiscal_year, {LEV} AS v FROM an) WHERE v IS NOT NULL) GROUP BY 1, 2"""),
    "k2a_liquidity": with_fs(f"""
      SELECT ruc, company_name, sector_name, fiscal_year, {D('ca')} AS current_assets, {D('na')} AS noncurrent_assets,
             {D('cl')} AS current_liabilities, {D('nl')} AS noncurrent_liabilities, {D('cash')} AS cash_and_equivalents,
             {R('ca', 'cl', 4)} AS current_ratio, {R('cash', 'cl', 4)} AS cash_ratio,
             CASE WHEN {R('ca', 'cl')} < 1 THEN 'Illiquid' WHEN {R('ca', 'cl')} < 1.5 THEN 'Adequate' ELSE 'Strong' END AS liquidity_flag
      FROM (SELECT ruc, year(date) AS fiscal_year,
                   coalesce(max(value) FILTER (account_code = '101'), sum(value) FILTER (group_code = '101' AND leaf), 0) AS ca,
                   coalesce(max(value) FILTER (account_code = '102'), sum(value) FILTER (group_code = '102' AND leaf), 0) AS na,
                   coalesce(max(value) FILTER (account_code = '201'), sum(value) FILTER (group_code = '201' AND leaf), 0) AS cl,
                   coalesce(max(value) FILTER (account_code = '202'), sum(value) FILTER (group_code = '202' AND leaf), 0) AS nl,
                   coalesce(max(value) FILTER (account_code = '10101'), 0) AS cash
            FROM (SELECT f.*, group_code, NOT EXISTS (SELECT 1 FROM fs k WHERE k.ruc = f.ruc AND k.date = f.date
                    AND k.period_type = 'ANUAL' AND k.account_code <> f.account_code
                    AND starts_with(k.account_code, f.account_code)) AS leaf
                  FROM fs f JOIN acct USING (account_code) WHERE period_type = 'ANUAL')
            WHERE group_code IN ('101', '102', '201', '202') GROUP BY 1, 2) JOIN comp USING (ruc)""", SECT, COMP, ACCT),
    "k3a_profitability": an(f"""
      SELECT {WHO}, {D('a')} AS total_assets, {D('i')} AS total_income, {D('e')} AS total_expenses, {D(NET)} AS net_result,
             {PCT(NET, 'a')} AS roa_pct, {PCT(NET, 'q')} AS roe_pct, {PCT(NET, 'i')} AS net_margin_pct,
             {PCT('e', 'i')} AS expense_ratio_pct,
             CASE WHEN i - e > 0 THEN 'Profitable' WHEN i - e = 0 THEN 'Break-even' ELSE 'Loss' END AS profitability_flag
      FROM an WHERE i IS NOT NULL OR e IS NOT NULL"""),
    "k3b_roa_box": an(f"""
      SELECT fiscal_year, sector_name, count(*) AS entity_count, round(min(r), 2) AS roa_min,
             round(quantile_cont(r, 0.25), 2) AS roa_p25, round(quantile_cont(r, 0.5), 2) AS roa_median,
             round(quantile_cont(r, 0.75), 2) AS roa_p75, round(max(r), 2) AS roa_max, round(avg(r), 2) AS roa_avg
      FROM (SELECT fiscal_year, sector_name, {R(NET, 'a')} * 100 AS r FROM an) WHERE r IS NOT NULL GROUP BY 1, 2"""),
    "k4a_turnover": an(f"""
      SELECT {WHO}, {D('i')} AS total_income, {D('a')} AS total_assets, {D('e')} AS total_expenses,
             {R('i', 'a', 4)} AS asset_turnover, {PCT('e', 'i')} AS cost_efficiency_pct, {R('i', 'q', 4)} AS income_on_equity
      FROM an WHERE i IS NOT NULL"""),
    "k5a_growth": an(f"""
      SELECT {WHO}, {D('a')} AS total_assets, {D('i')} AS total_income, {D('n')} AS net_result,
             {GROW('a', 'pa')} AS asset_growth_pct, {GROW('i', 'pi')} AS income_growth_pct, {GROW('q', 'pq')} AS equity_growth_pct,
             {D('n - pn')} AS net_result_change,
             CASE WHEN {R('a', 'a3')} >= 0 THEN round((pow({R('a', 'a3')}, 1.0 / 3) - 1) * 100, 2) END AS asset_cagr_3yr_pct
      FROM (SELECT *, i - e AS n, lag(a) OVER w AS pa, lag(i) OVER w AS pi, lag(q) OVER w AS pq, lag(i - e) OVER w AS pn,
                   lag(a, 3) OVER w AS a3 FROM an WINDOW w AS (PARTITION BY ruc ORDER BY fiscal_year))"""),
    "k5b_fastest": an(f"""
      SELECT {WHO}, {D('a')} AS current_assets, {D('a3')} AS assets_3yr_ago,
             CASE WHEN a >= 0 THEN round((pow({R('a', 'a3')}, 1.0 / 3) - 1) * 100, 2) END AS cagr_3yr_pct
      FROM (SELECT *, lag(a, 3) OVER (PARTITION BY ruc ORDER BY fiscal_year) AS a3 FROM an WHERE a IS NOT NULL)
      WHERE a3 > 0 AND {LATEST.format('a IS NOT NULL')} ORDER BY cagr_3yr_pct DESC NULLS LAST, ruc LIMIT 10"""),
    "k6a_hhi": an(f"""
      SELECT fiscal_year, sector_name, count(*) AS entities, {D('any_value(t)')} AS sector_assets, round(sum(pow(sh, 2)), 0) AS hhi,
             CASE WHEN sum(pow(sh, 2)) > 2500 THEN 'Highly Concentrated' WHEN sum(pow(sh, 2)) > 1500
                  THEN 'Moderately Concentrated' ELSE 'Competitive' END AS concentration_level
      FROM (SELECT *, sum(a) OVER (PARTITION BY sector_name, fiscal_year) AS t,
                   {D('a')} / {D('sum(a) OVER (PARTITION BY sector_name, fiscal_year)')} * 100 AS sh FROM an WHERE a IS NOT NULL)
      GROUP BY 1, 2"""),
    "k6b_cr5": an(f"""
      SELECT fiscal_year, sector_name, {D('sum(a) FILTER (r <= 5)')} AS cr5_assets, {PCT('sum(a) FILTER (r <= 5)', 'sum(a)')} AS cr5_pct
      FROM (SELECT *, rank() OVER (PARTITION BY sector_name, fiscal_year ORDER BY a DESC) AS r FROM an WHERE a IS NOT NULL)
      GROUP BY 1, 2"""),
    "k7a_risk_score": an(f"""
      SELECT {WHO}, {D('a')} AS total_assets, {D('l')} AS total_liabilities, {D('n')} AS net_result,
             coalesce(f1, 0) AS flag_high_leverage, coalesce(f2, 0) AS flag_loss, coalesce(f3, 0) AS flag_negative_equity,
             coalesce(f4, 0) AS flag_cost_overrun, coalesce(f5, 0) AS flag_asset_decline,
             len(list_filter([f1, f2, f3, f4, f5], lambda x: x IS NULL)) AS unknown_flags, s AS risk_score,
             CASE s WHEN 0 THEN 'Low' WHEN 1 THEN 'Watch' WHEN 2 THEN 'Elevated' ELSE 'Critical' END AS risk_level
      FROM (SELECT *, coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0) + coalesce(f5, 0) AS s FROM (
        SELECT *, ({LEV} > 0.9)::INT AS f1, (n < 0)::INT AS f2, (q < 0)::INT AS f3,
               ({D('i')} < {D('e')} * 0.8)::INT AS f4, (p IS NOT NULL AND a < p)::INT AS f5
        FROM (SELECT *, i - e AS n, lag(a) OVER (PARTITION BY ruc ORDER BY fiscal_year) AS p FROM an)))"""),
}

REP = "ruc, company_name, entity_type, date, period_type"
FYR = "ruc, company_name, entity_type, fiscal_year, period_type"
PAIR = """
      SELECT c.ruc, c.company_name, c.entity_type, c.date, c.period_type, p.account_code AS parent_code,
             p.account_name AS parent_name, {pv} AS parent_value, c.account_code AS child_code, c.account_name AS child_name,
             {cv} AS child_value, {ex} AS excess, '{kind}' AS anomaly_type, '{sev}' AS severity
      FROM children c JOIN parents p ON p.ruc = c.ruc AND p.date = c.date AND p.period_type = c.period_type
        AND p.account_code = c.parent
      WHERE c.value > p.value"""
SIDES = """
parents AS MATERIALIZED (SELECT * FROM fs WHERE length(account_code) = {n} AND value > 0),
children AS MATERIALIZED (SELECT *, left(account_code, {n}) AS parent FROM fs WHERE length(account_code) = {m} AND value > 0)"""


def _pair(n: int, m: int, kind: str, sev: str) -> str:
    return with_fs(PAIR.format(pv=D("p.value"), cv=D("c.value"), ex=D("c.value - p.value"), kind=kind, sev=sev), SIDES.format(n=n, m=m))


COMPOSITE = f"""
comp8 AS (
  SELECT ruc, company_name, entity_type, fiscal_year, period_type, {D('a')} AS total_assets, {D('l')} AS total_liabilities,
         {D('q')} AS total_equity, {D('i')} AS total_income, {D('e')} AS total_expenses,
         coalesce(f1, 0) AS flag_negative_assets, coalesce(f2, 0) AS flag_extreme_leverage,
         coalesce(f3, 0) AS flag_negative_equity, coalesce(f4, 0) AS flag_zero_income_with_costs,
         coalesce(f5, 0) AS flag_income_halved, coalesce(f6, 0) AS flag_abnormal_asset_change,
         coalesce(f7, 0) AS flag_zero_expenses_with_income,
         len(list_filter([f1, f2, f3, f4, f5, f6, f7], lambda x: x IS NULL)) AS unknown_flags,
         list_sum(list_transform([f1, f2, f3, f4, f5, f6, f7], lambda x: coalesce(x, 0))) AS anomaly_score,
         CASE list_sum(list_transform([f1, f2, f3, f4, f5, f6, f7], lambda x: coalesce(x, 0)))
           WHEN 0 THEN 'Normal' WHEN 1 THEN 'Watch' WHEN 2 THEN 'Suspicious' ELSE 'Critical' END AS anomaly_level
  FROM (SELECT *, (a < 0)::INT AS f1, ({LEV} > 1.2)::INT AS f2, (q < 0)::INT AS f3, (i = 0 AND e > 0)::INT AS f4,
               ({D('i')} < {D('pi')} * 0.5 AND pi > 0)::INT AS f5,
               (pa IS NOT NULL AND {D('mv')} > {R('sum(mv) OVER g', 'count(mv) OVER g')} * 3)::INT AS f6,
               (i > 0 AND e = 0)::INT AS f7
        FROM (SELECT *, abs(a - pa) AS mv FROM (
          SELECT *, lag(a) OVER w AS pa, lag(i) OVER w AS pi FROM (
            SELECT ruc, company_name, entity_type, year(date) AS fiscal_year, period_type,
                   sum(value) FILTER (account_code = '1') AS a, sum(value) FILTER (account_code = '2') AS l,
                   sum(value) FILTER (account_code = '3') AS q, sum(value) FILTER (account_code = '4') AS i,
                   sum(value) FILTER (account_code = '5') AS e
            FROM fs WHERE date IS NOT NULL AND account_code IN ('1', '2', '3', '4', '5') GROUP BY ALL)
          WINDOW w AS (PARTITION BY ruc, period_type ORDER BY fiscal_year)))
        WINDOW g AS (PARTITION BY entity_type, fiscal_year, period_type)))"""

ANOMALY = {
    "n1a_negative_assets": with_fs(f"""
      SELECT {REP}, {D('value')} AS total_assets, 'Negative total assets' AS anomaly_type, 'CRITICAL' AS severity
      FROM fs WHERE account_code = '1' AND value < 0"""),
    "n1b_excess_liabilities": with_fs(f"""
      SELECT {REP}, {D('a')} AS total_assets, {D('l')} AS total_liabilities, {R('l', 'a', 4)} AS leverage_ratio,
             'Liabilities > 120% of assets' AS anomaly_type, 'CRITICAL' AS severity
      FROM (SELECT {REP}, sum(value) FILTER (account_code = '1') AS a, sum(value) FILTER (account_code = '2') AS l
            FROM fs GROUP BY ALL) WHERE {LEV} > 1.2"""),
    "n1c_negative_equity": with_fs(f"""
      SELECT {REP}, {D('value')} AS total_equity, 'Negative equity' AS anomaly_type, 'HIGH' AS severity
      FROM fs WHERE account_code = '3' AND value < 0"""),
    "n1d_income_expense_gap": with_fs(f"""
      SELECT {REP}, {D('i')} AS income, {D('e')} AS expenses,
             CASE WHEN i = 0 THEN 'Zero income with real expenses' ELSE 'Real income with zero expenses' END AS anomaly_type,
             'MEDIUM' AS severity
      FROM (SELECT {REP}, coalesce(sum(value) FILTER (account_code = '4'), 0) AS i,
                   coalesce(sum(value) FILTER (account_code = '5'), 0) AS e
            FROM fs WHERE account_code IN ('4', '5') GROUP BY ALL)
      WHERE (i = 0 AND e > 0) OR (e = 0 AND i > 0)"""),
    "n2a_zscore": with_fs(f"""
      SELECT *, 'Z-score outlier' AS anomaly_type,
             CASE WHEN abs(z_score) > 5 THEN 'CRITICAL' WHEN abs(z_score) > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
      FROM (SELECT {REP}, account_code, account_name, v AS value, {C('m')} AS peer_mean, {C('s')} AS peer_std,
                   round((v - m) / NULLIF(s, 0), 2) AS z_score, n AS peer_count
            FROM (SELECT *, {D('value')} AS v, {D('sum(value) OVER p')} / count(*) OVER p AS m,
                         stddev_samp({D('value')}) OVER p AS s, count(*) OVER p AS n
                  FROM fs WHERE date IS NOT NULL WINDOW p AS (PARTITION BY account_code, year(date), period_type)) WHERE n >= 5)
      WHERE abs(z_score) > 3"""),
    "n2b_iqr": with_fs(f"""
      SELECT *, CASE WHEN total_assets < lower_fence THEN 'IQR outlier — unusually small'
                     ELSE 'IQR outlier — unusually large' END AS anomaly_type, 'HIGH' AS severity
      FROM (SELECT {REP}, v AS total_assets, {C('q1')} AS q1, {C('q3')} AS q3, {C('q3 - q1')} AS iqr,
                   {C('q1 - 3 * (q3 - q1)')} AS lower_fence, {C('q3 + 3 * (q3 - q1)')} AS upper_fence
            FROM (SELECT *, quantile_cont(v, 0.25) OVER g AS q1, quantile_cont(v, 0.75) OVER g AS q3, count(*) OVER g AS n
                  FROM (SELECT *, {D('value')} AS v FROM fs WHERE account_code = '1')
                  WINDOW g AS (PARTITION BY entity_type, year(date), period_type)) WHERE n >= 5)
      WHERE total_assets < lower_fence OR total_assets > upper_fence"""),
    "n3a_spikes": with_fs(f"""
      SELECT {FYR}, {D('p')} AS prev_year_assets, {D('a')} AS current_assets, ch AS yoy_change,
             round(ch / NULLIF({D('p')}, 0) * 100, 2) AS yoy_pct, {C('md')} AS sector_median_abs_change,
             CASE WHEN ch > 0 THEN 'Abnormal spike' ELSE 'Abnormal drop' END AS anomaly_type,
             CASE WHEN abs(ch) > md * 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
      FROM (SELECT *, quantile_cont(abs(ch), 0.5) OVER (PARTITION BY entity_type, fiscal_year, period_type) AS md FROM (
        SELECT *, {D('a - p')} AS ch FROM (
          SELECT *, lag(a) OVER (PARTITION BY ruc, period_type ORDER BY fiscal_year) AS p FROM (
            SELECT ruc, company_name, entity_type, year(date) AS fiscal_year, period_type, sum(value) AS a
            FROM fs WHERE account_code = '1' GROUP BY ALL))) WHERE ch IS NOT NULL)
      WHERE abs(ch) > md * 3"""),
    "n3b_sign_flip": with_fs(f"""
      SELECT c.ruc, c.company_name, c.entity_type, c.account_code, c.account_name, c.fiscal_year, c.period_type,
             {D('p.v')} AS prev_value, {D('c.v')} AS curr_value, 'Sign flip on class account' AS anomaly_type, 'HIGH' AS severity
      FROM y c JOIN y p ON p.ruc = c.ruc AND p.account_code = c.account_code AND p.period_type = c.period_type
        AND p.fiscal_year + 1 = c.fiscal_year WHERE sign(c.v) <> sign(p.v)""",
      """y AS (SELECT ruc, company_name, entity_type, account_code, account_name, year(date) AS fiscal_year, period_type,
                sum(value) AS v FROM fs WHERE account_code IN ('1', '2', '3', '4', '5') GROUP BY ALL)"""),
    "n4a_group_gt_class": _pair(1, 3, "Child > parent (group vs class)", "HIGH"),
    "n4b_subgroup_gt_group": _pair(3, 5, "Child > parent (subgroup vs group)", "MEDIUM"),
    "n5a_missing_years": with_fs("""
      SELECT ruc, company_name, entity_type, missing_year, 'Missing annual report' AS anomaly_type, 'HIGH' AS severity
      FROM (SELECT ruc, arg_max(company_name, y) AS company_name, arg_max(entity_type, y) AS entity_type,
                   min(y) AS y0, max(y) AS y1 FROM cyr GROUP BY 1)
      JOIN (SELECT DISTINCT y AS missing_year FROM cyr) ON missing_year BETWEEN y0 AND y1
      ANTI JOIN (SELECT ruc, y AS missing_year FROM cyr) k USING (ruc, missing_year)""",
      """cyr AS (SELECT ruc, year(date) AS y, arg_max(company_name, date) AS company_name, arg_max(entity_type, date) AS entity_type
                 FROM fs WHERE period_type = 'ANUAL' GROUP BY 1, 2)"""),
    "n5b_single_year": with_fs("""
      SELECT ruc, company_name, entity_type, count(DISTINCT year(date)) AS years_reported, min(date) AS first_report,
             max(date) AS last_report, 'Single year only — no trend possible' AS anomaly_type, 'LOW' AS severity
      FROM fs WHERE period_type = 'ANUAL' GROUP BY ruc, company_name, entity_type HAVING count(DISTINCT year(date)) = 1"""),
    "n6a_round_values": with_fs(f"""
      SELECT {REP}, account_code, account_name, {D('value')} AS value, 'Suspiciously round value' AS anomaly_type, 'LOW' AS severity
      FROM fs WHERE length(account_code) >= 3 AND abs(value) >= 1000000 AND value % 1000000 = 0"""),
    "n6b_constant_period": with_fs(f"""
      SELECT {REP}, count(*) AS total_accounts, {D('min(value)')} AS repeated_value,
             'All accounts share same value' AS anomaly_type, 'HIGH' AS severity
      FROM fs GROUP BY {REP} HAVING count(*) >= 3 AND count(DISTINCT value) = 1"""),
    "n6c_future_dates": with_fs(f"""
      SELECT {REP}, account_code, {D('value')} AS value, 'Future report date' AS anomaly_type, 'HIGH' AS severity
      FROM fs WHERE date > DATE '2000-06-30'"""),
    "n6d_old_dates": with_fs(f"""
      SELECT {REP}, account_code, {D('value')} AS value, 'Date before year 2000' AS anomaly_type, 'MEDIUM' AS severity
      FROM fs WHERE year(date) < 2000"""),
    "n7a_peer_leverage": with_fs(f"""
      SELECT {FYR}, round(v, 4) AS entity_leverage, round(m, 4) AS sector_mean_leverage, round(s, 4) AS sector_std_leverage,
             round((v - m) / NULLIF(s, 0), 2) AS leverage_z_score, 'Leverage far above sector peers' AS anomaly_type,
             CASE WHEN (v - m) / NULLIF(s, 0) > 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
      FROM (SELECT *, avg(v) OVER g AS m, stddev_samp(v) OVER g AS s, count(*) OVER g AS n FROM (
        SELECT ruc, company_name, entity_type, year(date) AS fiscal_year, period_type,
               {R("coalesce(sum(value) FILTER (account_code = '2'), 0)", "coalesce(sum(value) FILTER (account_code = '1'), 0)")} AS v
        FROM fs WHERE account_code IN ('1', '2') GROUP BY ALL) WHERE v IS NOT NULL
        WINDOW g AS (PARTITION BY entity_type, fiscal_year, period_type))
      WHERE n >= 3 AND (v - m) / NULLIF(s, 0) > 2"""),
    "n8_composite": with_fs("SELECT * FROM comp8", COMPOSITE),
}

CHECKS = {
    "q_counts": with_fs("""
      SELECT 'rows' AS metric, 'total' AS item, count(*) AS n FROM fs
      UNION ALL SELECT 'rows by period', period_type, count(*) FROM fs GROUP BY 2
      UNION ALL SELECT 'rows by year', CAST(year(date) AS VARCHAR), count(*) FROM fs WHERE date IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'companies by sector', entity_type, count(DISTINCT ruc) FROM fs GROUP BY 2"""),
    "q_codes": with_fs("""
      SELECT 'outside 1-5' AS metric, account_code AS item, account_name, count(*) AS n
      FROM fs WHERE left(account_code, 1) NOT IN ('1', '2', '3', '4', '5') GROUP BY 2, 3
      UNION ALL SELECT 'accounts per class', left(account_code, 1), NULL, count(DISTINCT account_code) FROM fs GROUP BY 2"""),
    "q_hierarchy_top": with_fs(f"""
      SELECT c.ruc, c.company_name, c.date, p.account_code AS cod_padre, {D('p.value')} AS valor_padre,
             c.account_code AS cod_hijo, {D('c.value')} AS valor_hijo, {D('c.value - p.value')} AS exceso
      FROM fs c JOIN fs p ON p.ruc = c.ruc AND p.date = c.date AND p.period_type = c.period_type
        AND p.account_code = left(c.account_code, 1)
      WHERE length(c.account_code) = 3 AND c.value > p.value AND p.value > 0
      ORDER BY c.value - p.value DESC, c.ruc, c.date, c.account_code, c.period_type LIMIT 20"""),
    "q_duplicates": with_fs("""
      SELECT ruc, account_code, date, period_type, count(*) AS occurrences FROM fs GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"""),
    "q_anomaly_levels": with_fs("""
      SELECT anomaly_level, count(*) AS entities, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct,
             CASE anomaly_level WHEN 'Normal' THEN 90.0 WHEN 'Watch' THEN 8.0 WHEN 'Suspicious' THEN 2.0 ELSE 0.5 END AS limit_pct,
             CASE WHEN anomaly_level = 'Normal' THEN count(*) * 100.0 / sum(count(*)) OVER () > 90
                  WHEN anomaly_level = 'Watch' THEN count(*) * 100.0 / sum(count(*)) OVER () < 8
                  WHEN anomaly_level = 'Suspicious' THEN count(*) * 100.0 / sum(count(*)) OVER () < 2
                  ELSE count(*) * 100.0 / sum(count(*)) OVER () < 0.5 END AS acceptable
      FROM comp8 GROUP BY 1""", COMPOSITE),
    "q_critical_entities": with_fs("""
      SELECT ruc, company_name, entity_type, fiscal_year, period_type, anomaly_score, anomaly_level
      FROM comp8 WHERE anomaly_level IN ('Critical', 'Suspicious')""", COMPOSITE),
    "q_mart_checks": with_fs("""
      SELECT 'mart_yearly_summary rows' AS metric, NULL AS fiscal_year, count(*) AS n, NULL AS max_rank FROM (
        SELECT DISTINCT sector_code, entity_type, ruc, company_name, year(date), period_type FROM fs WHERE date IS NOT NULL)
      UNION ALL SELECT 'negative assets', NULL, count(*) FILTER (total_activos < 0), NULL FROM mal
      UNION ALL SELECT 'rank range', fiscal_year, min(ranking_global), max(ranking_global) FROM mcr
        WHERE period_type = 'ANUAL' GROUP BY 2"""),
}
# the last check reads two marts; their texts are put in as sub-queries
CHECKS["q_mart_checks"] = (
    CHECKS["q_mart_checks"]
    .replace("FROM mal", f"FROM ({MARTS['mart_assets_vs_liabilities']})")
    .replace("FROM mcr", f"FROM ({MARTS['mart_company_ranking']})")
)

SQL: dict[str, str] = {**STAR, **VIEWS, **MARTS, **DASHBOARD, **KPI, **ANOMALY, **CHECKS}
