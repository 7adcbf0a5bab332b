"""DuckDB twins of ingest, receivables, contracts, prices and tax."""

from __future__ import annotations

from ledgerspark.oracles.finance import C, D, PCT, R
from ledgerspark.sources.adapters import AS_OF, as_cte

DAY = f"DATE '{AS_OF}'"


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(as_cte(c) if " " not in c else c for c in ctes) + "\n" + body.strip()


NUM = "try_cast(replace(replace(trim(value), '.', ''), ',', '.') AS DOUBLE)"
DATE = """CASE WHEN regexp_full_match(trim(date), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN CAST(try_strptime(trim(date), '%d/%m/%Y') AS DATE)
    WHEN regexp_full_match(trim(date), '\\d{1,2}-\\d{1,2}-\\d{4}') THEN CAST(try_strptime(trim(date), '%d-%m-%Y') AS DATE)
    WHEN regexp_full_match(trim(date), '\\d{4}-\\d{1,2}-\\d{1,2}') THEN CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE)
    WHEN regexp_full_match(trim(date), '\\d{8}') THEN CAST(try_strptime(trim(date), '%Y%m%d') AS DATE)
    WHEN regexp_full_match(trim(date), '\\d{1,2}/\\d{1,2}/\\d{2}') THEN CAST(try_strptime(trim(date), '%d/%m/%y') AS DATE) END"""
CLEAN = f"""
cl AS (SELECT replace(trim(sector_code), '.', '') AS sector_code, trim(entity_type) AS entity_type, trim(ruc) AS ruc,
    trim(company_name) AS company_name, {DATE} AS date, trim(period_type) AS period_type, trim(account_code) AS account_code,
    trim(account_name) AS account_name, {NUM} AS value, trim(entity_subtype) AS entity_subtype, batch_seq, line_no, part_no
  FROM raw_statements)"""
GOOD = "good AS (SELECT * FROM cl WHERE regexp_full_match(ruc, '\\d{13}') AND account_code <> '' AND value IS NOT NULL)"
COLS = "sector_code, entity_type, ruc, company_name, date, period_type, account_code, account_name, value, entity_subtype"
PICK = "QUALIFY row_number() OVER (PARTITION BY ruc, account_code, date, period_type ORDER BY {0}) = 1"
UP, DOWN = "line_no, part_no", "line_no DESC, part_no DESC"

INGEST = {
    "read_statements": q("""SELECT sector_code, entity_type, NULLIF(ruc, '') AS ruc, company_name, date, period_type, NULLIF(account_code, '') AS account_code,
        account_name, value, NULLIF(entity_subtype, '') AS entity_subtype, count(*) AS copies FROM raw_statements GROUP BY ALL""", "raw_statements"),
    "file_profile": """SELECT 'UTF-8' AS encoding, CASE 1 + l_linenumber % 2 WHEN 1 THEN chr(9) ELSE ';' END AS separator, CAST(10 AS INT) AS fields
        FROM lineitem GROUP BY ALL""",
    "read_table": q("SELECT CAST(id_factura AS VARCHAR) AS id_factura, CAST(id_cliente AS VARCHAR) AS id_cliente, fecha_emision, estado FROM facturas", "facturas"),
    "read_portal_table": q('SELECT ruc_emisor AS "RUC_EMISOR", clave_acceso AS "CLAVE_ACCESO", importe_total AS "IMPORTE_TOTAL" FROM comprobantes', "comprobantes"),
    "read_entities": q("SELECT entity_type, company_name, line_no, part_no FROM raw_statements WHERE entity_type = 'Casa de Valores '", "raw_statements"),
    "clean_number": q(f"SELECT value AS raw_value, {NUM} AS value, count(*) AS n FROM raw_statements GROUP BY 1, 2", "raw_statements"),
    "clean_date": q(f"SELECT date AS raw_date, {DATE} AS date, count(*) AS n FROM raw_statements GROUP BY 1, 2", "raw_statements"),
    "clean_statements": q(f"SELECT {COLS} FROM good {PICK.format(UP)}", "raw_statements", CLEAN, GOOD),
    "dedup_key": q(f"SELECT {COLS} FROM good {PICK.format(DOWN)}", "raw_statements", CLEAN, GOOD),
    "sector_filter": q(f"""SELECT {COLS} FROM good WHERE contains(upper(entity_type), 'ADMINISTRADORA DE FONDOS Y FIDEICOMISOS')
        {PICK.format(DOWN)}""", "raw_statements", CLEAN, GOOD),
    "load_first_wins": q(f"SELECT {COLS}, batch_seq FROM good {PICK.format('batch_seq, ' + UP)}", "raw_statements", CLEAN, GOOD),
    "load_last_wins": q(f"SELECT {COLS}, batch_seq FROM good {PICK.format('batch_seq DESC, ' + DOWN)}", "raw_statements", CLEAN, GOOD),
    "table_first_wins": q(f"SELECT {COLS}, batch_seq FROM good {PICK.format('batch_seq, ' + UP)}", "raw_statements", CLEAN, GOOD),
    "table_last_wins": q(f"SELECT {COLS}, batch_seq FROM good {PICK.format('batch_seq DESC, ' + DOWN)}", "raw_statements", CLEAN, GOOD),
    "high_water_mark": q("SELECT max(date) AS last_date, count(*) AS records FROM good", "raw_statements", CLEAN, GOOD),
    "run_metrics": q("""SELECT (SELECT count(*) FROM cl) AS rows_read,
        (SELECT count(DISTINCT (ruc, account_code, coalesce(date, DATE '0001-01-01'), period_type)) FROM good) AS rows_loaded,
        (SELECT count(*) FROM cl) - (SELECT count(*) FROM good) AS rows_unusable,
        (SELECT count(*) FROM cl WHERE value IS NULL) AS rows_without_value,
        (SELECT count(*) FROM cl) - (SELECT count(DISTINCT (ruc, account_code, coalesce(date, DATE '0001-01-01'), period_type)) FROM good) AS rows_discarded""", "raw_statements", CLEAN, GOOD),
    "q_nulls": q("""SELECT 'missing ruc' AS metric, '' AS item, count(*) FILTER (trim(ruc) = '') AS n FROM raw_statements
        UNION ALL SELECT 'missing value', '', count(*) FILTER (coalesce(trim(value), '') = '') FROM raw_statements
        UNION ALL SELECT 'missing account_code', '', count(*) FILTER (trim(account_code) = '') FROM raw_statements
        UNION ALL SELECT 'ruc length', ruc, count(*) FROM raw_statements WHERE length(ruc) <> 13 GROUP BY 2""", "raw_statements"),
    "q_dates": q("""SELECT 'not ISO' AS metric, '' AS item, count(*) FILTER (NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}')) AS n FROM raw_statements
        UNION ALL SELECT 'year outside range', date, count(*) FROM raw_statements
        WHERE regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') AND CAST(left(date, 4) AS INT) NOT BETWEEN 2000 AND 2030 GROUP BY 2""", "raw_statements"),
    "q_domains": q(f"""SELECT count(*) AS rows,
        count(*) FILTER (trim(period_type) NOT IN ('ANUAL', 'MENSUAL', 'TRIMESTRAL', 'SEMESTRAL')) AS unknown_period_type,
        count(*) FILTER ({NUM} IS NULL) AS value_missing, count(*) FILTER (NOT isfinite({NUM})) AS value_not_finite
        FROM raw_statements""", "raw_statements"),
    "roster_import": q("""SELECT fila, ced AS cedula, nom AS nombre, ape AS apellido, NULLIF(em, '') AS email,
        CASE WHEN res = 'insertado' THEN coalesce(gid, 24) END AS grupo_id, res AS resultado,
        CASE WHEN res = 'error' THEN 'Fila ' || fila || ': cedula, nombre y apellido son obligatorios.' END AS mensaje
      FROM (SELECT *, (SELECT any_value(n_nationkey) FROM nation WHERE n_nationkey = try_cast(NULLIF(g, '') AS INT)) AS gid,
               CASE WHEN ced = '' OR nom = '' OR ape = '' THEN 'error'
                    WHEN ced IN (SELECT cedula FROM empleados WHERE NOT activo) THEN 'omitido'
                    WHEN row_number() OVER (PARTITION BY ced, (nom = '' OR ape = '') ORDER BY fila) > 1 THEN 'omitido'
                    ELSE 'insertado' END AS res
            FROM (SELECT fila, trim(cedula) AS ced, trim(nombre) AS nom, trim(apellido) AS ape, trim(email) AS em, trim(grupo_id) AS g FROM nomina_csv)
            WHERE ced || nom || ape || em || g <> '')""", "nomina_csv", "empleados"),
    "row_visibility": q("""SELECT CAST(1 AS BIGINT) AS usuario, id, cedula, grupo_id FROM empleados WHERE grupo_id IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)
        UNION ALL SELECT 0, id, cedula, grupo_id FROM empleados""", "empleados"),
    "text_search": q("SELECT id, cedula, apellidos, nombres FROM empleados WHERE concat_ws('|', cedula, apellidos, nombres) ILIKE '%mach%' OR cedula ILIKE '%mach%'", "empleados"),
    "email_valid": q("SELECT id, email, regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS email_valido FROM empleados", "empleados"),
    "national_id_valid": q("""SELECT id, cedula, (CAST(left(cedula, 2) AS INT) BETWEEN 1 AND 24 OR left(cedula, 2) = '30')
          AND CAST(cedula[3] AS INT) <= 5
          AND (10 - list_sum(list_transform(range(1, 10), lambda i: CASE WHEN CAST(cedula[i] AS INT) * (1 + i % 2) > 9
                THEN CAST(cedula[i] AS INT) * (1 + i % 2) - 9 ELSE CAST(cedula[i] AS INT) * (1 + i % 2) END)) % 10) % 10
              = CAST(cedula[10] AS INT) AS valida FROM empleados""", "empleados"),
    "ruc_valid": q("""SELECT id, ruc_proveedor, CASE
          WHEN NOT regexp_full_match(ruc_proveedor, '[0-9]{13}') THEN 'RUC ''' || ruc_proveedor
            || ''' inválido: debe contener exactamente 13 dígitos numéricos (tiene ' || length(ruc_proveedor) || ' caracteres).'
          WHEN right(ruc_proveedor, 3) <> '001' THEN 'RUC ''' || ruc_proveedor
            || ''' inválido: los tres últimos dígitos deben ser ''001'' (tiene ''' || right(ruc_proveedor, 3) || ''').' END AS motivo
        FROM compras""", "compras"),
    "service_span": q("""SELECT id, fecha_ingreso,
        greatest(date_diff('year', fecha_ingreso, DATE '2024-01-31') - (strftime(fecha_ingreso, '%m%d') > '0131')::INT, 0) AS anios,
        date_diff('month', fecha_ingreso, DATE '2024-01-31') AS meses, abs(DATE '2024-01-31' - fecha_ingreso) AS dias FROM empleados""", "empleados"),
    "account_depth": q("""SELECT DISTINCT account_code, CASE WHEN contains(account_code, '.') THEN len(string_split(account_code, '.'))
          ELSE CASE length(account_code) WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 4 END END AS depth,
        CASE WHEN contains(account_code, '.') THEN CASE len(string_split(account_code, '.')) WHEN 2 THEN 'grupo' WHEN 3 THEN 'subgrupo' ELSE 'detalle' END
          ELSE CASE length(account_code) WHEN 1 THEN 'clase' WHEN 3 THEN 'grupo' WHEN 5 THEN 'subgrupo' ELSE 'detalle' END END AS label,
        split_part(account_code, '.', 1) AS root_segment FROM raw_statements WHERE account_code <> ''""", "raw_statements"),
    "file_keys": """SELECT c_custkey AS id, left(regexp_replace(trim(regexp_replace(upper(c_name || ' / ' || c_mktsegment || ' & Cía.'), '[^\\p{L}\\p{N}_\\s-]', '', 'g')), '\\s+', '_', 'g'), 60) AS clave FROM customer""",
    "notice_text": q("""SELECT id, 'Nómina – enero 2024 | Empresa Demo' AS asunto, 'Estimado/a ' || nombres || ' ' || apellidos || ', adjuntamos tu documento del período enero 2024. Empresa Demo' AS cuerpo
        FROM empleados""", "empleados"),
}
INGEST["read_mixed_statements"] = INGEST["read_statements"]

AGE = f"""
aged AS (SELECT *, CASE WHEN saldo_pendiente = 0 THEN 'Pagada' WHEN coalesce(dias_vencido, 0) = 0 THEN 'Vigente'
      WHEN dias_vencido <= 30 THEN '1-30 días' WHEN dias_vencido <= 60 THEN '31-60 días' WHEN dias_vencido <= 90 THEN '61-90 días'
      ELSE '+90 días' END AS aging_bucket,
    saldo_pendiente > 0 AND fecha_vencimiento - {DAY} BETWEEN 0 AND 7 AS alerta_por_vencer
  FROM (SELECT f.*, nombre_comercial, segmento,
               CASE WHEN saldo_pendiente > 0 THEN greatest({DAY} - fecha_vencimiento, 0) END AS dias_vencido
        FROM facturas f LEFT JOIN clientes USING (id_cliente)))"""
LATE = "aging_bucket IN ('1-30 días', '31-60 días', '61-90 días', '+90 días')"
RCV = ("facturas", "clientes", AGE)


def Z(test: str, col: str = "saldo_pendiente") -> str:
    return f"coalesce(sum({col}) FILTER ({test}), 0)"


MORA = f"{D(Z(LATE))} / NULLIF({D('sum(saldo_pendiente)')}, 0)"
AGING = {
    "aging_join": q(f"""SELECT id_factura, f.id_cliente, nombre_comercial, segmento, {D('limite_credito')} AS limite_credito, {D('saldo_pendiente')} AS saldo_pendiente
        FROM facturas f LEFT JOIN clientes c ON c.id_cliente = f.id_cliente""", "facturas", "clientes"),
    "aging_buckets": q(f"""SELECT id_factura, id_cliente, nombre_comercial, segmento, fecha_emision, fecha_vencimiento, termino_dias,
        {D('monto_total')} AS monto_total, {D('saldo_pendiente')} AS saldo_pendiente, estado, dias_vencido, aging_bucket, alerta_por_vencer FROM aged""", *RCV),
    "aging_summary": q(f"""SELECT aging_bucket, list_position(['Pagada', 'Vigente', '1-30 días', '31-60 días', '61-90 días', '+90 días'], aging_bucket) AS bucket_order,
        count(*) AS n_facturas, {D('sum(saldo_pendiente)')} AS saldo_total, {PCT('sum(saldo_pendiente)', 'sum(sum(saldo_pendiente)) OVER ()')} AS pct_saldo
        FROM aged GROUP BY 1""", *RCV),
    "aging_by_segment": q(f"SELECT segmento, aging_bucket, {D('sum(saldo_pendiente)')} AS saldo FROM aged WHERE saldo_pendiente > 0 GROUP BY 1, 2", *RCV),
    "top_debtors": q(f"""SELECT id_cliente, nombre_comercial, segmento, {D('sum(saldo_pendiente)')} AS saldo_vencido_total, count(*) AS n_facturas_vencidas
        FROM aged WHERE {LATE} AND nombre_comercial IS NOT NULL GROUP BY 1, 2, 3 ORDER BY sum(saldo_pendiente) DESC, 1 LIMIT 10""", *RCV),
    "due_soon": q(f"""SELECT id_factura, id_cliente, nombre_comercial, segmento, fecha_vencimiento, {D('monto_total')} AS monto_total,
        {D('saldo_pendiente')} AS saldo_pendiente FROM aged WHERE alerta_por_vencer""", *RCV),
    "bi_aging": q(f"""SELECT count(*) AS total_facturas, count(*) FILTER ({LATE}) AS facturas_vencidas,
        count(*) FILTER (aging_bucket = 'Vigente') AS facturas_vigentes, count(*) FILTER (aging_bucket = 'Pagada') AS facturas_pagadas,
        {D('sum(saldo_pendiente)')} AS saldo_total, {D(Z(LATE))} AS saldo_vencido,
        {D(Z("aging_bucket = 'Vigente'"))} AS saldo_vigente, {D(Z("aging_bucket = '1-30 días'"))} AS saldo_1_30,
        {D(Z("aging_bucket = '31-60 días'"))} AS saldo_31_60, {D(Z("aging_bucket = '61-90 días'"))} AS saldo_61_90,
        {D(Z("aging_bucket = '+90 días'"))} AS saldo_mas_90,
        {C(Z("aging_bucket = '1-30 días'") + " * 0.01 + " + Z("aging_bucket = '31-60 días'") + " * 0.05 + " + Z("aging_bucket = '61-90 días'") + " * 0.2 + " + Z("aging_bucket = '+90 días'") + " * 0.5")} AS provision_estimada,
        round(avg(dias_vencido) FILTER ({LATE} AND dias_vencido > 0), 4) AS dias_promedio_mora,
        round(avg({DAY} - fecha_emision) FILTER (saldo_pendiente > 0), 4) AS antiguedad_promedio,
        count(*) FILTER (alerta_por_vencer) AS facturas_por_vencer_7d, {D(Z('alerta_por_vencer'))} AS saldo_por_vencer_7d,
        (SELECT {D('sum(s)')} FROM (SELECT sum(saldo_pendiente) AS s FROM aged WHERE {LATE} GROUP BY nombre_comercial ORDER BY s DESC LIMIT 10)) AS top_n_deudores_saldo,
        round({MORA}, 6) AS pct_morosidad, round(count(*) FILTER (aging_bucket = 'Pagada') / count(*), 6) AS indice_recuperacion,
        CASE WHEN {MORA} <= 0.1 THEN 'Verde' WHEN {MORA} <= 0.25 THEN 'Amarillo' ELSE 'Rojo' END AS semaforo,
        CASE WHEN {MORA} <= 0.1 THEN 1 WHEN {MORA} <= 0.25 THEN 2 ELSE 3 END AS semaforo_valor FROM aged""", *RCV),
    "bi_aging_by_month": q(f"""SELECT strftime(fecha_emision, '%Y-%m') AS mes, 'T' || quarter(fecha_emision) || ' ' || year(fecha_emision) AS trimestre,
        CASE WHEN monto_total < 1000 THEN '< $1,000' WHEN monto_total < 5000 THEN '$1,000 - $4,999' WHEN monto_total < 20000 THEN '$5,000 - $19,999'
             WHEN monto_total < 50000 THEN '$20,000 - $49,999' ELSE '>= $50,000' END AS rango_monto,
        {D('sum(monto_total)')} AS monto, count(*) AS cantidad FROM aged GROUP BY 1, 2, 3""", *RCV),
}

SEM = f"""
sem AS (SELECT *, CASE WHEN dias_para_vencer < 15 THEN 'Rojo' WHEN dias_para_vencer <= 30 THEN 'Amarillo' ELSE 'Verde' END AS estado_semaforo
  FROM (SELECT *, fecha_vencimiento - {DAY} AS dias_para_vencer FROM obligaciones))"""
ONB = ("obligaciones", SEM)
SUBJ = "'[ALERTA ' || dias_para_vencer || 'd] Vence ''' || tipo || ''' — ' || entidad_relacionada"
RED = "count(*) FILTER (dias_para_vencer < 15) / count(*)"
CONTRACTS = {
    "contract_semaphore": q(f"""SELECT * REPLACE ({D('valor_usd')} AS valor_usd),
        CASE estado_semaforo WHEN 'Rojo' THEN 0 WHEN 'Amarillo' THEN 1 ELSE 2 END AS orden FROM sem""", *ONB),
    "contract_alerts": q(f"""SELECT id_obligacion, tipo, responsable_interno, fecha_vencimiento, dias_para_vencer, {D('valor_usd')} AS valor_usd,
        {SUBJ} AS asunto, CASE WHEN length({SUBJ}) > 40 THEN left({SUBJ}, 40) || '…' ELSE {SUBJ} END AS asunto_corto,
        concat_ws(chr(10), 'Para: ' || responsable_interno, 'ID de Obligación: ' || id_obligacion, 'Tipo: ' || tipo, 'Entidad: ' || entidad_relacionada,
          'Fecha de Vencimiento: ' || fecha_vencimiento, 'Días Restantes: ' || dias_para_vencer,
          'Valor en Riesgo: USD ' || format('{{:,.2f}}', {D('valor_usd')})) AS mensaje
        FROM sem WHERE dias_para_vencer IN (7, 15, 30)""", *ONB),
    "contract_alert_counts": q("SELECT dias_para_vencer, count(*) AS total, 'dry_run' AS modo FROM sem WHERE dias_para_vencer IN (7, 15, 30) GROUP BY 1", *ONB),
    "contract_dash": q(f"""SELECT count(*) AS total, count(*) FILTER (estado_semaforo = 'Rojo') AS rojos, count(*) FILTER (estado_semaforo = 'Amarillo') AS amarillos,
        count(*) FILTER (estado_semaforo = 'Verde') AS verdes, {D("sum(valor_usd) FILTER (estado_semaforo <> 'Verde')")} AS valor_riesgo,
        round(count(*) FILTER (estado_semaforo = 'Rojo') * 100.0 / count(*), 1) AS pct_critico FROM sem""", *ONB),
    "contract_by_type": q("SELECT tipo, estado_semaforo, count(*) AS cantidad FROM sem GROUP BY 1, 2", *ONB),
    "contract_next_months": q("SELECT strftime(fecha_vencimiento, '%Y-%m') AS mes, estado_semaforo, count(*) AS n FROM sem WHERE dias_para_vencer BETWEEN 0 AND 90 GROUP BY 1, 2", *ONB),
    "contract_top_red": q(f"""SELECT id_obligacion, tipo, entidad_relacionada, dias_para_vencer, {D('valor_usd')} AS valor_usd, responsable_interno
        FROM sem WHERE estado_semaforo = 'Rojo' ORDER BY valor_usd DESC, id_obligacion LIMIT 5""", *ONB),
    "bi_contracts": q(f"""SELECT count(*) AS total_contratos, count(*) FILTER (dias_para_vencer >= 0) AS contratos_activos,
        count(*) FILTER (dias_para_vencer < 0) AS contratos_vencidos, count(*) FILTER (dias_para_vencer < 15) AS contratos_rojo,
        count(*) FILTER (dias_para_vencer BETWEEN 15 AND 30) AS contratos_amarillo, count(*) FILTER (dias_para_vencer > 30) AS contratos_verde,
        round(avg(dias_para_vencer), 4) AS dias_promedio, round(avg(dias_para_vencer) FILTER (dias_para_vencer >= 0), 4) AS dias_promedio_activos,
        {D('sum(valor_usd)')} AS monto_total, {D(Z('dias_para_vencer < 15', 'valor_usd'))} AS monto_en_riesgo,
        {D(Z('dias_para_vencer BETWEEN 15 AND 30', 'valor_usd'))} AS monto_alerta, {D(Z('dias_para_vencer <= 30', 'valor_usd'))} AS monto_rojo_y_amarillo,
        count(*) FILTER (fecha_vencimiento BETWEEN {DAY} AND {DAY} + (7 - isodow({DAY}))::INT) AS vencen_esta_semana,
        count(*) FILTER (fecha_vencimiento BETWEEN {DAY} AND last_day({DAY})) AS vencen_este_mes,
        round(count(*) FILTER (dias_para_vencer <= 30) / count(*), 6) AS pct_en_riesgo,
        CASE WHEN {RED} > 0.3 THEN 'CRITICO - Mas del 30% en rojo' WHEN {RED} > 0.15 THEN 'ALERTA - Entre 15% y 30% en rojo'
             WHEN {RED} > 0.05 THEN 'PRECAUCION - Entre 5% y 15% en rojo' ELSE 'ESTABLE - Menos del 5% en rojo' END AS estado_general,
        CASE WHEN {RED} > 0.3 THEN 'Rojo' WHEN {RED} > 0.15 THEN 'Amarillo' ELSE 'Verde' END AS color_general FROM sem""", *ONB),
    "bi_contracts_grouped": q(" UNION ALL ".join(f"""SELECT '{dim}' AS dimension, {col} AS valor, count(*) AS contratos, count(*) FILTER (dias_para_vencer < 15) AS rojo,
        count(*) FILTER (dias_para_vencer BETWEEN 15 AND 30) AS amarillo, count(*) FILTER (dias_para_vencer > 30) AS verde, {D('sum(valor_usd)')} AS monto
        FROM sem GROUP BY 2""" for dim, col in (("tipo", "tipo"), ("responsable", "responsable_interno"))), *ONB),
    "bi_contracts_by_month": q(f"""SELECT mes, trimestre, n AS vencimientos, {D('m')} AS monto, f AS futuros, sum(x) OVER w AS acumulado_vencidos,
        {D('sum(y) OVER w')} AS acumulado_monto_vencido
        FROM (SELECT strftime(fecha_vencimiento, '%Y-%m') AS mes, any_value('T' || quarter(fecha_vencimiento) || ' ' || year(fecha_vencimiento)) AS trimestre,
              count(*) AS n, sum(valor_usd) AS m, count(*) FILTER (dias_para_vencer >= 0) AS f, count(*) FILTER (dias_para_vencer < 0) AS x,
              {Z('dias_para_vencer < 0', 'valor_usd')} AS y FROM sem GROUP BY 1) WINDOW w AS (ORDER BY mes)""", *ONB),
}

CMP = f"""
cmp AS (SELECT nombre, {D('precio_empresa')} AS precio_empresa, {D('precio_competidor')} AS precio_competidor, disponibilidad,
    {D('precio_empresa - precio_competidor')} AS diff_absoluta, precio_empresa - precio_competidor AS dx, precio_empresa AS px, precio_competidor AS cx,
    round({D('precio_empresa - precio_competidor')} / {D('precio_empresa')} * 100, 2) AS diff_porcentual
  FROM precios_propios JOIN precios_competidor USING (nombre))"""
PRC = ("precios_propios", "precios_competidor", CMP)
URG = "CASE WHEN diff_porcentual >= 10 THEN 'Alta' WHEN diff_porcentual >= 3 THEN 'Media' WHEN diff_porcentual >= 0 THEN 'Baja' ELSE 'Sin accion' END"
CHEAP = "count(*) FILTER (diff_porcentual <= 0) / count(*)"
BASE_COLS = "nombre, precio_empresa, precio_competidor, disponibilidad, diff_absoluta, diff_porcentual"
PRICES = {
    "price_compare": q("SELECT p.nombre, disponibilidad, codigo FROM precios_propios p JOIN precios_competidor c ON c.nombre = p.nombre", "precios_propios", "precios_competidor"),
    "price_diff": q(f"SELECT {BASE_COLS} FROM cmp", *PRC),
    "price_alerts": q(f"SELECT {BASE_COLS}, {D('dx * 50')} AS perdida_mensual, {URG} AS urgencia FROM cmp WHERE diff_porcentual > 3", *PRC),
    "price_alert_impact": q(f"""SELECT count(*) AS alertas, {D('sum(dx) * 50')} AS perdida_total, first(nombre ORDER BY dx DESC, nombre DESC) AS mayor_perdida_sku,
        {D('max(dx) * 50')} AS mayor_perdida_monto, count(*) FILTER (diff_porcentual >= 10) AS criticos,
        CASE WHEN count(*) FILTER (diff_porcentual >= 10) >= 3 THEN 'CRÍTICA' WHEN count(*) FILTER (diff_porcentual >= 10) >= 1 THEN 'MODERADA' ELSE 'BAJA' END AS nivel_alerta,
        round({R('sum(dx) * 50', 'count(*)')}, 4) AS perdida_promedio FROM cmp WHERE diff_porcentual > 3""", *PRC),
    "price_classes": q(f"""SELECT {BASE_COLS}, CASE WHEN diff_porcentual > 1 THEN 'Desventaja' WHEN diff_porcentual < -1 THEN 'Ventaja' ELSE 'Neutral' END AS clasificacion,
        CASE WHEN diff_porcentual >= 10 THEN '10%+ (Critico)' WHEN diff_porcentual >= 5 THEN '5% a 9.9%' WHEN diff_porcentual >= 3 THEN '3% a 4.9% (Alerta)'
             WHEN diff_porcentual >= 0 THEN '0% a 2.9% (Aceptable)' WHEN diff_porcentual >= -5 THEN '-5% a -0.1% (Ventaja)'
             ELSE 'Mas de -5% (Gran Ventaja)' END AS rango_diferencia, {URG} AS urgencia FROM cmp""", *PRC),
    "bi_prices": q(f"""SELECT count(*) AS total_productos, count(*) FILTER (diff_porcentual > 0) AS mas_caros, count(*) FILTER (diff_porcentual < 0) AS mas_baratos,
        round({D('sum(dx)')} / count(*), 4) AS diferencia_promedio_usd, round({D('sum(CAST(diff_porcentual AS DECIMAL(12,2)))')} / count(*), 4) AS diferencia_promedio_pct,
        {D('sum(dx) FILTER (diff_porcentual > 0) * 50')} AS impacto_mensual, count(*) FILTER (diff_porcentual > 3) AS alerta_critica,
        {D('sum(dx) FILTER (dx > 0) * 50')} AS ahorro_potencial, round({D('sum(px)')} / count(*), 4) AS precio_promedio_propio,
        round({D('sum(cx)')} / count(*), 4) AS precio_promedio_competidor, max(diff_porcentual) AS mayor_diferencia_positiva,
        min(diff_porcentual) AS mayor_diferencia_negativa, first(nombre ORDER BY diff_porcentual DESC, nombre) AS producto_mayor_sobrecoste,
        first(nombre ORDER BY diff_porcentual, nombre) AS producto_mayor_ventaja, count(*) FILTER (diff_porcentual >= 10) AS rango_critico,
        count(*) FILTER (diff_porcentual >= 3 AND diff_porcentual < 10) AS rango_moderado, count(*) FILTER (diff_porcentual >= 0 AND diff_porcentual < 3) AS rango_aceptable,
        count(*) FILTER (diff_porcentual < 0) AS con_ventaja, round({CHEAP}, 6) AS pct_competitividad,
        CASE WHEN {CHEAP} >= 0.7 THEN 'Verde' WHEN {CHEAP} >= 0.5 THEN 'Amarillo' ELSE 'Rojo' END AS semaforo,
        CASE WHEN {CHEAP} >= 0.7 THEN 3 WHEN {CHEAP} >= 0.5 THEN 2 ELSE 1 END AS semaforo_valor,
        CASE WHEN count(*) FILTER (diff_porcentual >= 10) >= 3 THEN 'CRITICA' WHEN count(*) FILTER (diff_porcentual >= 10) >= 1 THEN 'MODERADA' ELSE 'BAJA' END AS nivel_alerta
        FROM cmp""", *PRC),
    "page_products": q("""SELECT page_id, regexp_extract(card, 'title="([^"]*)"', 1) AS nombre,
          try_cast(regexp_replace(regexp_extract(card, 'price_color">([^<]*)<', 1), '[£$,]', '', 'g') AS DOUBLE) AS precio_competidor,
          CASE WHEN contains(card, 'In stock') THEN 'In Stock' WHEN contains(card, 'Out of stock') THEN 'Out of Stock' ELSE 'Bajo pedido' END AS disponibilidad
        FROM (SELECT page_id, unnest(string_split(html, '<article class="product_pod">')[2:]) AS card FROM listados)
        WHERE contains(card, 'price_color')""", "listados"),
}

CN = "try_cast(replace(trim({0}), ',', '.') AS DOUBLE)"
TAXX = f"""
tx AS (SELECT c.clave_acceso, c.ruc_emisor, c.numero, {CN.format('valor_sin_impuestos')} AS valor_sin_impuestos, {CN.format('iva')} AS iva,
    {CN.format('importe_total')} AS importe_total, {CN.format('base_imponible')} AS ret_base_imponible, {CN.format('valor_retenido')} AS ret_valor_retenido,
    doc_sustento IS NULL AS sin_retencion
  FROM comprobantes c LEFT JOIN retenciones r ON r.doc_sustento = c.clave_acceso),
tx2 AS (SELECT *, NOT sin_retencion AND round(abs(coalesce(valor_sin_impuestos, 0) - coalesce(ret_base_imponible, 0)), 6) > 0.01 AS diff_monto FROM tx)"""
VAL = """
val AS (SELECT *, motivo_error IS NULL AS valido FROM (SELECT *, NULLIF(concat_ws(' | ',
    CASE WHEN NOT regexp_full_match(ruc_proveedor, '[0-9]{13}') THEN 'RUC ''' || ruc_proveedor
            || ''' inválido: debe contener exactamente 13 dígitos numéricos (tiene ' || length(ruc_proveedor) || ' caracteres).'
         WHEN right(ruc_proveedor, 3) <> '001' THEN 'RUC ''' || ruc_proveedor
            || ''' inválido: los tres últimos dígitos deben ser ''001'' (tiene ''' || right(ruc_proveedor, 3) || ''').' END,
    CASE WHEN abs(valor_retenido_iva - esp) > 0.02 THEN 'Retención IVA no cuadra: esperado $' || CAST(esp AS DECIMAL(18,2)) || ' (IVA $' || monto_iva || ' × '
            || CAST(porcentaje_retencion_iva * 100 AS INT) || '%), registrado $' || valor_retenido_iva || ' (diferencia $'
            || CAST(abs(valor_retenido_iva - esp) AS DECIMAL(18,2)) || ').' END), '') AS motivo_error
  FROM (SELECT *, round(monto_iva * porcentaje_retencion_iva, 2) AS esp FROM compras)))"""
TAX = {
    "invoice_withholding": q("""SELECT clave_acceso, c.numero, doc_sustento AS ret_doc_sustento, r.base_imponible AS ret_base_imponible, doc_sustento IS NULL AS sin_retencion
        FROM comprobantes c LEFT JOIN retenciones r ON r.doc_sustento = c.clave_acceso""", "comprobantes", "retenciones"),
    "tax_cross": q("SELECT * FROM tx2", "comprobantes", "retenciones", TAXX),
    "tax_cross_counts": q("SELECT count(*) AS total, count(*) FILTER (sin_retencion) AS sin_retencion, count(*) FILTER (diff_monto) AS diff_monto FROM tx2", "comprobantes", "retenciones", TAXX),
    "purchase_validation": q(f"SELECT id, ruc_proveedor, {D('monto_iva')} AS monto_iva, {D('valor_retenido_iva')} AS valor_retenido_iva, motivo_error, valido FROM val", "compras", VAL),
    "purchase_validation_summary": q("""SELECT count(*) AS procesados, count(*) FILTER (valido) AS validos, count(*) FILTER (NOT valido) AS con_errores,
        round(count(*) FILTER (valido) * 100.0 / count(*), 1) AS tasa_aprobacion FROM val""", "compras", VAL),
    "tax_annex_rows": q("""SELECT codigo_sustento AS "codSustento", '01' AS "tpIdProv", ruc_proveedor AS "idProv", tipo_comprobante AS "tipoComprobante", fecha_emision AS "fechaRegistro",
        establecimiento, punto_emision AS "puntoEmision", secuencial, autorizacion, CAST(base_no_gravada AS VARCHAR) AS "baseNoGraIva", CAST(base_imponible AS VARCHAR) AS "baseImponible",
        CAST(base_imponible AS VARCHAR) AS "baseImpGrav", CAST(monto_iva AS VARCHAR) AS "montoIva",
        CASE WHEN porcentaje_retencion_iva = 0.10 THEN CAST(valor_retenido_iva AS VARCHAR) ELSE '0.00' END AS "valRetBien10",
        CASE WHEN porcentaje_retencion_iva = 0.20 THEN CAST(valor_retenido_iva AS VARCHAR) ELSE '0.00' END AS "valRetServ20",
        CASE WHEN porcentaje_retencion_iva = 0.30 THEN CAST(valor_retenido_iva AS VARCHAR) ELSE '0.00' END AS "valorRetBienes",
        '0.00' AS "valRetServ50",
        CASE WHEN porcentaje_retencion_iva = 0.70 THEN CAST(valor_retenido_iva AS VARCHAR) ELSE '0.00' END AS "valorRetServicios",
        CASE WHEN porcentaje_retencion_iva = 1.00 THEN CAST(valor_retenido_iva AS VARCHAR) ELSE '0.00' END AS "valRetServ100",
        CAST(valor_retenido_renta AS VARCHAR) AS "valorRetRenta" FROM val WHERE valido""", "compras", VAL),
    "tax_annex_header": q("""SELECT 'R' AS "TipoIDInformante", '1790000000001' AS "IdInformante", 'Declarante' AS "razonSocial",
        right(fecha_emision, 4) AS "Anio", substr(fecha_emision, 4, 2) AS "Mes", count(*) AS compras FROM val WHERE valido GROUP BY 4, 5""", "compras", VAL),
}

SQL: dict[str, str] = {**INGEST, **AGING, **CONTRACTS, **PRICES, **TAX}
