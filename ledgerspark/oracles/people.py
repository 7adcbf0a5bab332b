"""DuckDB twins of personnel, matching, sales, retrieval and streaming queries."""

from __future__ import annotations

from ledgerspark.oracles.base import with_fs
from ledgerspark.oracles.finance import C, D, R
from ledgerspark.oracles.jobs import CLEAN, GOOD, q
from ledgerspark.plans.payroll import TAX_BRACKETS
from ledgerspark.sources.adapters import AS_OF

DAY = f"DATE '{AS_OF}'"
NAME = "apellidos || ' ' || nombres"

HOURS = f"""
hrs AS (SELECT empleado_id, fecha, {C("CASE WHEN libre THEN 0 ELSE least(w, 480) END / 60.0::DOUBLE")} AS horas_normales,
    {C("CASE WHEN libre THEN 0 ELSE greatest(w - 480, 0) END / 60.0::DOUBLE")} AS horas_suplementarias,
    {C("CASE WHEN libre THEN w ELSE 0 END / 60.0::DOUBLE")} AS horas_extraordinarias, greatest(entrada_min - 480, 0) AS atraso_minutos
  FROM (SELECT *, greatest(salida_min - entrada_min - 60, 0) AS w, isodow(fecha) >= 6 OR fecha = DATE '2024-01-01' AS libre FROM asistencia))"""
TRAMO = "CASE " + " ".join(
    f"WHEN b BETWEEN {lo} AND {hi} THEN {amt}::DOUBLE + (b - {lo}::DOUBLE) * {pct}::DOUBLE / 100.0::DOUBLE" for lo, hi, amt, pct in TAX_BRACKETS
) + " ELSE 0 END"


def IR(col: str) -> str:
    """Monthly withholding of a column; written as a correlated value so that the base is computed once."""
    base = f"({col} * 12 - {C(col + ' * 0.0945::DOUBLE')} * 12)"
    tramo = TRAMO.replace("b BETWEEN", f"{base} BETWEEN").replace("(b -", f"({base} -")
    return f"CASE WHEN {base} <= 0 THEN 0 ELSE {C(f'({tramo}) / 12')} END"


SLIP = f"""
pay AS (SELECT *, {C('ing * 0.0945::DOUBLE')} AS aporte, {IR('ing')} AS ir FROM (
    SELECT *, s + sv + ev + com + bon + oin AS ing FROM (
      SELECT e.id, e.cedula, e.fecha_ingreso, {D('sueldo_base')} AS s,
             coalesce(h.su, 0) * ({D('sueldo_base')} / 240) * 1.5::DOUBLE AS sv, coalesce(h.ex, 0) * ({D('sueldo_base')} / 240) * 2::DOUBLE AS ev,
             coalesce(h.la, 0) * ({D('sueldo_base')} / 240 / 60) AS mul, coalesce({D('l.qu')}, 0) AS qu, coalesce({D('l.hi')}, 0) AS hi,
             coalesce({D('comisiones')}, 0) AS com, coalesce({D('bonos')}, 0) AS bon, coalesce({D('otros_ingresos')}, 0) AS oin,
             coalesce({D('anticipo_sueldo')}, 0) AS ant, coalesce({D('pension_alimenticia')}, 0) AS pen, coalesce({D('otras_deducciones')}, 0) AS ode
      FROM empleados e
      LEFT JOIN (SELECT empleado_id, sum(horas_suplementarias) AS su, sum(horas_extraordinarias) AS ex, sum(atraso_minutos) AS la
                 FROM hrs WHERE fecha BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1) h ON h.empleado_id = e.id
      LEFT JOIN (SELECT empleado_id, arg_max(cuota_mensual, id) FILTER (tipo = 'Quirografario') AS qu,
                        arg_max(cuota_mensual, id) FILTER (tipo = 'Hipotecario') AS hi FROM prestamos WHERE activo GROUP BY 1) l ON l.empleado_id = e.id
      LEFT JOIN borradores d ON d.empleado_id = e.id AND d.anio = 2024 AND d.mes = 1 WHERE e.activo)))"""
OUT = "(aporte + ir + mul + qu + hi + ant + pen + ode)"


def SPAN(a: str, b: str) -> str:
    return f"CASE WHEN fecha_ingreso > DATE '{a}' THEN least(greatest(DATE '{b}' - fecha_ingreso, 0), 360) ELSE 360 END"


HR = {
    "attendance_hours": q("SELECT * FROM hrs", "asistencia", HOURS),
    "income_tax": q(f"SELECT id, s AS sueldo_base, {IR('s')} AS retencion_ir FROM (SELECT id, {D('sueldo_base')} AS s FROM empleados)", "empleados"),
    "benefit_config": q("""SELECT id, year(fecha_ingreso) + 13 AS anio, CASE WHEN year(fecha_ingreso) + 13 = 2026 THEN 470.0 END AS sbu,
        CASE WHEN year(fecha_ingreso) = 2013 THEN 9.45 END AS aporte_personal_pct, CASE WHEN year(fecha_ingreso) = 2013 THEN 11.15 END AS aporte_patronal_pct,
        CASE WHEN year(fecha_ingreso) = 2013 THEN 8.33 END AS fondos_reserva_pct FROM empleados""", "empleados"),
    "payroll_month": q(f"""SELECT id AS empleado_id, cedula, '2024-01' AS periodo, 1 AS mes, 2024 AS anio, s AS sueldo_base,
        {C('sv')} AS horas_suplementarias_valor, {C('ev')} AS horas_extraordinarias_valor, com AS comisiones, bon AS bonos, oin AS otros_ingresos,
        {C('ing')} AS total_ingresos, aporte AS aporte_iess, qu AS prestamo_quirografario, hi AS prestamo_hipotecario, ant AS anticipo_sueldo,
        pen AS pension_alimenticia, ir AS retencion_ir, {C('mul')} AS multas, ode AS otras_deducciones, {C(OUT)} AS total_deducciones,
        {C(f'ing - {OUT}')} AS neto_a_recibir, {C('ing * 0.1115::DOUBLE')} AS aporte_patronal, {C('ing / 12')} AS decimo_tercero_prov,
        round(470.0 / 12, 2) AS decimo_cuarto_prov,
        CASE WHEN date_diff('month', fecha_ingreso, DATE '2024-01-31') >= 13 THEN {C('ing * 0.0833::DOUBLE')} ELSE 0 END AS fondos_reserva_prov,
        {C('s * 15 / 360')} AS vacaciones_prov, 'Calculado' AS estado FROM pay""", "empleados", "asistencia", "prestamos", "borradores", HOURS, SLIP),
    "payroll_totals": q(f"""SELECT anio, mes, {D('sum(total_ingresos)')} AS total_ingresos, {D('sum(total_deducciones)')} AS total_deducciones,
        {D('sum(neto_a_recibir)')} AS total_neto, {D('sum(aporte_patronal)')} AS total_patronal, count(*) AS num_empleados FROM roles_pago GROUP BY 1, 2""", "roles_pago"),
    "hr_dashboard": q(f"""SELECT (SELECT count(*) FROM empleados WHERE activo) AS total_empleados,
        (SELECT count(*) FROM empleados WHERE activo AND tipo_contrato = 'Plazo Fijo' AND fecha_fin_contrato - {DAY} BETWEEN 0 AND 30) AS contratos_por_vencer,
        {D('sum(total_ingresos)')} AS ingresos, {D('sum(neto_a_recibir)')} AS neto, {D('sum(aporte_patronal)')} AS patronal,
        (SELECT count(*) FROM permisos WHERE estado = 'Pendiente') AS permisos_pendientes
        FROM roles_pago WHERE anio = 2001 AND mes = 8""", "empleados", "roles_pago", "permisos"),
    "hr_lists": q("""SELECT lista, empleado_id, l.id, estado, cedula, apellidos, nombres, cargo FROM (
        SELECT 'rol' AS lista, empleado_id, id, estado FROM roles_pago UNION ALL SELECT 'permiso', empleado_id, id, estado FROM permisos
        UNION ALL SELECT 'asistencia', empleado_id, CAST(strftime(fecha, '%Y%m%d') AS BIGINT), '' FROM asistencia
        UNION ALL SELECT 'prestamo', empleado_id, id, tipo FROM prestamos WHERE activo) l JOIN empleados e ON e.id = l.empleado_id""",
        "empleados", "roles_pago", "permisos", "asistencia", "prestamos"),
    "employee_detail": q("""SELECT 'rol' AS lista, empleado_id, row_number() OVER (PARTITION BY empleado_id ORDER BY periodo DESC) AS orden, id FROM roles_pago QUALIFY orden <= 12
        UNION ALL SELECT 'permiso', empleado_id, row_number() OVER (PARTITION BY empleado_id ORDER BY fecha_inicio DESC, id DESC) AS orden, id FROM permisos QUALIFY orden <= 10""",
        "roles_pago", "permisos"),
    "payroll_social_file": q("""SELECT cedula AS "CEDULA", apellidos AS "APELLIDOS", nombres AS "NOMBRES", CAST(r.sueldo_base AS VARCHAR) AS "SUELDO", '30' AS "DIAS_TRABAJADOS",
        CAST(horas_suplementarias_valor AS VARCHAR) AS "HORAS_SUPL", CAST(horas_extraordinarias_valor AS VARCHAR) AS "HORAS_EXTR", CAST(total_ingresos AS VARCHAR) AS "TOTAL_INGRESOS",
        CAST(aporte_iess AS VARCHAR) AS "APORTE_PERSONAL", CAST(aporte_patronal AS VARCHAR) AS "APORTE_PATRONAL", CAST(fondos_reserva_prov AS VARCHAR) AS "FONDOS_RESERVA"
        FROM roles_pago r JOIN empleados e ON e.id = r.empleado_id""", "roles_pago", "empleados"),
    "payroll_bank_file": q(f"""SELECT CASE WHEN tipo_cuenta = 'Ahorros' THEN 'AHO' ELSE 'CTE' END AS "TIPO_CUENTA", coalesce(cuenta_bancaria, '') AS "NUMERO_CUENTA", cedula AS "CEDULA",
        {NAME} AS "NOMBRES", CAST(neto_a_recibir AS VARCHAR) AS "MONTO", 'NOMINA ' || periodo AS "REFERENCIA"
        FROM roles_pago r JOIN empleados e ON e.id = r.empleado_id WHERE estado = 'Aprobado'""", "roles_pago", "empleados"),
    "bonus_13th": q(f"""SELECT e.id AS empleado_id, {NAME} AS empleado, 'Dic 1999 - Nov 2000' AS periodo, coalesce({D('t')}, 0) AS total_percibido,
        {SPAN('1999-12-01', '2000-11-30')} AS dias_trabajados, {C(f'coalesce({D("t")}, 0) / 12')} AS valor FROM empleados e
        LEFT JOIN (SELECT empleado_id, sum(total_ingresos) AS t FROM roles_pago WHERE estado <> 'Borrador' AND anio * 100 + mes BETWEEN 199912 AND 200011 GROUP BY 1) r ON r.empleado_id = e.id""",
        "empleados", "roles_pago"),
    "bonus_14th": q(f"""SELECT empleado_id, empleado, region, periodo, 470.0 AS sbu, d AS dias_trabajados, {C('470.0::DOUBLE * d / 360')} AS valor
        FROM (SELECT id AS empleado_id, {NAME} AS empleado, region,
              CASE WHEN region = 'Costa/Galápagos' THEN 'Mar 2023 - Feb 2024' ELSE 'Ago 2023 - Jul 2024' END AS periodo,
              CASE WHEN region = 'Costa/Galápagos' THEN {SPAN('2023-03-01', '2024-02-28')} ELSE {SPAN('2023-08-01', '2024-07-31')} END AS d FROM empleados)""", "empleados"),
    "vacation_days": q(f"""SELECT empleado_id, empleado, y AS anios_servicio, der AS dias_derecho, tom AS dias_tomados, greatest(der - tom, 0) AS dias_disponibles,
        {C('s / 30')} AS valor_diario, {C('(der - tom) * (s / 30)')} AS valor_total
        FROM (SELECT *, 15 + CASE WHEN y >= 5 THEN least(y - 4, 15) ELSE 0 END AS der FROM (
          SELECT e.id AS empleado_id, {NAME} AS empleado, {D('sueldo_base')} AS s, coalesce(p.t, 0) AS tom,
                 greatest(date_diff('year', fecha_ingreso, DATE '2024-01-31') - (strftime(fecha_ingreso, '%m%d') > '0131')::INT, 0) AS y
          FROM empleados e LEFT JOIN (SELECT empleado_id, sum(dias) AS t FROM permisos WHERE tipo = 'Vacaciones' AND estado = 'Aprobado'
            AND fecha_inicio >= DATE '2023-01-31' GROUP BY 1) p ON p.empleado_id = e.id))""", "empleados", "permisos"),
    "profit_share": q(f"""SELECT *, {C('valor_10 + valor_5')} AS total FROM (
        SELECT empleado_id, empleado, 2024 AS anio, d AS dias_trabajados, c AS cargas_familiares,
               coalesce({C('250000.0::DOUBLE * d / NULLIF(sum(d) OVER (), 0)')}, 0) AS valor_10,
               coalesce({C('125000.0::DOUBLE * (c * d) / NULLIF(sum(c * d) OVER (), 0)')}, 0) AS valor_5
        FROM (SELECT id AS empleado_id, {NAME} AS empleado, coalesce(cargas_familiares, 0) AS c,
              least(greatest(least(coalesce(fecha_salida, DATE '2024-12-31'), DATE '2024-12-31') - greatest(fecha_ingreso, DATE '2024-01-01'), 0), 360) AS d
              FROM empleados WHERE fecha_ingreso <= DATE '2024-12-31' AND (fecha_salida IS NULL OR fecha_salida >= DATE '2024-01-01')))""", "empleados"),
}

ANS = """
ans AS (SELECT ciclo_id, evaluado_id, criterio, tipo_evaluador, puntaje FROM respuestas r JOIN evaluaciones e ON e.id = r.evaluacion_id WHERE completada = 1)"""


def MEAN(test: str | None = None) -> str:
    f = f" FILTER ({test})" if test else ""
    return C(f"{D('sum(puntaje)' + f)} / NULLIF(count(puntaje){f}, 0)")


REP = f"""
rep AS (SELECT *, {C('promedio - promedio_ciclo')} AS diferencia, CASE WHEN promedio >= 4.5 THEN 'Excelente' WHEN promedio >= 3.5 THEN 'Bueno'
    WHEN promedio >= 2.5 THEN 'Regular' ELSE 'Por mejorar' END AS nivel
  FROM (SELECT ciclo_id, evaluado_id, criterio, {MEAN("tipo_evaluador = 'Jefe'")} AS jefe, {MEAN("tipo_evaluador = 'Par'")} AS par,
               {MEAN("tipo_evaluador = 'Subordinado'")} AS subordinado, {MEAN()} AS promedio, count(*) AS respuestas FROM ans GROUP BY 1, 2, 3)
  JOIN (SELECT ciclo_id, criterio, {MEAN()} AS promedio_ciclo FROM ans GROUP BY 1, 2) USING (ciclo_id, criterio))"""
EVAL = {
    "eval_cycle_progress": q("SELECT ciclo_id, count(*) AS total_eval, sum(completada) AS completadas, count(DISTINCT evaluado_id) AS total_evaluados FROM evaluaciones GROUP BY 1", "evaluaciones"),
    "eval_person_progress": q(f"""SELECT ciclo_id, evaluado_id, {NAME} AS nombre, cargo, count(*) AS total_eval, sum(completada) AS completadas
        FROM evaluaciones v JOIN empleados e ON e.id = v.evaluado_id GROUP BY ALL""", "evaluaciones", "empleados"),
    "eval_report": q("SELECT * FROM rep", "evaluaciones", "respuestas", ANS, REP),
    "eval_recommendations": q("""SELECT ciclo_id, evaluado_id, coalesce(string_agg('Criterio ' || criterio, ', ' ORDER BY criterio) FILTER (promedio >= 4), '') AS fortalezas,
        coalesce(string_agg('Criterio ' || criterio, ', ' ORDER BY criterio) FILTER (promedio < 3.5), '') AS mejoras FROM rep GROUP BY 1, 2""",
        "evaluaciones", "respuestas", ANS, REP),
}

MAPS = """
cand AS (SELECT cedula, archivo FROM empleados JOIN archivos ON contains(archivo, cedula)),
got AS (SELECT cedula, min(archivo) AS archivo FROM (SELECT archivo, min(cedula) AS cedula FROM cand GROUP BY 1) GROUP BY 1),
mail AS (SELECT *, regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS bueno FROM empleados),
prev AS (SELECT nombres || ' ' || apellidos AS empleado, cedula, coalesce(archivo, 'FALTANTE') AS pdf_asignado,
    CASE WHEN archivo IS NULL THEN 'error' WHEN bueno THEN 'ok' ELSE 'advertencia' END AS estado,
    CASE WHEN archivo IS NULL THEN 'Ningún PDF con esta cédula fue subido' WHEN bueno THEN 'Ninguna'
         ELSE 'Email ''' || email || ''' inválido/en blanco.' END AS advertencias
  FROM mail LEFT JOIN got USING (cedula)
  UNION ALL SELECT 'DESCONOCIDO', 'DESCONOCIDO', archivo, 'error', 'PDF no matchea con ninguna cédula del grupo'
  FROM archivos ANTI JOIN got USING (archivo))"""
MAPPING = {
    "document_mapping": q("SELECT * FROM prev", "empleados", "archivos", MAPS),
    "document_mapping_status": q("""SELECT count(*) FILTER (cedula <> 'DESCONOCIDO' AND pdf_asignado <> 'FALTANTE') AS asignados,
        count(*) FILTER (estado = 'advertencia') AS con_advertencia, count(*) FILTER (pdf_asignado = 'FALTANTE') AS sin_pdf,
        count(*) FILTER (cedula = 'DESCONOCIDO') AS sin_empleado, count(*) FILTER (estado = 'error') = 0 AS puede_ejecutar FROM prev""", "empleados", "archivos", MAPS),
    "batch_log": q("""SELECT grupo_id AS envio_id, id AS empleado_id, CASE WHEN bueno THEN 'ok' ELSE 'fallo' END AS estado,
        CASE WHEN NOT bueno THEN 'Email inválido o vacío' END AS error_message FROM mail""", "empleados", "archivos", MAPS),
    "batch_outcome": q("""SELECT grupo_id AS envio_id, count(*) AS total, count(*) FILTER (bueno) AS enviados_ok, count(*) FILTER (NOT bueno) AS enviados_fallo
        FROM mail GROUP BY 1""", "empleados", "archivos", MAPS),
    "quote_pricing": q("""SELECT id, tipo_servicio, horas, nivel_urgencia, t AS tarifa_hora, t * horas AS costo_base, t * horas * u AS recargo,
        t * horas * (1 + u) AS subtotal, t * horas * (1 + u) * 0.3 AS ganancia, round(t * horas * (1 + u) * 1.3, 2) AS precio_final,
        CASE WHEN t IS NULL THEN 'Tipo de servicio desconocido: ' || tipo_servicio END AS error
        FROM (SELECT *, CAST(CASE tipo_servicio WHEN 'Básico' THEN 50 WHEN 'Estándar' THEN 80 WHEN 'Premium' THEN 120 END AS DECIMAL(6,0)) AS t,
              CASE WHEN nivel_urgencia = 'Alto' THEN 0.2 ELSE 0.0 END AS u FROM solicitudes)""", "solicitudes"),
}

# Greedy 1:1 match: rows are numbered per amount; a recursion walks the days of every amount at once.
GREEDY = f"""
bl AS (SELECT *, row_number() OVER (PARTITION BY monto, fecha_transaccion ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS n FROM banco),
ll AS (SELECT *, row_number() OVER (PARTITION BY monto ORDER BY fecha_registro, md5(CAST(id AS VARCHAR)), id) - 1 AS n FROM libro),
dd AS MATERIALIZED (SELECT monto, fecha_transaccion AS d, count(*) AS b, row_number() OVER (PARTITION BY monto ORDER BY fecha_transaccion) AS k FROM banco GROUP BY 1, 2),
lc AS MATERIALIZED (SELECT monto, fecha_registro AS d, count(*) AS c FROM libro GROUP BY 1, 2),
lim AS MATERIALIZED (SELECT dd.monto, dd.d, dd.b, dd.k, coalesce(sum(c) FILTER (lc.d < dd.d - 3), 0) AS lo, coalesce(sum(c) FILTER (lc.d <= dd.d + 3), 0) AS hi
  FROM dd LEFT JOIN lc ON lc.monto = dd.monto GROUP BY 1, 2, 3, 4),
walk AS (SELECT monto, d, k, lo AS s, least(b, hi - lo) AS m FROM lim WHERE k = 1
  UNION ALL SELECT l.monto, l.d, l.k, greatest(w.s + w.m, l.lo), least(l.b, l.hi - greatest(w.s + w.m, l.lo)) FROM walk w JOIN lim l ON l.monto = w.monto AND l.k = w.k + 1),
pr AS (SELECT bl.id AS banco_id, ll.id AS libro_id FROM bl JOIN walk ON walk.monto = bl.monto AND walk.d = bl.fecha_transaccion AND bl.n < walk.m
  JOIN ll ON ll.monto = bl.monto AND ll.n = walk.s + bl.n),
rec AS (SELECT banco_id, libro_id, referencia, comprobante, b.monto, fecha_transaccion, fecha_registro, descripcion, concepto,
      abs(fecha_transaccion - fecha_registro) AS desfase_dias, CASE WHEN libro_id IS NULL THEN 'No registrada en contabilidad' ELSE 'Conciliado' END AS estado
    FROM (SELECT id AS banco_id, * EXCLUDE (id) FROM banco) b LEFT JOIN pr USING (banco_id) LEFT JOIN libro l ON l.id = pr.libro_id
  UNION ALL SELECT NULL, id, NULL, comprobante, monto, NULL, fecha_registro, NULL, concepto, NULL, 'Partida en tránsito (no está en banco)'
    FROM libro WHERE id NOT IN (SELECT libro_id FROM pr))"""
MATCH_RATE = "count(*) FILTER (estado = 'Conciliado') / count(*)"


def rec(body: str) -> str:
    return q(body, "banco", "libro", GREEDY).replace("WITH ", "WITH RECURSIVE ", 1)


RECONCILE = {
    "bank_reconcile": rec(f"SELECT * REPLACE ({D('monto')} AS monto) FROM rec"),
    "bi_reconciliation": rec(f"""SELECT count(*) AS total_transacciones, count(*) FILTER (estado = 'Conciliado') AS conciliadas,
        count(*) FILTER (banco_id IS NULL) AS faltantes_banco, count(*) FILTER (libro_id IS NULL) AS faltantes_contabilidad,
        {D("sum(monto) FILTER (estado = 'Conciliado')")} AS monto_conciliado, {D('sum(monto) FILTER (banco_id IS NULL)')} AS monto_faltante_banco,
        {D('sum(monto) FILTER (libro_id IS NULL)')} AS monto_faltante_contabilidad, {D('sum(monto) FILTER (banco_id IS NULL OR libro_id IS NULL)')} AS monto_en_riesgo,
        round(avg(desfase_dias), 4) AS promedio_desfase, count(*) FILTER (desfase_dias > 2) AS desfase_mayor_2,
        count(*) FILTER (estado = 'Conciliado' AND regexp_matches(descripcion, '(?i)depósito|recibida|cobro|abono')) AS conciliadas_deposito,
        round({MATCH_RATE}, 6) AS tasa_conciliacion, round({R("sum(monto) FILTER (estado = 'Conciliado')", 'sum(monto)')}, 6) AS pct_monto_conciliado,
        CASE WHEN {MATCH_RATE} > 0.9 THEN 'Óptimo' WHEN {MATCH_RATE} > 0.75 THEN 'Aceptable' ELSE 'Crítico' END AS semaforo FROM rec"""),
    "bi_reconciliation_gaps": rec("SELECT desfase_dias, count(*) AS cantidad FROM rec WHERE estado = 'Conciliado' GROUP BY 1"),
    "bi_reconciliation_running": rec(f"""SELECT fecha_transaccion, sum(count(*)) OVER (ORDER BY fecha_transaccion) AS acumulado,
        {D('sum(sum(monto)) OVER (ORDER BY fecha_transaccion)')} AS acumulado_monto FROM rec WHERE estado = 'Conciliado' GROUP BY 1"""),
    "bi_reconciliation_bands": rec(f"""SELECT CASE WHEN monto <= 500 THEN '0 - 500' WHEN monto <= 2000 THEN '500 - 2,000' WHEN monto <= 5000 THEN '2,000 - 5,000'
        WHEN monto <= 15000 THEN '5,000 - 15,000' ELSE 'Mayor a 15,000' END AS rango_monto, count(*) AS cantidad, {D('sum(monto)')} AS monto
        FROM rec WHERE estado = 'Conciliado' GROUP BY 1"""),
}

TOPE = """
tope AS (SELECT company_name FROM (SELECT company_name, sum(abs(value)) AS s FROM fs GROUP BY 1) ORDER BY s DESC, company_name LIMIT 10)"""
REFD = """
refd AS (SELECT fs.* FROM fs JOIN (SELECT company_name, coalesce(max(date) FILTER (account_code = '4'), max(date)) AS r FROM fs GROUP BY 1) x
    ON x.company_name = fs.company_name AND x.r = fs.date WHERE fs.company_name IN (SELECT company_name FROM tope))"""
ENTITY = {
    "entity_top": with_fs(f"SELECT company_name, {D('sum(abs(value))')} AS volumen FROM fs GROUP BY 1 ORDER BY sum(abs(value)) DESC, 1 LIMIT 10"),
    "entity_report_metrics": with_fs(f"""SELECT company_name AS empresa, min(ruc) AS ruc, min(entity_type) AS tipo_entidad, date AS periodo_ref,
        {D("coalesce(sum(value) FILTER (account_code = '4'), 0)")} AS ingresos, {D("coalesce(sum(value) FILTER (account_code = '5'), 0)")} AS gastos,
        {D("coalesce(sum(value) FILTER (account_code = '4'), 0) - coalesce(sum(value) FILTER (account_code = '5'), 0)")} AS resultado,
        {D("coalesce(sum(value) FILTER (account_code = '3'), 0)")} AS patrimonio FROM refd GROUP BY company_name, date""", TOPE, REFD),
    "entity_report_accounts": with_fs(f"""SELECT company_name AS empresa, row_number() OVER (PARTITION BY company_name ORDER BY abs(value) DESC, account_code, period_type) AS orden,
        CASE WHEN length(account_name) > 55 THEN left(account_name, 55) || '...' ELSE account_name END AS cuenta, account_code, date AS periodo, {D('value')} AS valor
        FROM refd WHERE account_code NOT IN ('3', '4', '5') QUALIFY orden <= 6""", TOPE, REFD),
    "entity_report_history": with_fs(f"""SELECT company_name AS empresa, date AS periodo, {D('i')} AS ingresos, {D('g')} AS gastos, {D('i - g')} AS resultado
        FROM (SELECT company_name, date, coalesce(sum(value) FILTER (account_code = '4'), 0) AS i, coalesce(sum(value) FILTER (account_code = '5'), 0) AS g
              FROM fs WHERE account_code IN ('4', '5') AND company_name IN (SELECT company_name FROM tope) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY date DESC) <= 8""", TOPE),
}

WEEK = "CAST(floor((dayofyear({0}) + dayofweek(make_date(year({0}), 1, 1)) - 1) / 7) AS INT) + 1"
SALES = {
    "bi_sales": q(f"""SELECT *, 8500.0 AS meta_diaria, round(ventas_hoy / 8500, 6) AS pct_avance_diario, 220000.0 AS meta_mensual, round(ventas_mes / 220000, 6) AS pct_avance_mensual,
        coalesce({C(R('ventas_hoy', 'facturas_hoy'))}, 0) AS ticket_promedio, coalesce(round({R('ventas_hoy - ventas_ayer', 'ventas_ayer')}, 6), 0) AS variacion_ayer
        FROM (SELECT {C('sum(total)')} AS venta_total, {C(f'coalesce(sum(total) FILTER (fecha = {DAY}), 0)')} AS ventas_hoy,
              {C(f"coalesce(sum(total) FILTER (year(fecha) = 2001 AND {WEEK.format('fecha')} = {WEEK.format(DAY)}), 0)")} AS ventas_semana,
              {C('coalesce(sum(total) FILTER (year(fecha) = 2001 AND month(fecha) = 8), 0)')} AS ventas_mes,
              {C(f'coalesce(sum(total) FILTER (fecha = {DAY} - 1), 0)')} AS ventas_ayer, count(DISTINCT factura_id) FILTER (fecha = {DAY}) AS facturas_hoy FROM ventas)""", "ventas"),
    "bi_sales_rank": q(f"""SELECT vendedor_id, {C('v')} AS ventas_hoy, dense_rank() OVER (ORDER BY v DESC) AS ranking
        FROM (SELECT vendedor_id, coalesce(sum(total) FILTER (fecha = {DAY}), 0) AS v FROM ventas GROUP BY 1)""", "ventas"),
    "bi_sales_products": q(f"""SELECT grupo, producto_id, p_name AS producto, {C('v')} AS total FROM (
        (SELECT 'top' AS grupo, producto_id, sum(total) AS v FROM ventas GROUP BY 2 ORDER BY v DESC, 2 LIMIT 5) UNION ALL
        (SELECT 'bottom', producto_id, sum(total) AS v FROM ventas GROUP BY 2 ORDER BY v, 2 LIMIT 5)) JOIN part ON p_partkey = producto_id""", "ventas"),
    "bi_sales_category": q(f"SELECT p_type AS categoria, {C('sum(total)')} AS total FROM ventas JOIN part ON p_partkey = producto_id GROUP BY 1", "ventas"),
    "bi_sales_zone": q(f"""SELECT n_name AS zona, {C('sum(total)')} AS total, count(*) AS lineas
        FROM ventas JOIN supplier ON s_suppkey = vendedor_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""", "ventas"),
    "bi_sales_trend": q(f"SELECT fecha, {C('sum(total)')} AS total, 8500.0 AS meta FROM ventas GROUP BY 1", "ventas"),
    "calendar": q(f"""SELECT fecha, year(fecha) AS anio, month(fecha) AS mes, monthname(fecha) AS mes_nombre, {WEEK.format('fecha')} AS semana, dayname(fecha) AS dia_semana,
        isodow(fecha) AS dia_semana_num, fecha = {DAY} AS es_hoy, year(fecha) = 2001 AND {WEEK.format('fecha')} = {WEEK.format(DAY)} AS es_esta_semana
        FROM (SELECT CAST(unnest(generate_series((SELECT min(fecha) FROM ventas), (SELECT max(fecha) FROM ventas), INTERVAL 1 DAY)) AS DATE) AS fecha)""", "ventas"),
}

CENT = """
qs AS (SELECT label AS query_id, list(m ORDER BY i) AS v FROM (
    SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
knn AS (SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
  FROM (SELECT query_id, vec_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS s FROM qs, embeddings) QUALIFY rank <= 4)"""
RETRIEVAL = {
    "knn_topk": f"WITH {CENT.strip()} SELECT * FROM knn",
    "rag_retrieve": f"""WITH {CENT.strip()} SELECT query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS passages
        FROM knn JOIN documents ON doc_id = vec_id GROUP BY 1""",
}

VTA = """
vta AS (SELECT event_id AS factura_id, ts, user_id AS vendedor_id, 'Zona ' || (user_id % 6) AS zona, CAST(value AS DECIMAL(12,2)) AS total FROM events WHERE event_type = 'purchase')"""
DAILY = f"""WITH {VTA.strip()} SELECT CAST(ts AS DATE) AS fecha, {D('sum(total)')} AS total, count(*) AS ventas, round({D('sum(total)')} / 8500 * 100, 1) AS pct_meta FROM vta GROUP BY 1"""
STREAM = {
    "stream_day_total": DAILY,
    "batch_day_total": DAILY,
    "stream_hourly": f"WITH {VTA.strip()} SELECT date_trunc('hour', ts) AS hora, zona, vendedor_id, {D('sum(total)')} AS total, count(*) AS ventas FROM vta GROUP BY 1, 2, 3",
    "stream_dedup": f"WITH {VTA.strip()} SELECT factura_id, ts, vendedor_id, zona, {D('total')} AS total FROM vta",
}

STREAM["stream_statement_upsert"] = q(
    "SELECT DISTINCT ruc, account_code, date, period_type, company_name FROM good", "raw_statements", CLEAN, GOOD
)

SQL: dict[str, str] = {**HR, **EVAL, **MAPPING, **RECONCILE, **ENTITY, **SALES, **RETRIEVAL, **STREAM}
