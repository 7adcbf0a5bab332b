"""Domain tables derived from the given test tables.

Every text is plain SQL that Spark and DuckDB read alike, so a registered query and its twin start from the same
rows. Amounts become decimals before any arithmetic. ``{name}`` stands for a given table.

Remainders of keys decide which derived rows carry a defect or have no partner (an invoice without withholding, a
payment that is not booked). They shape the data; every query runs over all rows of its tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.session import spread, written_once
from ledgerspark.sources.tables import table

AS_OF = "2001-08-01"  # the reporting day of the batch tables: the last order date
PAY_YEAR, PAY_MONTH = 2024, 1  # the month covered by the events

_PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"
_DAY = "CAST(o_orderdate AS DATE)"


def _plus(date: str, days: str) -> str:
    return f"CAST({date} + ({days}) * INTERVAL 1 DAY AS DATE)"


def _digits(expr: str, size: int) -> str:
    """At least ``size`` digits; a longer number keeps all of its digits."""
    return f"lpad(CAST({expr} AS STRING), greatest({size}, CAST(length(CAST({expr} AS STRING)) AS INT)), '0')"


def _comma(expr: str) -> str:
    return f"replace(CAST({expr} AS STRING), '.', ',')"


_BALANCE = f"CAST({_PRICE} * CAST((o_orderkey % 5) * 0.25 AS DECIMAL(4,2)) AS DECIMAL(14,2))"
_ID10 = f"concat({_digits('c_custkey % 24 + 1', 2)}, {_digits('c_custkey * 37', 8)})"
_WHOLE = "CAST(floor(l_extendedprice) AS BIGINT)"
_Y, _M, _D = "CAST(year(l_shipdate) AS STRING)", _digits("month(l_shipdate)", 2), _digits("day(l_shipdate)", 2)

TABLES: dict[str, str] = {
    # statements as delivered: text columns, five date formats, broken numbers, repeated keys
    "raw_statements": f"""
        SELECT CASE l_partkey % 3 WHEN 0 THEN '22' WHEN 1 THEN '15.036' ELSE ' 2.118' END AS sector_code,
               CASE WHEN l_suppkey % 4 = 0 THEN 'Administradora de Fondos y Fideicomisos' ELSE 'Casa de Valores ' END AS entity_type,
               CASE WHEN l_partkey % 101 = 0 THEN '' WHEN l_partkey % 103 = 0 THEN '12345'
                    WHEN l_partkey % 5 = 0 THEN concat(' ', {_digits('l_suppkey', 13)}) ELSE {_digits('l_suppkey', 13)} END AS ruc,
               concat(' Supplier ', CAST(l_suppkey AS STRING), ' ') AS company_name,
               CASE WHEN l_partkey % 47 = 0 THEN 'n/d'
                    WHEN l_partkey % 5 = 0 THEN concat({_D}, '/', {_M}, '/', {_Y})
                    WHEN l_partkey % 5 = 1 THEN concat({_D}, '-', {_M}, '-', {_Y})
                    WHEN l_partkey % 5 = 2 THEN concat({_Y}, '-', {_M}, '-', {_D})
                    WHEN l_partkey % 5 = 3 THEN concat({_Y}, {_M}, {_D})
                    ELSE concat({_D}, '/', {_M}, '/', substr({_Y}, 3, 2)) END AS date,
               CASE WHEN l_partkey % 211 = 0 THEN 'DIARIO' WHEN l_linenumber % 2 = 0 THEN 'ANUAL' ELSE 'MENSUAL' END AS period_type,
               CASE l_partkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '101' WHEN 2 THEN '10101' WHEN 3 THEN '2' WHEN 4 THEN '3'
                    WHEN 5 THEN '502.03.08' WHEN 6 THEN '98' ELSE '' END AS account_code,
               concat('Cuenta ', CAST(l_partkey % 8 AS STRING)) AS account_name,
               CASE WHEN l_partkey % 53 = 0 THEN 'N/A' WHEN l_partkey % 59 = 0 THEN '#REF!'
                    ELSE concat(CASE WHEN l_partkey % 41 = 0 THEN '-' ELSE '' END,
                         CASE WHEN {_WHOLE} >= 1000 THEN concat(CAST(CAST(floor({_WHOLE} / 1000) AS BIGINT) AS STRING), '.', {_digits(f'{_WHOLE} % 1000', 3)})
                              ELSE CAST({_WHOLE} AS STRING) END,
                         ',', {_digits('CAST(round(l_extendedprice * 100) AS BIGINT) % 100', 2)}) END AS value,
               CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'FIDEICOMISO MERCANTIL' END AS entity_subtype,
               CAST(1 + l_linenumber % 2 AS INT) AS batch_seq, l_orderkey * 10 + l_linenumber AS line_no, l_partkey AS part_no
        FROM {{lineitem}}""",
    # receivables
    "clientes": """
        SELECT c_custkey AS id_cliente, c_name AS nombre_comercial, c_mktsegment AS segmento,
               CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * 10 AS DECIMAL(14,2)) AS limite_credito
        FROM {customer}""",
    "facturas": f"""
        SELECT o_orderkey AS id_factura, CASE WHEN o_orderkey % 89 = 0 THEN -1 - o_custkey ELSE o_custkey END AS id_cliente,
               {_DAY} AS fecha_emision,
               {_plus(_DAY, 'CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 45 END')} AS fecha_vencimiento,
               CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 45 END AS termino_dias, {_PRICE} AS monto_total,
               CASE WHEN o_orderkey % 97 = 0 THEN -{_BALANCE} ELSE {_BALANCE} END AS saldo_pendiente,
               CASE WHEN o_orderkey % 5 = 0 THEN 'Pagada' ELSE 'Pendiente' END AS estado
        FROM {{orders}}""",
    # contracts and obligations
    "obligaciones": f"""
        SELECT concat('OBL-', {_digits('o_orderkey', 10)}) AS id_obligacion, o_orderpriority AS tipo,
               concat('Entidad ', CAST(o_custkey AS STRING)) AS entidad_relacionada, {_DAY} AS fecha_inicio,
               {_plus(_DAY, '60')} AS fecha_vencimiento, {_PRICE} AS valor_usd,
               concat('Responsable ', CAST(o_custkey % 8 AS STRING)) AS responsable_interno
        FROM {{orders}}""",
    # price lists
    "precios_propios": """
        SELECT concat(p_name, ' #', CAST(p_partkey AS STRING)) AS nombre, p_partkey AS codigo,
               CAST(p_retailprice AS DECIMAL(12,2)) AS precio_empresa
        FROM {part}""",
    "precios_competidor": """
        SELECT concat(CASE WHEN p_partkey % 10 = 0 THEN 'Otro ' ELSE '' END, p_name, ' #', CAST(p_partkey AS STRING)) AS nombre,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.85 + (p_partkey * 7 % 30) * 0.01 AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS precio_competidor,
               CASE p_size % 3 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Out of Stock' ELSE 'Bajo pedido' END AS disponibilidad
        FROM {part}""",
    # tax portal exports: text columns with a decimal comma
    "comprobantes": f"""
        SELECT {_digits('o_custkey', 13)} AS ruc_emisor, concat('Emisor ', CAST(o_custkey AS STRING)) AS razon_social,
               {_digits('o_orderkey', 49)} AS clave_acceso, {_DAY} AS fecha_emision, {_digits('o_orderkey', 9)} AS numero,
               {_comma(_PRICE)} AS valor_sin_impuestos, {_comma(f'CAST({_PRICE} * 0.15 AS DECIMAL(12,2))')} AS iva,
               {_comma(f'CAST({_PRICE} * 1.15 AS DECIMAL(12,2))')} AS importe_total
        FROM {{orders}}""",
    "retenciones": f"""
        SELECT {_digits('o_custkey', 13)} AS ruc_emisor, 
               concat(CASE WHEN o_orderkey % 3 = 0 THEN 'S/N ' ELSE '' END, {_digits('o_orderkey', 49)}) AS doc_sustento, {_digits('o_orderkey', 9)} AS numero,
               CASE WHEN o_orderkey % 11 = 0 THEN 'n/d' ELSE {_comma(f'CAST({_PRICE} + CASE o_orderkey % 7 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0 END AS DECIMAL(12,2))')} END AS base_imponible,
               {_comma(f'CAST({_PRICE} * 0.01 AS DECIMAL(12,2))')} AS valor_retenido
        FROM {{orders}}""",
    # bank statement and ledger; every third order has the same amount
    "banco": f"""
        SELECT o_orderkey AS id, {_digits('o_orderkey', 10)} AS referencia, {_DAY} AS fecha_transaccion,
               CASE o_orderkey % 5 WHEN 0 THEN 'Depósito cliente' WHEN 1 THEN 'Transferencia recibida' WHEN 2 THEN 'Pago proveedor'
                    WHEN 3 THEN 'Cobro factura' ELSE 'Abono de intereses' END AS descripcion,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(1000 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS monto
        FROM {{orders}}""",
    "libro": f"""
        SELECT o_orderkey AS id, {_digits('o_orderkey', 10)} AS comprobante,
               {_plus(_DAY, 'o_orderkey % 6')} AS fecha_registro, concat('Asiento ', o_orderpriority) AS concepto,
               CASE WHEN o_orderkey % 8 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
                    WHEN o_orderkey % 3 = 0 THEN CAST(1000 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS monto
        FROM {{orders}}
        UNION ALL
        SELECT -1 - c_custkey, concat('C', {_digits('c_custkey', 9)}), CAST('1998-01-01' AS DATE), 'Ajuste', CAST(c_acctbal AS DECIMAL(18,2))
        FROM {{customer}}""",
    # purchases of the tax annex
    "compras": f"""
        SELECT o_orderkey AS id,
               CASE o_orderkey % 23 WHEN 0 THEN {_digits('o_custkey', 12)} WHEN 1 THEN concat({_digits('o_custkey', 10)}, '002')
                    WHEN 2 THEN concat('RUC', {_digits('o_custkey', 7)}, '001') WHEN 3 THEN concat({_digits('o_custkey', 11)}, '001')
                    ELSE concat({_digits('o_custkey', 10)}, '001') END AS ruc_proveedor,
               concat('Proveedor ', CAST(o_custkey AS STRING)) AS razon_social, {_digits('o_orderkey % 10', 2)} AS codigo_sustento,
               '01' AS tipo_comprobante, {_digits('o_custkey % 999', 3)} AS establecimiento, '001' AS punto_emision,
               {_digits('o_orderkey', 9)} AS secuencial, {_digits('o_orderkey', 49)} AS autorizacion,
               concat({_digits('day(o_orderdate)', 2)}, '/', {_digits('month(o_orderdate)', 2)}, '/', CAST(year(o_orderdate) AS STRING)) AS fecha_emision,
               CAST(0 AS DECIMAL(12,2)) AS base_no_gravada, {_PRICE} AS base_imponible,
               CAST({_PRICE} * 0.15 AS DECIMAL(12,2)) AS monto_iva,
               CAST(CASE o_orderkey % 6 WHEN 0 THEN 0.10 WHEN 1 THEN 0.20 WHEN 2 THEN 0.30 WHEN 3 THEN 0.50 WHEN 4 THEN 0.70 ELSE 1.00 END AS DECIMAL(4,2)) AS porcentaje_retencion_iva,
               CAST(CAST({_PRICE} * 0.15 AS DECIMAL(12,2)) * CASE o_orderkey % 6 WHEN 0 THEN 0.10 WHEN 1 THEN 0.20 WHEN 2 THEN 0.30 WHEN 3 THEN 0.50 WHEN 4 THEN 0.70 ELSE 1.00 END
                    + CASE o_orderkey % 13 WHEN 0 THEN 0.02 WHEN 1 THEN 0.03 WHEN 2 THEN -5 ELSE 0 END AS DECIMAL(12,2)) AS valor_retenido_iva,
               CAST({_PRICE} * 0.01 AS DECIMAL(12,2)) AS valor_retenido_renta
        FROM {{orders}}""",
    # sales lines
    "ventas": """
        SELECT l_orderkey AS factura_id, CAST(l_shipdate AS DATE) AS fecha, l_suppkey AS vendedor_id, l_partkey AS producto_id,
               CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * 1.15 AS total
        FROM {lineitem}""",
    # people
    "empleados": f"""
        SELECT c_custkey AS id, {_ID10} AS cedula, c_name AS apellidos, c_mktsegment AS nombres,
               CASE c_custkey % 3 WHEN 0 THEN 'Analista' WHEN 1 THEN 'Jefe' ELSE 'Asistente' END AS cargo,
               CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'sin-arroba.ec' ELSE concat('p', CAST(c_custkey AS STRING), '@empresa.com.ec') END AS email,
               c_nationkey AS grupo_id,
               CAST(470 + abs(CAST(c_acctbal AS DECIMAL(12,2))) * 0.5 AS DECIMAL(10,2)) AS sueldo_base,
               {_plus("CAST('2013-01-01' AS DATE)", 'c_custkey * 13 % 4200')} AS fecha_ingreso,
               CASE WHEN c_custkey % 23 = 0 THEN {_plus("CAST('2024-01-15' AS DATE)", 'c_custkey % 400')} END AS fecha_salida,
               CAST(c_custkey % 4 AS INT) AS cargas_familiares, c_custkey % 19 <> 0 AS activo,
               CASE WHEN c_nationkey % 2 = 0 THEN 'Costa/Galápagos' ELSE 'Sierra/Amazonía' END AS region,
               CASE WHEN c_custkey % 6 = 0 THEN 'Plazo Fijo' ELSE 'Indefinido' END AS tipo_contrato,
               CASE WHEN c_custkey % 6 = 0 THEN {_plus("CAST('2024-01-01' AS DATE)", 'c_custkey % 120')} END AS fecha_fin_contrato,
               CASE WHEN c_custkey % 2 = 0 THEN 'Ahorros' ELSE 'Corriente' END AS tipo_cuenta,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE {_digits('c_custkey', 12)} END AS cuenta_bancaria
        FROM {{customer}}""",
    "asistencia": """
        SELECT user_id AS empleado_id, CAST(ts AS DATE) AS fecha,
               min(CAST(extract(HOUR FROM ts) AS INT) * 60 + CAST(extract(MINUTE FROM ts) AS INT)) AS entrada_min,
               max(CAST(extract(HOUR FROM ts) AS INT) * 60 + CAST(extract(MINUTE FROM ts) AS INT)) AS salida_min
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "permisos": """
        SELECT event_id AS id, user_id AS empleado_id, CASE event_id % 3 WHEN 0 THEN 'Enfermedad' ELSE 'Vacaciones' END AS tipo,
               CAST(ts AS DATE) AS fecha_inicio, CAST(1 + event_id % 3 AS INT) AS dias,
               CASE WHEN event_type <> 'signup' THEN 'Rechazado' WHEN event_id % 4 = 0 THEN 'Pendiente' ELSE 'Aprobado' END AS estado
        FROM {events}""",
    "prestamos": f"""
        SELECT o_orderkey AS id, o_custkey AS empleado_id, CASE o_orderkey % 3 WHEN 0 THEN 'Hipotecario' ELSE 'Quirografario' END AS tipo,
               {_PRICE} AS monto_total, CAST({_PRICE} * 0.001 AS DECIMAL(10,2)) AS cuota_mensual, o_orderkey % 4 = 0 AS activo
        FROM {{orders}}""",
    "borradores": f"""
        SELECT c_custkey AS empleado_id, CAST({PAY_YEAR} AS INT) AS anio, CAST(CASE WHEN c_custkey % 5 = 0 THEN {PAY_MONTH} ELSE {PAY_MONTH} + c_custkey % 5 END AS INT) AS mes,
               c_custkey AS id, CAST(c_custkey % 50 AS DECIMAL(10,2)) AS comisiones, CAST(c_custkey % 7 * 10 AS DECIMAL(10,2)) AS bonos,
               CAST(c_custkey % 3 AS DECIMAL(10,2)) AS otros_ingresos, CAST(c_custkey % 5 * 8 AS DECIMAL(10,2)) AS anticipo_sueldo,
               CAST(CASE WHEN c_custkey % 9 = 0 THEN 60 ELSE 0 END AS DECIMAL(10,2)) AS pension_alimenticia,
               CAST(c_custkey % 2 AS DECIMAL(10,2)) AS otras_deducciones
        FROM {{customer}}""",
    "roles_pago": f"""
        SELECT o_custkey AS empleado_id, year(o_orderdate) AS anio, month(o_orderdate) AS mes, max(o_orderkey) AS id,
               concat(CAST(year(o_orderdate) AS STRING), '-', {_digits('month(o_orderdate)', 2)}) AS periodo,
               CASE max(o_orderkey) % 4 WHEN 0 THEN 'Borrador' WHEN 1 THEN 'Calculado' ELSE 'Aprobado' END AS estado,
               CAST(sum({_PRICE}) * 0.008 AS DECIMAL(12,2)) AS sueldo_base,
               CAST(sum({_PRICE}) * 0.001 AS DECIMAL(12,2)) AS horas_suplementarias_valor,
               CAST(sum({_PRICE}) * 0.0005 AS DECIMAL(12,2)) AS horas_extraordinarias_valor,
               CAST(sum({_PRICE}) * 0.01 AS DECIMAL(12,2)) AS total_ingresos,
               CAST(sum({_PRICE}) * 0.000945 AS DECIMAL(12,2)) AS aporte_iess,
               CAST(sum({_PRICE}) * 0.002 AS DECIMAL(12,2)) AS total_deducciones,
               CAST(sum({_PRICE}) * 0.008 AS DECIMAL(12,2)) AS neto_a_recibir,
               CAST(sum({_PRICE}) * 0.001115 AS DECIMAL(12,2)) AS aporte_patronal,
               CAST(sum({_PRICE}) * 0.000833 AS DECIMAL(12,2)) AS fondos_reserva_prov
        FROM {{orders}} GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)""",
    # 360 degree evaluations
    "evaluaciones": """
        SELECT event_id AS id, CAST(1 + CAST(extract(DAY FROM ts) AS INT) % 3 AS INT) AS ciclo_id, user_id AS evaluado_id,
               CASE event_type WHEN 'click' THEN 'Jefe' WHEN 'view' THEN 'Par' WHEN 'purchase' THEN 'Subordinado' ELSE 'Autoevaluación' END AS tipo_evaluador,
               CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS completada
        FROM {events}""",
    "respuestas": """
        SELECT event_id AS id, event_id AS evaluacion_id, event_id % 4 AS criterio, CAST(1 + (event_id * 3 + user_id) % 5 AS INT) AS puntaje
        FROM {events}""",
    # uploaded files and the people they belong to
    "archivos": f"""
        SELECT concat('nomina_', CASE WHEN c_custkey % 10 = 0 THEN concat('cliente', CAST(c_custkey AS STRING)) ELSE {_ID10} END, '_demo.pdf') AS archivo FROM {{customer}}
        UNION ALL SELECT concat('anexo-', CASE WHEN c_custkey % 7 = 0 THEN {_ID10} ELSE concat('cliente', CAST(c_custkey AS STRING)) END, '.pdf') FROM {{customer}}
        UNION ALL SELECT concat('proveedor_', {_digits('s_suppkey', 6)}, '.pdf') FROM {{supplier}}
        UNION ALL SELECT concat('lote_', {_digits('s_suppkey * 1234567 + 99000000000', 13)}, '_v2.pdf') FROM {{supplier}}""",
    # roster as uploaded
    "nomina_csv": f"""
        SELECT c_custkey AS fila, CASE WHEN c_custkey % 29 = 0 THEN '   ' WHEN c_custkey % 31 = 0 THEN '' ELSE concat(' ', {_ID10.replace('c_custkey', '(c_custkey - c_custkey % 13 % 2)')}) END AS cedula,
               CASE WHEN c_custkey % 29 = 0 THEN '' ELSE c_name END AS nombre,
               CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN ' ' ELSE c_mktsegment END AS apellido,
               CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN '' ELSE concat('p', CAST(c_custkey AS STRING), '@empresa.com.ec') END AS email,
               CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_nationkey * 2 AS STRING) END AS grupo_id
        FROM {{customer}}""",
    # listing pages: every given page with three product cards behind its text, one of them without a price
    "listados": """
        SELECT page_id, concat(html,
            '<article class="product_pod"><h3><a href="x" title="', url, '">t</a></h3><p class="price_color">£1,0', CAST(page_id % 90 + 10 AS STRING),
            '.50</p><p class="instock availability"><i class="icon-ok"></i> In stock (', CAST(page_id % 9 AS STRING), ') </p></article>',
            '<article class="product_pod"><h3><a title="sin precio">t</a></h3><p class="availability">In stock</p></article>',
            '<article class="product_pod"><h3><a title="B', CAST(page_id AS STRING), '">t</a></h3><p class="price_color">$', CAST(page_id % 70 AS STRING),
            '.25</p><p class="availability">', CASE WHEN page_id % 2 = 0 THEN 'Out of stock' ELSE 'Bajo pedido' END, '</p></article>') AS html
        FROM {pages}""",
    # service requests
    "solicitudes": """
        SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Básico' WHEN 1 THEN 'Estándar' WHEN 2 THEN 'Premium' ELSE 'Otro' END AS tipo_servicio,
               CAST(1 + o_custkey % 40 AS INT) AS horas, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Alto' ELSE 'Normal' END AS nivel_urgencia
        FROM {orders}""",
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table computed from the given tables; small ones are dealt out before their rows become long texts."""
    names = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{n: spread(table(spark, sf_dir, n)) for n in names})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as it would be delivered: stored once, so that queries start from plain columns."""
    return written_once(spark, f"domain_{name}", sf_dir, lambda: derive(spark, sf_dir, name))


def as_cte(name: str, alias: str | None = None) -> str:
    """The same table as a common table expression over the registered views."""
    text = re.sub(r"\{(\w+)\}", r"\1", TABLES[name])
    return f"{alias or name} AS ({text.strip()})"
