"""DuckDB twin of the derived statement table and helpers to compose query texts."""

from __future__ import annotations

from ledgerspark.sources.tables import DOTTED_ACCOUNTS, PLAIN_ACCOUNTS

_END = {
    "ANUAL": "make_date(year(mon), 12, 31)",
    "TRIMESTRAL": "last_day(CAST(date_trunc('quarter', mon) + INTERVAL 2 MONTH AS DATE))",
    "MENSUAL": "last_day(mon)",
}


def _branch(kind: str, code: str, name: str, measure: str, status: str | None, flag: str | None) -> str:
    tests = [f"ls = '{status}'"] if status else []
    tests += [f"rf = '{flag}'"] if flag else []
    where = f"WHERE {' AND '.join(tests)}" if tests else ""
    return (
        f"SELECT k, {_END[kind]} AS date, '{kind}' AS period_type, '{code}' AS account_code, "
        f"'{name}' AS account_name, CAST(sum({measure}) AS DECIMAL(18,2)) AS v FROM cube {where} GROUP BY 1, 2"
    )


_BRANCHES = "\nUNION ALL ".join(
    _branch(kind, *account)
    for kind, accounts in (("ANUAL", PLAIN_ACCOUNTS), ("TRIMESTRAL", PLAIN_ACCOUNTS), ("MENSUAL", DOTTED_ACCOUNTS))
    for account in accounts
)

FS = f"""
lines AS (
  SELECT l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS mon, l_linestatus AS ls, l_returnflag AS rf,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_tax AS DECIMAL(4,2)) AS t, CAST(l_discount AS DECIMAL(4,2)) AS d
  FROM lineitem),
cube AS MATERIALIZED (
  SELECT k, mon, ls, rf, sum(p) AS price, sum(p * t * 10) AS debt, sum(p) - sum(p * t * 10) AS equity,
         sum(p * (1 - d)) AS income, sum(p * (1 - t)) AS cost, sum(-p * d) AS memo
  FROM lines GROUP BY ALL),
acc AS ({_BRANCHES}),
acc2 AS (
  SELECT *, year(date) AS y, (period_type = 'ANUAL') AS an, account_code AS c FROM acc WHERE v IS NOT NULL),
fs AS MATERIALIZED (
  SELECT lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS sector_code, r_name AS entity_type,
         lpad(CAST(k AS VARCHAR), 13, '0') AS ruc,
         CASE WHEN k % 19 = 0 AND y >= 1999 THEN s_name || ' S.A.' ELSE s_name END AS company_name,
         CASE WHEN c = '98' AND k % 23 = 0 THEN NULL ELSE date END AS date,
         period_type, account_code, account_name,
         CAST(CASE WHEN an AND (k + y) % 71 = 0 THEN 500000
              WHEN c = '1' AND (k * 13 + y) % 97 = 0 THEN v * 20
              WHEN c = '1' AND (k + y) % 53 = 0 THEN -v
              WHEN c = '1' AND (k + y) % 59 = 0 THEN v * 0.3
              WHEN c = '2' AND (k * 3 + y) % 41 = 0 THEN v * 4
              WHEN c = '3' AND (k + y) % 47 = 0 THEN -v
              WHEN c = '4' AND (k + y) % 37 = 0 THEN 0
              WHEN c = '5' AND (k + y) % 43 = 0 THEN 0
              WHEN c = '10101' AND (k + y) % 61 = 0 THEN v * 10
              WHEN length(c) >= 3 AND k % 17 = 0 THEN v - (v % 1000000)
              ELSE v END AS DECIMAL(18,2)) AS value,
         CASE WHEN period_type = 'MENSUAL' THEN 'FIDEICOMISO MERCANTIL' ELSE '' END AS entity_subtype
  FROM acc2 JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE NOT (an AND (k * 7 + y) % 11 = 0) AND NOT (an AND k % 29 = 0 AND y <> 1998)
    AND NOT (an AND c IN ('101', '201') AND (k + y) % 31 = 0) AND NOT (an AND length(c) = 1 AND (k + y) % 67 = 0))
"""


def with_fs(body: str, *ctes: str) -> str:
    """Query over ``fs``; further common table expressions may be put between."""
    return "WITH " + ",\n".join([FS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def dbl(expr: str, digits: int | None = None) -> str:
    """Decimal expression as DOUBLE, rounded while still exact."""
    return f"CAST(round({expr}, {digits}) AS DOUBLE)" if digits is not None else f"CAST({expr} AS DOUBLE)"
