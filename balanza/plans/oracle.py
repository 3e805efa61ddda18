"""DuckDB SQL for checking: shared building blocks of the oracle statements."""

from __future__ import annotations

from balanza.constants import (
    BALANCE_ACCOUNTS, BANDS, CAMEL_WEIGHTS, INDICATORS, NOT_ACCRUING, OVERDUE,
    RATING_CUTS, RATING_WORST, THRESHOLDS, WIDE_ACCOUNTS,
)
from balanza.operators.dimensions import FACT_BALANCES, FACT_RATIOS
from balanza.operators.scoring import FACT_INPUTS, PANEL_INPUTS
from balanza.sources.adapter import LEAVES, SEGMENT_BY_NATION


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ledger(freq: str) -> str:
    period = {
        "month": "last_day(CAST(l_shipdate AS DATE))",
        "quarter": "last_day(CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) + INTERVAL 2 MONTH AS DATE))",
    }[freq]
    codes = " ".join(f"WHEN {i} THEN '{code}'" for i, (code, _) in enumerate(LEAVES))
    factors = " ".join(f"WHEN {i} THEN CAST({m} AS DECIMAL(3,2))" for i, (_, m) in enumerate(LEAVES))
    segments = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENT_BY_NATION))
    return f"""
leaves AS (
  SELECT l_suppkey, {period} AS fecha_corte, CASE l_partkey % 20 {codes} END AS leaf,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE l_partkey % 20 {factors} END) AS amount
  FROM lineitem GROUP BY ALL
),
entities AS (
  SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS ruc,
         'COOPERATIVA DE AHORRO Y CREDITO ' || upper(s_name) || ' LTDA'
           || CASE WHEN s_suppkey % 10 = 9 THEN ' EN LIQUIDACION' ELSE '' END AS razon_social,
         CASE s_nationkey % 4 {segments} END AS segmento
  FROM supplier
),
ledger AS (
  SELECT fecha_corte, segmento, ruc, razon_social, left(leaf, n) AS cuenta,
         'CUENTA ' || left(leaf, n) AS descripcion_cuenta,
         CAST(sum(amount) AS DECIMAL(20,4)) AS saldo_usd,
         CAST(year(fecha_corte) AS VARCHAR) AS anio
  FROM leaves JOIN entities ON l_suppkey = s_suppkey, (VALUES (1), (2), (4)) AS levels(n)
  GROUP BY ALL
)"""


def _pivot(keys: str, accounts: dict, where: str = "") -> str:
    columns = [f"CAST(max(CASE WHEN cuenta = '{code}' THEN saldo_usd END) AS DOUBLE) AS {name}" for name, code in accounts.items()]
    for name, codes in (("cart_nodev", NOT_ACCRUING), ("cart_vencida", OVERDUE)):
        columns.append(f"CAST(sum(CASE WHEN cuenta IN ({quoted(codes)}) THEN saldo_usd ELSE 0 END) AS DOUBLE) AS {name}")
    return f"SELECT {keys}, {', '.join(columns)} FROM ledger {where} GROUP BY {keys}"


_AUX = """*, coalesce(ingresos_total, 0) - coalesce(gastos_total, 0) AS resultado,
 cart_nodev + cart_vencida AS cart_imp,
 coalesce(int_ganados, 0) - coalesce(int_causados, 0) AS margen"""


def _ratio(num: str, den: str, scale: str = " * 100") -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den}{scale} END"


_CASH = "(coalesce(fondos_disp, 0) + coalesce(inversiones, 0))"
_RATIOS = {
    "capitalization": _ratio("patrimonio", "activo_total"),
    "delinquency": _ratio("cart_imp", "cartera_bruta"),
    "coverage": _ratio("abs(provisiones)", "cart_imp"),
    "productive": _ratio("(coalesce(cartera_bruta, 0) + coalesce(inversiones, 0))", "activo_total"),
    "op_efficiency": _ratio("coalesce(gastos_op, 0)", "activo_total"),
    "efficiency": _ratio("coalesce(gastos_op, 0)", "margen"),
    "intermediation": _ratio("cartera_bruta", "depositos"),
    "roa": _ratio("resultado", "activo_total"),
    "roe": _ratio("resultado", "patrimonio"),
    "nim": _ratio("margen", "activo_total"),
    "immediate": _ratio("fondos_disp", "depositos"),
    "extended": _ratio(_CASH, "depositos"),
    "leverage": _ratio("pasivo_total", "patrimonio", ""),
    "loans": _ratio("cartera_bruta", "activo_total"),
    "provisioning": _ratio("abs(provisiones)", "cartera_bruta"),
}
_FACT_KEYS = ["capitalization", "delinquency", "coverage", "roa", "roe", "nim", "extended", "op_efficiency", "leverage", "intermediation"]
_PANEL_KEYS = [
    "capitalization", "delinquency", "coverage", "productive", "op_efficiency", "efficiency", "intermediation",
    "roa", "roe", "nim", "immediate", "extended", "leverage", "loans", "provisioning",
]


def band_sql(column: str, component: str, variant: str) -> str:
    comparison, cuts, scores, last = BANDS[variant][component]
    steps = " ".join(f"WHEN {column} {comparison} {cut} THEN {float(score)}::DOUBLE" for cut, score in zip(cuts, scores))
    return f"CASE WHEN {column} IS NULL THEN 3.0::DOUBLE {steps} ELSE {float(last)}::DOUBLE END"


def _scores(variant: str, inputs: dict) -> str:
    b = {name: band_sql(column, name, variant) for name, column in inputs.items()}
    return (
        f"{b['capital']} AS sc_C, ({b['delinquency']} + {b['coverage']}) / 2.0::DOUBLE AS sc_A, "
        f"{b['op_efficiency']} AS sc_M, {b['roa']} AS sc_E, {b['liquidity']} AS sc_L"
    )


_CAMEL = "round(" + " + ".join(f"sc_{k} * {w}::DOUBLE" for k, w in CAMEL_WEIGHTS.items()) + ", 3)"


def rating_sql(column: str) -> str:
    steps = " ".join(f"WHEN {column} <= {cut} THEN '{name}'" for cut, name in RATING_CUTS)
    return f"CASE WHEN {column} IS NULL THEN 'SIN DATOS' {steps} ELSE '{RATING_WORST}' END"


def _scored(name: str, source: str, keys: list[str], names: list[str], variant: str, inputs: dict) -> str:
    ratios = ", ".join(f"{_RATIOS[k]} AS {n}" for k, n in zip(keys, names, strict=True))
    return f"""
{name}_ratios AS (SELECT *, {ratios} FROM (SELECT {_AUX} FROM ({source}))),
{name}_scores AS (SELECT *, {_scores(variant, inputs)} FROM {name}_ratios),
{name}_camel AS (SELECT *, {_CAMEL} AS camel FROM {name}_scores)"""


_FACT_COLUMNS = ", ".join(f"CAST({c} AS DECIMAL(20,4)) AS {c}" for c in FACT_BALANCES + FACT_RATIOS)
_FACT = (
    _scored("fact", _pivot("fecha_corte, ruc", BALANCE_ACCOUNTS), _FACT_KEYS, FACT_RATIOS, "etl", FACT_INPUTS)
    + f""",
fact AS (SELECT fecha_corte, ruc, {_FACT_COLUMNS}, CAST(camel AS DECIMAL(5,3)) AS camel_score,
  {rating_sql('camel')} AS rating_camel FROM fact_camel)"""
)
_PANEL = (
    _scored(
        "panel",
        _pivot(
            "fecha_corte, ruc, razon_social, segmento", BALANCE_ACCOUNTS | WIDE_ACCOUNTS,
            "WHERE razon_social NOT LIKE '%LIQUIDACI%'",
        ),
        _PANEL_KEYS, INDICATORS, "analyst", PANEL_INPUTS,
    )
    + f""",
panel AS (SELECT *, CASE WHEN activo_total > 0 THEN ln(activo_total) END AS log_activo,
  {rating_sql('camel')} AS rating_camel FROM panel_camel)"""
)
_DIM = """
dim AS (
  SELECT *, CASE WHEN razon_social LIKE '%LIQUIDACI%' THEN 'EN LIQUIDACION' ELSE 'ACTIVA' END AS estado
  FROM (SELECT ruc, arg_max(razon_social, (fecha_corte, razon_social)) AS razon_social,
               arg_max(segmento, (fecha_corte, segmento)) AS segmento,
               min(fecha_corte) AS primera_fecha, max(fecha_corte) AS ultima_fecha,
               CAST(count(DISTINCT fecha_corte) AS INTEGER) AS meses_activo
        FROM ledger GROUP BY ruc)
)"""
_SNAPSHOT = """
snap AS (SELECT * FROM fact JOIN (SELECT * FROM dim WHERE estado = 'ACTIVA') USING (ruc)
  WHERE fecha_corte = (SELECT max(fecha_corte) FROM fact))"""
_LONG = f"""
limits AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{k}', {float(l)}::DOUBLE, '{u}')" for n, (k, l, u) in THRESHOLDS.items())})
  AS t(indicador, tipo, limite, unidad)),
long AS (SELECT * FROM (UNPIVOT panel ON {", ".join(INDICATORS)} INTO NAME indicador VALUE valor) WHERE valor IS NOT NULL)"""

_PARTS = {"fact": _FACT, "panel": _PANEL, "dim": _DIM, "snap": _SNAPSHOT, "long": _LONG}
LIMIT_TEXT = "CASE WHEN tipo = 'mayor' THEN '≥' ELSE '≤' END || CAST(CAST(limite AS INTEGER) AS VARCHAR) || unidad"
BREACH = "CASE WHEN tipo = 'mayor' THEN valor < limite ELSE valor > limite END"


def sql(body: str, *parts: str, freq: str = "quarter") -> str:
    """The named building blocks and then ``body`` (which may add its own CTEs with a leading comma)."""
    blocks = [_ledger(freq), *[_PARTS[p] for p in parts]]
    body = body.strip()
    tail = body if body.startswith(",") else "\n" + body
    return "WITH " + ",".join(blocks) + tail


def rounded(expression: str, digits: int) -> str:
    """Half-up rounding on decimals, as double."""
    return f"CAST(round(CAST({expression} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"
