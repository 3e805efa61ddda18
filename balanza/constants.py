"""Fixed values of the domain: account codes, limits, band tables and labels.

These are regulatory or published figures, so they are stated as plain data.
"""

# Chart-of-accounts codes behind each pivoted balance.
BALANCE_ACCOUNTS = {
    "activo_total": "1",
    "pasivo_total": "2",
    "patrimonio": "3",
    "fondos_disp": "11",
    "inversiones": "13",
    "cartera_bruta": "14",
    "provisiones": "1499",
    "depositos": "21",
    "gastos_total": "4",
    "ingresos_total": "5",
    "int_causados": "41",
    "gastos_op": "45",
    "int_ganados": "51",
}
WIDE_ACCOUNTS = {
    "oblig_financ": "26",
    "capital_social": "31",
    "reservas": "33",
    "prov_gasto": "44",
}

# Non-performing loan accounts (not accruing / overdue).
NOT_ACCRUING = [
    "1425", "1426", "1427", "1428", "1432", "1433", "1434", "1435",
    "1436", "1440", "1441", "1442", "1443", "1444", "1448",
]
OVERDUE = ["1449", "1450", "1451", "1452", "1456", "1457", "1458", "1459"]

# Segments and entity states.
SEGMENTS = ["SEGMENTO 1", "SEGMENTO 1 MUTUALISTA", "SEGMENTO 2", "SEGMENTO 3"]
ACTIVE = "ACTIVA"
IN_LIQUIDATION = "EN LIQUIDACION"
LIQUIDATION_MARK = "LIQUIDACI"

# Regulatory limit per indicator (direction, limit, unit).
THRESHOLDS = {
    "C_solvencia": ("mayor", 9, "%"),
    "A_morosidad": ("menor", 5, "%"),
    "A_cobertura": ("mayor", 100, "%"),
    "A_activos_prod": ("mayor", 80, "%"),
    "M_efic_operativa": ("menor", 5, "%"),
    "M_efic_ratio": ("menor", 60, "%"),
    "M_intermediacion": ("mayor", 70, "%"),
    "E_roa": ("mayor", 1, "%"),
    "E_roe": ("mayor", 5, "%"),
    "E_nim": ("mayor", 3, "%"),
    "L_liq_inmediata": ("mayor", 10, "%"),
    "L_liq_ampliada": ("mayor", 14, "%"),
    "S_apalancamiento": ("menor", 10, "x"),
    "S_cartera_activo": ("mayor", 60, "%"),
    "S_aprovision": ("mayor", 3, "%"),
}
INDICATORS = list(THRESHOLDS)

# Clustering features, radar features and the inverted ones.
CLUSTER_FEATURES = [
    "C_solvencia", "A_morosidad", "A_cobertura", "A_activos_prod",
    "M_efic_operativa", "M_efic_ratio", "E_roa", "E_nim",
    "L_liq_ampliada", "S_aprovision",
]
RADAR_FEATURES = [
    "C_solvencia", "A_morosidad", "A_cobertura",
    "M_efic_operativa", "E_roa", "L_liq_ampliada",
]
RADAR_INVERTED = ["A_morosidad", "M_efic_operativa"]

# Regressors of the capitalization model.
OLS_TARGET = "C_solvencia"
OLS_REGRESSORS = [
    "A_morosidad", "M_efic_operativa", "E_roa",
    "L_liq_ampliada", "S_aprovision", "log_activo",
]

# Band tables (comparison, cut points, score per cut, score past the last cut).
BANDS = {
    "analyst": {
        "capital": (">=", (15, 12, 9, 6), (1, 2, 3, 4), 5),
        "delinquency": ("<", (2, 4, 6, 10), (1, 2, 3, 4), 5),
        "coverage": (">", (200, 150, 100, 75), (1, 2, 3, 4), 5),
        "op_efficiency": ("<", (3, 4, 5.5, 7), (1, 2, 3, 4), 5),
        "roa": (">", (1.5, 0.75, 0, -0.5), (1, 2, 3, 4), 5),
        "liquidity": (">", (25, 20, 14, 10), (1, 2, 3, 4), 5),
    },
    "etl": {
        "capital": (">=", (15, 12, 9, 6), (1, 2, 3, 4), 5),
        "delinquency": (">=", (100, 6, 4, 2), (5, 4, 3, 2), 1),
        "coverage": (">=", (200, 150, 100, 75), (1, 2, 3, 4), 5),
        "op_efficiency": (">=", (100, 7, 5.5, 4), (5, 4, 3, 2), 1),
        "roa": (">=", (1.5, 0.75, 0, -0.5), (1, 2, 3, 4), 5),
        "liquidity": (">=", (25, 20, 14, 10), (1, 2, 3, 4), 5),
    },
}
NEUTRAL_SCORE = 3.0
CAMEL_WEIGHTS = {"C": 0.25, "A": 0.25, "M": 0.20, "E": 0.15, "L": 0.15}
RATING_CUTS = [(1.5, "EXCELENTE"), (2.5, "BUENO"), (3.5, "ADECUADO"), (4.5, "MARGINAL")]
RATING_WORST = "CRITICO"
RATING_MISSING = "SIN DATOS"
RATINGS = ["EXCELENTE", "BUENO", "ADECUADO", "MARGINAL", "CRITICO", "SIN DATOS"]
SOLVENCY_CUTS = [(12, "SOLVENTE"), (9, "ADECUADO"), (6, "ALERTA")]
SOLVENCY_WORST = "CRITICO"
NO_DATA = "Sin datos"

# Limits shown next to the status table of one entity.
STATUS_LIMITS = {
    "capitalizacion": (9, "mayor", "%"),
    "liquidez_amplia": (14, "mayor", "%"),
    "cobertura": (100, "mayor", "%"),
    "morosidad": (5, "menor", "%"),
    "apalancamiento": (10, "menor", "x"),
    "roa": (0, "mayor", "%"),
}

# Accounts and labels of the single-entity study.
ENTITY_ACCOUNTS = {
    "1": "activo_total",
    "2": "pasivo_total",
    "3": "patrimonio",
    "11": "fondos_disponibles",
    "14": "cartera_bruta",
    "1499": "provisiones",
    "21": "depositos",
    "4": "gastos",
    "5": "ingresos",
}

# System-level limits drawn on the trend panel (None = no limit).
SYSTEM_LIMITS = {
    "sist_solvencia": 9.0,
    "sist_morosidad": 5.0,
    "sist_cobertura": 100.0,
    "sist_roa": 1.0,
    "sist_liq_amp": 14.0,
    "sist_nim": 3.0,
    "sist_efic_op": 5.0,
    "activo_total_m": None,
    "n_coops": None,
}

# Spanish month abbreviations, January first.
MONTHS_ES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]

# Ledger columns in order.
LEDGER_COLUMNS = [
    "fecha_corte", "segmento", "ruc", "razon_social",
    "cuenta", "descripcion_cuenta", "saldo_usd", "anio",
]
REQUIRED_COLUMNS = ["fecha_corte", "cuenta", "saldo_usd"]

# Accepted header spellings, exact first, then by substring in this order. A balance
# column is known by its exact spellings only, so that e.g. a previous balance is never taken for it.
HEADER_EXACT = {
    "FECHA_DE_CORTE": "fecha_corte",
    "FECHA_CORTE": "fecha_corte",
    "SEGMENTO": "segmento",
    "RUC": "ruc",
    "RAZON_SOCIAL": "razon_social",
    "CUENTA": "cuenta",
    "DESCRIPCION_CUENTA": "descripcion_cuenta",
    "SALDO_USD": "saldo_usd",
    "SALDO": "saldo_usd",
}
HEADER_CONTAINS = [
    ("FECHA", "fecha_corte"),
    ("RAZ", "razon_social"),
    ("DESCRIPCI", "descripcion_cuenta"),
]

# Provinces by the first two digits of a tax number, from 01 on.
PROVINCES = [
    "Azuay", "Bolívar", "Cañar", "Carchi", "Cotopaxi", "Chimborazo", "El Oro", "Esmeraldas", "Guayas", "Imbabura", "Loja", "Los Ríos",
    "Los Ríos", "Manabí", "Morona Santiago", "Napo", "Pichincha", "Tungurahua", "Zamora Chinchipe", "Galápagos", "Sucumbíos", "Orellana",
    "Santo Domingo", "Santa Elena",
]
