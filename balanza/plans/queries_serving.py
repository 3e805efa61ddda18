"""Registered queries: star schema, scoring and dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.constants import CLUSTER_FEATURES, STATUS_LIMITS
from balanza.operators import describe, dimensions, pivot, ratios, scoring, serve
from balanza.plans import adhoc as surface
from balanza.plans.catalog import query
from balanza.plans.oracle import rounded, sql
from balanza.plans.star import star
from balanza.session import checkpoint
from balanza.sources.adapter import ledger_from_tables


def doubles(df, digits: dict | None = None):
    """Decimals as doubles, and optionally half-up rounding, for comparison."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "decimal":
            c = c.cast("double")
        elif f.dataType.typeName() == "short":
            c = c.cast("int")
        columns.append(c.alias(f.name))
    return df.select(*columns)


FACT_NUMBERS = dimensions.FACT_BALANCES + dimensions.FACT_RATIOS + ["camel_score"]
_FACT_OUT = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FACT_NUMBERS)
RUC = "0000000000001"

# Star schema ---------------------------------------------------------------------------------


@query("fact_indicadores", sql(f"SELECT fecha_corte, ruc, {_FACT_OUT}, rating_camel FROM fact", "fact"))
def fact_indicadores(spark, sf_dir):
    return doubles(dimensions.build_fact_indicadores(ledger_from_tables(spark, sf_dir)))


_PANEL_OUT = ["activo_total", "pasivo_total", "oblig_financ", "capital_social", "reservas", "prov_gasto",
              "sc_C", "sc_A", "sc_M", "sc_E", "sc_L", "camel"]
_PANEL_KEYS = "fecha_corte, ruc, razon_social, segmento, rating_camel"
_PANEL_ROUND = describe.INDICATORS + ["log_activo"]


@query(
    "panel_15",
    sql(f"SELECT {_PANEL_KEYS}, {', '.join(_PANEL_OUT)}, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in _PANEL_ROUND) + " FROM panel", "panel"),
)
def panel_15(spark, sf_dir):
    panel = dimensions.build_panel(ledger_from_tables(spark, sf_dir))
    return panel.select(
        *_PANEL_KEYS.split(", "), *_PANEL_OUT, *[F.round(c, 6).alias(c) for c in _PANEL_ROUND]
    )


@query("dim_entity", sql("SELECT * FROM dim", "dim"))
def dim_entity(spark, sf_dir):
    return doubles(dimensions.build_dim_entity(star(spark, sf_dir).ledger))


@query(
    "dim_account",
    sql("""SELECT cuenta, arg_max(descripcion_cuenta, (fecha_corte, descripcion_cuenta)) AS descripcion_cuenta,
           CAST(length(cuenta) AS INTEGER) AS nivel FROM ledger WHERE cuenta <> '' GROUP BY cuenta"""),
)
def dim_account(spark, sf_dir):
    return doubles(dimensions.build_dim_account(star(spark, sf_dir).ledger))


_DIM_UNTIL = """(SELECT ruc, arg_max(razon_social, (fecha_corte, razon_social)) AS razon_social,
  arg_max(segmento, (fecha_corte, segmento)) AS segmento, min(fecha_corte) AS primera_fecha,
  max(fecha_corte) AS ultima_fecha, CAST(count(DISTINCT fecha_corte) AS INTEGER) AS meses_activo,
  CASE WHEN arg_max(razon_social, (fecha_corte, razon_social)) LIKE '%LIQUIDACI%' THEN 'EN LIQUIDACION' ELSE 'ACTIVA' END AS estado
  FROM ledger WHERE {where} GROUP BY ruc)"""


@query(
    "upsert_entity",
    sql(f""", old AS {_DIM_UNTIL.format(where="anio >= '1997'")}, new AS {_DIM_UNTIL.format(where="anio <= '1999'")}
    SELECT ruc, coalesce(o.primera_fecha, n.primera_fecha) AS primera_fecha,
    {", ".join(f"CASE WHEN n.ruc IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in ("razon_social", "segmento", "ultima_fecha", "meses_activo", "estado"))}
    FROM old o FULL JOIN new n USING (ruc)"""),
)
def upsert_entity(spark, sf_dir):
    """Load the years from 1997 on, then upsert the years up to 1999 on top."""
    ledger = star(spark, sf_dir).ledger
    old = dimensions.build_dim_entity(ledger.where(F.col("anio") >= "1997"))
    new = dimensions.build_dim_entity(ledger.where(F.col("anio") <= "1999"))
    return doubles(dimensions.upsert_entities(old, new))


@query(
    "upsert_accounts",
    sql(""", old AS (SELECT cuenta, min('VIEJA ' || cuenta) AS descripcion_cuenta, CAST(length(cuenta) AS INTEGER) AS nivel
      FROM ledger GROUP BY cuenta),
    new AS (SELECT cuenta, max(descripcion_cuenta) AS descripcion_cuenta FROM ledger WHERE length(cuenta) <= 2 GROUP BY cuenta)
    SELECT o.cuenta, coalesce(n.descripcion_cuenta, o.descripcion_cuenta) AS descripcion_cuenta, o.nivel
    FROM old o LEFT JOIN new n USING (cuenta)"""),
)
def upsert_accounts(spark, sf_dir):
    """New descriptions for the first two levels only; levels never change."""
    dim = dimensions.build_dim_account(star(spark, sf_dir).ledger)
    old = dim.withColumn("descripcion_cuenta", F.concat(F.lit("VIEJA "), "cuenta"))
    return doubles(dimensions.upsert_accounts(old, dim.where(F.length("cuenta") <= 2)))


@query(
    "upsert_scores",
    sql(f""", old AS (SELECT fecha_corte, ruc, CAST(camel AS DECIMAL(5,3)) AS camel_score, rating_camel, C_solvencia FROM panel)
    SELECT coalesce(o.fecha_corte, n.fecha_corte) AS fecha_corte, coalesce(o.ruc, n.ruc) AS ruc,
      CAST(n.camel_score AS DOUBLE) AS camel_score, n.rating_camel, round(CAST(
        CASE WHEN o.ruc IS NOT NULL THEN o.C_solvencia ELSE n.capitalizacion_pct END AS DOUBLE), 4) AS capitalizacion_pct
    FROM old o FULL JOIN fact n ON o.ruc = n.ruc AND o.fecha_corte = n.fecha_corte""", "fact", "panel"),
)
def upsert_scores(spark, sf_dir):
    """Analyst scores as the old batch, replaced by the ETL scores; balances of old rows stay."""
    s = star(spark, sf_dir)
    old = s.panel.select(
        "fecha_corte", "ruc", F.col("camel").cast("decimal(5,3)").alias("camel_score"), "rating_camel",
        F.col("C_solvencia").alias("capitalizacion_pct"),
    )
    new = s.fact.select("fecha_corte", "ruc", "camel_score", "rating_camel", F.col("capitalizacion_pct").cast("double").alias("capitalizacion_pct"))
    merged = dimensions.upsert_scores(old, new)
    return doubles(merged.withColumn("capitalizacion_pct", F.round("capitalizacion_pct", 4)))


@query(
    "orphans",
    sql("""SELECT ruc, count(*) AS filas FROM ledger
    WHERE ruc NOT IN (SELECT ruc FROM dim WHERE estado = 'ACTIVA') GROUP BY ruc""", "dim"),
)
def orphans(spark, sf_dir):
    """Ledger rows without an entity when the dimension holds only active ones."""
    s = star(spark, sf_dir)
    missing = dimensions.orphans(s.ledger, serve.active_only(s.dim_entity), "ruc")
    return missing.groupBy("ruc").agg(F.count(F.lit(1)).alias("filas"))


_DIRECTORY_RATIOS = ", ".join(
    f"{rounded(c, 2)} AS {c + '_pct' if c == 'liquidez_ampliada' else c}" for c in dimensions.FACT_RATIOS
)


def _directory_scores():
    from balanza.plans.oracle import _scores

    return _scores("analyst", scoring.FACT_INPUTS)


_DIRECTORY = f""", cut AS (SELECT * FROM fact_ratios WHERE fecha_corte = (SELECT max(fecha_corte) FROM ledger)),
 scored AS (SELECT *, {_directory_scores()} FROM cut),
 figures AS (SELECT *, round(sc_C * 0.25::DOUBLE + sc_A * 0.25::DOUBLE + sc_M * 0.2::DOUBLE + sc_E * 0.15::DOUBLE + sc_L * 0.15::DOUBLE, 3) AS camel FROM scored),
 directory AS (SELECT dim.*, {rounded('activo_total / 1e6', 2)} AS "activo_M_Dec2001",
   {rounded('patrimonio / 1e6', 2)} AS "patrimonio_M_Dec2001", {rounded('cartera_bruta / 1e6', 2)} AS "cartera_M_Dec2001",
   {rounded('depositos / 1e6', 2)} AS "depositos_M_Dec2001", {_DIRECTORY_RATIOS}, sc_C, sc_A, sc_M, sc_E, sc_L, camel,
   CASE WHEN camel <= 1.5 THEN 'EXCELENTE' WHEN camel <= 2.5 THEN 'BUENO' WHEN camel <= 3.5 THEN 'ADECUADO'
        WHEN camel <= 4.5 THEN 'MARGINAL' WHEN camel > 4.5 THEN 'CRITICO' END AS rating_camel
   FROM dim LEFT JOIN figures USING (ruc))"""


@query("directory", sql(_DIRECTORY + " SELECT * FROM directory", "fact", "dim"))
def directory(spark, sf_dir):
    return doubles(dimensions.build_directory(star(spark, sf_dir).ledger))


@query(
    "rating_crosstab",
    sql(_DIRECTORY + " SELECT segmento, "
        + ", ".join(f"CAST(count(*) FILTER (WHERE rating_camel = '{r}') AS BIGINT) AS \"{r}\"" for r in describe.RATINGS)
        + " FROM directory WHERE estado = 'ACTIVA' GROUP BY segmento", "fact", "dim"),
)
def rating_crosstab(spark, sf_dir):
    return describe.rating_crosstab(dimensions.build_directory(star(spark, sf_dir).ledger))


# Ranking and dashboard -----------------------------------------------------------------------

_R2 = ", ".join(
    f"CAST(round({c}, {d}) AS DOUBLE) AS {c}"
    for c, d in (("camel_score", 3), ("morosidad_pct", 2), ("capitalizacion_pct", 2), ("liquidez_ampliada", 2), ("roa_pct", 2))
)
_RANKING = f"SELECT razon_social, segmento, estado, rating_camel, ruc, {_R2} FROM snap"


@query("ranking_etl", sql(_RANKING + " ORDER BY camel_score DESC, ruc", "fact", "dim", "snap"))
def ranking_etl(spark, sf_dir):
    """From the ledger: the cut is chosen before the pivot, so the scan reads only its rows."""
    ledger = star(spark, sf_dir).ledger
    cut = dimensions.build_fact_indicadores(serve.at_latest_cut(ledger), "etl")
    return serve.ranking(cut, dimensions.build_dim_entity(ledger))


_ANALYST = ["C_solvencia", "A_morosidad", "A_cobertura", "M_efic_operativa", "E_roa", "L_liq_ampliada"]


@query(
    "ranking_analyst",
    sql(f"""SELECT ruc, razon_social, segmento, sc_C, sc_A, sc_M, sc_E, sc_L, camel, rating_camel,
        {", ".join(f"{rounded(c, 4)} AS {c}" for c in _ANALYST)}, {rounded('activo_total / 1e6', 1)} AS activo_m,
        row_number() OVER (ORDER BY camel, ruc) AS posicion
        FROM panel WHERE fecha_corte = (SELECT max(fecha_corte) FROM panel)""", "panel"),
)
def ranking_analyst(spark, sf_dir):
    cut = serve.at_latest_cut(star(spark, sf_dir).panel)
    placed = serve.global_position(cut, [F.col("camel"), F.col("ruc")])
    return placed.select(
        "ruc", "razon_social", "segmento", "sc_C", "sc_A", "sc_M", "sc_E", "sc_L", "camel", "rating_camel",
        *[describe.half_up(c, 4).alias(c) for c in _ANALYST],
        describe.half_up(F.col("activo_total") / F.lit(1e6), 1).alias("activo_m"), "posicion",
    )


def in_order(rows):
    """Rows with their position in the order that they come in: partitions and rows of a sorted table are in order."""
    placed = checkpoint(rows.withColumn("_place", F.monotonically_increasing_id()))
    return serve.global_position(placed, [F.col("_place")]).drop("_place")


def _served(name, oracle, function):
    @query(name, sql(oracle, "fact", "dim", "snap"))
    def run(spark, sf_dir):
        s = star(spark, sf_dir)
        return function(s.fact, s.dim_entity)

    return run


def _avg(c):
    return f"CAST(round(CAST(avg({c}) AS DECIMAL(24,8)), 2) AS DOUBLE)"


_KPI_SQL = f"""SELECT count(DISTINCT ruc) AS total_coops, {_avg('camel_score')} AS camel_promedio,
 {_avg('morosidad_pct')} AS morosidad_promedio, {_avg('liquidez_ampliada')} AS liquidez_promedio,
 {rounded('sum(activo_total) / 1e9', 2)} AS activos_sistema_b, max(fecha_corte) AS ultimo_corte FROM snap"""
_served("kpis", _KPI_SQL, serve.kpis)
_served(
    "sidebar_stats",
    f""", t AS (SELECT count(DISTINCT ruc) AS n, max(fecha_corte) AS cut, {rounded('sum(activo_total) / 1e9', 1)} AS b FROM snap)
    SELECT CAST(n AS VARCHAR) AS sidebar_coops,
      list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], month(cut)) || ' ' || year(cut) AS sidebar_corte,
      CASE WHEN b >= 1 THEN '~' || CAST(floor(b) AS BIGINT) || 'B USD' ELSE '~' || CAST(round(b * 1000) AS BIGINT) || 'M USD' END AS sidebar_activos
    FROM t""",
    serve.sidebar_stats,
)
_served(
    "segment_distribution",
    f"SELECT segmento, count(*) AS cantidad, {_avg('camel_score')} AS camel_promedio FROM snap GROUP BY segmento",
    serve.segment_distribution,
)
_served(
    "segment_total",
    "SELECT CAST(count(*) AS BIGINT) AS total FROM snap",
    lambda f, d: serve.segment_total(serve.segment_distribution(f, d)),
)
_served(
    "segment_comparison",
    f"""SELECT segmento, count(*) AS total, {_avg('camel_score')} AS camel_promedio, {_avg('morosidad_pct')} AS morosidad_promedio,
    {_avg('capitalizacion_pct')} AS capital_promedio, {_avg('liquidez_ampliada')} AS liquidez_promedio, {_avg('roa_pct')} AS roa_promedio,
    {rounded('sum(activo_total) / 1e9', 2)} AS activos_miles_millones FROM snap GROUP BY segmento""",
    serve.segment_comparison,
)
_TOP = """SELECT ruc, razon_social, segmento, CAST(camel_score AS DOUBLE) AS camel_score, rating_camel,
 CAST(morosidad_pct AS DOUBLE) AS morosidad_pct, CAST(capitalizacion_pct AS DOUBLE) AS capitalizacion_pct
 FROM snap ORDER BY snap.camel_score {}, ruc LIMIT 5"""
_served("top5", _TOP.format("DESC"), lambda f, d: serve.top_n(f, d, 5, "worst"))
_served("bottom5", _TOP.format("ASC"), lambda f, d: serve.top_n(f, d, 5, "best"))

_HISTORY_ROUND = ", ".join(
    f"CAST(round({c}, {n}) AS DOUBLE) AS {c}"
    for c, n in (("camel_score", 3), ("morosidad_pct", 2), ("capitalizacion_pct", 2), ("liquidez_ampliada", 2), ("roa_pct", 2), ("eficiencia_op_pct", 2))
)
_HISTORY = f"""SELECT {{key}}fecha_corte, rating_camel, {_HISTORY_ROUND}, {rounded('activo_total / 1e6', 2)} AS activo_millones"""


@query(
    "entity_history_24",
    sql(_HISTORY.format(key="ruc, ") + " FROM fact QUALIFY row_number() OVER (PARTITION BY ruc ORDER BY fecha_corte DESC) <= 24", "fact"),
)
def entity_history_24(spark, sf_dir):
    return serve.entity_history(star(spark, sf_dir).fact)


@query(
    "entity_history_one",
    sql(_HISTORY.format(key="") + f" FROM fact WHERE ruc = '{RUC}' ORDER BY fecha_corte DESC LIMIT 24", "fact"),
)
def entity_history_one(spark, sf_dir):
    return serve.entity_history(star(spark, sf_dir).fact, RUC)


@query("entity", sql(f"SELECT * FROM dim WHERE ruc = '{RUC}'", "dim"))
def entity(spark, sf_dir):
    return doubles(serve.entity(star(spark, sf_dir).dim_entity, RUC))


_served(
    "ranking_search",
    _RANKING + " WHERE contains(lower(razon_social || ' ' || ruc), 'supplier') AND contains(lower(segmento), 'segmento 1')",
    lambda f, d: serve.filter_ranking(serve.ranking_rows(f, d), "Supplier", "Segmento 1"),
)
_served(
    "ranking_search_count",
    "SELECT count(*) AS visibles FROM snap WHERE lower(segmento) = 'segmento 1'",
    lambda f, d: serve.visible_count(serve.filter_ranking(serve.ranking_rows(f, d), segmento="segmento 1", match="exact")),
)
_served(
    "sort_ranking_nulls",
    f"""SELECT *, row_number() OVER (ORDER BY capitalizacion_pct DESC NULLS LAST, ruc) AS posicion FROM ({_RANKING})""",
    lambda f, d: in_order(serve.sort_ranking(serve.ranking_rows(f, d), "capitalizacion_pct", ascending=False)),
)
_served(
    "sort_ranking_names",
    f"""SELECT *, row_number() OVER (ORDER BY razon_social NULLS LAST, ruc) AS posicion FROM ({_RANKING})""",
    lambda f, d: in_order(serve.sort_ranking(serve.ranking_rows(f, d), "razon_social")),
)
_served(
    "ranked",
    f"SELECT *, row_number() OVER (ORDER BY camel_score, ruc) AS posicion FROM ({_RANKING})",
    lambda f, d: serve.ranked(serve.ranking_rows(f, d)),
)
_served(
    "threshold_flags",
    """SELECT ruc, morosidad_pct <= 5 AS cumple_morosidad, capitalizacion_pct >= 9 AS cumple_capital,
       liquidez_ampliada >= 14 AS cumple_liquidez, roa_pct >= 0 AS cumple_roa FROM snap""",
    lambda f, d: scoring.threshold_flags(serve.snapshot(f, d)).select(
        "ruc", "cumple_morosidad", "cumple_capital", "cumple_liquidez", "cumple_roa"
    ),
)


@query(
    "search_entities",
    sql("SELECT ruc, razon_social FROM dim WHERE razon_social ILIKE '%00001%' OR razon_social ILIKE '%liquidacion%'", "dim"),
)
def search_entities(spark, sf_dir):
    return serve.search_entities(star(spark, sf_dir).dim_entity, ["00001", "liquidacion"]).select("ruc", "razon_social")


@query(
    "latest_row",
    sql("""SELECT ruc, fecha_corte, CAST(camel_score AS DOUBLE) AS camel_score, rating_camel FROM fact
        QUALIFY row_number() OVER (PARTITION BY ruc ORDER BY fecha_corte DESC) = 1""", "fact"),
)
def latest_row(spark, sf_dir):
    fact = star(spark, sf_dir).fact.select("ruc", "fecha_corte", "camel_score", "rating_camel")
    return doubles(serve.latest_row(fact, "ruc"))


_RADAR = """SELECT ruc, fecha_corte,
 greatest(0, least(100, coalesce(c, 0) / 9.0::DOUBLE * 100)) AS "radar_C",
 CASE WHEN a > 0 THEN greatest(0, least(100, 5.0::DOUBLE / a * 100)) ELSE 0 END AS "radar_A",
 CASE WHEN m IS NOT NULL THEN greatest(0, least(100, 80.0::DOUBLE / greatest(m, 1) * 100)) ELSE 0 END AS "radar_M",
 greatest(0, least(100, coalesce(e, 0) * 25 + 50)) AS "radar_E",
 greatest(0, least(100, coalesce(l, 0) / 14.0::DOUBLE * 100)) AS "radar_L"
 FROM (SELECT ruc, fecha_corte, CAST(capitalizacion_pct AS DOUBLE) AS c, CAST(morosidad_pct AS DOUBLE) AS a,
   CAST(eficiencia_op_pct AS DOUBLE) AS m, CAST(roa_pct AS DOUBLE) AS e, CAST(liquidez_ampliada AS DOUBLE) AS l FROM fact)"""


@query("radar_scores", sql(_RADAR, "fact"))
def radar_scores(spark, sf_dir):
    return scoring.radar_scores(doubles(star(spark, sf_dir).fact)).select(
        "ruc", "fecha_corte", "radar_C", "radar_A", "radar_M", "radar_E", "radar_L"
    )


def _cut_band(column, cuts):
    steps = " ".join(f"WHEN {column} >= {c} THEN {i}" for i, c in enumerate(cuts, 1))
    return f"CASE {steps} ELSE {len(cuts) + 1} END"


@query(
    "score_bands",
    sql(f"""SELECT ruc, fecha_corte, s AS score_100, {_cut_band('s', scoring.GAUGE_CUTS)} AS banda_medidor,
     {_cut_band('s', scoring.TABLE_CUTS)} AS banda_tabla, {_cut_band('s', scoring.SEGMENT_CUTS)} AS banda_segmento
     FROM (SELECT ruc, fecha_corte, (5.0::DOUBLE - CAST(camel_score AS DOUBLE)) / 4.0::DOUBLE * 100.0::DOUBLE AS s FROM fact)""", "fact"),
)
def score_bands(spark, sf_dir):
    scored = doubles(star(spark, sf_dir).fact).select("ruc", "fecha_corte", scoring.score_100().alias("score_100"))
    return scored.withColumns(
        {
            "banda_medidor": scoring.band("score_100", scoring.GAUGE_CUTS),
            "banda_tabla": scoring.band("score_100", scoring.TABLE_CUTS),
            "banda_segmento": scoring.band("score_100", scoring.SEGMENT_CUTS),
        }
    )


# Status of entities --------------------------------------------------------------------------

_ENTITY_PIVOT = ", ".join(
    f"CAST(sum(CASE WHEN cuenta = '{code}' THEN saldo_usd END) AS DOUBLE) AS {name}"
    for code, name in pivot.ENTITY_ACCOUNTS.items()
)
_NPL = """SELECT ruc, fecha_corte, CAST(sum(CASE WHEN cuenta LIKE '1425%' THEN saldo_usd ELSE 0 END) AS DOUBLE) AS no_devenga,
 CAST(sum(CASE WHEN cuenta LIKE '1426%' THEN saldo_usd ELSE 0 END) AS DOUBLE) AS vencida FROM ledger GROUP BY ruc, fecha_corte"""
_ENTITY_PANEL = f""", wide AS (SELECT ruc, fecha_corte, {_ENTITY_PIVOT} FROM ledger
  WHERE cuenta IN ('1','2','3','11','14','1499','21','4','5') GROUP BY ruc, fecha_corte),
 npl AS (SELECT *, no_devenga + vencida AS cartera_improductiva FROM ({_NPL})),
 entity AS (SELECT *, patrimonio / nullif(activo_total, 0) * 100 AS capitalizacion,
   pasivo_total / nullif(patrimonio, 0) AS apalancamiento,
   CASE WHEN cartera_bruta > 0 THEN cartera_improductiva / cartera_bruta * 100 END AS morosidad,
   CASE WHEN cartera_improductiva > 0 THEN abs(provisiones) / cartera_improductiva * 100 END AS cobertura,
   (coalesce(ingresos, 0) - coalesce(gastos, 0)) / nullif(activo_total, 0) * 100 AS roa,
   fondos_disponibles / nullif(depositos, 0) * 100 AS liquidez_amplia
   FROM wide LEFT JOIN npl USING (ruc, fecha_corte))"""


def entity_panel(spark, sf_dir):
    ledger = star(spark, sf_dir).ledger
    merged = pivot.merge_on_date(pivot.entity_pivot(ledger), pivot.npl_prefix(ledger))
    return ratios.entity_ratios(merged)


@query(
    "entity_pivot",
    sql(f"""SELECT ruc, fecha_corte, {_ENTITY_PIVOT} FROM ledger
     WHERE cuenta IN ('1','2','3','11','14','1499','21','4','5') GROUP BY ruc, fecha_corte"""),
)
def entity_pivot(spark, sf_dir):
    return pivot.entity_pivot(star(spark, sf_dir).ledger)


@query("npl_prefix", sql(f"SELECT *, no_devenga + vencida AS cartera_improductiva FROM ({_NPL})"))
def npl_prefix(spark, sf_dir):
    return pivot.npl_prefix(star(spark, sf_dir).ledger)


_STATE = """CASE WHEN capitalizacion IS NULL THEN 'Sin datos' WHEN capitalizacion >= 12 THEN 'SOLVENTE'
 WHEN capitalizacion >= 9 THEN 'ADECUADO' WHEN capitalizacion >= 6 THEN 'ALERTA' ELSE 'CRITICO' END"""
_TABLE_RATIOS = ["capitalizacion", "morosidad", "cobertura", "apalancamiento", "roa", "liquidez_amplia"]


@query(
    "history_table",
    sql(_ENTITY_PANEL + f""" SELECT ruc, fecha_corte, {rounded('activo_total / 1e6', 2)} AS activo_m, {rounded('patrimonio / 1e6', 2)} AS patrimonio_m,
    {", ".join(f"{rounded(c, 2)} AS {c}" for c in _TABLE_RATIOS)}, {_STATE} AS estado FROM entity"""),
)
def history_table(spark, sf_dir):
    """Status table of every entity at every date."""
    half_up = describe.half_up
    return entity_panel(spark, sf_dir).select(
        "ruc", "fecha_corte",
        half_up(F.col("activo_total") / F.lit(1e6), 2).alias("activo_m"),
        half_up(F.col("patrimonio") / F.lit(1e6), 2).alias("patrimonio_m"),
        *[half_up(c, 2).alias(c) for c in _TABLE_RATIOS],
        scoring.solvency_state().alias("estado"),
    )


@query("solvency_state", sql(_ENTITY_PANEL + f" SELECT {_STATE} AS estado, count(*) AS n FROM entity GROUP BY 1"))
def solvency_state(spark, sf_dir):
    states = entity_panel(spark, sf_dir).select(scoring.solvency_state().alias("estado"))
    return states.groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


_LIGHTS = " UNION ALL ".join(
    f"""SELECT ruc, fecha_corte, '{name}' AS indicador, CASE WHEN {name} IS NULL THEN 'Sin datos'
     WHEN {name} {'>=' if kind == 'mayor' else '<='} {limit} AND abs({name} - {limit}) >= {limit} * 0.3::DOUBLE THEN 'SOLVENTE'
     WHEN {name} {'>=' if kind == 'mayor' else '<='} {limit} THEN 'ADECUADO'
     WHEN abs({name} - {limit}) <= {limit} * 0.2::DOUBLE THEN 'ALERTA' ELSE 'CRITICO' END AS estado FROM entity"""
    for name, (limit, kind, _) in STATUS_LIMITS.items()
)


@query("traffic_light", sql(_ENTITY_PANEL + f" SELECT indicador, estado, count(*) AS n FROM ({_LIGHTS}) GROUP BY 1, 2"))
def traffic_light(spark, sf_dir):
    """Status of every limit at every date, counted per indicator."""
    rows = entity_panel(spark, sf_dir).select(
        "ruc", "fecha_corte",
        *[scoring.traffic_light(name, F.lit(float(limit)), kind).alias(name) for name, (limit, kind, _) in STATUS_LIMITS.items()],
    )
    lights = rows.unpivot(["ruc", "fecha_corte"], list(STATUS_LIMITS), "indicador", "estado")
    return describe.crosstab(lights, "indicador", "estado")


@query(
    "below_limit",
    sql(_ENTITY_PANEL + " SELECT ruc, fecha_corte, " + ", ".join(f"{n} < {l} AS {n}" for n, (l, _, _) in STATUS_LIMITS.items()) + " FROM entity"),
)
def below_limit(spark, sf_dir):
    """Chart shading: under the limit line, whatever the direction of the limit."""
    return entity_panel(spark, sf_dir).select(
        "ruc", "fecha_corte", *[(F.col(n) < F.lit(float(l))).alias(n) for n, (l, _, _) in STATUS_LIMITS.items()]
    )


@query(
    "risk_matrix",
    sql("SELECT ruc, fecha_corte, camel, rating_camel, sc_C, sc_A, sc_M, sc_E, sc_L, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in CLUSTER_FEATURES)
        + " FROM panel WHERE rating_camel IN ('MARGINAL', 'CRITICO')", "panel"),
)
def risk_matrix(spark, sf_dir):
    rows = describe.risk_matrix(star(spark, sf_dir).panel).drop("nombre")
    return rows.withColumns({c: F.round(c, 6) for c in CLUSTER_FEATURES})


@query("solid_and_weak", sql("""SELECT CASE WHEN camel <= 2.5 THEN 'solida' ELSE 'riesgo' END AS grupo, ruc, fecha_corte, camel, rating_camel
 FROM panel WHERE camel <= 2.5 OR camel > 3.5""", "panel"))
def solid_and_weak(spark, sf_dir):
    panel = star(spark, sf_dir).panel.select("ruc", "fecha_corte", "camel", "rating_camel")
    solid = serve.solid(panel).withColumn("grupo", F.lit("solida"))
    return solid.unionByName(serve.weak(panel).withColumn("grupo", F.lit("riesgo")))


@query(
    "json_rows",
    sql("""SELECT '{"ruc":"' || ruc || '","fecha_corte":"' || fecha_corte || '","rating_camel":"' || rating_camel
      || '","nulo":null}' AS json FROM fact""", "fact"),
)
def json_rows(spark, sf_dir):
    fact = star(spark, sf_dir).fact
    return serve.to_json_rows(fact.select("ruc", "fecha_corte", "rating_camel", F.lit(None).cast("double").alias("nulo")))


# Ad-hoc surface ------------------------------------------------------------------------------

_LAST = "fi.fecha_corte = (SELECT max(fecha_corte) FROM fact_indicadores)"
_JOINED = "fact_indicadores fi JOIN dim_cooperativa dc ON fi.ruc = dc.ruc"
ADHOC = {
    "adhoc_count_by_segment": "SELECT segmento, count(*) AS cantidad FROM dim_cooperativa GROUP BY segmento ORDER BY segmento",
    "adhoc_top5_camel": f"SELECT dc.ruc, dc.razon_social, CAST(fi.camel_score AS DOUBLE) AS camel_score, fi.rating_camel FROM {_JOINED} WHERE {_LAST} ORDER BY fi.camel_score DESC, dc.ruc LIMIT 5",
    "adhoc_best_camel": f"SELECT dc.ruc, dc.razon_social, CAST(fi.camel_score AS DOUBLE) AS camel_score FROM {_JOINED} WHERE {_LAST} AND dc.estado = 'ACTIVA' ORDER BY fi.camel_score, dc.ruc LIMIT 10",
    "adhoc_mean_npl_segment": f"SELECT CAST(round(CAST(avg(fi.morosidad_pct) AS DECIMAL(24,8)), 4) AS DOUBLE) AS morosidad FROM {_JOINED} WHERE {_LAST} AND dc.segmento = 'SEGMENTO 1'",
    "adhoc_npl_over_10": f"SELECT count(*) AS cantidad FROM {_JOINED} WHERE {_LAST} AND dc.estado = 'ACTIVA' AND fi.morosidad_pct > 10",
    "adhoc_liquidity_by_segment": f"SELECT dc.segmento, CAST(round(CAST(avg(fi.liquidez_ampliada) AS DECIMAL(24,8)), 4) AS DOUBLE) AS liquidez FROM {_JOINED} WHERE {_LAST} GROUP BY dc.segmento",
    "adhoc_negative_roa_s1": f"SELECT dc.ruc, dc.razon_social, CAST(fi.roa_pct AS DOUBLE) AS roa_pct FROM {_JOINED} WHERE {_LAST} AND dc.segmento = 'SEGMENTO 1' AND fi.roa_pct < 0 ORDER BY dc.ruc",
    "adhoc_top10_assets": f"SELECT dc.ruc, dc.razon_social, CAST(fi.activo_total AS DOUBLE) AS activo_total FROM {_JOINED} WHERE {_LAST} AND fi.activo_total IS NOT NULL ORDER BY fi.activo_total DESC, dc.ruc LIMIT 10",
    "adhoc_guarded": "SELECT ruc, fecha_corte FROM fact_indicadores ORDER BY ruc, fecha_corte LIMIT 500;",
}


def _adhoc_oracle(statement):
    views = ", dim_cooperativa AS (SELECT * FROM dim), fact_indicadores AS (SELECT * FROM fact) "
    return sql(views + statement.rstrip(";").replace("LIMIT 500", "LIMIT 100"), "fact", "dim")


def _register_adhoc(name, statement):
    @query(name, _adhoc_oracle(statement))
    def run(spark, sf_dir):
        s = star(spark, sf_dir)
        surface.register_views({"dim_cooperativa": s.dim_entity, "dim_cuenta": s.dim_account, "fact_indicadores": s.fact})
        return surface.adhoc(spark, statement)


for _name, _statement in ADHOC.items():
    _register_adhoc(_name, _statement)


#: Statements that must not run, and what they would reach.
REFUSED = {
    "shell": "SELECT TRANSFORM(cuenta) USING 'echo ran' AS (o string) FROM dim_cuenta",
    "jvm": "SELECT reflect/**/('java.lang.System', 'getProperty', 'java.version') FROM dim_cuenta",
    "jvm by name": "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version') FROM dim_cuenta",
    "jvm in a subquery": "SELECT ruc FROM dim_cooperativa WHERE ruc IN (SELECT reflect('java.lang.System', 'getProperty', cuenta) FROM dim_cuenta)",
    "file": "SELECT * FROM text.`/etc/hostname`",
    "file names": "SELECT input_file_name/**/() FROM dim_cuenta",
    "other view": "SELECT * FROM IDENTIFIER('not_published')",
    "generator": "SELECT explode(sequence(1, 1000)) AS x FROM dim_cuenta",
    "command": "DROP VIEW dim_cuenta",
}


@query("adhoc_refused", sql(", probe(caso) AS (VALUES " + ", ".join(f"('{k}')" for k in REFUSED)
    + ") SELECT caso, true AS rechazado, (SELECT count(*) FROM dim) AS entidades FROM probe", "dim"))
def adhoc_refused(spark, sf_dir):
    """Each statement is tried over the published tables; afterwards these are all still there."""
    s = star(spark, sf_dir)
    surface.register_views({"dim_cooperativa": s.dim_entity, "dim_cuenta": s.dim_account, "fact_indicadores": s.fact})
    spark.table("dim_cuenta").createOrReplaceTempView("not_published")
    tried = [(case, surface.try_adhoc(spark, statement).columns == ["error"]) for case, statement in REFUSED.items()]
    left = surface.adhoc(spark, "SELECT count(*) AS n FROM dim_cooperativa").first().n
    return spark.createDataFrame([(case, refused, left) for case, refused in tried], "caso string, rechazado boolean, entidades bigint")


_CATALOGUE = {
    "dim_cooperativa": "ruc string, razon_social string, segmento string, primera_fecha date, ultima_fecha date, meses_activo smallint, estado string",
    "dim_cuenta": "cuenta string, descripcion_cuenta string, nivel smallint",
    "fact_indicadores": "fecha_corte date, ruc string, activo_total decimal(20,4), patrimonio decimal(20,4), cartera_bruta decimal(20,4), depositos decimal(20,4), "
    "capitalizacion_pct decimal(20,4), morosidad_pct decimal(20,4), cobertura_pct decimal(20,4), roa_pct decimal(20,4), roe_pct decimal(20,4), nim_pct decimal(20,4), "
    "liquidez_ampliada decimal(20,4), eficiencia_op_pct decimal(20,4), apalancamiento decimal(20,4), intermediacion decimal(20,4), camel_score decimal(5,3), rating_camel string",
}


@query("column_catalogue", "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(view, *column.split(" ")) for view, columns in _CATALOGUE.items() for column in columns.split(", ")
) + ") AS t(vista, columna, tipo)")
def column_catalogue(spark, sf_dir):
    s = star(spark, sf_dir)
    surface.register_views({"dim_cooperativa": s.dim_entity, "dim_cuenta": s.dim_account, "fact_indicadores": s.fact})
    return surface.column_catalogue(spark)
