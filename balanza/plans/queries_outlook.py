"""Registered queries: periods, early warnings, regressions with a horizon, anomalies, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from balanza.constants import CLUSTER_FEATURES
from balanza.functions.scalar import province
from balanza.operators import outlook, ratios, serve, series
from balanza.plans.catalog import query
from balanza.plans.oracle import sql
from balanza.plans.queries_analysis import regular, rounds
from balanza.plans.queries_ledger import SYSTEM_RATIOS, system
from balanza.plans.star import star
from balanza.session import checkpoint, scratch_path
from balanza.sources import store

# Periods -------------------------------------------------------------------------------------

PERIODS = [("antes", "1995-01-01", "1997-06-30"), ("evento", "1997-07-01", "1998-12-31"), ("todo", "1996-03-31", "2001-12-31"), ("nunca", "2020-01-01", "2022-12-31")]


def periods(spark):
    rows = [(name, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for name, a, b in PERIODS]
    return spark.createDataFrame(rows, "periodo string, desde date, hasta date")


_STATS = ["media", "mediana", "std", "min", "max"]
_PERIOD_SQL = """, per(periodo, desde, hasta) AS (VALUES ('antes', DATE '1995-01-01', DATE '1997-06-30'), ('evento', DATE '1997-07-01', DATE '1998-12-31'),
   ('todo', DATE '1996-03-31', DATE '2001-12-31'), ('nunca', DATE '2020-01-01', DATE '2022-12-31')),
 v AS (SELECT fecha_corte, indicador, valor FROM (UNPIVOT (SELECT fecha_corte, "C_solvencia", "A_morosidad", "E_roa", "L_liq_ampliada" FROM panel)
   ON "C_solvencia", "A_morosidad", "E_roa", "L_liq_ampliada" INTO NAME indicador VALUE valor)),
 prof AS (SELECT periodo, indicador, count(*) AS n, avg(valor) AS media, quantile_cont(valor, 0.5) AS mediana, stddev_samp(valor) AS std, min(valor) AS min, max(valor) AS max
   FROM v JOIN per ON fecha_corte BETWEEN desde AND hasta GROUP BY periodo, indicador)"""
_PERIOD_INDICATORS = ["C_solvencia", "A_morosidad", "E_roa", "L_liq_ampliada"]


@query("period_profile", sql(_PERIOD_SQL + " SELECT periodo, indicador, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS) + " FROM prof", "panel"))
def period_profile(spark, sf_dir):
    return rounds(outlook.period_profile(star(spark, sf_dir).panel, periods(spark), _PERIOD_INDICATORS), _STATS)


@query(
    "period_change",
    sql(_PERIOD_SQL + """ SELECT a.indicador, round(a.media, 6) AS media_antes, round(a.mediana, 6) AS mediana_antes, round(b.media, 6) AS media_durante,
      round(b.mediana, 6) AS mediana_durante, round(b.media - a.media, 6) AS cambio_media, round(b.mediana - a.mediana, 6) AS cambio_mediana
      FROM prof a JOIN prof b USING (indicador) WHERE a.periodo = 'antes' AND b.periodo = 'evento'""", "panel"),
)
def period_change(spark, sf_dir):
    profile = outlook.period_profile(star(spark, sf_dir).panel, periods(spark), _PERIOD_INDICATORS)
    changed = outlook.period_change(profile, "antes", "evento")
    return rounds(changed, [c for c in changed.columns if c != "indicador"])


@query(
    "trend_events",
    sql(SYSTEM_RATIOS + """ SELECT fecha_corte, month(fecha_corte) = 12 AS es_diciembre,
      (fecha_corte BETWEEN DATE '1996-03-01' AND DATE '1997-03-31') OR (fecha_corte BETWEEN DATE '1999-09-30' AND DATE '1999-09-30') AS en_evento FROM ratios"""),
)
def trend_events(spark, sf_dir):
    """The trend charts' bands for two events, one of them a single day."""
    shaded = series.system_trends(ratios.system_ratios(system(star(spark, sf_dir).ledger)), [("1996-03-01", "1997-03-31"), ("1999-09-30", "1999-09-30")])
    return shaded.select("fecha_corte", "es_diciembre", "en_evento").distinct()


# Early warning -------------------------------------------------------------------------------

SPLIT = "1998-12-31"


def labelled(spark, sf_dir):
    panel = star(spark, sf_dir).panel
    return outlook.future_label(panel, F.col("rating_camel").isin("MARGINAL", "CRITICO"))


_LABELS = """, m AS (SELECT *, year(fecha_corte) * 12 + month(fecha_corte) AS mes, rating_camel IN ('MARGINAL', 'CRITICO') AS malo FROM panel),
 f AS (SELECT a.ruc, a.fecha_corte, a.camel, any_value(a.mes) AS mes, max(CAST(b.malo AS INTEGER)) AS alguno FROM m a
   LEFT JOIN m b ON a.ruc = b.ruc AND b.mes BETWEEN a.mes + 1 AND a.mes + 12 GROUP BY a.ruc, a.fecha_corte, a.camel),
 lab AS (SELECT ruc, fecha_corte, camel, CASE WHEN alguno = 1 THEN 1 WHEN mes + 12 <= (SELECT max(mes) FROM m) THEN alguno END AS alerta FROM f)"""


@query("warning_labels", sql(_LABELS + " SELECT ruc, fecha_corte, alerta, coalesce(alerta IS NOT NULL AND fecha_corte <= DATE '1997-12-31', false) AS ensena FROM lab", "panel"))
def warning_labels(spark, sf_dir):
    """Who gets a bad rating within a year, and which rows may teach at the split date: those whose year was over by then."""
    rows = labelled(spark, sf_dir).select("ruc", "fecha_corte", "alerta")
    teaches = outlook.training_rows(rows, SPLIT).select("ruc", "fecha_corte", F.lit(True).alias("ensena"))
    return rows.join(teaches, ["ruc", "fecha_corte"], "left").na.fill(False, ["ensena"])


@query(
    "warning_quality",
    sql(_LABELS + """, s AS (SELECT alerta, camel / 5 AS p FROM lab WHERE alerta IS NOT NULL AND fecha_corte > DATE '1998-12-31'),
     auc AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM (SELECT p FROM s WHERE alerta = 1) a, (SELECT p FROM s WHERE alerta = 0) b)
     SELECT count(*) AS n, count(*) FILTER (WHERE alerta = 1) AS positivos, round(avg(CASE WHEN (p >= 0.6) = (alerta = 1) THEN 1 ELSE 0 END), 6) AS exactitud,
       round(count(*) FILTER (WHERE p >= 0.6 AND alerta = 1) / count(*) FILTER (WHERE p >= 0.6), 6) AS precision,
       round(count(*) FILTER (WHERE p >= 0.6 AND alerta = 1) / count(*) FILTER (WHERE alerta = 1), 6) AS sensibilidad, round(any_value(auc), 6) AS auc FROM s, auc""", "panel"),
)
def warning_quality(spark, sf_dir):
    """How well the present score alone warns: the measure that the forest has to beat."""
    rows = labelled(spark, sf_dir).where(F.col("fecha_corte") > F.lit(SPLIT).cast("date")).withColumn("probabilidad", F.col("camel") / F.lit(5.0))
    return rounds(outlook.warning_quality(rows, threshold=0.6), ["exactitud", "precision", "sensibilidad", "auc"])


def warned(spark, sf_dir):
    return outlook.early_warning(checkpoint(labelled(spark, sf_dir)), SPLIT)


@query("early_warning")
def early_warning(spark, sf_dir):
    return warned(spark, sf_dir)[0].select("ruc", "fecha_corte", "alerta", "probabilidad")


@query("importances")
def importances(spark, sf_dir):
    return warned(spark, sf_dir)[1].importances()


# Regression ----------------------------------------------------------------------------------

_PAIRS = """, obs AS (SELECT ruc, fecha_corte, CAST(capitalizacion_pct AS DOUBLE) AS valor FROM fact WHERE capitalizacion_pct IS NOT NULL),
 cal AS (SELECT ruc, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS fecha_corte
   FROM (SELECT ruc, min(fecha_corte) AS a, max(fecha_corte) AS b FROM obs GROUP BY ruc)),
 reg AS (SELECT cal.ruc, cal.fecha_corte, obs.valor, year(cal.fecha_corte) * 12 + month(cal.fecha_corte) AS mes FROM cal ASOF JOIN obs ON cal.ruc = obs.ruc AND cal.fecha_corte >= obs.fecha_corte),
 par AS (SELECT a.*, b.valor AS objetivo FROM reg a JOIN reg b ON a.ruc = b.ruc AND b.mes = a.mes + 3),
 fit AS (SELECT f.mes, count(*) AS n, regr_slope(objetivo, valor) AS s, regr_intercept(objetivo, valor) AS i FROM (SELECT DISTINCT mes FROM reg) f JOIN par p ON p.mes + 3 <= f.mes GROUP BY f.mes HAVING count(*) > 1)"""


@query(
    "backtest_3m",
    sql(_PAIRS + """ SELECT fecha_corte AS corte, any_value(fit.n) AS n_entrena, round(any_value(s), 4) AS pendiente, round(any_value(i), 4) AS intercepto,
      count(*) AS n_prueba, round(avg(abs(objetivo - i - s * valor)), 4) AS mae, round(sqrt(avg((objetivo - i - s * valor) ** 2)), 4) AS rmse,
      round(avg(abs(objetivo - valor)), 9) AS mae_ingenuo FROM par JOIN fit USING (mes) WHERE s IS NOT NULL GROUP BY fecha_corte""", "fact", freq="month"),
)
def backtest_3m(spark, sf_dir):
    out = outlook.backtest(regular(spark, sf_dir), "valor")
    out = out.withColumns({"intercepto": F.col("pesos")[0], "pendiente": F.col("pesos")[1]}).drop("pesos")
    # Values have four decimals, so their mean may end in a five there.
    return rounds(rounds(out, ["pendiente", "intercepto", "mae", "rmse"], 4), ["mae_ingenuo"], 9)


# Anomalies -----------------------------------------------------------------------------------


@query(
    "robust_distance",
    sql(""", c AS (SELECT ruc, fecha_corte, "A_morosidad" AS x, "E_roa" AS y FROM panel WHERE "A_morosidad" IS NOT NULL AND "E_roa" IS NOT NULL),
     m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM c),
     d AS (SELECT quantile_cont(abs(x - mx), 0.5) * 1.482602218505602 AS sx, quantile_cont(abs(y - my), 0.5) * 1.482602218505602 AS sy FROM c, m),
     k AS (SELECT avg(x) AS ax, avg(y) AS ay, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM c, m, d
       WHERE ((x - mx) / sx) ** 2 + ((y - my) / sy) ** 2 <= -2 * ln(0.025)),
     z AS (SELECT ruc, fecha_corte, (vy * (x - ax) ** 2 - 2 * vxy * (x - ax) * (y - ay) + vx * (y - ay) ** 2) / (vx * vy - vxy * vxy) AS d2 FROM c, k)
     SELECT ruc, fecha_corte, round(d2, 4) AS distancia2, d2 > -2 * ln(0.025) AS anomalo FROM z""", "panel"),
)
def robust_distance(spark, sf_dir):
    found = outlook.robust_distance(star(spark, sf_dir).panel, ["A_morosidad", "E_roa"])
    return found.select("ruc", "fecha_corte", F.round("distancia2", 4).alias("distancia2"), "anomalo")


@query("robust_anomalies")
def robust_anomalies(spark, sf_dir):
    """Rows that stand out in all cluster features together."""
    found = outlook.robust_distance(star(spark, sf_dir).panel, CLUSTER_FEATURES, rounds=2)
    return found.where("anomalo").select("ruc", "fecha_corte", F.round("distancia2", 4).alias("distancia2"))


# Provinces and exports -----------------------------------------------------------------------


@query(
    "provinces",
    sql(""" SELECT coalesce(list_extract(['Azuay', 'Bolívar', 'Cañar', 'Carchi', 'Cotopaxi', 'Chimborazo', 'El Oro', 'Esmeraldas', 'Guayas', 'Imbabura', 'Loja', 'Los Ríos', 'Los Ríos',
      'Manabí', 'Morona Santiago', 'Napo', 'Pichincha', 'Tungurahua', 'Zamora Chinchipe', 'Galápagos', 'Sucumbíos', 'Orellana', 'Santo Domingo', 'Santa Elena'], CAST(s_suppkey % 27 AS INTEGER)), 'SIN PROVINCIA') AS provincia,
      count(*) AS entidades FROM supplier GROUP BY 1"""),
)
def provinces(spark, sf_dir):
    """Suppliers' keys as RUCs of 27 codes, three of which are no province."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ruc = F.concat(F.lpad((F.col("s_suppkey") % 27).cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 11, "0"))
    return rows.groupBy(F.coalesce(province(ruc), F.lit("SIN PROVINCIA")).alias("provincia")).agg(F.count(F.lit(1)).alias("entidades"))


@query(
    "ranking_export",
    sql("""SELECT ruc, segmento, rating_camel, row_number() OVER (ORDER BY camel_score DESC, ruc) AS posicion FROM snap""", "fact", "dim", "snap"),
)
def ranking_export(spark, sf_dir):
    """The ranking written as one spreadsheet file and read back; the position is the line's place in the file."""
    s, path = star(spark, sf_dir), scratch_path(spark, "ranking")
    store.write_ranking_csv(serve.ranked(serve.ranking_rows(s.fact, s.dim_entity), "worst"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col(back.columns[0]).cast("bigint").alias("posicion"), "ruc", "segmento", "rating_camel")
