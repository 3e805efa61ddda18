"""Registered queries whose answers have closed forms: fits on one or two columns, given centres, file round trips."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from balanza.functions.scalar import short_label, stars
from balanza.operators import cluster, describe, neighbours, series, stats
from balanza.plans.catalog import query
from balanza.plans.oracle import sql
from balanza.plans.queries_analysis import rounds
from balanza.plans.queries_ledger import _raw_text
from balanza.plans.star import star
from balanza.session import scratch_path
from balanza.sources import store, text

# Files ---------------------------------------------------------------------------------------


@query("ingest_latin", sql("SELECT ruc, 'Ñandú ' || razon_social AS razon_social, CAST(count(*) AS BIGINT) AS filas FROM ledger GROUP BY 1, 2"))
def ingest_latin(spark, sf_dir):
    """Names beyond ASCII through files in ISO-8859-1."""
    root = scratch_path(spark, "latin")
    raw = _raw_text(star(spark, sf_dir).ledger, True).withColumn("RAZON SOCIAL", F.concat(F.lit("Ñandú "), F.col("RAZON SOCIAL")))
    raw.write.partitionBy("anio").option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(root)
    return text.read_ledger_tree(spark, root).groupBy("ruc", "razon_social").agg(F.count(F.lit(1)).alias("filas"))


@query(
    "ingest_layouts",
    sql("""SELECT anio, ruc, CASE WHEN CAST(ruc AS BIGINT) % 3 = 0 THEN segmento END AS segmento, CAST(count(*) AS BIGINT) AS filas, CAST(sum(saldo_usd) AS DOUBLE) AS total
      FROM ledger WHERE CAST(ruc AS BIGINT) % 3 < 2 GROUP BY ALL"""),
)
def ingest_layouts(spark, sf_dir):
    """Three layouts in one tree: all columns; the required ones in another order; and one without balances, which is refused."""
    raw, root = _raw_text(star(spark, sf_dir).ledger, False), scratch_path(spark, "layouts")
    kind = F.col("RUC").cast("bigint") % 3
    few = raw.select(F.col("CUENTA").alias("Cuenta"), F.col("SALDO (USD)").alias("Saldo"), F.col("FECHA DE CORTE").alias("fecha_corte"), F.col("RUC").alias("Ruc"), "anio")
    for rows, sep in ((raw.where(kind == 0), "\t"), (few.where(F.col("Ruc").cast("bigint") % 3 == 1), ";"), (raw.where(kind == 2).drop("SALDO (USD)"), ";")):
        rows.write.mode("append").partitionBy("anio").option("header", True).option("sep", sep).csv(root)
    back = text.read_ledger_tree(spark, root)
    return back.groupBy("anio", "ruc", "segmento").agg(F.count(F.lit(1)).alias("filas"), F.sum("saldo_usd").cast("double").alias("total"))


@query("refused_layouts", sql("""SELECT DISTINCT anio, 'missing saldo_usd' AS motivo FROM ledger"""))
def refused_layouts(spark, sf_dir):
    raw, root = _raw_text(star(spark, sf_dir).ledger, False), scratch_path(spark, "layouts")
    raw.drop("SALDO (USD)").write.partitionBy("anio").option("header", True).option("sep", ";").csv(root)
    return text.refused_files(spark, text.scan_tree(spark, root)).select(text.year_of_path(F.col("path")).alias("anio"), "motivo").distinct()


@query("store_skip", sql("SELECT anio, CAST(count(*) AS BIGINT) AS filas, CAST(sum(saldo_usd) AS DOUBLE) AS total FROM ledger GROUP BY anio"))
def store_skip(spark, sf_dir):
    """A store that exists is left as it is."""
    ledger, path = star(spark, sf_dir).ledger, scratch_path(spark, "store")
    store.write_ledger(ledger, path)
    store.write_ledger(ledger.withColumn("saldo_usd", -F.col("saldo_usd")), path, "skip")
    return store.read_ledger(spark, path).groupBy("anio").agg(F.count(F.lit(1)).alias("filas"), F.sum("saldo_usd").cast("double").alias("total"))


@query(
    "export_csv",
    sql("SELECT ruc, razon_social, segmento, estado FROM dim", "dim"),
)
def export_csv(spark, sf_dir):
    """The entities as a spreadsheet file with a byte-order mark, read back."""
    path = scratch_path(spark, "export")
    store.write_directory_csv(star(spark, sf_dir).dim_entity.select("ruc", "razon_social", "segmento", "estado"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col(back.columns[0]).alias("ruc"), "razon_social", "segmento", "estado")


@query(
    "ledger_schema",
    """SELECT * FROM (VALUES ('fecha_corte', 'date'), ('segmento', 'string'), ('ruc', 'string'), ('razon_social', 'string'), ('cuenta', 'string'),
      ('descripcion_cuenta', 'string'), ('saldo_usd', 'decimal(38,4)'), ('anio', 'string')) AS t(column_name, column_type)""",
)
def ledger_schema(spark, sf_dir):
    return describe.describe_schema(describe.preview(star(spark, sf_dir).ledger, 3))


# Text ----------------------------------------------------------------------------------------


@query(
    "short_labels",
    """SELECT l_linenumber % 3 AS caso, CASE l_linenumber % 3 WHEN 0 THEN 'Mutualista' WHEN 1 THEN 'Seg. 3' ELSE 'SEGMENTO 2' END AS etiqueta, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def short_labels(spark, sf_dir):
    lines, case = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_linenumber") % 3
    label = F.when(case == 0, "Segmento 1 Mutualista").when(case == 1, "Segmento 3").otherwise("SEGMENTO 2")
    return lines.groupBy(case.cast("bigint").alias("caso"), short_label(label).alias("etiqueta")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "significance_stars",
    """SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig, count(*) AS n
      FROM (SELECT (CAST(l_partkey AS BIGINT) % 1000) / 10000.0::DOUBLE AS p FROM lineitem) GROUP BY 1""",
)
def significance_stars(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(stars((F.col("l_partkey") % 1000) / F.lit(10000.0)).alias("sig")).agg(F.count(F.lit(1)).alias("n"))


# Clusters ------------------------------------------------------------------------------------

_RULE = "CASE WHEN rating_camel IN ('SOLIDA', 'ADECUADA') THEN 0 ELSE 1 END"


@query(
    "attached_clusters",
    sql("""SELECT cluster, count(*) AS n FROM (SELECT CASE WHEN month(fecha_corte) = 12 THEN CAST(substr(ruc, 13, 1) AS BIGINT) % 3 END AS cluster FROM panel) GROUP BY cluster""", "panel"),
)
def attached_clusters(spark, sf_dir):
    """Labels for the rows of December, joined back to the whole panel."""
    panel = star(spark, sf_dir).panel
    some = panel.where(F.month("fecha_corte") == 12).select(
        F.concat_ws("|", "ruc", "fecha_corte").alias("id"), (F.substring("ruc", 13, 1).cast("bigint") % 3).alias("label")
    )
    return cluster.attach_clusters(panel, some).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_TWO = """, c AS (SELECT ruc || '|' || CAST(fecha_corte AS VARCHAR) AS id, "A_morosidad" AS x, "E_roa" AS y FROM panel WHERE "A_morosidad" IS NOT NULL AND "E_roa" IS NOT NULL)"""
_EIGEN = _TWO + """, m AS (SELECT avg(x) AS ax, avg(y) AS ay, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS w FROM c),
 e AS (SELECT *, (vx + vy + sqrt((vx - vy) ** 2 + 4 * w * w)) / 2 AS l1, (vx + vy - sqrt((vx - vy) ** 2 + 4 * w * w)) / 2 AS l2 FROM m),
 u AS (SELECT *, w / sqrt(w * w + (l1 - vx) ** 2) AS a, (l1 - vx) / sqrt(w * w + (l1 - vx) ** 2) AS b FROM e),
 v AS (SELECT *, CASE WHEN abs(a) >= abs(b) THEN sign(a) ELSE sign(b) END AS s FROM u)"""


def two_points(spark, sf_dir):
    panel = star(spark, sf_dir).panel.withColumn("id", F.concat_ws("|", "ruc", "fecha_corte"))
    return neighbours.to_points(panel, "id", ["A_morosidad", "E_roa"])


@query(
    "pca_pair_variance",
    sql(_EIGEN + """ SELECT 1 AS componente, round(l1 / (l1 + l2), 6) AS varianza, round(l1 / (l1 + l2), 6) AS acumulada FROM v
      UNION ALL SELECT 2, round(l2 / (l1 + l2), 6), 1.0 FROM v""", "panel"),
)
def pca_pair_variance(spark, sf_dir):
    return rounds(cluster.Components(two_points(spark, sf_dir)).variance(), ["varianza", "acumulada"])


@query("pca_pair_loadings", sql(_EIGEN + """ SELECT 'A_morosidad' AS indicador, round(a * s, 6) AS pc1 FROM v UNION ALL SELECT 'E_roa', round(b * s, 6) FROM v""", "panel"))
def pca_pair_loadings(spark, sf_dir):
    return rounds(cluster.Components(two_points(spark, sf_dir)).loadings(["A_morosidad", "E_roa"]).select("indicador", "pc1"), ["pc1"])


@query("pca_pair_scores", sql(_EIGEN + " SELECT id, round(((x - ax) * a + (y - ay) * b) * s, 5) AS pc1 FROM c, v", "panel"))
def pca_pair_scores(spark, sf_dir):
    return rounds(cluster.Components(two_points(spark, sf_dir)).scores(1), ["pc1"], 5)


@query("components_for_95", sql(_EIGEN + " SELECT CASE WHEN l1 / (l1 + l2) >= 0.95 THEN 1 ELSE 2 END AS componentes FROM v", "panel"))
def components_for_95(spark, sf_dir):
    return cluster.components_for(cluster.Components(two_points(spark, sf_dir)).variance(), 0.95)


_CENTRES = [[5.0, 2.0], [15.0, -1.0], [40.0, -10.0]]


@query(
    "kmeans_assigned",
    sql(_TWO + """, d AS (SELECT *, (x - 5) ** 2 + (y - 2) ** 2 AS d0, (x - 15) ** 2 + (y + 1) ** 2 AS d1, (x - 40) ** 2 + (y + 10) ** 2 AS d2 FROM c)
     SELECT CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS label, count(*) AS n, round(sum(least(d0, d1, d2)), 4) AS inercia FROM d GROUP BY 1""", "panel"),
)
def kmeans_assigned(spark, sf_dir):
    """Given centres: which is nearest, and the sum of squares to it."""
    centres = np.array(_CENTRES)
    labelled = cluster.assign(two_points(spark, sf_dir), centres)
    at = lambda d: F.element_at(F.array(*[F.lit(float(v)) for v in centres[:, d]]), F.col("label") + 1)
    square = (F.col("x0") - at(0)) * (F.col("x0") - at(0)) + (F.col("x1") - at(1)) * (F.col("x1") - at(1))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(square), 4).alias("inercia"))


@query(
    "best_k_rule",
    "SELECT * FROM (VALUES (5, 3, 2, 4)) AS t(inercia, silhouette, calinski_harabasz, davies_bouldin) WHERE (SELECT count(*) FROM region) = 5",
)
def best_k_rule(spark, sf_dir):
    """Each criterion's choice from a sweep made of the regions: one k per region."""
    k = F.col("r_regionkey").cast("int") + 1
    value = lambda best: F.when(k == best, 1.0).otherwise(F.lit(0.1) / k)
    sweep = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        k.alias("k"), (-k).cast("double").alias("inercia"), value(3).alias("silhouette"), value(2).alias("calinski_harabasz"), (-value(4)).alias("davies_bouldin")
    )
    return cluster.best_k(sweep)


@query(
    "members_by_rule",
    sql(f""", r AS (SELECT {_RULE} AS cluster, ruc || '|' || CAST(fecha_corte AS VARCHAR) AS id FROM panel)
      SELECT cluster, count(*) OVER (PARTITION BY cluster) AS n, id FROM r""", "panel"),
)
def members_by_rule(spark, sf_dir):
    panel = star(spark, sf_dir).panel
    rule = F.when(F.col("rating_camel").isin("SOLIDA", "ADECUADA"), 0).otherwise(1)
    return cluster.cluster_members(panel.select(rule.alias("cluster"), F.concat_ws("|", "ruc", "fecha_corte").alias("id")), "cluster", "id")


# Smoothing -----------------------------------------------------------------------------------

_STRAIGHT = """, o AS (SELECT ruc, fecha_corte, row_number() OVER (PARTITION BY ruc ORDER BY fecha_corte) - 1 AS i, CAST(substr(ruc, 13, 1) AS BIGINT) AS d FROM panel),
 n AS (SELECT ruc, any_value(d) AS d, max(i) AS i, max(fecha_corte) AS u FROM o GROUP BY ruc)"""


@query(
    "holt_straight",
    sql(_STRAIGHT + """ SELECT ruc, paso, CAST(10 + d + 0.5 * (i + paso) AS DOUBLE) AS prediccion, CAST(10 + d + 0.5 * (i + paso) AS DOUBLE) AS inferior,
      CAST(10 + d + 0.5 * (i + paso) AS DOUBLE) AS superior FROM n, (SELECT unnest(range(1, 4)) AS paso)""", "panel"),
)
def holt_straight(spark, sf_dir):
    """On straight lines the forecast goes on with them and its band has no width."""
    place = F.row_number().over(Window.partitionBy("ruc").orderBy("fecha_corte")) - 1
    line = star(spark, sf_dir).panel.select("ruc", "fecha_corte", (F.lit(10.0) + F.substring("ruc", 13, 1).cast("int") + place * F.lit(0.5)).alias("valor"))
    found = series.holt(line, 3).select("ruc", "paso", "prediccion", "inferior", "superior")
    return rounds(found, ["prediccion", "inferior", "superior"], 3)


# Regression ----------------------------------------------------------------------------------

_LINE = """, c AS (SELECT ruc, fecha_corte, "A_morosidad" AS x, "C_solvencia" AS y FROM panel WHERE "A_morosidad" IS NOT NULL AND "C_solvencia" IS NOT NULL),
 f AS (SELECT count(*) AS n, avg(x) AS ax, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2 FROM c),
 r AS (SELECT ruc, fecha_corte, x, a + b * x AS ajustado, y - a - b * x AS e, 1 / n + (x - ax) ** 2 / sxx AS h, n, ax, a, b, sxx, r2 FROM c, f)"""


@query(
    "ols_line_hc3",
    sql(_LINE + """, s AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(r2) AS r2, any_value(n) AS n, sqrt(sum(((x - ax) * e / (1 - h)) ** 2)) / any_value(sxx) AS eb,
       sqrt(sum(((1 / n - ax * (x - ax) / sxx) * e / (1 - h)) ** 2)) AS ea FROM r)
     SELECT 'Intercept' AS variable, round(a, 5) AS coeficiente, round(ea, 5) AS error, round(a / ea, 4) AS z, round(r2, 6) AS r2, n FROM s
     UNION ALL SELECT 'A_morosidad', round(b, 5), round(eb, 5), round(b / eb, 4), round(r2, 6), n FROM s""", "panel"),
)
def ols_line_hc3(spark, sf_dir):
    table = stats.ols_hc3(star(spark, sf_dir).panel, "C_solvencia", ["A_morosidad"])
    table = rounds(rounds(rounds(table, ["coeficiente", "error"], 5), ["z"], 4), ["r2"])
    return table.select("variable", "coeficiente", "error", "z", "r2", F.col("n").cast("bigint").alias("n"))


@query("ols_line_residuals", sql(_LINE + " SELECT ruc, fecha_corte, round(ajustado, 5) AS ajustado, round(e, 5) AS residuo FROM r", "panel"))
def ols_line_residuals(spark, sf_dir):
    found = stats.ols_residuals(star(spark, sf_dir).panel, "C_solvencia", ["A_morosidad"])
    return rounds(found.select("ruc", "fecha_corte", "ajustado", "residuo"), ["ajustado", "residuo"], 5)
