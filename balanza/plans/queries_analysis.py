"""Registered queries: panel statistics, clustering and time series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from balanza.constants import CLUSTER_FEATURES, INDICATORS, RADAR_FEATURES, RADAR_INVERTED, SYSTEM_LIMITS
from balanza.functions.scalar import _AS241
from balanza.operators import cluster, describe, neighbours, ratios, series, stats
from balanza.plans.catalog import query
from balanza.plans.oracle import BREACH, LIMIT_TEXT, rounded, sql
from balanza.plans.queries_ledger import SYSTEM_RATIOS, system
from balanza.plans.star import star
from balanza.session import checkpoint


def rounds(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _panel_query(name, oracle, function, *parts):
    @query(name, sql(oracle, "panel", *parts) if oracle else None)
    def run(spark, sf_dir):
        return function(star(spark, sf_dir).panel)

    return run


# Descriptives and compliance -----------------------------------------------------------------

_PROFILE = ["media", "mediana", "std", "min", "p10", "p90", "max"]
_panel_query(
    "indicator_profile",
    f""", q AS (SELECT indicador, quantile_cont(valor, 0.25) AS q1, quantile_cont(valor, 0.75) AS q3 FROM long GROUP BY indicador)
    SELECT indicador, count(*) AS n, round(avg(valor), 6) AS media, round(quantile_cont(valor, 0.5), 6) AS mediana,
      round(stddev_samp(valor), 6) AS std, round(stddev_samp(valor) / avg(valor) * 100, 4) AS cv_pct,
      round(min(valor), 6) AS min, round(quantile_cont(valor, 0.1), 6) AS p10, round(quantile_cont(valor, 0.9), 6) AS p90,
      round(max(valor), 6) AS max, any_value({LIMIT_TEXT}) AS umbral,
      CAST(count(*) FILTER (WHERE {BREACH}) AS BIGINT) AS n_incumple,
      CAST(count(*) FILTER (WHERE valor < q1 - 1.5 * (q3 - q1) OR valor > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers_iqr
    FROM long JOIN q USING (indicador) JOIN limits USING (indicador) GROUP BY indicador""",
    lambda panel: rounds(rounds(describe.indicator_profile(panel), _PROFILE), ["cv_pct"], 4),
    "long",
)
_panel_query(
    "iqr_outliers",
    """, q AS (SELECT segmento, quantile_cont("A_morosidad", 0.25) AS q1, quantile_cont("A_morosidad", 0.75) AS q3 FROM panel GROUP BY segmento)
    SELECT ruc, fecha_corte, segmento, round("A_morosidad", 6) AS "A_morosidad" FROM panel JOIN q USING (segmento)
    WHERE "A_morosidad" < q1 - (q3 - q1) * 1.5 OR "A_morosidad" > q3 + (q3 - q1) * 1.5""",
    lambda panel: rounds(
        describe.iqr_outliers(panel.select("ruc", "fecha_corte", "segmento", "A_morosidad"), "A_morosidad", ["segmento"])
        .select("ruc", "fecha_corte", "segmento", "A_morosidad"),
        ["A_morosidad"],
    ),
)
_ALERTS = f"""SELECT fecha_corte, ruc, indicador, {rounded('valor', 2)} AS valor, {LIMIT_TEXT} AS umbral
 FROM long JOIN limits USING (indicador) WHERE {BREACH}"""
_panel_query("compliance_alerts", _ALERTS, lambda panel: describe.compliance_alerts(panel).drop("cooperativa"), "long")
_panel_query(
    "breach_counts",
    f", alerts AS ({_ALERTS}) SELECT ruc, count(*) AS n_incumplimientos FROM alerts GROUP BY ruc",
    lambda panel: describe.breach_counts(describe.compliance_alerts(panel)).drop("cooperativa"),
    "long",
)
_panel_query(
    "executive_summary",
    f""", m AS (SELECT indicador, quantile_cont(valor, 0.5) AS valor FROM long GROUP BY indicador)
    SELECT indicador, round(valor, 6) AS mediana, {LIMIT_TEXT} AS umbral, CASE WHEN {BREACH} THEN 'ALERTA' ELSE 'OK' END AS estado
    FROM m JOIN limits USING (indicador)""",
    lambda panel: rounds(describe.executive_summary(panel), ["mediana"]),
    "long",
)
_panel_query(
    "complete_count",
    f"SELECT count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in INDICATORS)}) AS completas, count(*) AS total FROM panel",
    describe.complete_count,
)
_panel_query(
    "rating_distribution",
    "SELECT rating_camel, count(*) AS n, count(*) / CAST((SELECT count(*) FROM panel) AS DOUBLE) * 100 AS pct FROM panel GROUP BY rating_camel",
    describe.rating_distribution,
)

# Statistics ----------------------------------------------------------------------------------


def _avg_rank(c, over=""):
    return f"(rank() OVER ({over} ORDER BY {c}) + (count(*) OVER (PARTITION BY {(over.replace('PARTITION BY ', '') + ', ') if over else ''}{c}) - 1) / 2.0)"


_PAIRS = [(b, a) for a, b in combinations(INDICATORS, 2)]
_panel_query(
    "spearman_matrix",
    f""", complete AS (SELECT {", ".join(INDICATORS)} FROM panel WHERE {' AND '.join(f'{c} IS NOT NULL' for c in INDICATORS)}),
    r AS (SELECT {", ".join(f"{_avg_rank(c)} AS {c}" for c in INDICATORS)} FROM complete)
    SELECT unnest([{", ".join(f"'{a}'" for a, _ in _PAIRS)}]) AS indicador, unnest([{", ".join(f"'{b}'" for _, b in _PAIRS)}]) AS contra,
      unnest([{", ".join(f"round(corr({a}, {b}), 6)" for a, b in _PAIRS)}]) AS rho FROM r""",
    lambda panel: rounds(stats.spearman_matrix(panel), ["rho"]),
)
_panel_query(
    "spearman_target",
    f""", pairs AS (SELECT indicador, valor, "C_solvencia" AS t FROM (UNPIVOT panel ON {", ".join(c for c in INDICATORS if c != "C_solvencia")} INTO NAME indicador VALUE valor)
      WHERE "C_solvencia" IS NOT NULL),
    r AS (SELECT indicador, {_avg_rank('valor', 'PARTITION BY indicador')} AS a, {_avg_rank('t', 'PARTITION BY indicador')} AS b FROM pairs)
    SELECT indicador, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY indicador HAVING count(*) >= 5""",
    lambda panel: rounds(stats.spearman_with(panel).select("indicador", "n", "rho"), ["rho"]),
)
_panel_query("spearman_target_p", None, lambda panel: stats.spearman_with(panel))
_panel_query("vif", None, lambda panel: stats.vif(panel))
_panel_query(
    "vif_pair",
    """, g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM
      (SELECT "A_morosidad" AS a, "S_aprovision" AS b FROM panel WHERE "A_morosidad" IS NOT NULL AND "S_aprovision" IS NOT NULL))
    SELECT unnest(['A_morosidad', 'S_aprovision']) AS indicador, round(1 / (1 - ab * ab / (aa * bb)), 6) AS vif FROM g""",
    lambda panel: rounds(stats.vif(panel, ["A_morosidad", "S_aprovision"]), ["vif"]),
)
_panel_query(
    "ols_coefficients",
    """, d AS (SELECT "C_solvencia" AS y, "A_morosidad" AS a, "log_activo" AS b FROM panel
      WHERE "C_solvencia" IS NOT NULL AND "A_morosidad" IS NOT NULL AND log_activo IS NOT NULL),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
      covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM d),
    s AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)
    SELECT unnest(['Intercept', 'A_morosidad', 'log_activo']) AS variable,
      unnest([round(my - ca * ma - cb * mb, 5), round(ca, 5), round(cb, 5)]) AS coeficiente, CAST(n AS INTEGER) AS n FROM s""",
    lambda panel: rounds(stats.ols_coefficients(panel, "C_solvencia", ["A_morosidad", "log_activo"]), ["coeficiente"], 5),
)
_panel_query("ols_hc3", None, stats.ols_hc3)
_panel_query("ols_residuals", None, lambda panel: stats.ols_residuals(panel).select("ruc", "fecha_corte", "ajustado", "residuo"))
_panel_query("normality", None, lambda panel: stats.normality(stats.ols_residuals(panel), "residuo", ["ruc", "fecha_corte"]))


def _horner(x, coefficients):
    text = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _rational(x, region):
    top, bottom = _AS241[region]
    return f"{_horner(x, top)} / {_horner(x, bottom)}"


def _quantile_sql(source, p, keep):
    """Normal quantile ``z`` of ``p`` per row of ``source``."""
    return f"""SELECT {keep}, CASE WHEN abs(q) <= 0.425 THEN q * {_rational('c', 'central')}
      ELSE CASE WHEN q < 0 THEN -1 ELSE 1 END * CASE WHEN r <= 5 THEN {_rational('(r - 1.6)', 'middle')} ELSE {_rational('(r - 5.0)', 'tail')} END END AS z
      FROM (SELECT *, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(CASE WHEN p <= 0.5 THEN p ELSE 1 - p END)) AS r
            FROM (SELECT *, {p} AS p FROM {source}))"""


_ORDERED = """, o AS (SELECT ruc, fecha_corte, "E_roa" AS v, row_number() OVER (ORDER BY "E_roa", ruc, fecha_corte) AS i,
  count(*) OVER () AS n FROM panel WHERE "E_roa" IS NOT NULL)"""
_FILLIBEN = """CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
  ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END"""
_panel_query(
    "qq_pairs",
    _ORDERED + f", t AS ({_quantile_sql('o', _FILLIBEN, 'ruc, fecha_corte, i, v')}) "
    "SELECT ruc, fecha_corte, i AS orden, round(v, 6) AS valor, round(z, 6) AS teorico FROM t",
    lambda panel: rounds(stats.qq_pairs(panel, "E_roa", ["ruc", "fecha_corte"]), ["valor", "teorico"]),
)
_panel_query(
    "qq_fit",
    _ORDERED + f", t AS ({_quantile_sql('o', _FILLIBEN, 'i, v')}) "
    "SELECT round(regr_slope(v, z), 6) AS pendiente, round(regr_intercept(v, z), 6) AS intercepto, round(corr(v, z), 6) AS r FROM t",
    lambda panel: rounds(stats.qq_fit(stats.qq_pairs(panel, "E_roa", ["ruc", "fecha_corte"])), ["pendiente", "intercepto", "r"]),
)
_BLOM = "(i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)"
_panel_query(
    "shapiro_w",
    _ORDERED + f""", t AS ({_quantile_sql('o', _BLOM, 'i, n, v')}),
    s AS (SELECT max(n) AS n, sum(z * z) AS mm, sum(z * v) AS mx, var_pop(v) * count(*) AS ss, 1 / sqrt(max(n)::DOUBLE) AS u,
      max(v) FILTER (WHERE i = 1) AS x1, max(v) FILTER (WHERE i = 2) AS x2, max(v) FILTER (WHERE i = n - 1) AS xm,
      max(v) FILTER (WHERE i = n) AS xn, max(z) FILTER (WHERE i = n - 1) AS mp, max(z) FILTER (WHERE i = n) AS mn FROM t),
    a AS (SELECT *, {_horner('u', stats.SW_LAST)} + mn / sqrt(mm) AS e, {_horner('u', stats.SW_SECOND)} + mp / sqrt(mm) AS f FROM s)
    SELECT n, round(pow(e * (xn - x1) + f * (xm - x2) + (mx - mn * (xn - x1) - mp * (xm - x2))
      / sqrt((mm - 2 * mn * mn - 2 * mp * mp) / (1 - 2 * e * e - 2 * f * f)), 2) / ss, 6) AS w FROM a""",
    lambda panel: rounds(stats.shapiro_wilk(panel, "E_roa", ["ruc", "fecha_corte"]).select("n", "w"), ["w"]),
)

# A fixed labelling, so that SQL can check the cluster operators.
_RULE = 'CASE WHEN "C_solvencia" >= 12 THEN 0 WHEN "C_solvencia" >= 6 THEN 1 ELSE 2 END'
_RULE_B = 'CASE WHEN "A_morosidad" < 4 THEN 0 WHEN "A_morosidad" < 10 THEN 1 ELSE 2 END'


def rule_label(column="C_solvencia", cuts=(12, 6)):
    return F.when(F.col(column) >= cuts[0], 0).when(F.col(column) >= cuts[1], 1).otherwise(2)


def rule_label_b():
    return F.when(F.col("A_morosidad") < 4, 0).when(F.col("A_morosidad") < 10, 1).otherwise(2)


def labelled_panel(panel):
    return panel.where(F.col("C_solvencia").isNotNull()).withColumn("cluster", rule_label())


_LABELLED = f', lab AS (SELECT *, {_RULE} AS cluster FROM panel WHERE "C_solvencia" IS NOT NULL)'

_panel_query(
    "kruskal",
    _LABELLED + f""", v AS (SELECT indicador, cluster, valor FROM (UNPIVOT lab ON {", ".join(INDICATORS)} INTO NAME indicador VALUE valor)),
    r AS (SELECT indicador, cluster, {_avg_rank('valor', 'PARTITION BY indicador')} AS r FROM v),
    t AS (SELECT indicador, sum(c) AS n, sum(c * c * c - c) AS ties FROM (SELECT indicador, valor, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY ALL) GROUP BY indicador),
    g AS (SELECT indicador, count(*) AS grupos, sum(s * s / m) AS term FROM (SELECT indicador, cluster, sum(r) AS s, count(*) AS m FROM r GROUP BY ALL) GROUP BY indicador),
    h AS (SELECT indicador, CAST(n AS BIGINT) AS n, grupos, (12 / (n * (n + 1)) * term - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM g JOIN t USING (indicador))
    SELECT indicador, n, grupos, round(h, 5) AS h, round(exp(-h / 2), 6) AS p_valor, exp(-h / 2) < 0.05 AS significativo FROM h""",
    lambda panel: rounds(rounds(stats.kruskal(labelled_panel(panel)), ["h"], 5), ["p_valor"]),
)


def _median_pivot(columns):
    return ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in columns)


_panel_query(
    "cluster_profile",
    _LABELLED + f" SELECT cluster, {_median_pivot(CLUSTER_FEATURES)} FROM lab GROUP BY cluster",
    lambda panel: rounds(describe.cluster_profile(labelled_panel(panel)), CLUSTER_FEATURES),
)
_panel_query(
    "radar_profile",
    _LABELLED + f""", v AS (SELECT indicador, cluster, quantile_cont(valor, 0.5) AS m FROM (UNPIVOT lab ON {", ".join(RADAR_FEATURES)} INTO NAME indicador VALUE valor) GROUP BY ALL),
    e AS (SELECT *, min(m) OVER (PARTITION BY indicador) AS lo, max(m) OVER (PARTITION BY indicador) AS hi FROM v)
    SELECT cluster, indicador, round((CASE WHEN indicador IN ({", ".join(f"'{c}'" for c in RADAR_INVERTED)}) THEN hi - m + lo ELSE m END - lo) / nullif(hi - lo, 0), 6) AS radar FROM e""",
    lambda panel: rounds(describe.radar_profile(labelled_panel(panel)), ["radar"]),
)
_panel_query(
    "contingency",
    f"SELECT {_RULE} AS a, {_RULE_B} AS b, count(*) AS n FROM panel GROUP BY 1, 2",
    lambda panel: describe.crosstab(panel.select(rule_label().alias("a"), rule_label_b().alias("b")), "a", "b"),
)
_panel_query(
    "adjusted_rand",
    f""", c AS (SELECT {_RULE} AS a, {_RULE_B} AS b, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bb,
      (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS pa,
      (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS pb,
      (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS total)
    SELECT round((bb - pa * pb / total) / ((pa + pb) / 2 - pa * pb / total), 6) AS ari FROM s""",
    lambda panel: rounds(cluster.adjusted_rand(panel.select(rule_label().alias("a"), rule_label_b().alias("b")), "a", "b"), ["ari"]),
)

# Clustering ----------------------------------------------------------------------------------

_AXES = range(len(CLUSTER_FEATURES))
_POINTS = f""", complete AS (SELECT ruc || '|' || CAST(fecha_corte AS VARCHAR) AS id, {", ".join(CLUSTER_FEATURES)} FROM panel
   WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CLUSTER_FEATURES)}),
 q AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m{i}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r{i}" for i, c in enumerate(CLUSTER_FEATURES))} FROM complete),
 pts AS MATERIALIZED (SELECT id, {", ".join(f"({c} - m{i}) / coalesce(nullif(r{i}, 0), 1) AS x{i}" for i, c in enumerate(CLUSTER_FEATURES))}, {_RULE} AS label FROM complete, q)"""
_DIST = "sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in _AXES) + ")"


def points_of(spark, sf_dir):
    """Robust-scaled points of the whole panel, built once per source."""
    s = star(spark, sf_dir)
    if not hasattr(s, "points"):
        s.points = cluster.scaled_points(s.panel)
    return s.points


def rule_points(spark, sf_dir):
    """Points with the fixed label instead of a fitted one."""
    s = star(spark, sf_dir)
    panel = s.panel.select(F.concat_ws("|", "ruc", "fecha_corte").alias("id"), rule_label().alias("label"))
    return points_of(spark, sf_dir).join(panel, "id")


def _points_query(name, oracle, function):
    @query(name, sql(_POINTS + oracle, "panel") if oracle else None)
    def run(spark, sf_dir):
        return function(points_of(spark, sf_dir))

    return run


def _rule_query(name, oracle, function):
    @query(name, sql(_POINTS + oracle, "panel") if oracle else None)
    def run(spark, sf_dir):
        return function(rule_points(spark, sf_dir))

    return run


_points_query(
    "robust_scaled",
    " SELECT id, " + ", ".join(f"round(x{i}, 6) AS x{i}" for i in _AXES) + " FROM pts",
    lambda points: rounds(points, neighbours.dimensions(points)),
)
_rule_query(
    "silhouette",
    f""", d AS (SELECT a.id, a.label, b.label AS other, sum({_DIST}) AS total FROM pts a, pts b GROUP BY ALL),
    c AS (SELECT label AS other, count(*) AS m FROM pts GROUP BY label),
    s AS (SELECT id, label, max(CASE WHEN other = label THEN m END) AS own, max(CASE WHEN other = label AND m > 1 THEN total / (m - 1) END) AS a,
      min(CASE WHEN other <> label THEN total / m END) AS b FROM d JOIN c USING (other) GROUP BY id, label)
    SELECT id, label, CASE WHEN own = 1 THEN 0 ELSE round((b - a) / greatest(a, b), 6) END AS silhouette FROM s""",
    lambda points: rounds(cluster.silhouette(points), ["silhouette"]),
)
_MOMENTS = f""", m AS (SELECT label, count(*) AS n, {", ".join(f"avg(x{i}) AS c{i}" for i in _AXES)} FROM pts GROUP BY label),
 w AS (SELECT label, any_value(n) AS n, sum({" + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in _AXES)}) AS ss,
   avg(sqrt({" + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in _AXES)})) AS spread FROM pts JOIN m USING (label) GROUP BY label)"""
_rule_query(
    "calinski_harabasz",
    _MOMENTS + f""", g AS (SELECT {", ".join(f"avg(x{i}) AS g{i}" for i in _AXES)} FROM pts),
    b AS (SELECT sum(n * ({" + ".join(f"(c{i} - g{i}) * (c{i} - g{i})" for i in _AXES)})) AS between_ss, count(*) AS k, sum(n) AS n FROM m, g)
    SELECT round((between_ss / (k - 1)) / ((SELECT sum(ss) FROM w) / (n - k)), 6) AS calinski_harabasz FROM b""",
    lambda points: rounds(cluster.calinski_harabasz(points), ["calinski_harabasz"]),
)
_rule_query(
    "davies_bouldin",
    _MOMENTS + f""", z AS (SELECT m.*, spread FROM m JOIN w USING (label))
    SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT max((a.spread + b.spread)
      / sqrt({" + ".join(f"(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})" for i in _AXES)})) AS worst FROM z a JOIN z b ON a.label <> b.label GROUP BY a.label)""",
    lambda points: rounds(cluster.davies_bouldin(points), ["davies_bouldin"]),
)
_KDIST = f""", kd AS MATERIALIZED (SELECT id, k_dist FROM (SELECT a.id, {_DIST} AS k_dist, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}) AS r FROM pts a, pts b) WHERE r = 3),
 e AS (SELECT quantile_cont(k_dist, 0.25) AS eps FROM kd)"""
_points_query(
    "k_distance", _KDIST + " SELECT id, round(k_dist, 6) AS k_dist FROM kd", lambda points: rounds(cluster.k_distance(points), ["k_dist"])
)
_points_query("dbscan_eps", _KDIST + " SELECT round(eps, 6) AS eps FROM e", lambda points: rounds(cluster.dbscan_eps(points), ["eps"]))


def dbscan_of(points):
    eps = cluster.dbscan_eps(points).first().eps
    return cluster.dbscan(points, eps)


_points_query(
    "dbscan_noise",
    _KDIST + f""", c AS MATERIALIZED (SELECT a.id FROM pts a, pts b, e WHERE {_DIST} <= eps GROUP BY a.id HAVING count(*) >= 3),
    near AS (SELECT DISTINCT a.id FROM pts a, (SELECT * FROM pts WHERE id IN (SELECT id FROM c)) b, e WHERE {_DIST} <= eps)
    SELECT id, id IN (SELECT id FROM c) AS nucleo, id NOT IN (SELECT id FROM near) AS ruido FROM pts""",
    lambda points: dbscan_of(points).select("id", "nucleo", F.col("label").isNull().alias("ruido")),
)

# At each cut by itself: radius, neighbours and numbers never cross dates.
_CUTS = f""", p AS MATERIALIZED (SELECT *, split_part(id, '|', 2) AS cut FROM pts),
 near AS MATERIALIZED (SELECT a.cut, a.id AS a, b.id AS b, {_DIST} AS d FROM p a JOIN p b ON a.cut = b.cut),
 kc AS MATERIALIZED (SELECT cut, a AS id, d AS k_dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM near) WHERE r = 3),
 ec AS MATERIALIZED (SELECT cut, quantile_cont(k_dist, 0.25) AS eps FROM kc GROUP BY cut)"""
_CLUSTERS = _CUTS + """, close AS MATERIALIZED (SELECT n.* FROM near n JOIN ec USING (cut) WHERE d <= eps),
 core AS MATERIALIZED (SELECT a AS id FROM close GROUP BY a HAVING count(*) >= 3),
 hop AS MATERIALIZED (SELECT a, b FROM close WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 reach AS (SELECT id, id AS r FROM core UNION SELECT reach.id, hop.b FROM reach JOIN hop ON hop.a = reach.r),
 named AS MATERIALIZED (SELECT id, min(r) AS label FROM reach GROUP BY id),
 edge AS (SELECT a AS id, min(label) AS label FROM close JOIN named ON named.id = close.b GROUP BY a),
 lab AS MATERIALIZED (SELECT p.cut, p.id, coalesce(named.label, edge.label) AS label, named.id IS NOT NULL AS nucleo
   FROM p LEFT JOIN named USING (id) LEFT JOIN edge USING (id))"""


def cut_points(spark, sf_dir):
    """The points with their cut date and the radius of that date."""
    s = star(spark, sf_dir)
    dated = points_of(spark, sf_dir).join(s.panel.select(F.concat_ws("|", "ruc", "fecha_corte").alias("id"), F.col("fecha_corte").cast("string").alias("cut")), "id")
    return checkpoint(dated)


def clusters_by_cut(spark, sf_dir):
    """Clusters of each cut; a cut of fewer than three points has no radius, and all of it is noise."""
    points = cut_points(spark, sf_dir)
    radii = cluster.dbscan_eps(points, by=["cut"])
    return cluster.dbscan(points.join(radii, "cut", "left").na.fill(0.0, ["eps"]), "eps", by=["cut"])


def _cut_query(name, oracle, function):
    recursive = sql(_POINTS + oracle, "panel").replace("WITH", "WITH RECURSIVE", 1)
    query(name, recursive)(function)


_cut_query("k_distance_by_cut", _CUTS + " SELECT cut, id, round(k_dist, 6) AS k_dist FROM kc",
    lambda spark, sf_dir: rounds(cluster.k_distance(cut_points(spark, sf_dir), by=["cut"]), ["k_dist"]))
_cut_query("dbscan_eps_by_cut", _CUTS + " SELECT cut, round(eps, 6) AS eps FROM ec",
    lambda spark, sf_dir: rounds(cluster.dbscan_eps(cut_points(spark, sf_dir), by=["cut"]), ["eps"]))
_cut_query("dbscan", _CLUSTERS + """ SELECT lab.cut, id, CASE WHEN label IS NULL THEN -1 ELSE n END AS cluster, nucleo FROM lab
   LEFT JOIN (SELECT cut, label, row_number() OVER (PARTITION BY cut ORDER BY label) - 1 AS n FROM (SELECT DISTINCT cut, label FROM lab WHERE label IS NOT NULL)) USING (cut, label)""",
    lambda spark, sf_dir: cluster.numbered(clusters_by_cut(spark, sf_dir), ["cut"]))
_cut_query("dbscan_summary", _CLUSTERS + " SELECT cut, count(DISTINCT label) AS clusters, count(*) FILTER (WHERE label IS NULL) AS ruido FROM lab GROUP BY cut",
    lambda spark, sf_dir: cluster.dbscan_summary(clusters_by_cut(spark, sf_dir), ["cut"]))
_points_query("pca_scores", None, lambda points: cluster.Components(points).scores())
_points_query("pca_variance", None, lambda points: cluster.Components(points).variance())
_points_query("pca_loadings", None, lambda points: cluster.Components(points).loadings(CLUSTER_FEATURES))
_points_query("components_for_70", None, lambda points: cluster.components_for(cluster.Components(points).variance()))


def sweep_of(spark, sf_dir):
    """The sweep over k, fitted once per source."""
    s = star(spark, sf_dir)
    if not hasattr(s, "sweep"):
        s.sweep = cluster.kmeans_sweep(points_of(spark, sf_dir))
    return s.sweep


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return sweep_of(spark, sf_dir)


@query("kmeans_best_k")
def kmeans_best_k(spark, sf_dir):
    return cluster.best_k(sweep_of(spark, sf_dir))


def fitted(spark, sf_dir):
    """The final three clusters, fitted once per source."""
    s = star(spark, sf_dir)
    if not hasattr(s, "kmeans"):
        labelled, centres = cluster.kmeans(points_of(spark, sf_dir))
        s.kmeans = checkpoint(labelled), centres
    return s.kmeans


@query("kmeans3")
def kmeans3(spark, sf_dir):
    return fitted(spark, sf_dir)[0].select("id", "label")


@query("kmeans_silhouette")
def kmeans_silhouette(spark, sf_dir):
    return cluster.silhouette(fitted(spark, sf_dir)[0])


@query("kmeans_kruskal")
def kmeans_kruskal(spark, sf_dir):
    panel = cluster.attach_clusters(star(spark, sf_dir).panel, fitted(spark, sf_dir)[0])
    return stats.kruskal(panel)


@query("cluster_members")
def cluster_members(spark, sf_dir):
    panel = cluster.attach_clusters(star(spark, sf_dir).panel, fitted(spark, sf_dir)[0])
    return cluster.cluster_members(panel.where(F.col("cluster").isNotNull()), "cluster", "id")


@query("biplot")
def biplot(spark, sf_dir):
    return cluster.biplot(cluster.Components(points_of(spark, sf_dir)), CLUSTER_FEATURES, fitted(spark, sf_dir)[1])


@query("hierarchical")
def hierarchical(spark, sf_dir):
    return cluster.hierarchical(points_of(spark, sf_dir)).select("id", "label")


def two_labelings(spark, sf_dir):
    tree = cluster.hierarchical(points_of(spark, sf_dir))
    labelled = fitted(spark, sf_dir)[0].withColumnRenamed("label", "K-Means")
    return checkpoint(labelled.join(tree.select("id", F.col("label").alias("Jerarquico")), "id"))


@query("validation_table")
def validation_table(spark, sf_dir):
    return cluster.validation_table(two_labelings(spark, sf_dir), ["K-Means", "Jerarquico"])


@query("kmeans_vs_hierarchical")
def kmeans_vs_hierarchical(spark, sf_dir):
    return cluster.adjusted_rand(two_labelings(spark, sf_dir), "K-Means", "Jerarquico")


# Time series ---------------------------------------------------------------------------------


def monthly(spark, sf_dir):
    """Capitalization per entity and month, as observed."""
    fact = star(spark, sf_dir, "month").fact
    return fact.select("ruc", "fecha_corte", F.col("capitalizacion_pct").cast("double").alias("valor")).where(
        F.col("valor").isNotNull()
    )


def regular(spark, sf_dir):
    return series.asof_monthly(monthly(spark, sf_dir))


_MONTHLY = """, obs AS (SELECT ruc, fecha_corte, CAST(capitalizacion_pct AS DOUBLE) AS valor FROM fact WHERE capitalizacion_pct IS NOT NULL),
 cal AS (SELECT ruc, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS fecha_corte
   FROM (SELECT ruc, min(fecha_corte) AS a, max(fecha_corte) AS b FROM obs GROUP BY ruc)),
 reg AS (SELECT cal.ruc, cal.fecha_corte, obs.valor FROM cal ASOF JOIN obs ON cal.ruc = obs.ruc AND cal.fecha_corte >= obs.fecha_corte),
 idx AS (SELECT *, row_number() OVER (PARTITION BY ruc ORDER BY fecha_corte) - 1 AS x FROM reg),
 line AS (SELECT ruc, count(*) AS n, max(fecha_corte) AS ultima_fecha, regr_slope(valor, x) AS s, regr_intercept(valor, x) AS i, regr_r2(valor, x) AS r2 FROM idx GROUP BY ruc)"""


def _series_query(name, oracle, function):
    @query(name, sql(_MONTHLY + oracle, "fact", freq="month") if oracle else None)
    def run(spark, sf_dir):
        return function(regular(spark, sf_dir))

    return run


_series_query("asof_monthly", " SELECT * FROM reg", lambda df: df)
_series_query(
    "linear_trend",
    """ SELECT ruc, n, ultima_fecha, round(s, 8) AS pendiente_mensual, round(i, 8) AS intercepto, round(r2, 8) AS r2,
    round(s * 12, 8) AS pendiente_anual FROM line""",
    lambda df: rounds(series.trend(df), ["pendiente_mensual", "intercepto", "r2", "pendiente_anual"], 8),
)
_series_query(
    "linear_projection",
    """ SELECT ruc, CAST(paso AS INTEGER) AS paso, last_day(CAST(date_trunc('month', ultima_fecha) + to_months(CAST(paso AS INTEGER)) AS DATE)) AS fecha_corte,
    round(i + s * (n - 1 + paso), 8) AS prediccion FROM line, range(1, 13) AS t(paso) WHERE s IS NOT NULL""",
    lambda df: rounds(series.project_linear(df), ["prediccion"], 8),
)
_series_query("holt", None, series.holt)
_series_query("adf", None, series.adf)


@query(
    "yoy_growth",
    sql(""", y AS (SELECT ruc, year(fecha_corte) AS anio, arg_max(CAST(activo_total AS DOUBLE), fecha_corte) AS valor FROM fact
       WHERE activo_total IS NOT NULL GROUP BY ALL)
     SELECT ruc, CAST(anio AS INTEGER) AS anio, valor, round((valor / nullif(lag(valor) OVER (PARTITION BY ruc ORDER BY anio), 0) - 1) * 100, 8) AS crecimiento_pct FROM y""", "fact"),
)
def yoy_growth(spark, sf_dir):
    fact = star(spark, sf_dir).fact.select("ruc", "fecha_corte", F.col("activo_total").cast("double").alias("valor"))
    return rounds(series.yoy_growth(fact), ["crecimiento_pct"], 8)


def recent_delinquency(spark, sf_dir):
    return star(spark, sf_dir).fact.select("ruc", "fecha_corte", F.round("morosidad_pct", 2).cast("double").alias("valor"))


_FORECAST = """, h AS (SELECT ruc, fecha_corte, coalesce(CAST(round(morosidad_pct, 2) AS DOUBLE), 0) AS y,
   row_number() OVER (PARTITION BY ruc ORDER BY fecha_corte DESC) AS b FROM fact QUALIFY b <= 24),
 xs AS (SELECT *, count(*) OVER (PARTITION BY ruc) AS n, count(*) OVER (PARTITION BY ruc) - b AS x FROM h),
 f AS (SELECT ruc, any_value(n) AS n, max(fecha_corte) AS ultima_fecha, arg_max(y, fecha_corte) AS ultimo_valor, regr_slope(y, x) AS s, regr_intercept(y, x) AS i
   FROM xs GROUP BY ruc HAVING count(*) >= 4),
 z AS (SELECT f.*, 1.96 * sqrt(r.sse / greatest(f.n - 2, 1)) AS hb FROM f JOIN
   (SELECT ruc, sum(pow(y - (i + s * x), 2)) AS sse FROM xs JOIN (SELECT ruc, s, i FROM f) USING (ruc) GROUP BY ruc) r USING (ruc)),
 fc AS (SELECT ruc, CAST(paso AS INTEGER) AS paso, strftime(date_trunc('month', ultima_fecha) + to_months(CAST(paso AS INTEGER)), '%Y-%m') AS mes, ultima_fecha, ultimo_valor,
   s, i, i + s * (n + paso - 1) AS p, hb FROM z, range(1, 5) AS t(paso))"""
_FORECAST_OUT = ["pendiente", "intercepto", "prediccion", "semibanda", "inferior", "superior"]


@query(
    "forecast4",
    sql(_FORECAST + """ SELECT ruc, paso, mes, ultima_fecha, ultimo_valor, round(s, 8) AS pendiente, round(i, 8) AS intercepto, round(p, 8) AS prediccion,
     round(hb, 8) AS semibanda, round(p - hb, 8) AS inferior, round(p + hb, 8) AS superior FROM fc""", "fact"),
)
def forecast4(spark, sf_dir):
    return rounds(series.forecast4(recent_delinquency(spark, sf_dir)), _FORECAST_OUT, 8)


@query(
    "forecast_frame",
    sql(_FORECAST + """, l AS (SELECT ruc, mes, p, hb FROM fc UNION ALL
       SELECT ruc, strftime(ultima_fecha, '%Y-%m'), ultimo_valor, hb FROM fc WHERE paso = 1),
     months AS (SELECT ruc, strftime(fecha_corte, '%Y-%m') AS mes FROM xs UNION ALL
       SELECT ruc, strftime(date_trunc('month', u) + to_months(CAST(k AS INTEGER)), '%Y-%m') FROM (SELECT ruc, max(fecha_corte) AS u FROM xs GROUP BY ruc), range(1, 5) AS t(k))
     SELECT ruc, strftime(fecha_corte, '%Y-%m') AS mes, 'historico' AS serie, round(y, 8) AS valor FROM xs
     UNION ALL SELECT ruc, mes, 'proyeccion', round(p, 8) FROM l UNION ALL SELECT ruc, mes, 'superior', round(p + hb, 8) FROM l
     UNION ALL SELECT ruc, mes, 'inferior', round(p - hb, 8) FROM l UNION ALL SELECT ruc, mes, 'umbral', 5.0::DOUBLE FROM months""", "fact"),
)
def forecast_frame(spark, sf_dir):
    return rounds(series.forecast_frame(recent_delinquency(spark, sf_dir), 5.0), ["valor"], 8)


_TREND_PARTS = " UNION ALL ".join(
    f"SELECT fecha_corte, '{n}' AS indicador, CAST({n} AS DOUBLE) AS valor, {'NULL' if l is None else l}::DOUBLE AS umbral FROM ratios"
    for n, l in SYSTEM_LIMITS.items()
)


@query(
    "system_trends",
    sql(SYSTEM_RATIOS + f""" SELECT *, month(fecha_corte) = 12 AS es_diciembre,
      fecha_corte BETWEEN DATE '2020-03-01' AND DATE '2021-03-01' AS en_evento FROM ({_TREND_PARTS})"""),
)
def system_trends(spark, sf_dir):
    return series.system_trends(ratios.system_ratios(system(star(spark, sf_dir).ledger)))
