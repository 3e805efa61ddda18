"""Rank correlation, collinearity, tests and robust regression.

Passes over the data are Spark aggregates; only fixed-size matrices (one row and column per
variable) reach the driver.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from balanza.constants import INDICATORS, OLS_REGRESSORS, OLS_TARGET
from balanza.functions.ordered import average_rank, exact_quantiles, global_position, with_average_rank
from balanza.functions.scalar import stars, with_normal_quantile
from balanza.functions.tails import chi2_p, normal_p, t_p
from balanza.operators.describe import complete_cases, long_panel

MIN_PAIRS = 5


def spearman_matrix(df: DataFrame, columns: list[str] = INDICATORS, ids: list[str] | None = None) -> DataFrame:
    """Lower triangle of the rank correlation over complete rows.

    Ranks come from distinct values and their counts, so a value held by a third of the rows
    is one row of the ranking, and each row then meets its ranks again by its key.
    """
    ids = ids or ["ruc", "fecha_corte"]
    long = long_panel(complete_cases(df, columns), columns, ids)
    wide = (
        with_average_rank(long, ["indicador"], "valor")
        .groupBy(*ids)
        .pivot("indicador", columns)
        .agg(F.max("rango"))
    )
    pairs = [(b, a) for a, b in combinations(columns, 2)]
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long_pairs = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "par", "rho")
    parts = F.split("par", r"\|")
    return long_pairs.select(parts[0].alias("indicador"), parts[1].alias("contra"), "rho")


def spearman_with(df: DataFrame, target: str = OLS_TARGET, columns: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Rank correlation of each column with a target over the rows that have both."""
    ids = ids or ["ruc", "fecha_corte"]
    columns = columns or [c for c in INDICATORS if c != target]
    pairs = (
        df.where(F.col(target).isNotNull())
        .withColumn("_target", F.col(target))
        .unpivot([*ids, "_target"], columns, "indicador", "valor")
        .where(F.col("valor").isNotNull())
    )
    ranked = with_average_rank(pairs, ["indicador"], "valor", "rango").drop("empates")
    both = with_average_rank(ranked, ["indicador"], "_target", "rango_objetivo")
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("rho") * F.col("rho")))
    return (
        both.groupBy("indicador")
        .agg(F.count(F.lit(1)).alias("n"), F.corr("rango", "rango_objetivo").alias("rho"))
        .where(F.col("n") >= MIN_PAIRS)
        .withColumn("p_valor", t_p(t, (F.col("n") - 2).cast("double")))
        .withColumn("sig", stars("p_valor"))
        .orderBy("rho")
    )


# Second moments ----------------------------------------------------------------------------


def gram(df: DataFrame, columns: dict[str, Column]) -> np.ndarray:
    """Matrix of Σ a·b over complete rows in one aggregate; one row reaches the driver."""
    names = list(columns)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    row = df.agg(*[F.sum(columns[names[i]] * columns[names[j]]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((len(names), len(names)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = row[f"s{i}_{j}"] or 0.0
    return matrix


def _scaled_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse through unit-diagonal scaling, for columns of very different size."""
    size = np.sqrt(np.diag(matrix))
    size = np.where(size > 0, size, 1.0)
    return np.linalg.pinv(matrix / np.outer(size, size), hermitian=True) / np.outer(size, size)


def vif(df: DataFrame, columns: list[str] = INDICATORS) -> DataFrame:
    """Variance inflation factors without intercept, largest first.

    A column that the others determine exactly has an infinite factor; one of zeros has none (null).
    """
    matrix = gram(complete_cases(df, columns), {c: F.col(c) for c in columns})
    factors = inflation(matrix)
    rows = sorted(zip(columns, factors), key=lambda r: -(r[1] or 0.0))
    return df.sparkSession.createDataFrame(rows, "indicador string, vif double")


#: Share of a column, of unit length, that the others must leave unexplained.
COLLINEAR = 1e-12


def inflation(matrix: np.ndarray) -> list[float | None]:
    """The factor of each column from its matrix of products: 1 / (share that the others don't explain)."""
    size = np.sqrt(np.diag(matrix))
    scale = np.where(size > 0, size, 1.0)
    unit = matrix / np.outer(scale, scale)
    factors: list[float | None] = []
    for i in range(len(unit)):
        others = np.arange(len(unit)) != i
        cross = unit[others, i]
        left = 1.0 - float(cross @ np.linalg.pinv(unit[np.ix_(others, others)], rcond=COLLINEAR, hermitian=True) @ cross)
        factors.append(None if size[i] == 0 else 1.0 / left if left > COLLINEAR else float("inf"))
    return factors


# Regression --------------------------------------------------------------------------------


class LinearModel:
    """Least squares with HC3 errors: two passes over the data, matrices of the regressors' size."""

    def __init__(self, df: DataFrame, target: str, regressors: list[str]):
        self.target, self.names = target, ["Intercept", *regressors]
        self.rows = complete_cases(df, [target, *regressors])
        self.x = {"Intercept": F.lit(1.0)} | {c: F.col(c) for c in regressors}
        everything = gram(self.rows, self.x | {"_y": F.col(target)})
        self.n = int(round(everything[0, 0]))
        inner, cross = everything[:-1, :-1], everything[:-1, -1]
        self.inverse = _scaled_inverse(inner)
        self.coefficients = self.inverse @ cross

    def fitted(self) -> Column:
        total = F.lit(0.0)
        for value, c in zip(self.coefficients, self.x.values()):
            total = total + F.lit(float(value)) * c
        return total

    def leverage(self) -> Column:
        """xᵢᵀ (XᵀX)⁻¹ xᵢ as a native expression."""
        total, parts = F.lit(0.0), list(self.x.values())
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                if i <= j:
                    factor = float(self.inverse[i, j]) * (1.0 if i == j else 2.0)
                    total = total + F.lit(factor) * a * b
        return total

    def residuals(self) -> DataFrame:
        return self.rows.withColumn("ajustado", self.fitted()).withColumn("residuo", F.col(self.target) - F.col("ajustado"))

    def standard_errors(self) -> np.ndarray:
        scored = self.residuals().withColumn("_w", F.col("residuo") / (F.lit(1.0) - self.leverage()))
        meat = gram(scored, {n: c * F.col("_w") for n, c in self.x.items()})
        return np.sqrt(np.diag(self.inverse @ meat @ self.inverse))

    def r2(self) -> float:
        row = self.residuals().agg(
            F.sum(F.col("residuo") * F.col("residuo")).alias("sse"), F.var_pop(self.target).alias("v"), F.count(F.lit(1)).alias("n")
        ).first()
        return 1.0 - row.sse / (row.v * row.n)


def ols_coefficients(df: DataFrame, target: str, regressors: list[str]) -> DataFrame:
    model = LinearModel(df, target, regressors)
    rows = [(n, float(c), model.n) for n, c in zip(model.names, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "variable string, coeficiente double, n int")


def ols_hc3(df: DataFrame, target: str = OLS_TARGET, regressors: list[str] = OLS_REGRESSORS) -> DataFrame:
    """Coefficients with HC3 errors, z values, normal p-values and stars."""
    model = LinearModel(df, target, regressors)
    r2 = model.r2()
    rows = [
        (n, float(c), float(e), float(c / e) if e > 0 else None, r2, model.n)
        for n, c, e in zip(model.names, model.coefficients, model.standard_errors())
    ]
    table = df.sparkSession.createDataFrame(
        rows, "variable string, coeficiente double, error double, z double, r2 double, n int"
    )
    return table.withColumn("p_valor", normal_p("z")).withColumn("sig", stars("p_valor"))


def ols_residuals(df: DataFrame, target: str = OLS_TARGET, regressors: list[str] = OLS_REGRESSORS) -> DataFrame:
    return LinearModel(df, target, regressors).residuals()


# Normality ---------------------------------------------------------------------------------


def _ordered(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).select(*ids, column)
    placed = global_position(rows, [F.col(column), *[F.col(c) for c in ids]], "_i")
    return placed.withColumn("_n", placed.select(F.max("_i")).scalar())


def qq_pairs(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's probabilities."""
    n, i = F.col("_n"), F.col("_i")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    p = F.when(i == 1, F.lit(1.0) - last).when(i == n, last).otherwise((i - F.lit(0.3175)) / (n + F.lit(0.365)))
    return with_normal_quantile(_ordered(df, column, ids), p, "teorico").select(
        *ids, i.alias("orden"), F.col(column).alias("valor"), "teorico"
    )


def qq_fit(pairs: DataFrame) -> DataFrame:
    """Line through the Q-Q pairs."""
    return pairs.agg(
        F.regr_slope("valor", "teorico").alias("pendiente"),
        F.regr_intercept("valor", "teorico").alias("intercepto"),
        F.corr("valor", "teorico").alias("r"),
    )


# Royston's 1995 polynomials for the Shapiro-Wilk test, constant term first.
SW_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SW_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_SMALL_GAMMA = (-2.273, 0.459)
SW_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SW_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def shapiro_wilk(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Shapiro-Wilk W and p-value (Royston's approximation) from one aggregate of ordered rows."""
    i, n, x = F.col("_i"), F.col("_n"), F.col(column)
    scored = with_normal_quantile(_ordered(df, column, ids), (i - F.lit(0.375)) / (n + F.lit(0.25)), "_m")

    def at(position):
        return F.max(F.when(i == position, x))

    def score_at(position):
        return F.max(F.when(i == position, F.col("_m")))

    sums = scored.agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum(F.col("_m") * x).alias("mx"),
        (F.var_pop(x) * F.count(x)).alias("ss"),
        at(1).alias("x1"), at(2).alias("x2"), at(n - 1).alias("xm"), at(n).alias("xn"),
        score_at(n).alias("mn"), score_at(n - 1).alias("mp"),
    )
    n, mm, mx, mn, mp = (F.col(c) for c in ("n", "mm", "mx", "mn", "mp"))
    u = F.lit(1.0) / F.sqrt(n)
    last = _poly(SW_LAST, u) + mn / F.sqrt(mm)
    second = _poly(SW_SECOND, u) + mp / F.sqrt(mm)
    ends, inner = F.col("xn") - F.col("x1"), F.col("xm") - F.col("x2")
    two = F.lit(2.0)
    phi_large = (mm - two * mn * mn - two * mp * mp) / (F.lit(1.0) - two * last * last - two * second * second)
    phi_small = (mm - two * mn * mn) / (F.lit(1.0) - two * last * last)
    weighted = F.when(
        n > 5, last * ends + second * inner + (mx - mn * ends - mp * inner) / F.sqrt(phi_large)
    ).otherwise(last * ends + (mx - mn * ends) / F.sqrt(phi_small))
    tested = sums.where((n >= 4) & (F.col("ss") > 0)).withColumn("w", F.least(F.lit(1.0), weighted * weighted / F.col("ss")))
    log_n, log_gap = F.ln(F.col("n").cast("double")), F.ln(F.greatest(F.lit(1.0) - F.col("w"), F.lit(1e-300)))
    size = F.col("n").cast("double")
    large = (log_gap - _poly(SW_LARGE_MEAN, log_n)) / F.exp(_poly(SW_LARGE_LOG_SD, log_n))
    small = (-F.ln(_poly(SW_SMALL_GAMMA, size) - log_gap) - _poly(SW_SMALL_MEAN, size)) / F.exp(_poly(SW_SMALL_LOG_SD, size))
    z = F.when(n >= 12, large).otherwise(small)
    return (
        tested.withColumn("z", z)
        .withColumn("_two", normal_p("z"))
        .select("n", "w", F.when(F.col("z") > 0, F.col("_two") / 2).otherwise(F.lit(1.0) - F.col("_two") / 2).alias("p_valor"))
    )


def normality(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Shapiro-Wilk with its verdict at 5 %."""
    verdict = F.when(F.col("p_valor") > 0.05, "NORMAL").otherwise("NO NORMAL")
    return shapiro_wilk(df, column, ids).withColumn("veredicto", verdict)


# Group differences -------------------------------------------------------------------------


def kruskal(df: DataFrame, columns: list[str] = INDICATORS, group: str = "cluster") -> DataFrame:
    """Kruskal-Wallis H with tie correction per column; groups of one are left out.

    Rank sums are taken over (group, value) counts, so repeated values meet the ranking once.
    """
    long = long_panel(df.where(F.col(group).isNotNull()), columns, [group])
    cells = long.groupBy("indicador", group, "valor").agg(F.count(F.lit(1)).alias("_cell"))
    large = cells.groupBy("indicador", group).agg(F.sum("_cell").alias("_size")).where(F.col("_size") >= 2)
    cells = cells.join(large.select("indicador", group), ["indicador", group])
    ranks = average_rank(cells, ["indicador"], "valor", weight="_cell")
    ties = ranks.groupBy("indicador").agg(
        F.sum("empates").alias("n"),
        F.sum(F.col("empates").cast("double") * F.col("empates") * F.col("empates") - F.col("empates")).alias("_ties"),
    )
    groups = (
        cells.join(ranks, ["indicador", "valor"])
        .groupBy("indicador", group)
        .agg(F.sum(F.col("rango") * F.col("_cell")).alias("_ranks"), F.sum("_cell").alias("_size"))
    )
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_term") - F.lit(3.0) * (n + 1)
    correction = F.lit(1.0) - F.col("_ties") / (n * n * n - n)
    return (
        groups.groupBy("indicador")
        .agg(F.sum(F.col("_ranks") * F.col("_ranks") / F.col("_size")).alias("_term"), F.count(F.lit(1)).alias("grupos"))
        .where(F.col("grupos") >= 2)
        .join(ties, "indicador")
        .withColumn("h", F.try_divide(h, correction))
        .where(F.col("h").isNotNull())
        .withColumn("p_valor", chi2_p("h", (F.col("grupos") - 1).cast("double")))
        .select("indicador", "n", "grupos", "h", "p_valor", (F.col("p_valor") < 0.05).alias("significativo"))
        .orderBy("p_valor")
    )


# Scaling -----------------------------------------------------------------------------------


def robust_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column (two numbers each on the driver); range 0 counts as 1."""
    long = long_panel(df, columns, [])
    rows = exact_quantiles(long, ["indicador"], "valor", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]).collect()
    return dict.fromkeys(columns, (0.0, 1.0)) | {r.indicador: (r.q2, (r.q3 - r.q1) or 1.0) for r in rows}


def robust_scale(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """``(x − median) / IQR`` per column."""
    model = robust_fit(df, columns)
    return df.withColumns(
        {f"{prefix}{c}": (F.col(c) - F.lit(model[c][0])) / F.lit(model[c][1]) for c in columns}
    )
