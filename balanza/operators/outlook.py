"""Looking ahead: periods, early warnings, regressions with a horizon, and multivariate anomalies."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from balanza.constants import CLUSTER_FEATURES
from balanza.functions.ordered import exact_quantiles
from balanza.functions.tails import chi2_upper
from balanza.session import scratch_path

SEED = 42


def month_number(date) -> Column:
    """Months since year 0: dates a whole number of months apart differ by that number."""
    return F.year(date) * 12 + F.month(date)


# Periods -----------------------------------------------------------------------------------


def label_periods(df: DataFrame, periods: DataFrame, date: str = "fecha_corte") -> DataFrame:
    """Each row of ``df`` once for every period of ``periods (periodo, desde, hasta)`` that its date falls in, ends included.

    Periods may overlap or leave gaps. They are looked up by month, so the join has a key, and a
    period is a few rows, however many dates the table has. A period without both ends is left out.
    """
    months = F.explode(F.sequence(F.trunc("desde", "MM"), F.trunc("hasta", "MM"), F.expr("interval 1 month")))
    known = periods.where(F.col("desde") <= F.col("hasta")).select("periodo", "desde", "hasta", months.alias("_month"))
    here = (F.trunc(F.col(date), "MM") == F.col("_month")) & F.col(date).between(F.col("desde"), F.col("hasta"))
    return df.join(known, here).drop("desde", "hasta", "_month")


def period_profile(df: DataFrame, periods: DataFrame, indicators: list[str], date: str = "fecha_corte") -> DataFrame:
    """Count, mean, median, spread and extremes of each indicator in each period."""
    labelled = label_periods(df.select(date, *indicators), periods, date)
    long = labelled.unpivot(["periodo"], indicators, "indicador", "valor").where(F.col("valor").isNotNull())
    keys = ["periodo", "indicador"]
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("std"),
        F.min("valor").alias("min"), F.max("valor").alias("max"),
    )
    return moments.join(exact_quantiles(long, keys, "valor", [0.5], ["mediana"]), keys)


def period_change(profile: DataFrame, before: str, during: str) -> DataFrame:
    """How the mean and median of each indicator moved from one period to another."""
    side = lambda p, tag: profile.where(F.col("periodo") == p).select("indicador", F.col("media").alias(f"media_{tag}"), F.col("mediana").alias(f"mediana_{tag}"))
    both = side(before, "antes").join(side(during, "durante"), "indicador")
    return both.withColumns({f"cambio_{m}": F.col(f"{m}_durante") - F.col(f"{m}_antes") for m in ("media", "mediana")})


# Early warning -----------------------------------------------------------------------------


def future_label(
    panel: DataFrame, bad: Column, months: int = 12, key: str = "ruc", date: str = "fecha_corte", out: str = "alerta"
) -> DataFrame:
    """``panel`` with ``out``: 1 if the entity is ``bad`` at any of its dates in the ``months`` after the row's, 0 if at none.

    Null where the answer is not known: the table ends before the horizon does and nothing bad is
    seen, or the entity has no later date in it. A window holds one entity's dates.
    """
    last = panel.agg(F.max(month_number(date)).alias("m")).select("m").scalar()
    ahead = Window.partitionBy(key).orderBy("_month").rangeBetween(1, months)
    seen = panel.withColumns({"_month": month_number(date), "_bad": bad.cast("int"), "_last": last})
    seen = seen.withColumns({"_any": F.max("_bad").over(ahead)})
    known = F.when(F.col("_any") == 1, 1).when(F.col("_month") + months <= F.col("_last"), F.col("_any"))
    return seen.withColumn(out, known).drop("_month", "_bad", "_any", "_last")


@dataclass(frozen=True)
class WarningModel:
    """A fitted early-warning forest: its features, what replaces a missing one, and when its knowledge ends."""

    features: list[str]
    medians: dict[str, float]
    model: RandomForestClassificationModel
    until: object

    def assembled(self, rows: DataFrame) -> DataFrame:
        filled = rows.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for i, c in enumerate(self.features)})
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.features))], outputCol="_features").transform(filled)

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``probabilidad`` of an alert; rows with missing features are scored too."""
        scored = self.model.transform(self.assembled(rows))
        drop = [c for c in scored.columns if c.startswith("_")] + ["rawPrediction", "prediction"]
        return scored.withColumn("probabilidad", vector_to_array("probability")[1]).drop(*drop, "probability")

    def importances(self) -> DataFrame:
        """(indicador, importancia, lugar): what the trees gained by splits on each feature; shares of 1."""
        gains = self.model.featureImportances.toArray()
        order = sorted(range(len(gains)), key=lambda i: (-gains[i], self.features[i]))
        rows = [(self.features[i], float(gains[i]), place) for place, i in enumerate(order, 1)]
        return SparkSession.active().createDataFrame(rows, "indicador string, importancia double, lugar int")


def training_rows(labelled: DataFrame, split, months: int = 12, date: str = "fecha_corte", label: str = "alerta") -> DataFrame:
    """Rows whose label was known at the date ``split``: their whole horizon lies before or at it."""
    return labelled.where(F.col(label).isNotNull() & (F.add_months(F.col(date), months) <= F.last_day(F.lit(split).cast("date"))))


def fit_warning(
    labelled: DataFrame, split, features: list[str] = CLUSTER_FEATURES, months: int = 12, date: str = "fecha_corte",
    label: str = "alerta", trees: int = 50, depth: int = 5, seed: int = SEED,
) -> WarningModel:
    """A random forest on what was known at ``split``; missing features take the median of the training rows.

    Needs rows of both labels among them.
    """
    rows = training_rows(labelled, split, months, date, label)
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "indicador", "valor")
    found = exact_quantiles(long.where(F.col("valor").isNotNull()), ["indicador"], "valor", [0.5], ["m"]).collect()
    medians = {c: 0.0 for c in features} | {r.indicador: float(r.m) for r in found}
    if rows.select(label).distinct().count() < 2:
        raise ValueError(f"rows up to {split} do not have both labels")
    empty = WarningModel(features, medians, None, split)
    # Rows in a fixed order, so that the trees repeat between runs.
    ready = empty.assembled(rows).select("_features", F.col(label).cast("double").alias("_label"), *[f"_f{i}" for i in range(len(features))])
    ready = ready.repartitionByRange(4, *[f"_f{i}" for i in range(len(features))]).sortWithinPartitions(*[f"_f{i}" for i in range(len(features))], "_label")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)
    # Written and read again: a fresh fit drags its training data along, which tasks can't be sent.
    path = scratch_path(labelled.sparkSession, "forest")
    forest.fit(ready.select("_features", "_label")).write().save(path)
    return WarningModel(features, medians, RandomForestClassificationModel.load(path), split)


def early_warning(labelled: DataFrame, split, date: str = "fecha_corte", **fit) -> tuple[DataFrame, WarningModel]:
    """(rows after ``split`` with their probability, the fitted forest); nothing after ``split`` is learnt from."""
    fitted = fit_warning(labelled, split, date=date, **fit)
    return fitted.score(labelled.where(F.col(date) > F.lit(split).cast("date"))), fitted


def warning_quality(scored: DataFrame, label: str = "alerta", threshold: float = 0.5) -> DataFrame:
    """(n, positivos, exactitud, precision, sensibilidad, auc) over rows with a known label."""
    known = scored.where(F.col(label).isNotNull())
    said = F.col("probabilidad") >= threshold
    yes = F.col(label) == 1
    # The area under the curve from average ranks: ties count half.
    counts = known.groupBy("probabilidad").agg(F.count_if(yes).alias("p"), F.count_if(~yes).alias("q"))
    below = Window.partitionBy(F.lit(0)).orderBy("probabilidad").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("_below", F.coalesce(F.sum("q").over(below), F.lit(0)))
    area = steps.agg(F.try_divide(F.sum(F.col("p") * (F.col("_below") + F.col("q") / 2)), F.sum("p").cast("double") * F.sum("q")).alias("auc"))
    return known.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes).alias("positivos"), F.avg((said == yes).cast("double")).alias("exactitud"),
        F.try_divide(F.count_if(said & yes), F.count_if(said)).alias("precision"),
        F.try_divide(F.count_if(said & yes), F.count_if(yes)).alias("sensibilidad"),
    ).withColumn("auc", area.scalar())


# Regression with a horizon -----------------------------------------------------------------


def with_target(
    df: DataFrame, value: str, months: int = 3, key: str = "ruc", date: str = "fecha_corte", out: str = "objetivo"
) -> DataFrame:
    """``df`` with the same series' value exactly ``months`` later; null where there is none."""
    ahead = Window.partitionBy(key).orderBy("_month").rangeBetween(months, months)
    return df.withColumn("_month", month_number(date)).withColumn(out, F.first(value).over(ahead)).drop("_month")


def _solve(features: list[str], means: list[float]):
    names = ["_one", *features]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                gram = np.array([[row[f"_s_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
                right = np.array([row[f"_t_{i}"] for i in range(len(names))], float)
                # Scaled to a unit diagonal, so that units don't decide what is singular.
                unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                scaled = gram / unit[:, None] / unit[None, :]
                full = np.linalg.matrix_rank(scaled, tol=1e-10) == len(names)
                weights = np.linalg.solve(scaled, right / unit) / unit if full else None
                if full:
                    weights[0] += means[-1] - weights[1:] @ np.array(means[:-1])
                out.append((row["_fold"], int(row["_n"]), None if weights is None else list(map(float, weights))))
            yield pd.DataFrame(out, columns=["_fold", "n_entrena", "_weights"])

    return run


def expanding_fits(pairs: DataFrame, features: list[str], months: int = 3, date: str = "fecha_corte", target: str = "objetivo") -> DataFrame:
    """(_fold, n_entrena, _weights): least squares with intercept at every month, on what was known then.

    One aggregate per month of target gives the sums of products, one running total over the
    months gives those of every expanding window; no row is read once per fold. ``_weights`` is
    the intercept and one weight per feature, null where the sums are singular.
    """
    known = pairs.where(F.col(target).isNotNull())
    for c in features:
        known = known.where(F.col(c).isNotNull())
    # Moved to their means, so that sums of products keep their digits; the intercept moves back.
    means = known.agg(*[F.avg(F.col(c).cast("double")) for c in [*features, target]]).first()
    means = [0.0 if m is None else float(m) for m in means]
    terms = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(m) for c, m in zip(features, means)]]
    goal = F.col(target).cast("double") - F.lit(means[-1])
    sums = {f"_s_{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))}
    sums |= {f"_t_{i}": F.sum(terms[i] * goal) for i in range(len(terms))}
    monthly = known.groupBy((month_number(date) + months).alias("_seen")).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in sums.items()])
    # One row a month from here on. A month without new targets still is a fold: it knows what the last one knew.
    folds = pairs.select(month_number(date).alias("_fold")).distinct()
    upto = Window.partitionBy(F.lit(0)).orderBy("_fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = folds.join(monthly.withColumnRenamed("_seen", "_fold"), "_fold", "full_outer").na.fill(0)
    totals = rows.select("_fold", *[F.sum(c).over(upto).alias(c) for c in ("_n", *sums)])
    return totals.where(F.col("_n") > len(features)).mapInPandas(_solve(features, means), "_fold int, n_entrena bigint, _weights array<double>")


def backtest(
    df: DataFrame, value: str, features: list[str] | None = None, months: int = 3, key: str = "ruc", date: str = "fecha_corte"
) -> DataFrame:
    """One row a month: the regression of ``value`` ``months`` later on today's features, and its errors on that month's rows.

    At month t it has learnt from the pairs whose later value is of month t or before; it then
    predicts from the rows of month t, and is compared with what came. Months without a fit or
    without rows that can be compared are left out.
    """
    features = features or [value]
    pairs = with_target(df, value, months, key, date)
    fits = expanding_fits(pairs, features, months, date)
    rows = pairs.where(F.col("objetivo").isNotNull()).withColumn("_fold", month_number(date)).join(fits.where(F.col("_weights").isNotNull()), "_fold")
    said = F.col("_weights")[0]
    for i, c in enumerate(features):
        said = said + F.col("_weights")[i + 1] * F.col(c).cast("double")
    gone = F.col("objetivo").cast("double") - said
    naive = F.col("objetivo").cast("double") - F.col(value).cast("double")
    return (
        rows.withColumns({"_gone": gone, "_naive": naive}).where(F.col("_gone").isNotNull()).groupBy("_fold")
        .agg(
            F.max(date).alias("corte"), F.first("n_entrena").alias("n_entrena"), F.first("_weights").alias("pesos"),
            F.count(F.lit(1)).alias("n_prueba"), F.avg(F.abs("_gone")).alias("mae"), F.sqrt(F.avg(F.col("_gone") * F.col("_gone"))).alias("rmse"),
            F.avg(F.abs("_naive")).alias("mae_ingenuo"),
        )
        .drop("_fold")
    )


# Anomalies ---------------------------------------------------------------------------------

_TO_SIGMA = 1.482602218505602


def chi2_cut(share: float, axes: int) -> float:
    """The value that a chi-squared variable stays below with probability ``share``."""
    low, high = 0.0, 1.0
    while chi2_upper(high, axes) > 1 - share:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_upper(middle, axes) > 1 - share else (low, middle)
    return (low + high) / 2


def robust_distance(df: DataFrame, features: list[str], share: float = 0.975, rounds: int = 1) -> DataFrame:
    """``df``'s rows with all ``features``, with ``distancia2`` and ``anomalo``.

    The squared distance is measured by the centre and covariance of the rows that are not far
    out themselves: first by medians and absolute deviations of single columns, then ``rounds``
    times by the distance so found. Outliers thus neither widen the covariance nor hide each
    other, and rows that are unusual only in combination show. Medians, one mean and one
    covariance matrix reach the driver. Columns that do not vary among the kept rows count for
    nothing. Fewer kept rows than columns leave the first distance.
    """
    rows = df.na.drop(subset=features).withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(features)})
    axes, cut = [f"_x{i}" for i in range(len(features))], chi2_cut(share, len(features))

    def medians(table: DataFrame) -> dict[str, float]:
        long = table.select(*axes).unpivot([], axes, "eje", "valor")
        return {r.eje: float(r.m) for r in exact_quantiles(long, ["eje"], "valor", [0.5], ["m"]).collect()}

    centre = medians(rows)
    if not centre:
        return rows.drop(*axes).withColumns({"distancia2": F.lit(None).cast("double"), "anomalo": F.lit(None).cast("boolean")})
    spread = medians(rows.select(*[F.abs(F.col(c) - F.lit(centre[c])).alias(c) for c in axes]))
    far = F.lit(0.0)
    for c in axes:
        if spread[c] > 0:
            step = (F.col(c) - F.lit(centre[c])) / F.lit(_TO_SIGMA * spread[c])
            far = far + step * step
    for _ in range(rounds):
        pairs = [(i, j) for i in range(len(axes)) for j in range(i, len(axes))]
        kept = rows.where(far <= cut).agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(axes)],
            *[F.covar_samp(axes[i], axes[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        if kept.n <= len(axes):
            break
        cov = np.zeros((len(axes), len(axes)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = kept[f"c{i}_{j}"]
        scale = np.sqrt(np.diag(cov))
        live = np.flatnonzero(scale > 0)
        inverse = np.linalg.pinv(cov[np.ix_(live, live)] / np.outer(scale[live], scale[live]), rcond=1e-10)
        far, gone = F.lit(0.0), [(F.col(axes[i]) - F.lit(float(kept[f"m{i}"]))) / F.lit(float(scale[i])) for i in live]
        for a in range(len(live)):
            for b in range(len(live)):
                far = far + F.lit(float(inverse[a, b])) * gone[a] * gone[b]
    return rows.withColumn("distancia2", far).withColumn("anomalo", F.col("distancia2") > cut).drop(*axes)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
