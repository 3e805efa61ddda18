"""Time series per entity: calendar, growth, trend and forecasts.

Every series is first one value per entity and date, so a window or a group over one entity
holds at most one row per month, however many ledger rows the entity has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from balanza.constants import SYSTEM_LIMITS
from balanza.functions.scalar import month_label, next_months
from balanza.operators import series_models
from balanza.session import spread


def _month_end_before(c):
    return F.last_day(F.add_months(F.trunc(c, "MM"), -1))


def asof_monthly(series: DataFrame, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Last observation at or before each month-end of the key's span.

    Each observation is spread over the month-ends it covers, up to its successor: one window
    and one explode, without a calendar join.
    """
    ordered = Window.partitionBy(key).orderBy(date)
    observed = series.where(F.col(value).isNotNull() & F.col(date).isNotNull()).select(key, date, value)
    covered = observed.withColumn("_next", F.lead(date).over(ordered)).withColumns(
        {
            "_from": F.last_day(date),
            "_to": F.when(F.col("_next").isNotNull(), _month_end_before(F.col("_next")))
            .when(F.col(date) == F.last_day(date), F.col(date))
            .otherwise(_month_end_before(F.col(date))),
        }
    )
    months = F.sequence(F.trunc("_from", "MM"), F.trunc("_to", "MM"), F.expr("interval 1 month"))
    return (
        covered.where(F.col("_from") <= F.col("_to"))
        .withColumn("_month", F.explode(months))
        .select(key, F.last_day("_month").alias(date), value)
    )


def yoy_growth(df: DataFrame, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Growth in % of the last non-null value of each year over the previous year present."""
    yearly = (
        df.where(F.col(value).isNotNull())
        .groupBy(key, F.year(date).alias("anio"))
        .agg(F.max_by(value, date).alias(value))
    )
    before = F.lag(value).over(Window.partitionBy(key).orderBy("anio"))
    return yearly.withColumn("crecimiento_pct", (F.try_divide(F.col(value), before) - F.lit(1.0)) * F.lit(100.0))


def _indexed(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.withColumn("_x", F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1)


def trend(df: DataFrame, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Least-squares line of each series on its month index."""
    return (
        _indexed(df, key, date)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(date).alias("ultima_fecha"),
            F.regr_slope(value, "_x").alias("pendiente_mensual"),
            F.regr_intercept(value, "_x").alias("intercepto"),
            F.regr_r2(value, "_x").alias("r2"),
        )
        .withColumn("pendiente_anual", F.col("pendiente_mensual") * F.lit(12.0))
    )


def project_linear(df: DataFrame, steps: int = 12, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """The trend continued for ``steps`` month-ends."""
    line = trend(df, key, date, value).where(F.col("pendiente_mensual").isNotNull())
    return line.withColumn("paso", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        key,
        "paso",
        F.expr("last_day(add_months(trunc(ultima_fecha, 'MM'), paso))").alias(date),
        (F.col("intercepto") + F.col("pendiente_mensual") * (F.col("n") - 1 + F.col("paso"))).alias("prediccion"),
    )


def recent(df: DataFrame, n: int = 24, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """The last ``n`` observations of each key with their index, missing values as 0."""
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    return (
        df.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= n)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
        .withColumns({"_x": F.col("_n") - F.col("_back"), "_y": F.coalesce(F.col(value), F.lit(0.0))})
        .select(key, date, "_n", "_x", "_y")
    )


def forecast4(df: DataFrame, steps: int = 4, last: int = 24, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Short forecast with a constant 95 % band; needs at least 4 observations."""
    whole = Window.partitionBy(key)

    def total(c):
        return F.sum(c).over(whole)

    x, y, n = F.col("_x").cast("double"), F.col("_y"), F.col("_n")
    rows = recent(df, last, key, date, value).where(n >= 4)
    fitted = rows.withColumn(
        "_slope", (n * total(x * y) - total(x) * total(y)) / (n * total(x * x) - total(x) * total(x))
    ).withColumn("_level", (total(y) - F.col("_slope") * total(x)) / n)
    error = y - (F.col("_level") + F.col("_slope") * x)
    lines = fitted.withColumn("_error", error).groupBy(key).agg(
        F.max("_n").alias("n"),
        F.max(date).alias("ultima_fecha"),
        F.max_by("_y", date).alias("ultimo_valor"),
        F.max("_slope").alias("pendiente"),
        F.max("_level").alias("intercepto"),
        F.sum(F.col("_error") * F.col("_error")).alias("_sse"),
    )
    band = F.sqrt(F.col("_sse") / F.greatest(F.col("n") - 2, F.lit(1))) * F.lit(1.96)
    point = F.col("intercepto") + F.col("pendiente") * (F.col("n") + F.col("paso") - 1)
    return (
        lines.withColumns({"semibanda": band, "_labels": next_months(F.col("ultima_fecha"), steps)})
        .select("*", F.posexplode("_labels").alias("_i", "mes"))
        .withColumn("paso", F.col("_i") + 1)
        .withColumn("prediccion", point)
        .select(
            key, "paso", "mes", "ultima_fecha", "ultimo_valor", "pendiente", "intercepto", "prediccion", "semibanda",
            (F.col("prediccion") - F.col("semibanda")).alias("inferior"),
            (F.col("prediccion") + F.col("semibanda")).alias("superior"),
        )
    )


def forecast_frame(df: DataFrame, limit: float | None = None, steps: int = 4, last: int = 24, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Chart rows: history, projection with band (starting at the last value) and limit line."""
    history = recent(df, last, key, date, value).select(
        key, month_label(date).alias("mes"), F.lit("historico").alias("serie"), F.col("_y").alias("valor")
    )
    forecast = forecast4(df, steps, last, key, date, value)
    ahead = forecast.select(key, "mes", F.col("prediccion").alias("_p"), "semibanda")
    start = forecast.where(F.col("paso") == 1).select(
        key, month_label("ultima_fecha").alias("mes"), F.col("ultimo_valor").alias("_p"), "semibanda"
    )
    lines = (
        start.unionByName(ahead)
        .withColumns({"inferior": F.col("_p") - F.col("semibanda"), "superior": F.col("_p") + F.col("semibanda")})
        .withColumnRenamed("_p", "proyeccion")
        .unpivot([key, "mes"], ["proyeccion", "superior", "inferior"], "serie", "valor")
    )
    frame = history.unionByName(lines)
    if limit is None:
        return frame
    # The limit line covers the months after the history even where there is no forecast.
    months = history.select(key, "mes").unionByName(
        recent(df, last, key, date, value)
        .groupBy(key)
        .agg(F.max(date).alias("_last"))
        .select(key, F.explode(next_months(F.col("_last"), steps)).alias("mes"))
    )
    return frame.unionByName(months.select(key, "mes", F.lit("umbral").alias("serie"), F.lit(float(limit)).alias("valor")))


def _model_rows(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(
        F.col(key).alias("clave"), F.col(date).alias("fecha"), F.col(value).cast("double").alias("valor")
    )


def holt(df: DataFrame, steps: int = 12, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Exponential smoothing with additive trend per series, with a 95 % band of constant width.

    A series that is too short continues its straight line instead.
    """
    fitted = spread(_model_rows(df, key, date, value), "clave").groupBy("clave").applyInPandas(
        series_models.holt_forecaster(steps), series_models.HOLT_SCHEMA
    )
    return fitted.select(
        F.col("clave").alias(key), "paso",
        F.expr("last_day(add_months(trunc(ultima, 'MM'), paso))").alias(date),
        "prediccion", "inferior", "superior", "alfa", "beta", "metodo",
    )


def adf(df: DataFrame, key: str = "ruc", date: str = "fecha_corte", value: str = "valor") -> DataFrame:
    """Augmented Dickey-Fuller test per series with the lag chosen by AIC."""
    tested = spread(_model_rows(df, key, date, value), "clave").groupBy("clave").applyInPandas(series_models.adf_test, series_models.ADF_SCHEMA)
    return tested.select(
        F.col("clave").alias(key), "n", "estadistico", "p_valor", "rezagos",
        F.when(F.col("p_valor") < 0.05, "ESTACIONARIA").when(F.col("p_valor").isNotNull(), "NO ESTACIONARIA").alias("veredicto"),
    )


#: Shaded in the trend charts unless other periods are given.
EVENTS = [("2020-03-01", "2021-03-01")]


def mark_periods(df: DataFrame, date: str = "fecha_corte", events: list[tuple[str, str]] = EVENTS) -> DataFrame:
    """December highlight and the shaded event bands of the trend charts, ends included."""
    day, inside = F.col(date), F.lit(False)
    for start, end in events:
        inside = inside | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.withColumns({"es_diciembre": F.month(day) == 12, "en_evento": inside})


def system_trends(ratios: DataFrame, events: list[tuple[str, str]] = EVENTS) -> DataFrame:
    """The nine system series in long form with their limits."""
    names = list(SYSTEM_LIMITS)
    limits = F.create_map(*[c for n in names for c in (F.lit(n), F.lit(SYSTEM_LIMITS[n]).cast("double"))])
    wide = ratios.select("fecha_corte", *[F.col(n).cast("double").alias(n) for n in names])
    long = wide.unpivot(["fecha_corte"], names, "indicador", "valor")
    return mark_periods(long.withColumn("umbral", limits[F.col("indicador")]), events=events)
