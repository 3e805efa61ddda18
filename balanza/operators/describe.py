"""Descriptive queries over the ledger, the directory and the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from balanza.constants import (
    CLUSTER_FEATURES, INDICATORS, RADAR_FEATURES, RADAR_INVERTED, RATINGS, SEGMENTS, THRESHOLDS,
)
from balanza.functions.ordered import exact_quantiles, quantiles_of_counts, value_counts
from balanza.functions.scalar import all_of, breaches, half_up, limit_text, short_name
from balanza.operators.serve import active_only

MILLION = 1e6


def _millions(c: str = "saldo_usd") -> Column:
    return F.sum(c).cast("double") / F.lit(MILLION)


# Ledger overview ---------------------------------------------------------------------------


def _per_entity_month(ledger: DataFrame, *keys: str) -> DataFrame:
    """Rows and totals per (keys, date, entity).

    Several distinct counts over raw rows would multiply every row; over this aggregate they
    multiply only one row per entity and date.
    """
    return ledger.groupBy(*keys, "fecha_corte", "ruc").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("saldo_usd").alias("_total")
    )


def year_overview(ledger: DataFrame) -> DataFrame:
    return _per_entity_month(ledger, "anio").groupBy("anio").agg(
        F.countDistinct("fecha_corte").alias("meses"),
        F.countDistinct("ruc").alias("cooperativas"),
        F.sum("_rows").alias("registros"),
    )


def load_report(ledger: DataFrame) -> DataFrame:
    """Per year: entities, months, rows, total in billions and last date."""
    return _per_entity_month(ledger, "anio").groupBy("anio").agg(
        F.countDistinct("ruc").alias("cooperativas"),
        F.countDistinct("fecha_corte").alias("meses"),
        F.sum("_rows").alias("registros"),
        half_up(F.sum("_total").cast("double") / F.lit(1e9), 4).alias("total_miles_millones"),
        F.max("fecha_corte").alias("ultima_fecha"),
    )


def entities_by_segment(ledger: DataFrame, anio: str | None = None) -> DataFrame:
    rows = ledger if anio is None else ledger.where(F.col("anio") == anio)
    return rows.groupBy("segmento").agg(F.countDistinct("ruc").alias("cooperativas"))


def extent(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("filas"), F.min("fecha_corte").alias("desde"), F.max("fecha_corte").alias("hasta")
    )


def entity_matrix(ledger: DataFrame, segments: list[str] = SEGMENTS) -> DataFrame:
    """Distinct entities per year, segments as columns, absent = 0."""
    pairs = ledger.select("anio", "segmento", "ruc").distinct()
    return pairs.groupBy("anio").pivot("segmento", segments).agg(F.count("ruc")).na.fill(0)


def account_series(ledger: DataFrame, cuenta: str, out: str = "millones") -> DataFrame:
    """Sum of one account by date and segment, in millions."""
    return (
        ledger.where(F.col("cuenta") == cuenta).groupBy("fecha_corte", "anio", "segmento").agg(_millions().alias(out))
    )


def last_per_year(series: DataFrame, value: str) -> DataFrame:
    """Last non-null value in each year and segment."""
    return (
        series.where(F.col(value).isNotNull())
        .groupBy("anio", "segmento")
        .agg(F.max_by(value, "fecha_corte").alias(value))
    )


def year_end_matrix(ledger: DataFrame, cuenta: str = "1", segments: list[str] = SEGMENTS) -> DataFrame:
    last = last_per_year(account_series(ledger, cuenta), "millones")
    return last.groupBy("anio").pivot("segmento", segments).agg(F.max("millones")).na.fill(0)


def prefix_in(df: DataFrame, n: int, codes: list[str]) -> DataFrame:
    return df.where(F.substring("cuenta", 1, n).isin(codes))


def at_level(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.length("cuenta") == n)


def liquidity_series(ledger: DataFrame) -> DataFrame:
    """Cash and investments of the system by date, in millions."""
    kind = F.when(F.substring("cuenta", 1, 2) == "11", "Fondos Disponibles").when(
        F.substring("cuenta", 1, 2) == "13", "Inversiones"
    )
    rows = at_level(prefix_in(ledger, 2, ["11", "13"]), 2)
    return rows.groupBy("fecha_corte", "anio", kind.alias("tipo")).agg(_millions().alias("saldo_millones"))


def top_assets(ledger: DataFrame, n: int = 15) -> DataFrame:
    """Largest entities by assets at the last date."""
    last = ledger.where(F.col("fecha_corte") == ledger.select(F.max("fecha_corte")).scalar())
    return (
        last.where(F.col("cuenta") == "1")
        .groupBy("razon_social", "segmento")
        .agg(_millions().alias("activo_millones"))
        .orderBy(F.col("activo_millones").desc_nulls_last(), "razon_social")
        .limit(n)
        .withColumn("nombre_corto", short_name("razon_social"))
    )


def top_accounts(ledger: DataFrame, n: int = 10) -> DataFrame:
    return (
        ledger.groupBy("cuenta", "descripcion_cuenta")
        .agg(F.count(F.lit(1)).alias("veces"))
        .orderBy(F.col("veces").desc(), "cuenta")
        .limit(n)
    )


def account_usage(ledger: DataFrame, segmento: str | None = None, anio: str | None = None, max_level: int = 4, n: int = 100) -> DataFrame:
    """Entities and rows per account, shortest codes first."""
    rows = ledger.where(F.length("cuenta") <= max_level)
    if segmento is not None:
        rows = rows.where(F.col("segmento") == segmento)
    if anio is not None:
        rows = rows.where(F.col("anio") == anio)
    return (
        rows.groupBy("cuenta", "descripcion_cuenta")
        .agg(F.countDistinct("ruc").alias("coops"), F.count(F.lit(1)).alias("registros"))
        .orderBy(F.length("cuenta"), "cuenta")
        .limit(n)
    )


def npl_accounts(ledger: DataFrame, segmento: str, anio: str | None = None) -> DataFrame:
    """Non-performing accounts in use and how many entities use them."""
    rows = ledger.where(
        (F.col("segmento") == segmento) & (F.col("cuenta").startswith("1425") | F.col("cuenta").startswith("1426"))
    )
    if anio is not None:
        rows = rows.where(F.col("anio") == anio)
    return rows.groupBy("cuenta", "descripcion_cuenta").agg(F.countDistinct("ruc").alias("coops"))


def entity_span(ledger: DataFrame, segmento: str | None = None) -> DataFrame:
    rows = ledger if segmento is None else ledger.where(F.col("segmento") == segmento)
    months = rows.select("ruc", "razon_social", "fecha_corte").distinct()
    return months.groupBy("ruc", "razon_social").agg(
        F.count("fecha_corte").alias("meses"), F.min("fecha_corte").alias("desde"), F.max("fecha_corte").alias("hasta")
    )


def extract(ledger: DataFrame, anio: str, segmento: str, cuentas: list[str]) -> DataFrame:
    """Entity × account × date balances in millions for one year and segment."""
    rows = ledger.where(
        (F.col("anio") == anio) & (F.col("segmento") == segmento) & F.col("cuenta").isin(cuentas)
    )
    return rows.groupBy("fecha_corte", "ruc", "razon_social", "cuenta", "descripcion_cuenta").agg(
        _millions().alias("saldo_millones")
    )


def distinct_periods(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types as rows."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas") for name, df in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


# Distribution ------------------------------------------------------------------------------


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, sample deviation, min, quartiles and max per key."""
    basics = df.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("media"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return basics.join(exact_quantiles(df, [key], value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"]), key, "left")


def december_assets(ledger: DataFrame, anio: str) -> DataFrame:
    """Assets per entity at the December cut of one year, in millions."""
    rows = ledger.where((F.col("cuenta") == "1") & (F.col("anio") == anio) & (F.month("fecha_corte") == 12))
    return rows.groupBy("ruc", "razon_social", "segmento").agg(_millions().alias("activo_millones"))


def _outside(value: str) -> Column:
    spread = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    return (F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread)


def iqr_outliers(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Rows outside the Tukey fences of ``column`` (per key when keys are given)."""
    keys = keys or []
    fences = exact_quantiles(df, keys, column, [0.25, 0.75], ["q1", "q3"])
    if keys:
        return df.join(fences, keys).where(_outside(column))
    q1, q3 = fences.select("q1").scalar(), fences.select("q3").scalar()
    return df.withColumns({"q1": q1, "q3": q3}).where(_outside(column))


def long_panel(panel: DataFrame, columns: list[str] = INDICATORS, ids: list[str] | None = None) -> DataFrame:
    """One row per panel row and indicator with a value."""
    ids = ids if ids is not None else ["ruc", "fecha_corte"]
    return panel.unpivot(ids, columns, "indicador", "valor").where(F.col("valor").isNotNull())


def thresholds(spark: SparkSession) -> DataFrame:
    """The fixed limits, one row per indicator (15 rows, safe to broadcast)."""
    rows = [(name, kind, float(limit), unit) for name, (kind, limit, unit) in THRESHOLDS.items()]
    return spark.createDataFrame(rows, "indicador string, tipo string, limite double, unidad string")


def _with_limits(long: DataFrame) -> DataFrame:
    return long.join(F.broadcast(thresholds(long.sparkSession)), "indicador")


def indicator_profile(panel: DataFrame) -> DataFrame:
    """Per indicator: moments, quantiles, breaches of its limit and Tukey outliers."""
    long = long_panel(panel)
    basics = _with_limits(long).groupBy("indicador", "tipo", "limite", "unidad").agg(
        F.count("valor").alias("n"),
        F.avg("valor").alias("media"),
        F.stddev_samp("valor").alias("std"),
        F.min("valor").alias("min"),
        F.max("valor").alias("max"),
        F.sum(breaches("valor", "tipo", "limite").cast("int")).alias("n_incumple"),
    )
    ranked = value_counts(long, ["indicador"], "valor")
    points = quantiles_of_counts(
        ranked, ["indicador"], "valor", [0.10, 0.25, 0.5, 0.75, 0.90], ["p10", "q1", "mediana", "q3", "p90"]
    )
    outliers = (
        ranked.join(F.broadcast(points), "indicador")
        .groupBy("indicador")
        .agg(F.sum(F.when(_outside("valor"), F.col("_count")).otherwise(0)).alias("n_outliers_iqr"))
    )
    return (
        basics.join(points, "indicador")
        .join(outliers, "indicador")
        .select(
            "indicador", "n", "media", "mediana", "std",
            F.when(F.col("media") != 0, F.col("std") / F.col("media") * F.lit(100.0)).alias("cv_pct"),
            "min", "p10", "p90", "max",
            limit_text("tipo", "limite", "unidad").alias("umbral"),
            "n_incumple", "n_outliers_iqr",
        )
    )


def compliance_alerts(panel: DataFrame) -> DataFrame:
    """Every broken limit: entity, date, indicator, value and limit."""
    named = panel.withColumn("cooperativa", short_name("razon_social"))
    long = long_panel(named, ids=["ruc", "fecha_corte", "cooperativa"])
    return (
        _with_limits(long)
        .where(breaches("valor", "tipo", "limite"))
        .select(
            "fecha_corte", "ruc", "cooperativa", "indicador", half_up("valor", 2).alias("valor"),
            limit_text("tipo", "limite", "unidad").alias("umbral"),
        )
    )


def breach_counts(alerts: DataFrame) -> DataFrame:
    """Broken limits per entity key, with one of its names (the last by letter)."""
    return (
        alerts.groupBy("ruc")
        .agg(F.max("cooperativa").alias("cooperativa"), F.count(F.lit(1)).alias("n_incumplimientos"))
        .orderBy(F.col("n_incumplimientos").desc(), "ruc")
    )


def executive_summary(panel: DataFrame) -> DataFrame:
    """Median of each indicator against its limit."""
    medians = exact_quantiles(long_panel(panel), ["indicador"], "valor", [0.5], ["mediana"])
    met = ~breaches("mediana", "tipo", "limite")
    return _with_limits(medians).select(
        "indicador",
        "mediana",
        limit_text("tipo", "limite", "unidad").alias("umbral"),
        F.when(met, "OK").otherwise("ALERTA").alias("estado"),
    )


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def complete_count(df: DataFrame, columns: list[str] = INDICATORS) -> DataFrame:
    complete = all_of([F.col(c).isNotNull() for c in columns])
    return df.agg(F.count(F.when(complete, 1)).alias("completas"), F.count(F.lit(1)).alias("total"))


# Ratings and clusters ----------------------------------------------------------------------


def rating_crosstab(directory: DataFrame) -> DataFrame:
    """Active entities by segment, ratings as columns, absent = 0."""
    return active_only(directory).groupBy("segmento").pivot("rating_camel", RATINGS).agg(F.count(F.lit(1))).na.fill(0)


def rating_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per rating; the total is a scalar over the handful of ratings."""
    counts = df.groupBy("rating_camel").agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") / total * F.lit(100.0))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form, one row per occupied cell."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def cluster_profile(df: DataFrame, label: str = "cluster", columns: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """Median of each feature per cluster, features as columns."""
    long = long_panel(df, columns, [label])
    medians = exact_quantiles(long, [label, "indicador"], "valor", [0.5], ["mediana"])
    return medians.groupBy(label).pivot("indicador", columns).agg(F.max("mediana"))


def radar_profile(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Cluster medians per feature, lower-is-better inverted, min-max scaled across clusters."""
    long = long_panel(df, RADAR_FEATURES, [label])
    medians = exact_quantiles(long, [label, "indicador"], "valor", [0.5], ["mediana"])
    ends = medians.groupBy("indicador").agg(F.min("mediana").alias("low"), F.max("mediana").alias("high"))
    inverted = F.when(
        F.col("indicador").isin(RADAR_INVERTED), F.col("high") - F.col("mediana") + F.col("low")
    ).otherwise(F.col("mediana"))
    return medians.join(ends, "indicador").select(
        label, "indicador", F.try_divide(inverted - F.col("low"), F.col("high") - F.col("low")).alias("radar")
    )


def risk_matrix(panel: DataFrame, columns: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """At-risk entities with the figures behind their rating."""
    return panel.where(F.col("rating_camel").isin("MARGINAL", "CRITICO")).select(
        "ruc", "fecha_corte", short_name("razon_social").alias("nombre"), "camel", "rating_camel",
        "sc_C", "sc_A", "sc_M", "sc_E", "sc_L", *columns,
    )

