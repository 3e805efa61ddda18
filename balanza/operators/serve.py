"""Dashboard queries over the indicator fact and the entity dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from balanza.constants import ACTIVE
from balanza.functions.ordered import global_position
from balanza.functions.scalar import any_of, as_col, month_label


def at_latest_cut(df: DataFrame, date: str = "fecha_corte") -> DataFrame:
    """Rows at the greatest date, through a scalar subquery."""
    return df.where(F.col(date) == df.select(F.max(date)).scalar())


def active_only(dim: DataFrame) -> DataFrame:
    return dim.where(F.col("estado") == ACTIVE)


def facts_with_entity(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join on the entity key; Spark broadcasts the dimension only while its size allows."""
    return fact.join(dim, "ruc")


def snapshot(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Active entities at the latest cut."""
    return facts_with_entity(at_latest_cut(fact), active_only(dim))


def _mean(c: str, digits: int = 2):
    return F.round(F.avg(c), digits).cast("double")


def _rounded(c: str, digits: int = 2):
    return F.round(c, digits).cast("double").alias(c)


def _sum_in(c: str, unit: int, digits: int):
    return F.round((F.sum(c) / F.lit(unit).cast("decimal(11,0)")), digits).cast("double")


def kpis(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """One row; an empty cut gives zero entities and null figures."""
    return snapshot(fact, dim).agg(
        F.countDistinct("ruc").alias("total_coops"),
        _mean("camel_score").alias("camel_promedio"),
        _mean("morosidad_pct").alias("morosidad_promedio"),
        _mean("liquidez_ampliada").alias("liquidez_promedio"),
        _sum_in("activo_total", 10**9, 2).alias("activos_sistema_b"),
        F.max("fecha_corte").alias("ultimo_corte"),
    )


def sidebar_stats(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Entity count, Spanish cut label and rough assets; a dash where there is no data."""
    totals = snapshot(fact, dim).agg(
        F.countDistinct("ruc").alias("n"),
        F.max("fecha_corte").alias("cut"),
        F.coalesce(_sum_in("activo_total", 10**9, 1), F.lit(0.0)).alias("billions"),
    )
    return totals.select(
        F.col("n").cast("string").alias("sidebar_coops"),
        F.when(F.col("cut").isNull(), "—").otherwise(month_label("cut", "es")).alias("sidebar_corte"),
        F.when(
            F.col("billions") >= 1, F.concat(F.lit("~"), F.floor("billions").cast("string"), F.lit("B USD"))
        )
        .otherwise(F.concat(F.lit("~"), F.round(F.col("billions") * 1000).cast("bigint").cast("string"), F.lit("M USD")))
        .alias("sidebar_activos"),
    )


def segment_distribution(fact: DataFrame, dim: DataFrame) -> DataFrame:
    return snapshot(fact, dim).groupBy("segmento").agg(
        F.count(F.lit(1)).alias("cantidad"), _mean("camel_score").alias("camel_promedio")
    )


def segment_total(distribution: DataFrame) -> DataFrame:
    return distribution.agg(F.sum("cantidad").alias("total"))


def segment_comparison(fact: DataFrame, dim: DataFrame) -> DataFrame:
    return snapshot(fact, dim).groupBy("segmento").agg(
        F.count(F.lit(1)).alias("total"),
        _mean("camel_score").alias("camel_promedio"),
        _mean("morosidad_pct").alias("morosidad_promedio"),
        _mean("capitalizacion_pct").alias("capital_promedio"),
        _mean("liquidez_ampliada").alias("liquidez_promedio"),
        _mean("roa_pct").alias("roa_promedio"),
        _sum_in("activo_total", 10**9, 2).alias("activos_miles_millones"),
    )


RANKING_COLUMNS = [
    "razon_social", "segmento", "estado", "camel_score", "rating_camel",
    "morosidad_pct", "capitalizacion_pct", "liquidez_ampliada", "roa_pct", "ruc",
]


def ranking_rows(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """The ranking without its order."""
    rounded = {"camel_score": 3, "morosidad_pct": 2, "capitalizacion_pct": 2, "liquidez_ampliada": 2, "roa_pct": 2}
    return snapshot(fact, dim).select(
        *[_rounded(c, rounded[c]) if c in rounded else F.col(c) for c in RANKING_COLUMNS]
    )


def _score_order(order: str):
    """``worst`` lists the highest (worst) score first, ``best`` the lowest."""
    score = F.col("camel_score")
    return score.desc_nulls_last() if order == "worst" else score.asc_nulls_last()


def ranking(fact: DataFrame, dim: DataFrame, order: str = "worst") -> DataFrame:
    return ranking_rows(fact, dim).orderBy(_score_order(order), "ruc")


def ranked(rows: DataFrame, order: str = "best") -> DataFrame:
    """Position in the ranking, computed per range slice."""
    return global_position(rows, [_score_order(order), F.col("ruc")])


def top_n(fact: DataFrame, dim: DataFrame, n: int = 5, order: str = "worst") -> DataFrame:
    return (
        snapshot(fact, dim)
        .select(
            "ruc", "razon_social", "segmento", _rounded("camel_score", 3), "rating_camel",
            F.col("morosidad_pct").cast("double"), F.col("capitalizacion_pct").cast("double"),
        )
        .orderBy(_score_order(order), "ruc")
        .limit(n)
    )


def entity(dim: DataFrame, ruc: str) -> DataFrame:
    """One entity; no row means not found."""
    return dim.where(F.col("ruc") == ruc)


def entity_history(fact: DataFrame, ruc: str | None = None, n: int = 24) -> DataFrame:
    """Last ``n`` cuts, newest first, of one entity or of each."""
    shown = [
        "fecha_corte", _rounded("camel_score", 3), "rating_camel", _rounded("morosidad_pct"),
        _rounded("capitalizacion_pct"), _rounded("liquidez_ampliada"), _rounded("roa_pct"),
        _rounded("eficiencia_op_pct"),
        F.round(F.col("activo_total") / F.lit(10**6).cast("decimal(8,0)"), 2).cast("double").alias("activo_millones"),
    ]
    if ruc is not None:
        rows = fact.where(F.col("ruc") == ruc).orderBy(F.col("fecha_corte").desc()).limit(n)
        return rows.select(*shown)
    newest = Window.partitionBy("ruc").orderBy(F.col("fecha_corte").desc())
    return fact.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).select("ruc", *shown)


def filter_ranking(rows: DataFrame, q: str = "", segmento: str = "", match: str = "contains") -> DataFrame:
    """Case-insensitive text search over name and key, and segment filter.

    ``contains`` lets ``segmento 1`` also match the mutualists of segment 1.
    """
    text = F.lower(F.concat_ws(" ", "razon_social", "ruc"))
    found = rows.where(text.contains(q.lower())) if q else rows
    if segmento:
        label, wanted = F.lower("segmento"), segmento.lower()
        found = found.where(label.contains(wanted) if match == "contains" else label == wanted)
    return found


def visible_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("visibles"))


def search_entities(dim: DataFrame, words: list[str]) -> DataFrame:
    """Entities whose name contains any of the words, in any case."""
    return dim.where(any_of([F.col("razon_social").ilike(f"%{w}%") for w in words]))


def sort_ranking(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort by any column; missing values come last in both directions."""
    c = F.col(column)
    return rows.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "ruc")


def latest_row(df: DataFrame, key: str, date: str = "fecha_corte") -> DataFrame:
    """The last observation per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), date).alias("_row")).select(key, "_row.*")


def at_risk(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating_camel").isin("MARGINAL", "CRITICO"))


def solid(df: DataFrame, score="camel", cut: float = 2.5) -> DataFrame:
    return df.where(as_col(score) <= cut)


def weak(df: DataFrame, score="camel", cut: float = 3.5) -> DataFrame:
    return df.where(as_col(score) > cut)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row: decimals as numbers, dates as text, nulls kept."""
    columns = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "decimal":
            columns.append(F.col(f.name).cast("double").alias(f.name))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            columns.append(F.col(f.name).cast("string").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
