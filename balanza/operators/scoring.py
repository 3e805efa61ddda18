"""Band scores, composite score, rating and status labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.constants import (
    BANDS, CAMEL_WEIGHTS, NO_DATA, RATING_CUTS, RATING_MISSING, RATING_WORST,
    SOLVENCY_CUTS, SOLVENCY_WORST,
)
from balanza.functions.scalar import as_col, band_score, clamp

FACT_INPUTS = {
    "capital": "capitalizacion_pct",
    "delinquency": "morosidad_pct",
    "coverage": "cobertura_pct",
    "op_efficiency": "eficiencia_op_pct",
    "roa": "roa_pct",
    "liquidity": "liquidez_ampliada",
}
PANEL_INPUTS = {
    "capital": "C_solvencia",
    "delinquency": "A_morosidad",
    "coverage": "A_cobertura",
    "op_efficiency": "M_efic_operativa",
    "roa": "E_roa",
    "liquidity": "L_liq_ampliada",
}


def bands(variant: str, inputs: dict[str, str]) -> dict[str, Column]:
    """Scores 1 (best) to 5 (worst) of the five components."""
    table = BANDS[variant]
    score = {name: band_score(inputs[name], *table[name]) for name in table}
    return {
        "sc_C": score["capital"],
        "sc_A": (score["delinquency"] + score["coverage"]) / F.lit(2.0),
        "sc_M": score["op_efficiency"],
        "sc_E": score["roa"],
        "sc_L": score["liquidity"],
    }


def camel_score() -> Column:
    parts = [F.col(f"sc_{k}") * F.lit(w) for k, w in CAMEL_WEIGHTS.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.round(total, 3)


def rating(c="camel") -> Column:
    v = as_col(c)
    label = F.when(v.isNull(), RATING_MISSING)
    for cut, name in RATING_CUTS:
        label = label.when(v <= cut, name)
    return label.otherwise(RATING_WORST)


def with_scores(df: DataFrame, variant: str = "analyst", inputs: dict[str, str] = PANEL_INPUTS) -> DataFrame:
    return (
        df.withColumns(bands(variant, inputs))
        .withColumn("camel", camel_score())
        .withColumn("rating_camel", rating("camel"))
    )


def solvency_state(c="capitalizacion") -> Column:
    v = as_col(c)
    label = F.when(v.isNull(), NO_DATA)
    for cut, name in SOLVENCY_CUTS:
        label = label.when(v >= cut, name)
    return label.otherwise(SOLVENCY_WORST)


def traffic_light(value, limit, kind) -> Column:
    """Comfortable, met, narrowly missed or clearly missed limit."""
    v, limit = as_col(value), as_col(limit)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    met = F.when(kind == "mayor", v >= limit).otherwise(v <= limit)
    distance, size = F.abs(v - limit), F.abs(limit)
    return (
        F.when(v.isNull(), NO_DATA)
        .when(met & (distance >= size * F.lit(0.3)), "SOLVENTE")
        .when(met, "ADECUADO")
        .when(distance <= size * F.lit(0.2), "ALERTA")
        .otherwise("CRITICO")
    )


def radar_scores(df: DataFrame) -> DataFrame:
    """The five components on 0-100 for the entity radar."""
    none = F.lit(0.0)
    return df.withColumns(
        {
            "radar_C": clamp(F.coalesce("capitalizacion_pct", none) / F.lit(9.0) * F.lit(100.0), 0, 100),
            "radar_A": F.when(
                F.col("morosidad_pct") > 0, clamp(F.lit(5.0) / F.col("morosidad_pct") * F.lit(100.0), 0, 100)
            ).otherwise(none),
            "radar_M": F.when(
                F.col("eficiencia_op_pct").isNotNull(),
                clamp(F.lit(80.0) / F.greatest(F.col("eficiencia_op_pct"), F.lit(1.0)) * F.lit(100.0), 0, 100),
            ).otherwise(none),
            "radar_E": clamp(F.coalesce("roa_pct", none) * F.lit(25.0) + F.lit(50.0), 0, 100),
            "radar_L": clamp(F.coalesce("liquidez_ampliada", none) / F.lit(14.0) * F.lit(100.0), 0, 100),
        }
    )


# Colour bands on the 0-100 scale, best first.
GAUGE_CUTS = (90, 75, 60, 40)
TABLE_CUTS = (80, 60, 40, 20)
SEGMENT_CUTS = (60, 40)


def score_100(c="camel_score") -> Column:
    """The 1-5 score mapped to 0-100 with high = best; our own mapping, for the colour bands."""
    return (F.lit(5.0) - as_col(c)) / F.lit(4.0) * F.lit(100.0)


def band(c, cuts) -> Column:
    """1 for the best band, one more per cut missed."""
    v = as_col(c)
    label = F.when(v.isNull(), F.lit(None).cast("int"))
    for position, cut in enumerate(cuts, start=1):
        label = label.when(v >= cut, F.lit(position))
    return label.otherwise(F.lit(len(cuts) + 1))


def threshold_flags(df: DataFrame) -> DataFrame:
    """Pass or fail against the four limits shown with the ranking."""
    return df.withColumns(
        {
            "cumple_morosidad": F.col("morosidad_pct") <= 5,
            "cumple_capital": F.col("capitalizacion_pct") >= 9,
            "cumple_liquidez": F.col("liquidez_ampliada") >= 14,
            "cumple_roa": F.col("roa_pct") >= 0,
        }
    )
