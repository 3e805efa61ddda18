"""Star schema: dimensions, indicator fact, directory, upserts and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.constants import ACTIVE, IN_LIQUIDATION, LIQUIDATION_MARK
from balanza.functions.scalar import half_up
from balanza.operators import pivot, ratios, scoring


def _at_last_date(c: str):
    """Value at the greatest date; within a date the greatest value wins."""
    return F.max_by(c, F.struct("fecha_corte", c)).alias(c)


def build_dim_entity(ledger: DataFrame) -> DataFrame:
    """One row per entity: attributes at its last date, active span and state.

    The ledger first shrinks to its distinct (entity, date, name, segment) tuples with a hash
    aggregate; the string-valued ``max_by`` then sorts those, not the account rows.
    """
    spans = ledger.where(F.col("fecha_corte").isNotNull()).select("ruc", "fecha_corte", "razon_social", "segmento").distinct()
    return (
        spans.groupBy("ruc")
        .agg(
            _at_last_date("razon_social"),
            _at_last_date("segmento"),
            F.min("fecha_corte").alias("primera_fecha"),
            F.max("fecha_corte").alias("ultima_fecha"),
            F.countDistinct("fecha_corte").cast("smallint").alias("meses_activo"),
        )
        .withColumn(
            "estado",
            F.when(F.col("razon_social").contains(LIQUIDATION_MARK), IN_LIQUIDATION).otherwise(ACTIVE),
        )
    )


def valid_keys(df: DataFrame, key: str = "cuenta") -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(key) != ""))


def build_dim_account(ledger: DataFrame) -> DataFrame:
    """One row per account: description at its last date and level (code length)."""
    described = (
        valid_keys(ledger).where(F.col("fecha_corte").isNotNull()).select("cuenta", "fecha_corte", "descripcion_cuenta").distinct()
    )
    return (
        described.groupBy("cuenta")
        .agg(_at_last_date("descripcion_cuenta"))
        .withColumn("nivel", F.length("cuenta").cast("smallint"))
    )


FACT_BALANCES = ["activo_total", "patrimonio", "cartera_bruta", "depositos"]
FACT_RATIOS = [
    "capitalizacion_pct", "morosidad_pct", "cobertura_pct", "roa_pct", "roe_pct", "nim_pct",
    "liquidez_ampliada", "eficiencia_op_pct", "apalancamiento", "intermediacion",
]


def build_fact_indicadores(ledger: DataFrame, variant: str = "etl") -> DataFrame:
    """Balances, ratios, score and rating of every entity at every date, in one pass.

    Ratios keep four decimals like the stored fact, in a wider decimal so that one extreme
    ratio cannot fail the load.
    """
    scored = scoring.with_scores(
        ratios.with_fact_ratios(pivot.pivot_accounts(ledger)), variant, scoring.FACT_INPUTS
    )
    return scored.select(
        "fecha_corte",
        "ruc",
        *[F.col(c).cast("decimal(20,4)").alias(c) for c in FACT_BALANCES + FACT_RATIOS],
        F.col("camel").cast("decimal(5,3)").alias("camel_score"),
        "rating_camel",
    )


def build_panel(ledger: DataFrame, segmento: str | None = None, cut=None, variant: str = "analyst") -> DataFrame:
    """Cross-section panel: 15 ratios, size control, band scores and rating per entity and date."""
    rows = pivot.exclude_liquidation(ledger)
    if segmento is not None:
        rows = rows.where(F.col("segmento") == segmento)
    if cut is not None:
        rows = rows.where(F.col("fecha_corte") == F.lit(cut))
    pivoted = pivot.pivot_accounts(rows, wide=True, keys=("fecha_corte", "ruc", "razon_social", "segmento"))
    return scoring.with_scores(ratios.with_panel_ratios(pivoted), variant)


def build_directory(ledger: DataFrame, cut=None) -> DataFrame:
    """Every entity with its state and, where present, its figures at the cut (default: last).

    The cut must be known when columns are named after it, so it is one value on the driver.
    """
    if cut is None:
        cut = ledger.agg(F.max("fecha_corte")).first()[0]
    label = cut.strftime("%b%Y")
    scored = scoring.with_scores(
        ratios.with_fact_ratios(pivot.pivot_accounts(ledger.where(F.col("fecha_corte") == F.lit(cut)))),
        "analyst",
        scoring.FACT_INPUTS,
    )
    millions = {
        "activo_total": f"activo_M_{label}",
        "patrimonio": f"patrimonio_M_{label}",
        "cartera_bruta": f"cartera_M_{label}",
        "depositos": f"depositos_M_{label}",
    }
    figures = scored.select(
        "ruc",
        *[half_up(F.col(c) / F.lit(1e6), 2).alias(name) for c, name in millions.items()],
        *[
            half_up(c, 2).alias(f"{c}_pct" if c == "liquidez_ampliada" else c)
            for c in FACT_RATIOS
        ],
        "sc_C", "sc_A", "sc_M", "sc_E", "sc_L", "camel", "rating_camel",
    )
    return build_dim_entity(ledger).join(figures, "ruc", "left")


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key is missing in the dimension; must be empty."""
    return fact.join(dim.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Insert new keys; on known keys replace only the ``update`` columns."""
    incoming = new.withColumn("_new", F.lit(True))
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(incoming.alias("n"), key, "full_outer")
    columns = []
    for c in old.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in update:
            columns.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*columns)


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first date of a known entity is kept."""
    return upsert(old, new, ["ruc"], ["razon_social", "segmento", "ultima_fecha", "meses_activo", "estado"])


def upsert_accounts(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["cuenta"], ["descripcion_cuenta"])


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["fecha_corte", "ruc"], ["camel_score", "rating_camel"])
