"""Points: rows as an id and coordinate columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dimensions(points: DataFrame) -> list[str]:
    """Coordinate columns ``x0, x1, ...`` of a points table."""
    return [c for c in points.columns if c.startswith("x") and c[1:].isdigit()]


def to_points(df: DataFrame, id_column: str, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(id, x0, x1, ..., kept columns) over rows with all features."""
    rows = df.na.drop(subset=features)
    return rows.select(
        F.col(id_column).alias("id"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        *(keep or []),
    )
