"""Global order statistics without a single-task window.

An unpartitioned window, or an exact percentile of one group, gathers all rows in one
task. Here rows are range-partitioned into slices, every slice is summed, and each row
gets the total of the slices before its own; only slice totals meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from balanza.functions.scalar import as_col
from balanza.session import checkpoint


def running_total(df: DataFrame, keys: list[str], order: list, weight, out: str) -> DataFrame:
    """Cumulative sum of ``weight`` per ``keys`` in ``order``.

    ``order`` must be unique within ``keys``, so that no range slice is forced to hold
    one repeated value. Adaptive execution joins neighbouring small slices, which keeps them
    ranges. The sliced rows are checkpointed: both the slice totals and the rows themselves
    must see the same slice borders, also after an executor is lost.
    """
    order = [as_col(c) for c in order]
    sliced = checkpoint(
        df.withColumn("_weight", as_col(weight))
        .repartitionByRange(*keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    group = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group)
        .agg(F.sum("_weight").alias("_slice_total"))
        .withColumn("_before", F.coalesce(F.sum("_slice_total").over(before), F.lit(0)))
        .drop("_slice_total")
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(offsets, group)
        .withColumn(out, F.col("_before") + F.sum("_weight").over(inside))
        .drop("_slice", "_before", "_weight")
    )


def global_position(df: DataFrame, order: list, out: str = "posicion", keys: list[str] | None = None) -> DataFrame:
    """1-based position in a total order (``order`` must end in a unique tie-break)."""
    return running_total(df, keys or [], order, F.lit(1).cast("long"), out)


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per key with their (weighted) counts and the cumulative count up to each."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("_count"))
    return running_total(counts, keys, [value], "_count", "_upto")


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rango", weight: str | None = None) -> DataFrame:
    """Average rank of every distinct value per key, with the size of its tie group."""
    return value_counts(df, keys, value, weight).select(
        *keys,
        value,
        (F.col("_upto") - (F.col("_count") - 1) / F.lit(2.0)).alias(out),
        F.col("_count").alias("empates"),
    )


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rango") -> DataFrame:
    """Attach average ranks to the rows. A hot value skews only the row side of the join,
    which adaptive execution splits."""
    ranks = average_rank(df, keys, value, out)
    return df.where(F.col(value).isNotNull()).join(ranks, [*keys, value])


def quantile_name(p: float) -> str:
    return f"q{round(p * 10000):05d}"


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """Linearly interpolated exact quantiles per key, one output row per key."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, names)


def quantiles_of_counts(ranked: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """``exact_quantiles`` over an existing ``value_counts`` table."""
    names = names or [quantile_name(p) for p in probs]
    if keys:
        joined = ranked.join(ranked.groupBy(*keys).agg(F.max("_upto").alias("_n")), keys)
    else:
        joined = ranked.withColumn("_n", ranked.select(F.max("_upto")).scalar())
    first, last = F.col("_upto") - F.col("_count"), F.col("_upto") - 1
    aggregates = [F.max("_n").alias("_n")]
    for p, name in zip(probs, names, strict=True):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        for end, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggregates.append(F.max(F.when((first <= at) & (at <= last), F.col(value))).alias(f"_{name}_{end}"))
    found = joined.groupBy(*keys).agg(*aggregates)
    columns = []
    for p, name in zip(probs, names, strict=True):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *columns)
