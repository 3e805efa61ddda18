"""Ledger store and relational tables: writes, refreshes and reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from balanza.constants import LEDGER_COLUMNS
from balanza.functions.scalar import AMOUNT


def clustered(ledger: DataFrame, tasks: int | None = None) -> DataFrame:
    """Range-partition by (year, date, entity, account) and sort inside each partition.

    Files get tight min/max statistics on date, entity and account, and one hot year or
    entity is spread over several tasks, which hashing by year would not do. ``tasks`` is the
    number of partitions for a ledger whose size is known, so that each is sorted in memory.
    """
    order = ["anio", "fecha_corte", "ruc", "cuenta"]
    # A year that is replaced must have the type of those that stay.
    typed = ledger.select(*LEDGER_COLUMNS).withColumn("saldo_usd", F.col("saldo_usd").cast(AMOUNT))
    ranges = typed.repartitionByRange(tasks, *order) if tasks else typed.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order)


def write_ledger(ledger: DataFrame, path: str, mode: str = "overwrite", tasks: int | None = None) -> None:
    """Full rebuild (``overwrite``), or ``ignore`` to leave an existing store as it is."""
    if mode == "skip":
        mode = "ignore"
    clustered(ledger, tasks).write.mode(mode).partitionBy("anio").parquet(path)


def refresh_year(ledger: DataFrame, path: str, anio: str) -> None:
    """Replace one year of the store; the other years' files stay untouched."""
    (
        clustered(ledger.where(F.col("anio") == anio))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("anio")
        .parquet(path)
    )


LEDGER_SCHEMA = (
    "fecha_corte date, segmento string, ruc string, razon_social string, "
    f"cuenta string, descripcion_cuenta string, saldo_usd {AMOUNT}, anio string"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def append(frames: list[DataFrame]) -> DataFrame:
    """Bag union of conformed ledgers; duplicates are kept."""
    total = frames[0]
    for df in frames[1:]:
        total = total.unionByName(df)
    return total


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_relational(df: DataFrame, table: str, url: str | None = None, batch: int = 100_000, mode: str = "append") -> None:
    """Batched JDBC load. The address and credentials come from the environment only."""
    (
        df.write.format("jdbc")
        .option("url", url or os.environ["BALANZA_JDBC_URL"])
        .option("dbtable", table)
        .option("user", os.environ.get("BALANZA_JDBC_USER", ""))
        .option("password", os.environ.get("BALANZA_JDBC_PASSWORD", ""))
        .option("batchsize", batch)
        .mode(mode)
        .save()
    )


def read_relational(spark: SparkSession, table: str, url: str | None = None, **options) -> DataFrame:
    """JDBC scan; pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the scan is not one task."""
    return (
        spark.read.format("jdbc")
        .option("url", url or os.environ["BALANZA_JDBC_URL"])
        .option("dbtable", table)
        .option("user", os.environ.get("BALANZA_JDBC_USER", ""))
        .option("password", os.environ.get("BALANZA_JDBC_PASSWORD", ""))
        .options(**options)
        .load()
    )


def write_directory_csv(directory: DataFrame, path: str) -> None:
    """CSV with header in UTF-8 with byte-order mark, which spreadsheets expect.

    Spark writes no mark of its own, so it leads the first column's name.
    """
    first, *rest = directory.columns
    marked = directory.withColumnRenamed(first, "\ufeff" + first)
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_ranking_csv(ranked: DataFrame, path: str, position: str = "posicion") -> None:
    """The ranking as spreadsheet files with a byte-order mark, position first, rows in its order from file to file."""
    ordered = ranked.select(position, *[c for c in ranked.columns if c != position]).orderBy(position)
    write_directory_csv(ordered, path)
