"""The materialized star schema that serving and analysis queries read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from balanza.operators import dimensions
from balanza.session import materialize, scratch_path
from balanza.sources import store
from balanza.sources.adapter import ledger_from_tables, ledger_tasks


class Star:
    """Ledger, dimensions, indicator fact and panel of one source, each built once.

    Every table is written as Parquet to the shared folder on first use, as a nightly load
    would do, so that a dashboard query scans the small product and not the ledger.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, freq: str = "quarter"):
        self.spark, self.sf_dir, self.freq = spark, sf_dir, freq

    @cached_property
    def ledger(self) -> DataFrame:
        path = scratch_path(self.spark, f"ledger-{self.freq}")
        store.write_ledger(ledger_from_tables(self.spark, self.sf_dir, self.freq), path, tasks=ledger_tasks(self.spark, self.sf_dir))
        return store.read_ledger(self.spark, path)

    @cached_property
    def dim_entity(self) -> DataFrame:
        return materialize(dimensions.build_dim_entity(self.ledger), "dim_cooperativa")

    @cached_property
    def dim_account(self) -> DataFrame:
        return materialize(dimensions.build_dim_account(self.ledger), "dim_cuenta")

    @cached_property
    def fact(self) -> DataFrame:
        return materialize(dimensions.build_fact_indicadores(self.ledger), "fact_indicadores")

    @cached_property
    def panel(self) -> DataFrame:
        return materialize(dimensions.build_panel(self.ledger), "panel")


_STARS: dict[tuple, Star] = {}


def star(spark: SparkSession, sf_dir: str, freq: str = "quarter") -> Star:
    key = (spark.sparkContext.applicationId, sf_dir, freq)
    if key not in _STARS:
        _STARS[key] = Star(spark, sf_dir, freq)
    return _STARS[key]
