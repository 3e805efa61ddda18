"""Account pivots: ledger rows to one row per entity and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.constants import BALANCE_ACCOUNTS, ENTITY_ACCOUNTS, LIQUIDATION_MARK, NOT_ACCRUING, OVERDUE, WIDE_ACCOUNTS


def _balance(code: str, value: str = "saldo_usd"):
    return F.when(F.col("cuenta") == code, F.col(value))


def _listed(codes: list[str]):
    return F.sum(F.when(F.col("cuenta").isin(codes), F.col("saldo_usd")).otherwise(F.lit(0).cast("decimal(20,4)")))


def _as_double(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def pivot_accounts(ledger: DataFrame, wide: bool = False, keys=("fecha_corte", "ruc")) -> DataFrame:
    """Balances and non-performing sums of every entity and date, in one aggregation.

    The ledger is not filtered to the needed accounts first: entities without any of them
    must survive as all-null rows, and one conditional aggregate with map-side combine does
    that without a second scan and a join. A greatest balance is the same taken as double, which
    keeps its buffer primitive; sums stay decimal, so that they do not depend on row order.
    """
    accounts = BALANCE_ACCOUNTS | WIDE_ACCOUNTS if wide else BALANCE_ACCOUNTS
    columns = [F.max(_balance(code, "_balance")).alias(name) for name, code in accounts.items()]
    columns += [_listed(NOT_ACCRUING).alias("cart_nodev"), _listed(OVERDUE).alias("cart_vencida")]
    pivoted = ledger.withColumn("_balance", F.col("saldo_usd").cast("double")).groupBy(*keys).agg(*columns)
    return _as_double(pivoted, ["cart_nodev", "cart_vencida"])


def entity_pivot(ledger: DataFrame, ruc: str | None = None) -> DataFrame:
    """Summed balance per date and account of one entity (or of each), accounts as columns."""
    source = ledger if ruc is None else ledger.where(F.col("ruc") == ruc)
    pivoted = (
        source.where(F.col("cuenta").isin(list(ENTITY_ACCOUNTS)))
        .groupBy("ruc", "fecha_corte")
        .pivot("cuenta", list(ENTITY_ACCOUNTS))
        .agg(F.sum("saldo_usd"))
        .withColumnsRenamed(ENTITY_ACCOUNTS)
    )
    return _as_double(pivoted, ENTITY_ACCOUNTS.values())


def npl_prefix(ledger: DataFrame, ruc: str | None = None) -> DataFrame:
    """Non-performing loans by account prefix: narrower than the account lists."""
    source = ledger if ruc is None else ledger.where(F.col("ruc") == ruc)
    zero = F.lit(0).cast("decimal(20,4)")

    def under(prefix: str):
        return F.sum(F.when(F.col("cuenta").startswith(prefix), F.col("saldo_usd")).otherwise(zero)).cast("double")

    return (
        source.groupBy("ruc", "fecha_corte")
        .agg(under("1425").alias("no_devenga"), under("1426").alias("vencida"))
        .withColumn("cartera_improductiva", F.col("no_devenga") + F.col("vencida"))
    )


def merge_on_date(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of two per-date aggregates of the same entities."""
    return left.join(right, ["ruc", "fecha_corte"], "left")


def exclude_liquidation(df: DataFrame) -> DataFrame:
    """Rows whose name does not mention liquidation; null names are dropped too."""
    return df.where(~F.col("razon_social").contains(LIQUIDATION_MARK))


# Account behind each summed column of the system series.
SYSTEM_SUMS = {
    "activo_total_m": "1",
    "pasivo_m": "2",
    "patrimonio_m": "3",
    "cartera_m": "14",
    "depositos_m": "21",
    "provisiones_m": "1499",
    "fondos_m": "11",
    "inver_m": "13",
    "gastos_m": "4",
    "ingresos_m": "5",
    "int_causados_m": "41",
    "gastos_op_m": "45",
    "int_ganados_m": "51",
}


def system_series(ledger: DataFrame, segmento: str = "SEGMENTO 1", since: int = 2018) -> DataFrame:
    """Per date: entities and account sums in millions of one segment, liquidation excluded."""
    rows = exclude_liquidation(
        ledger.where((F.col("segmento") == segmento) & (F.col("fecha_corte") >= F.make_date(F.lit(since), F.lit(1), F.lit(1))))
    )
    sums = {name: F.sum(_balance(code)) for name, code in SYSTEM_SUMS.items()}
    sums["nodev_m"] = _listed(NOT_ACCRUING)
    sums["vencida_m"] = _listed(OVERDUE)
    return (
        rows.groupBy("fecha_corte")
        .agg(
            F.countDistinct("ruc").alias("n_coops"),
            *[(total.cast("double") / F.lit(1e6)).alias(name) for name, total in sums.items()],
        )
        .withColumn("mes", F.month("fecha_corte"))
    )
