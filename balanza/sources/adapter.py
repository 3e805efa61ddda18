"""The driver's tables as a ledger: test input for every operator of the engine."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from balanza.session import tasks_for

# Account and multiplier by ``l_partkey % 20``.
LEAVES = [
    ("1103", "1"), ("1301", "1"), ("1401", "1"), ("1402", "1"), ("1403", "1"),
    ("1404", "1"), ("1425", "0.1"), ("1449", "0.1"), ("1499", "-0.15"), ("2101", "1"),
    ("2103", "1"), ("2601", "1"), ("3101", "0.5"), ("3301", "0.5"), ("4101", "0.2"),
    ("4401", "0.2"), ("4501", "0.2"), ("5101", "0.3"), ("5104", "0.3"), ("1801", "1"),
]
# Account levels stored in the ledger, as code lengths.
LEVELS = [1, 2, 4]
# Segment by ``s_nationkey % 4``.
SEGMENT_BY_NATION = ["SEGMENTO 1", "SEGMENTO 2", "SEGMENTO 3", "SEGMENTO 1 MUTUALISTA"]


def _pick(values, position: Column) -> Column:
    return F.element_at(F.array(*values), (position + 1).cast("int"))


def period_end(c: str, freq: str) -> Column:
    if freq == "month":
        return F.last_day(F.col(c))
    if freq == "quarter":
        return F.last_day(F.add_months(F.trunc(F.col(c).cast("date"), "quarter"), 2))
    raise ValueError(f"unknown frequency: {freq}")


def ledger_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which the ledger is dealt, by the number of lines (from the files' footers)."""
    return tasks_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())


def _accounts() -> dict[str, list[int]]:
    """Every account at every level, with the places in ``LEAVES`` of the leaves under it."""
    under: dict[str, list[int]] = {}
    for level in LEVELS:
        for i, (code, _) in enumerate(LEAVES):
            under.setdefault(code[:level], []).append(i)
    return under


def ledger_from_tables(spark: SparkSession, sf_dir: str, freq: str = "quarter") -> DataFrame:
    """lineitem ⋈ supplier → ledger.

    Lines are dealt once, as four narrow columns, by supplier and period. One aggregate makes a row
    of account sums of every supplier and period, which meets its entity before it becomes the
    rows of its accounts, so no account row is grouped, and the rows of an entity's date leave together.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kind = F.col("l_partkey") % 20
    # Cents times hundredths: exact sums of ten-thousandths in a long, without wide decimals.
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    hundredths = [F.lit(int(Decimal(m) * 100)).cast("bigint") for _, m in LEAVES]
    dealt = lines.where(F.col("l_suppkey").isNotNull()).select(
        "l_suppkey",
        period_end("l_shipdate", freq).alias("fecha_corte"),
        F.coalesce(_pick([F.lit(i) for i in range(len(LEAVES))], kind), F.lit(len(LEAVES))).alias("leaf"),
        (cents * _pick(hundredths, kind)).alias("amount"),
    ).repartition(ledger_tasks(spark, sf_dir), "l_suppkey", "fecha_corte")
    # Which leaves have a line, as a bit set: an account without any is no row, one without a known amount is.
    under = list(_accounts().items())
    sums = dealt.groupBy("l_suppkey", "fecha_corte").agg(
        F.bit_or(F.expr("shiftleft(1, leaf)")).alias("present"),
        *[F.sum(F.when(F.col("leaf").isin(leaves), F.col("amount"))).alias(f"sum{i}") for i, (_, leaves) in enumerate(under)],
    )
    # Last the lines without a part, which are of no account.
    codes = [*[F.lit(code) for code, _ in under], F.lit(None).cast("string")]
    bits = [F.lit(sum(1 << i for i in leaves)) for _, leaves in under] + [F.lit(1 << len(LEAVES))]
    amounts = F.array(*[F.col(f"sum{i}") for i in range(len(under))], F.lit(None).cast("bigint"))
    entity = supplier.select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.lpad(F.col("s_suppkey").cast("string"), 13, "0").alias("ruc"),
        F.concat(
            F.lit("COOPERATIVA DE AHORRO Y CREDITO "),
            F.upper("s_name"),
            F.lit(" LTDA"),
            F.when(F.col("s_suppkey") % 10 == 9, " EN LIQUIDACION").otherwise(""),
        ).alias("razon_social"),
        _pick([F.lit(s) for s in SEGMENT_BY_NATION], F.col("s_nationkey") % 4).alias("segmento"),
    )
    names = ["segmento", "ruc", "razon_social"]
    accounts = (
        sums.join(entity, "l_suppkey")
        .select("fecha_corte", *names, "present", F.posexplode(amounts).alias("place", "amount"))
        .where(F.col("present").bitwiseAND(_pick(bits, F.col("place"))) != 0)
        .withColumn("cuenta", _pick(codes, F.col("place")))
    )
    return accounts.select(
        "fecha_corte",
        *names,
        "cuenta",
        F.concat(F.lit("CUENTA "), "cuenta").alias("descripcion_cuenta"),
        (F.col("amount").cast("decimal(19,0)") / F.lit(10_000)).cast("decimal(20,4)").alias("saldo_usd"),
        F.year("fecha_corte").cast("string").alias("anio"),
    )
