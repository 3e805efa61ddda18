"""Registered queries: ledger overview, series by account, ingestion."""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Observation, functions as F

from balanza.constants import SEGMENTS
from balanza.functions.scalar import month_ends, month_label, next_months, short_name, truncate
from balanza.operators import describe, pivot, ratios
from balanza.plans.catalog import query
from balanza.plans.oracle import quoted, rounded, sql
from balanza.plans.queries_serving import doubles
from balanza.plans.star import star
from balanza.session import checkpoint, scratch_path
from balanza.sources import store, text


def _ledger_query(name, oracle, function, *parts):
    @query(name, sql(oracle, *parts))
    def run(spark, sf_dir):
        return function(star(spark, sf_dir).ledger)

    return run


_ledger_query(
    "year_overview",
    """SELECT anio, count(DISTINCT fecha_corte) AS meses, count(DISTINCT ruc) AS cooperativas,
       CAST(count(*) AS BIGINT) AS registros FROM ledger GROUP BY anio""",
    describe.year_overview,
)
_REPORT = f"""SELECT anio, count(DISTINCT ruc) AS cooperativas, count(DISTINCT fecha_corte) AS meses,
 count(*) AS registros, {rounded('CAST(sum(saldo_usd) AS DOUBLE) / 1e9', 4)} AS total_miles_millones,
 max(fecha_corte) AS ultima_fecha FROM ledger GROUP BY anio"""
_ledger_query("load_report", _REPORT, describe.load_report)
_ledger_query(
    "entities_by_segment",
    "SELECT segmento, count(DISTINCT ruc) AS cooperativas FROM ledger WHERE anio = '2000' GROUP BY segmento",
    lambda ledger: describe.entities_by_segment(ledger, "2000"),
)
_ledger_query(
    "extent", "SELECT count(*) AS filas, min(fecha_corte) AS desde, max(fecha_corte) AS hasta FROM ledger", describe.extent
)
_ledger_query(
    "entity_matrix",
    "SELECT anio, " + ", ".join(f"count(DISTINCT ruc) FILTER (WHERE segmento = '{s}') AS \"{s}\"" for s in SEGMENTS)
    + " FROM ledger GROUP BY anio",
    describe.entity_matrix,
)
_SERIES = """SELECT fecha_corte, anio, segmento, CAST(sum(saldo_usd) AS DOUBLE) / 1e6 AS millones
 FROM ledger WHERE cuenta = '{}' GROUP BY ALL"""
for _name, _code in (("assets", "1"), ("loans", "14"), ("deposits", "21")):
    _ledger_query(
        f"account_series_{_name}", _SERIES.format(_code), lambda ledger, code=_code: describe.account_series(ledger, code)
    )
_ledger_query(
    "year_end_matrix",
    ", series AS (" + _SERIES.format("1") + """), last AS (SELECT anio, segmento, arg_max(millones, fecha_corte) AS v
      FROM series GROUP BY anio, segmento) SELECT anio, """
    + ", ".join(f"coalesce(max(v) FILTER (WHERE segmento = '{s}'), 0) AS \"{s}\"" for s in SEGMENTS)
    + " FROM last GROUP BY anio",
    describe.year_end_matrix,
)
_ledger_query(
    "liquidity_series",
    """SELECT fecha_corte, anio, CASE left(cuenta, 2) WHEN '11' THEN 'Fondos Disponibles' ELSE 'Inversiones' END AS tipo,
       CAST(sum(saldo_usd) AS DOUBLE) / 1e6 AS saldo_millones FROM ledger
       WHERE left(cuenta, 2) IN ('11', '13') AND length(cuenta) = 2 GROUP BY ALL""",
    describe.liquidity_series,
)
_ledger_query(
    "top15_assets",
    """SELECT razon_social, segmento, CAST(sum(saldo_usd) AS DOUBLE) / 1e6 AS activo_millones FROM ledger
       WHERE cuenta = '1' AND fecha_corte = (SELECT max(fecha_corte) FROM ledger)
       GROUP BY ALL ORDER BY activo_millones DESC, razon_social LIMIT 15""",
    lambda ledger: describe.top_assets(ledger, 15).drop("nombre_corto"),
)
_ledger_query(
    "top_accounts",
    """SELECT cuenta, descripcion_cuenta, count(*) AS veces FROM ledger GROUP BY ALL ORDER BY veces DESC, cuenta LIMIT 10""",
    describe.top_accounts,
)
_ledger_query(
    "account_usage",
    """SELECT cuenta, descripcion_cuenta, count(DISTINCT ruc) AS coops, count(*) AS registros FROM ledger
       WHERE segmento = 'SEGMENTO 1' AND length(cuenta) <= 4 AND anio = '2000' GROUP BY cuenta, descripcion_cuenta
       ORDER BY length(cuenta), cuenta LIMIT 100""",
    lambda ledger: describe.account_usage(ledger, "SEGMENTO 1", "2000"),
)
_ledger_query(
    "npl_accounts",
    """SELECT cuenta, descripcion_cuenta, count(DISTINCT ruc) AS coops FROM ledger
       WHERE segmento = 'SEGMENTO 1' AND anio = '2000' AND (cuenta LIKE '1425%' OR cuenta LIKE '1426%') GROUP BY ALL""",
    lambda ledger: describe.npl_accounts(ledger, "SEGMENTO 1", "2000"),
)
_ledger_query(
    "entity_span",
    """SELECT ruc, razon_social, count(DISTINCT fecha_corte) AS meses, min(fecha_corte) AS desde, max(fecha_corte) AS hasta
       FROM ledger WHERE segmento = 'SEGMENTO 1' GROUP BY ALL""",
    lambda ledger: describe.entity_span(ledger, "SEGMENTO 1"),
)
_EXTRACT = ["1", "11", "13", "14", "2", "21", "3", "5", "4"]
_ledger_query(
    "extract",
    f"""SELECT fecha_corte, ruc, razon_social, cuenta, descripcion_cuenta, CAST(sum(saldo_usd) AS DOUBLE) / 1e6 AS saldo_millones
       FROM ledger WHERE anio = '2000' AND segmento = 'SEGMENTO 1' AND cuenta IN ({quoted(_EXTRACT)}) GROUP BY ALL""",
    lambda ledger: describe.extract(ledger, "2000", "SEGMENTO 1", _EXTRACT),
)
_ledger_query("distinct_periods", "SELECT DISTINCT fecha_corte FROM ledger", lambda ledger: describe.distinct_periods(ledger, "fecha_corte"))
_ledger_query(
    "describe_by_segment",
    """, assets AS (SELECT ruc, segmento, CAST(sum(saldo_usd) AS DOUBLE) / 1e6 AS v FROM ledger
         WHERE cuenta = '1' AND anio = '2000' AND month(fecha_corte) = 12 GROUP BY ruc, razon_social, segmento)
       SELECT segmento, count(v) AS n, round(avg(v), 6) AS media, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
         round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75
       FROM assets GROUP BY segmento""",
    lambda ledger: describe.describe_by(describe.december_assets(ledger, "2000"), "segmento", "activo_millones").withColumns(
        {c: F.round(c, 6) for c in ("media", "std", "p25", "p50", "p75")}
    ),
)

_SYSTEM_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN cuenta = '{code}' THEN saldo_usd END) AS DOUBLE) / 1e6 AS {name}"
    for name, code in pivot.SYSTEM_SUMS.items()
) + "".join(
    f", CAST(sum(CASE WHEN cuenta IN ({quoted(codes)}) THEN saldo_usd ELSE 0 END) AS DOUBLE) / 1e6 AS {name}"
    for name, codes in (("nodev_m", pivot.NOT_ACCRUING), ("vencida_m", pivot.OVERDUE))
)
SYSTEM = f"""SELECT fecha_corte, CAST(month(fecha_corte) AS INTEGER) AS mes, count(DISTINCT ruc) AS n_coops, {_SYSTEM_SUMS} FROM ledger
 WHERE segmento = 'SEGMENTO 1' AND year(fecha_corte) >= 1996 AND razon_social NOT LIKE '%LIQUIDACI%' GROUP BY fecha_corte"""
SYSTEM_RATIOS = f""", system AS ({SYSTEM}), improd AS (SELECT *, nodev_m + vencida_m AS cart_improd_m FROM system),
 ratios AS (SELECT *, ingresos_m - gastos_m AS resultado_m, patrimonio_m / activo_total_m * 100 AS sist_solvencia,
  cart_improd_m / cartera_m * 100 AS sist_morosidad, abs(provisiones_m) / cart_improd_m * 100 AS sist_cobertura,
  (ingresos_m - gastos_m) / activo_total_m * 100 AS sist_roa, (fondos_m + inver_m) / depositos_m * 100 AS sist_liq_amp,
  (int_ganados_m - int_causados_m) / activo_total_m * 100 AS sist_nim, gastos_op_m / activo_total_m * 100 AS sist_efic_op
  FROM improd)"""


def system(ledger):
    return pivot.system_series(ledger, "SEGMENTO 1", 1996)


_ledger_query("system_series", SYSTEM, system)
_ledger_query("system_ratios", SYSTEM_RATIOS + " SELECT * FROM ratios", lambda ledger: ratios.system_ratios(system(ledger)))


@query(
    "table_counts",
    sql("""SELECT 'dim_cooperativa' AS tabla, count(*) AS filas FROM dim UNION ALL
     SELECT 'dim_cuenta', count(DISTINCT cuenta) FROM ledger UNION ALL
     SELECT 'fact_eeff', count(*) FROM ledger UNION ALL SELECT 'fact_indicadores', count(*) FROM fact""", "fact", "dim"),
)
def table_counts(spark, sf_dir):
    s = star(spark, sf_dir)
    return describe.table_counts(
        {"dim_cooperativa": s.dim_entity, "dim_cuenta": s.dim_account, "fact_eeff": s.ledger, "fact_indicadores": s.fact}
    )


_ledger_query(
    "short_names",
    r""", n AS (SELECT DISTINCT razon_social, trim(regexp_replace(regexp_replace(razon_social, 'COOPERATIVA DE AHORRO Y CR[EÉ]DITO\s*', '', 'g'),
          'LIMITADA|LTDA\.?', '', 'g')) AS t FROM ledger)
     SELECT razon_social, array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS nombre,
       substr(razon_social, 1, 28) AS etiqueta FROM n""",
    lambda ledger: ledger.select("razon_social").distinct().select(
        "razon_social", short_name("razon_social").alias("nombre"), truncate("razon_social", 28).alias("etiqueta")
    ),
)
_ledger_query(
    "last_months",
    """, m AS (SELECT ruc, max(fecha_corte) AS u FROM ledger GROUP BY ruc)
     SELECT ruc, list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], month(u)) || ' ' || year(u) AS corte,
       strftime(u, '%b%Y') AS etiqueta, strftime(date_trunc('month', u) + to_months(3), '%Y-%m') AS tercer_mes,
       last_day(CAST(date_trunc('month', u) + to_months(2) AS DATE)) AS segundo_cierre FROM m""",
    lambda ledger: ledger.groupBy("ruc").agg(F.max("fecha_corte").alias("u")).select(
        "ruc", month_label("u", "es").alias("corte"), month_label("u", "short").alias("etiqueta"),
        next_months("u", 3)[2].alias("tercer_mes"), month_ends("u", 2)[1].alias("segundo_cierre"),
    ),
)
_LEDGER_OUT = "SELECT * REPLACE (CAST(saldo_usd AS DOUBLE) AS saldo_usd) FROM ledger"


# Ingestion -----------------------------------------------------------------------------------


def _raw_text(ledger, decimal_comma: bool):
    """A ledger as the supervisor's yearly text: all strings, published header spellings."""
    amount = F.col("saldo_usd").cast("string")
    return ledger.select(
        F.date_format("fecha_corte", "yyyy-MM-dd").alias("FECHA DE CORTE"),
        F.col("segmento").alias("SEGMENTO"),
        F.col("ruc").alias("RUC"),
        F.col("razon_social").alias("RAZON SOCIAL"),
        F.col("cuenta").alias("CUENTA"),
        F.col("descripcion_cuenta").alias("DESCRIPCION CUENTA"),
        (F.replace(amount, F.lit("."), F.lit(",")) if decimal_comma else amount).alias("SALDO (USD)"),
        "anio",
    )


def raw_tree(spark, sf_dir) -> str:
    """Text files per year folder: tab-separated until 1998, semicolons and decimal commas after."""
    ledger, root = star(spark, sf_dir).ledger, scratch_path(spark, "raw")
    early, late = ledger.where(F.col("anio") <= "1998"), ledger.where(F.col("anio") > "1998")
    for rows, sep in ((_raw_text(early, False), "\t"), (_raw_text(late, True), ";")):
        rows.write.mode("append").partitionBy("anio").option("header", True).option("sep", sep).csv(root)
    return root


@query("ingest_tree", sql(_LEDGER_OUT))
def ingest_tree(spark, sf_dir):
    return doubles(text.read_ledger_tree(spark, raw_tree(spark, sf_dir)))


@query("ingest_refresh_year", sql(_REPORT))
def ingest_refresh_year(spark, sf_dir):
    """Store the ledger with one year damaged, then replace that year from the raw files."""
    ledger, path = star(spark, sf_dir).ledger, scratch_path(spark, "store")
    broken = ledger.where(F.col("anio") == "2001").withColumn("saldo_usd", -F.col("saldo_usd"))
    store.write_ledger(store.append([ledger.where(F.col("anio") != "2001"), broken, broken]), path)
    store.refresh_year(text.read_ledger_tree(spark, raw_tree(spark, sf_dir)), path, "2001")
    return describe.load_report(store.read_ledger(spark, path))


#: Entities of an archive where it holds several.
ENTITIES_AN_ARCHIVE = 32


def _write_archives(raw, root: str, members, name: str = "RUC") -> int:
    """Write one ZIP file per ``name`` and year, in tasks; ``members(csv text)`` lists its files.

    An entity's is bounded by cuts × chart of accounts. A name that is no column of the text stays out of it.
    """
    columns = [c for c in raw.columns if c not in ("anio", name) or c == "RUC"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for member, body in members(pdf[columns].to_csv(sep=";", index=False)):
                z.writestr(member, body.encode("latin-1"))
        files, top = fs.FileSystem.from_uri(root)
        # Names that differ in their last three places share a folder, so that no folder has all archives.
        folder = f"{top}/archivos/{first['anio']}/{str(first[name])[:-3] or '0'}"
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{first['anio']} {first[name]}.zip") as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"bytes": [len(packed.getvalue())]})

    return raw.groupBy(name, "anio").applyInPandas(pack, "bytes bigint").agg(F.sum("bytes")).first()[0]


@query("ingest_zip", sql(_LEDGER_OUT))
def ingest_zip(spark, sf_dir):
    """Archives whose first member lacks the required columns and whose last repeats the ledger."""
    ledger, root = star(spark, sf_dir).ledger, scratch_path(spark, "zips")
    lots = -(-ledger.agg(F.approx_count_distinct("ruc")).first()[0] // ENTITIES_AN_ARCHIVE)
    _write_archives(
        _raw_text(ledger, True).withColumn("lote", F.pmod(F.xxhash64("RUC"), F.lit(max(1, lots)))), root,
        lambda csv: [("leame.txt", "NOTA\nsin datos\n"), ("balance.csv", csv), ("copia.csv", csv)], "lote",
    )
    return doubles(text.read_ledger_tree(spark, root))


@query(
    "ingest_refused",
    sql("""SELECT anio, ruc, CAST(count(*) AS BIGINT) AS filas, 'datos.csv: late, leame.txt: missing fecha_corte, cuenta, saldo_usd' AS motivos
     FROM ledger WHERE CAST(anio AS INTEGER) % 2 = 0 GROUP BY anio, ruc
     UNION ALL SELECT DISTINCT anio, ruc, CAST(0 AS BIGINT), 'archive: none' FROM ledger WHERE CAST(anio AS INTEGER) % 2 = 1"""),
)
def ingest_refused(spark, sf_dir):
    """Even years: a member that breaks off after all its rows, then a whole one. Odd years: only the broken one."""
    raw, root = _raw_text(star(spark, sf_dir).ledger, True), scratch_path(spark, "zips")
    broken = lambda csv: csv + '"abierto;'
    even = F.col("anio").cast("int") % 2 == 0
    _write_archives(raw.where(even), root, lambda csv: [("leame.txt", "NOTA\nx\n"), ("datos.csv", broken(csv)), ("todo.csv", csv)])
    _write_archives(raw.where(~even), root, lambda csv: [("datos.csv", broken(csv))])
    tree = text.scan_tree(spark, root)
    name = F.try_url_decode(F.col("path"))
    part = F.regexp_extract(name, r"!([^!]+)$", 1)
    why = F.when(F.col("motivo").startswith("Error tokenizing"), "late").when(F.col("motivo") == "no readable member", "none").otherwise(F.col("motivo"))
    said = F.concat_ws(": ", F.when(part == "", "archive").otherwise(part), why)
    refused = text.refused_files(spark, tree).select(
        F.regexp_extract(name, r"([0-9]{4}) ([0-9]+)[.]zip", 1).alias("anio"), F.regexp_extract(name, r"([0-9]{4}) ([0-9]+)[.]zip", 2).alias("ruc"),
        part.alias("part"), said.alias("said"),
    )
    # In odd years the member's own reason comes besides the archive's.
    told = refused.where((F.col("anio").cast("int") % 2 == 0) | (F.col("part") == "")).groupBy("anio", "ruc").agg(
        F.array_join(F.array_sort(F.collect_list("said")), ", ").alias("motivos")
    )
    rows = text.read_ledger_tree(spark, root, tree=tree).groupBy("anio", "ruc").agg(F.count(F.lit(1)).alias("filas"))
    return told.join(rows, ["anio", "ruc"], "left").select("anio", "ruc", F.coalesce("filas", F.lit(0)).alias("filas"), "motivos")


@query(
    "rejected_amounts",
    sql("""SELECT l_returnflag AS segmento, CAST(count(*) AS BIGINT) AS filas, count(*) FILTER (WHERE l_linenumber % 4 = 3) AS ceros,
     CAST(sum(CASE l_linenumber % 4 WHEN 0 THEN CAST('123456789' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '.25' AS DECIMAL(38,4))
       WHEN 1 THEN CAST('12345678901234567' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS DECIMAL(38,4))
       WHEN 2 THEN CAST(l_linenumber AS DECIMAL(38,4)) ELSE 0 END) AS VARCHAR) AS total,
     (SELECT count(*) FROM lineitem WHERE l_linenumber % 4 = 3) AS rechazados FROM lineitem GROUP BY l_returnflag"""),
)
def rejected_amounts(spark, sf_dir):
    """Balances of 17 and 25 digits stay as they are; what is no number is 0 and counted beside the rows."""
    lines, key = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    kind = F.col("l_linenumber") % 4
    amount = (
        F.when(kind == 0, F.concat(F.lit("123456789"), key, F.lit(",25"))).when(kind == 1, F.concat(F.lit("12345678901234567"), key))
        .when(kind == 2, F.concat(F.lit(" +"), F.col("l_linenumber").cast("string"), F.lit("e0 "))).otherwise(F.lit("n/d"))
    )
    watch = Observation()
    ledger = text.conform(lines.select(F.col("l_returnflag").alias("segmento"), amount.alias("saldo_usd"), F.lit("x").alias("anio")), watch)
    sums = checkpoint(
        ledger.groupBy("segmento").agg(
            F.count(F.lit(1)).alias("filas"), F.count_if(F.col("saldo_usd") == 0).alias("ceros"), F.sum("saldo_usd").cast("string").alias("total")
        )
    )
    return sums.withColumn("rechazados", F.lit(watch.get["rechazados"]).cast("bigint"))


@query(
    "clean_rows",
    sql(f"""SELECT CAST(count(*) AS BIGINT) AS filas, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(20,4)) END) AS DOUBLE) AS total,
     count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS fechas, count(DISTINCT l_returnflag) AS textos FROM lineitem"""),
)
def clean_rows(spark, sf_dir):
    """Amount, date and text cleaning over every line, with every third amount and odd date damaged."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    amount = F.col("l_extendedprice").cast("decimal(20,4)").cast("string")
    dirty = lines.select(
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("1."), F.replace(amount, F.lit("."), F.lit(","))))
        .otherwise(F.concat(F.lit(" "), F.replace(amount, F.lit("."), F.lit(",")))).alias("saldo"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", '"yyyy-MM-dd"')).otherwise("sin fecha").alias("fecha"),
        F.concat(F.lit(' "'), "l_returnflag", F.lit('" ')).alias("texto"),
    )
    return dirty.agg(
        F.count(F.lit(1)).alias("filas"),
        F.sum(text.parse_amount("saldo")).cast("double").alias("total"),
        F.count(text.parse_date("fecha")).alias("fechas"),
        F.countDistinct(text.clean_text("texto")).alias("textos"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
