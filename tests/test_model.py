import datetime as dt

import pytest
from pyspark.sql import functions as F

from balanza.operators import describe, dimensions, serve

D = dt.date


def spans(spark, rows):
    return spark.createDataFrame(
        [(d, s, r, n, "1", "x", None, None) for d, s, r, n in rows],
        "fecha_corte date, segmento string, ruc string, razon_social string, cuenta string, descripcion_cuenta string, saldo_usd decimal(20,4), anio string",
    )


def test_dim_entity(spark):
    ledger = spans(spark, [
        (D(2020, 1, 31), "SEGMENTO 2", "1", "UNO"), (D(2020, 2, 29), "SEGMENTO 1", "1", "UNO"),
        (D(2020, 2, 29), "SEGMENTO 1", "1", "UNO EN LIQUIDACION"), (None, "SEGMENTO 3", "1", "ZZZ"),
        (D(2020, 2, 29), "SEGMENTO 3", "2", "DOS"),
    ])
    rows = {r.ruc: r for r in dimensions.build_dim_entity(ledger).collect()}
    assert rows["1"].razon_social == "UNO EN LIQUIDACION" and rows["1"].estado == "EN LIQUIDACION"
    assert rows["1"].segmento == "SEGMENTO 1" and rows["1"].meses_activo == 2 and rows["1"].primera_fecha == D(2020, 1, 31)
    assert rows["2"].estado == "ACTIVA"


def test_upsert_keeps_first_date(spark):
    old = dimensions.build_dim_entity(spans(spark, [(D(2020, 1, 31), "SEGMENTO 2", "1", "UNO"), (D(2020, 1, 31), "SEGMENTO 2", "2", "DOS")]))
    new = dimensions.build_dim_entity(spans(spark, [(D(2019, 1, 31), "SEGMENTO 1", "1", "UNO NUEVO"), (D(2021, 1, 31), "SEGMENTO 1", "3", "TRES")]))
    once = dimensions.upsert_entities(old, new)
    rows = {r.ruc: r for r in once.collect()}
    assert rows["1"].primera_fecha == D(2020, 1, 31) and rows["1"].razon_social == "UNO NUEVO" and rows["1"].ultima_fecha == D(2019, 1, 31)
    assert rows["2"].razon_social == "DOS" and rows["3"].primera_fecha == D(2021, 1, 31)
    assert sorted(map(tuple, dimensions.upsert_entities(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_upsert_accounts_keeps_level(spark):
    old = spark.createDataFrame([("14", "VIEJA", 9)], "cuenta string, descripcion_cuenta string, nivel int")
    new = spark.createDataFrame([("14", None, 2), ("15", "NUEVA", 2)], "cuenta string, descripcion_cuenta string, nivel int")
    assert sorted(map(tuple, dimensions.upsert_accounts(old, new).collect())) == [("14", None, 9), ("15", "NUEVA", 2)]


def test_entity_without_needed_accounts_survives(make_ledger):
    rows = dimensions.build_fact_indicadores(make_ledger({"X": {"9999": 1}})).collect()
    assert len(rows) == 1 and rows[0].activo_total is None and float(rows[0].camel_score) == 3.0


def test_orphans(spark):
    fact = spark.createDataFrame([("1",), ("2",)], "ruc string")
    assert [r.ruc for r in dimensions.orphans(fact, fact.where("ruc = '1'"), "ruc").collect()] == ["2"]


def test_panel_excludes_liquidation(make_ledger):
    ledger = make_ledger({"E1": {"1": 10}}).unionByName(make_ledger({"E2": {"1": 10}}, name="{} EN LIQUIDACION"))
    assert [r.ruc for r in dimensions.build_panel(ledger, "SEGMENTO 1").collect()] == ["E1"]


def test_empty_cut_has_no_figures(spark, entities_ledger):
    fact = dimensions.build_fact_indicadores(entities_ledger)
    dim = dimensions.build_dim_entity(entities_ledger).withColumn("estado", F.lit("EN LIQUIDACION"))
    row = serve.kpis(fact, dim).first()
    assert row.total_coops == 0 and row.camel_promedio is None
    side = serve.sidebar_stats(fact, dim).first()
    assert tuple(side) == ("0", "—", "~0M USD")


def test_ranking_order_and_search(entities_ledger):
    fact, dim = dimensions.build_fact_indicadores(entities_ledger), dimensions.build_dim_entity(entities_ledger)
    assert [r.ruc for r in serve.ranking(fact, dim).collect()] == ["E2", "E3", "E4", "E1"]
    assert [r.ruc for r in serve.top_n(fact, dim, 2, "best").collect()] == ["E1", "E4"]
    rows = serve.ranking_rows(fact, dim)
    assert serve.visible_count(serve.filter_ranking(rows, "e1", "segmento")).first()[0] == 1
    assert serve.filter_ranking(rows, segmento="segmento 1 m").isEmpty()
    for ascending in (True, False):
        assert serve.sort_ranking(rows, "morosidad_pct", ascending).collect()[-1].ruc == "E3"
    assert serve.entity(dim, "nadie").isEmpty()
    assert len(serve.entity_history(fact, "E1").collect()) == 1


def test_profile_and_alerts(entities_ledger):
    panel = dimensions.build_panel(entities_ledger)
    profile = {r.indicador: r for r in describe.indicator_profile(panel).collect()}
    assert profile["C_solvencia"].n == 3 and profile["C_solvencia"].n_incumple == 2 and profile["C_solvencia"].mediana == pytest.approx(4)
    alerts = {(r.ruc, r.indicador) for r in describe.compliance_alerts(panel).collect()}
    assert ("E2", "A_morosidad") in alerts and ("E1", "A_morosidad") not in alerts
    assert describe.complete_count(panel).first().completas == 2
