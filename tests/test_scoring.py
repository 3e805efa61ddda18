import pytest
from pyspark.sql import functions as F

from balanza.constants import BANDS
from balanza.functions.scalar import band_score
from balanza.operators import dimensions, pivot, ratios, scoring

RATIOS = {
    "E1": dict(capitalizacion_pct=15, morosidad_pct=3, cobertura_pct=200, eficiencia_op_pct=3.5, roa_pct=2, roe_pct=13.3333,
               nim_pct=4.5, liquidez_ampliada=26.6667, apalancamiento=5.6667, intermediacion=116.6667),
    "E2": dict(capitalizacion_pct=4, morosidad_pct=15, cobertura_pct=41.6667, eficiencia_op_pct=6, roa_pct=-1, roe_pct=-25,
               nim_pct=1, liquidez_ampliada=4.2857, apalancamiento=24, intermediacion=114.2857),
    "E3": dict(capitalizacion_pct=None, morosidad_pct=None, cobertura_pct=None, eficiencia_op_pct=None, roa_pct=None,
               roe_pct=0, nim_pct=None, liquidez_ampliada=None, apalancamiento=None, intermediacion=None),
    "E4": dict(capitalizacion_pct=-4, morosidad_pct=0, cobertura_pct=None, eficiencia_op_pct=0, roa_pct=0, roe_pct=None,
               nim_pct=0, liquidez_ampliada=17.5, apalancamiento=None, intermediacion=75),
}
SCORES = {
    "analyst": {
        "E1": (1, 2, 2, 1, 1, 1.450, "EXCELENTE"), "E2": (5, 5, 4, 5, 5, 4.800, "CRITICO"),
        "E3": (3, 3, 3, 3, 3, 3.000, "ADECUADO"), "E4": (5, 2, 1, 4, 3, 3.000, "ADECUADO"),
    },
    "etl": {
        "E1": (1, 1.5, 1, 1, 1, 1.125, "EXCELENTE"), "E2": (5, 4.5, 3, 5, 5, 4.475, "MARGINAL"),
        "E3": (3, 3, 3, 3, 3, 3.000, "ADECUADO"), "E4": (5, 2, 1, 3, 3, 2.850, "ADECUADO"),
    },
}


def test_ratios(entities_ledger):
    rows = ratios.with_fact_ratios(pivot.pivot_accounts(entities_ledger)).collect()
    assert len(rows) == 4
    for row in rows:
        for name, expected in RATIOS[row.ruc].items():
            assert row[name] == (None if expected is None else pytest.approx(expected, abs=5e-5)), (row.ruc, name)


@pytest.mark.parametrize("variant", ["analyst", "etl"])
def test_scores(entities_ledger, variant):
    scored = scoring.with_scores(
        ratios.with_fact_ratios(pivot.pivot_accounts(entities_ledger)), variant, scoring.FACT_INPUTS
    )
    for row in scored.collect():
        got = (row.sc_C, row.sc_A, row.sc_M, row.sc_E, row.sc_L, row.camel, row.rating_camel)
        assert got == SCORES[variant][row.ruc]


def test_fact_matches_variant(entities_ledger):
    fact = {r.ruc: r for r in dimensions.build_fact_indicadores(entities_ledger).collect()}
    assert float(fact["E2"].camel_score) == 4.475 and fact["E2"].rating_camel == "MARGINAL"
    assert fact["E3"].activo_total == 0 and fact["E3"].cartera_bruta is None


@pytest.mark.parametrize("variant", list(BANDS))
@pytest.mark.parametrize("component", list(BANDS["analyst"]))
def test_band_edges(spark, variant, component):
    """On, just under and just over every cut point, against a plain reading of the table."""
    comparison, cuts, scores, last = BANDS[variant][component]
    values = [c + d for c in cuts for d in (-0.001, 0.0, 0.001)]
    test = {">=": float.__ge__, ">": float.__gt__, "<": float.__lt__}[comparison]
    expected = [next((s for c, s in zip(cuts, scores) if test(float(v), float(c))), last) for v in values]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in df.select("i", band_score("v", *BANDS[variant][component]).alias("s")).orderBy("i").collect()]
    assert got == [float(e) for e in expected]
    missing = spark.range(1).select(band_score(F.lit(None).cast("double"), *BANDS[variant][component])).first()[0]
    assert missing == 3.0


def test_traffic_light(spark):
    rows = [(15.0, 9.0, "SOLVENTE"), (10.0, 9.0, "ADECUADO"), (8.0, 9.0, "ALERTA"), (5.0, 9.0, "CRITICO"),
            (None, 9.0, "Sin datos"), (0.0, 0.0, "SOLVENTE"), (-0.01, 0.0, "CRITICO")]
    df = spark.createDataFrame(rows, "v double, l double, e string")
    assert all(r.e == r.got for r in df.withColumn("got", scoring.traffic_light("v", "l", "mayor")).collect())


def test_solvency_state(spark):
    rows = [(12.0, "SOLVENTE"), (9.0, "ADECUADO"), (6.0, "ALERTA"), (5.9, "CRITICO"), (None, "Sin datos")]
    df = spark.createDataFrame(rows, "v double, e string")
    assert all(r.e == r.got for r in df.withColumn("got", scoring.solvency_state("v")).collect())


def test_radar(spark):
    schema = "capitalizacion_pct double, morosidad_pct double, eficiencia_op_pct double, roa_pct double, liquidez_ampliada double"
    a, b = scoring.radar_scores(spark.createDataFrame([(9.0, 10.0, None, 1.0, 7.0), (None, 0.0, 100.0, None, None)], schema)).collect()
    assert (a.radar_C, a.radar_A, a.radar_M, a.radar_E, a.radar_L) == (100, 50, 0, 75, 50)
    assert (b.radar_C, b.radar_A, b.radar_M, b.radar_E, b.radar_L) == (0, 0, 80, 50, 0)


def test_score_properties(entities_ledger):
    for variant in ("analyst", "etl"):
        for r in dimensions.build_fact_indicadores(entities_ledger, variant).collect():
            assert 1 <= r.camel_score <= 5 and (r.camel_score * 1000) % 25 == 0


def test_entity_ratios_undefined_division_is_null(entities_ledger):
    merged = pivot.merge_on_date(pivot.entity_pivot(entities_ledger), pivot.npl_prefix(entities_ledger))
    rows = {r.ruc: r for r in ratios.entity_ratios(merged).collect()}
    assert rows["E3"].capitalizacion is None and rows["E1"].capitalizacion == pytest.approx(15)
    assert rows["E4"].apalancamiento == pytest.approx(-26) and rows["E1"].no_devenga == 14
