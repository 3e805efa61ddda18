import datetime as dt

import numpy as np
import pytest

from balanza.operators import series, series_models

D = dt.date
SCHEMA = "ruc string, fecha_corte date, valor double"


def monthly(spark, values, ruc="1", start=2020):
    ends = [D(start + (i // 12) + ((i % 12) + 1) // 12, (i % 12 + 1) % 12 + 1, 1) - dt.timedelta(days=1) for i in range(len(values))]
    return spark.createDataFrame([(ruc, e, None if v is None else float(v)) for e, v in zip(ends, values)], SCHEMA)


def test_asof_monthly(spark):
    rows = [("1", D(2024, 1, 31), 10.0), ("1", D(2024, 2, 29), 11.0), ("1", D(2024, 4, 30), 13.0),
            ("2", D(2024, 1, 15), 9.0), ("2", D(2024, 3, 10), 7.0), ("3", D(2024, 1, 15), 1.0)]
    got = {(r.ruc, r.fecha_corte): r.valor for r in series.asof_monthly(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        ("1", D(2024, 1, 31)): 10, ("1", D(2024, 2, 29)): 11, ("1", D(2024, 3, 31)): 11, ("1", D(2024, 4, 30)): 13,
        ("2", D(2024, 1, 31)): 9, ("2", D(2024, 2, 29)): 9,
    }


def test_forecast4(spark):
    df = monthly(spark, [1, 2, 3, 4], "a").unionByName(monthly(spark, [0, None, 2, 3], "b")).unionByName(monthly(spark, [1, 2, 3], "c"))
    rows = sorted(series.forecast4(df).collect(), key=lambda r: (r.ruc, r.paso))
    assert [r.prediccion for r in rows[:4]] == pytest.approx([5, 6, 7, 8]) and rows[0].semibanda == pytest.approx(0, abs=1e-9)
    assert [r.prediccion for r in rows[4:]] == pytest.approx([4.0, 5.1, 6.2, 7.3]) and rows[4].semibanda == pytest.approx(1.159552, abs=1e-6)
    assert {r.ruc for r in rows} == {"a", "b"} and rows[0].mes == "2020-05"


def test_forecast_frame_keeps_limit_without_forecast(spark):
    rows = series.forecast_frame(monthly(spark, [1, 2, 3], "c"), 5.0).collect()
    assert sorted({r.serie for r in rows}) == ["historico", "umbral"] and sum(r.serie == "umbral" for r in rows) == 7


def test_recent_takes_the_last(spark):
    assert series.forecast4(monthly(spark, [100] * 30 + [float(i) for i in range(24)])).first().pendiente == pytest.approx(1)


def test_trend_and_growth(spark):
    df = monthly(spark, [2 + 0.5 * i for i in range(25)])
    t = series.trend(df).first()
    assert (t.pendiente_mensual, t.intercepto, t.r2, t.pendiente_anual) == pytest.approx((0.5, 2, 1, 6))
    last = sorted(series.project_linear(df).collect(), key=lambda r: r.paso)[-1]
    assert last.prediccion == pytest.approx(2 + 0.5 * 36) and last.fecha_corte == D(2023, 1, 31)
    growth = {r.anio: r.crecimiento_pct for r in series.yoy_growth(df).collect()}
    assert growth[2020] is None and growth[2021] == pytest.approx((13.5 / 7.5 - 1) * 100)


def test_holt_follows_a_line(spark):
    rows = sorted(series.holt(monthly(spark, [5 + 0.25 * i for i in range(40)])).collect(), key=lambda r: r.paso)
    assert [r.prediccion for r in rows] == pytest.approx([5 + 0.25 * (39 + i) for i in range(1, 13)], abs=1e-6)
    assert rows[0].superior == pytest.approx(rows[0].inferior, abs=1e-6) and rows[0].metodo == "holt"
    short = series.holt(monthly(spark, [1, 2, 3])).collect()
    assert {r.metodo for r in short} == {"lineal"} and max(r.prediccion for r in short) == pytest.approx(15)


def test_holt_is_at_least_as_good_as_a_grid():
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=60)) + 10
    best = series_models.fit_holt(y)[-1]
    for a in np.linspace(0.02, 1, 25):
        for share in np.linspace(0.0001, 1, 25):
            _, _, sse = series_models._best_states(series_models._holt_errors(y, np.array([a]), np.array([a * share])))
            assert best <= sse[0] * (1 + 1e-6)


def test_adf(spark):
    rng = np.random.default_rng(11)
    noise, walk = rng.normal(size=120), np.cumsum(rng.normal(size=120))
    df = monthly(spark, noise, "ruido").unionByName(monthly(spark, walk, "paseo")).unionByName(monthly(spark, [3.0] * 30, "fija"))
    rows = {r.ruc: r for r in series.adf(df).collect()}
    assert rows["ruido"].veredicto == "ESTACIONARIA" and rows["paseo"].veredicto == "NO ESTACIONARIA"
    assert rows["fija"].estadistico is None and rows["fija"].veredicto is None


def test_df_p_value_at_critical_values():
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert series_models.df_p_value(stat) == pytest.approx(p, rel=0.03)


def test_mark_periods(spark):
    rows = series.mark_periods(spark.createDataFrame([("1", D(2020, 12, 31), 1.0), ("1", D(2021, 3, 31), 1.0)], SCHEMA)).collect()
    assert [(r.es_diciembre, r.en_evento) for r in rows] == [(True, True), (False, False)]
