import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from balanza.functions.scalar import province
from balanza.operators import outlook, serve, series
from balanza.sources import store

D = dt.date


def month_end(i):
    year, month = divmod(i, 12)
    return (D(2015 + year + (month == 11), (month + 1) % 12 + 1, 1)) - dt.timedelta(days=1)


def test_periods(spark):
    df = spark.createDataFrame([(month_end(i), float(i)) for i in range(24)] + [(None, 1.0), (D(2015, 3, 15), None)], "fecha_corte date, v double")
    periods = spark.createDataFrame(
        [("a", D(2015, 1, 31), D(2015, 3, 31)), ("b", D(2015, 3, 31), D(2015, 3, 31)), ("c", D(2015, 4, 1), D(2015, 4, 29)), ("d", None, D(2016, 1, 1)),
         ("e", D(2016, 12, 1), D(2016, 1, 1)), ("f", D(2014, 6, 1), D(2020, 1, 1))],
        "periodo string, desde date, hasta date",
    )
    got = {(r.periodo, r.n, r.media, r.mediana, r.max) for r in outlook.period_profile(df, periods, ["v"]).collect()}
    assert got == {("a", 3, 1.0, 1.0, 2.0), ("b", 1, 2.0, 2.0, 2.0), ("f", 24, 11.5, 11.5, 23.0)}
    change = outlook.period_change(outlook.period_profile(df, periods, ["v"]), "a", "f").first()
    assert change.cambio_media == 10.5 and change.mediana_antes == 1.0
    assert outlook.period_profile(df.limit(0), periods, ["v"]).count() == 0


def test_events_of_the_trend(spark):
    df = spark.createDataFrame([(month_end(i),) for i in range(12)], "fecha_corte date")
    rows = series.mark_periods(df, events=[("2015-02-01", "2015-03-31"), ("2015-12-31", "2015-12-31")]).orderBy("fecha_corte").collect()
    assert [i for i, r in enumerate(rows) if r.en_evento] == [1, 2, 11]
    assert not any(r.en_evento for r in series.mark_periods(df, events=[]).collect())


def history(spark, bad_months, n=30, entities=("x", "y")):
    rows = [(e, month_end(i), i in bad_months.get(e, ()), float(i)) for e in entities for i in range(n)]
    return spark.createDataFrame(rows, "ruc string, fecha_corte date, malo boolean, v double")


def test_future_label(spark):
    rows = outlook.future_label(history(spark, {"x": {10}}), F.col("malo"), 3).collect()
    label = {(r.ruc, r.fecha_corte): r.alerta for r in rows}
    assert [label["x", month_end(i)] for i in range(30)] == [None if i > 26 else int(7 <= i <= 9) for i in range(30)]
    late = outlook.future_label(history(spark, {"y": {29}}), F.col("malo"), 3).where("ruc = 'y'").orderBy("fecha_corte").collect()
    assert [r.alerta for r in late[-5:]] == [0, 1, 1, 1, None]


def test_training_ends_at_the_split(spark):
    rows = outlook.future_label(history(spark, {"x": {5, 20}}), F.col("malo"), 3)
    used = outlook.training_rows(rows, "2016-06-30", 3)
    assert used.agg(F.max("fecha_corte")).first()[0] == D(2016, 3, 31)
    # What comes after the split changes nothing that is learnt.
    spoilt = rows.withColumn("alerta", F.when(F.col("fecha_corte") > "2016-03-31", 1 - F.col("alerta")).otherwise(F.col("alerta")))
    spoilt = spoilt.withColumn("v", F.when(F.col("fecha_corte") > "2016-06-30", F.lit(-1e9)).otherwise(F.col("v")))
    fits = [outlook.fit_warning(df, "2016-06-30", ["v"], 3, trees=5) for df in (rows, spoilt)]
    assert fits[0].medians == fits[1].medians
    probe = rows.where("fecha_corte <= '2016-03-31'")
    a, b = ([r.probabilidad for r in f.score(probe).orderBy("ruc", "fecha_corte").collect()] for f in fits)
    assert a == b
    with pytest.raises(ValueError):
        outlook.fit_warning(rows.withColumn("alerta", F.lit(0)), "2016-06-30", ["v"], 3)


def test_warning_and_importances(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(60):
        level = rng.normal()
        for i in range(20):
            level = 0.9 * level + 0.3 * rng.normal()
            rows.append((f"e{e}", month_end(i), float(level) if rng.random() > 0.1 else None, float(rng.normal()), bool(level > 1)))
    df = spark.createDataFrame(rows, "ruc string, fecha_corte date, senal double, ruido double, malo boolean")
    labelled = outlook.future_label(df, F.col("malo"), 3)
    scored, model = outlook.early_warning(labelled, "2016-01-31", features=["senal", "ruido"], months=3, trees=20)
    assert scored.agg(F.min("fecha_corte")).first()[0] > D(2016, 1, 31)
    assert scored.columns == [*labelled.columns, "probabilidad"]
    quality = outlook.warning_quality(scored).first()
    known = [(r.alerta, r.probabilidad) for r in scored.collect() if r.alerta is not None]
    pairs = [(p > q) + 0.5 * (p == q) for a, p in known if a for b, q in known if not b]
    assert quality.n == len(known) and quality.auc == pytest.approx(sum(pairs) / len(pairs)) and quality.auc > 0.75
    gains = {r.indicador: (r.importancia, r.lugar) for r in model.importances().collect()}
    assert gains["senal"][0] > 0.7 and gains["senal"][1] == 1 and sum(g for g, _ in gains.values()) == pytest.approx(1)


def test_backtest_against_fits_by_fold(spark):
    rng = np.random.default_rng(3)
    series_of = {e: np.cumsum(rng.normal(size=26)) + 5 for e in "abcd"}
    rows = [(e, month_end(i), float(v), float(np.sin(i) + v / 2)) for e, vs in series_of.items() for i, v in enumerate(vs) if not (e == "b" and i in (4, 9))]
    df = spark.createDataFrame(rows, "ruc string, fecha_corte date, v double, w double")
    at = {(e, d): (v, w) for e, d, v, w in rows}
    pairs = [(i, *at[e, month_end(i)], at[e, month_end(i + 3)][0]) for e in "abcd" for i in range(23) if (e, month_end(i)) in at and (e, month_end(i + 3)) in at]
    for features, pick in ((["v"], [1]), (["v", "w"], [1, 2])):
        got = {r.corte: r for r in outlook.backtest(df, "v", features).collect()}
        seen = 0
        for t in range(26):
            past = np.array([p for p in pairs if p[0] + 3 <= t])
            test = np.array([p for p in pairs if p[0] == t])
            # At first w is half of v.
            if len(past) <= len(features) or not len(test) or (t == 3 and len(features) == 2):
                assert month_end(t) not in got
                continue
            x = np.column_stack([np.ones(len(past)), past[:, pick]])
            weights, *_ = np.linalg.lstsq(x, past[:, 3], rcond=None)
            gone = test[:, 3] - np.column_stack([np.ones(len(test)), test[:, pick]]) @ weights
            r, seen = got[month_end(t)], seen + 1
            assert r.n_entrena == len(past) and r.n_prueba == len(test) and list(r.pesos) == pytest.approx(list(weights), abs=1e-6)
            assert r.mae == pytest.approx(np.abs(gone).mean()) and r.rmse == pytest.approx(np.sqrt((gone**2).mean()))
        assert seen > 15
    flat = spark.createDataFrame([("a", month_end(i), 1.0, 1.0) for i in range(12)], "ruc string, fecha_corte date, v double, w double")
    assert outlook.backtest(flat, "v").count() == 0


def test_robust_distance(spark):
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([0, 0], [[1, 0.95], [0.95, 1]], size=400)
    x[:6] = [2, -2]  # unusual only in combination
    x[6:10] = [50, 50]
    rows = [(i, float(a), float(b), 3.0) for i, (a, b) in enumerate(x)] + [(900, None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, fija double")
    got = {r.id: r for r in outlook.robust_distance(df, ["a", "b"], rounds=2).collect()}
    assert 900 not in got and all(got[i].anomalo for i in range(10))
    assert sum(r.anomalo for r in got.values()) < 45
    assert outlook.chi2_cut(0.975, 2) == pytest.approx(-2 * np.log(0.025))
    with_flat = {r.id: r.distancia2 for r in outlook.robust_distance(df, ["a", "b", "fija"], rounds=2).collect()}
    assert with_flat[0] > outlook.chi2_cut(0.975, 3) and set(with_flat) == set(got)
    assert outlook.robust_distance(df.limit(0), ["a", "b"]).count() == 0
    few = outlook.robust_distance(df.where("id in (20, 21)"), ["a", "b"]).collect()
    assert len(few) == 2


def test_provinces(spark):
    rows = spark.createDataFrame([("0190001",), ("1790",), ("24",), ("2500",), ("00",), ("x1",), (None,)], "ruc string").select(province("ruc")).collect()
    assert [r[0] for r in rows] == ["Azuay", "Pichincha", "Santa Elena", None, None, None, None]


def test_ranking_export(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 4.0)], "ruc string, camel_score double")
    store.write_ranking_csv(serve.ranked(rows, "worst"), str(tmp_path / "r"))
    lines = "".join(p.read_text("utf-8-sig") for p in sorted((tmp_path / "r").glob("part-*.csv")))
    assert [x for x in lines.replace("﻿", "").splitlines() if not x.startswith("posicion")] == ["1,d,4.0", "2,a,2.0", "3,b,2.0", "4,c,"]
