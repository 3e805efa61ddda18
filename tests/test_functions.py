import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from balanza.functions import ordered, scalar, tails
from balanza.functions.scalar import with_normal_quantile


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text,value",
    [("1234,50", 1234.5), ("1.234,56", 0), (" -42 ", -42), ("abc", 0), ("", 0), (None, 0), ("1e3", 1000), ("nan", 0), ("inf", 0), (".5", 0.5)],
)
def test_parse_amount(spark, text, value):
    assert float(one(spark, scalar.parse_amount(F.lit(text).cast("string")))) == value


@pytest.mark.parametrize(
    "text,value",
    [("2024-01-31", dt.date(2024, 1, 31)), (' "2024-01-31" ', dt.date(2024, 1, 31)), ("31/01/2024", dt.date(2024, 1, 31)),
     ("2024-01-31 00:00:00", dt.date(2024, 1, 31)), ("sin fecha", None), ("2024-02-31", None)],
)
def test_parse_date(spark, text, value):
    assert one(spark, scalar.parse_date(F.lit(text))) == value


def test_text_helpers(spark):
    assert one(spark, scalar.clean_text(F.lit(' "1425" '))) == "1425"
    assert one(spark, scalar.short_name(F.lit("COOPERATIVA DE AHORRO Y CRÉDITO SAN PEDRO LTDA."))) == "San Pedro"
    assert one(spark, scalar.short_label(F.lit("Segmento 1 Mutualista"))) == "Mutualista"
    assert one(spark, scalar.short_label(F.lit("SEGMENTO 1"))) == "SEGMENTO 1"
    assert one(spark, scalar.limit_text(F.lit("mayor"), F.lit(9.0), F.lit("%"))) == "≥9%"
    assert one(spark, scalar.limit_text(F.lit("menor"), F.lit(7.5), F.lit("x"))) == "≤7.5x"
    assert [one(spark, scalar.stars(F.lit(p))) for p in (0.0005, 0.005, 0.03, 0.05)] == ["***", "**", "*", ""]
    assert one(spark, scalar.truncate(F.lit("x" * 40))) == "x" * 28


def test_months(spark):
    day = F.lit("2026-11-30").cast("date")
    assert one(spark, scalar.month_label(day, "es")) == "Nov 2026"
    assert one(spark, scalar.month_label(day, "short")) == "Nov2026"
    assert one(spark, scalar.next_months(day, 3)) == ["2026-12", "2027-01", "2027-02"]
    assert one(spark, scalar.month_ends(F.lit("2024-01-31").cast("date"), 2)) == [dt.date(2024, 2, 29), dt.date(2024, 3, 31)]


def test_half_up(spark):
    assert one(spark, scalar.half_up(F.lit(1.005), 2)) == 1.01 and one(spark, scalar.half_up(F.lit(-2.5), 0)) == -3


def test_normal_quantile(spark):
    p = [1e-12, 1e-6, 0.01, 0.074, 0.2, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    for r in with_normal_quantile(df, F.col("p"), "z").collect():
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-14)


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert tails.chi2_upper(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-12)
    assert tails.chi2_upper(3.0, 3) == pytest.approx(math.erfc(math.sqrt(1.5)) + math.sqrt(6 / math.pi) * math.exp(-1.5), rel=1e-10)
    assert tails.chi2_upper(200.0, 4) == pytest.approx(math.exp(-100) * 101, rel=1e-9)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value and one key."""
    rng = np.random.default_rng(3)
    rows = [("a", 7.0)] * 400 + [("a", float(v)) for v in rng.normal(size=500).round(2)] + [("b", float(v)) for v in rng.normal(size=301)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5), rows


def test_exact_quantiles(hot):
    df, rows = hot
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in ordered.exact_quantiles(df, ["k"], "v", probs).collect():
        mine = [v for k, v in rows if k == r.k]
        assert list(r[1:]) == pytest.approx(list(np.quantile(mine, probs)))
    everything = ordered.exact_quantiles(df, [], "v", [0.5], ["m"]).collect()
    assert len(everything) == 1 and everything[0].m == pytest.approx(np.median([v for _, v in rows]))


def test_average_rank(hot):
    df, rows = hot
    ranks = {(r.k, r.v): (r.rango, r.empates) for r in ordered.average_rank(df, ["k"], "v").collect()}
    for key in "ab":
        mine = np.sort([v for k, v in rows if k == key])
        for v in set(mine):
            at = np.flatnonzero(mine == v) + 1
            assert ranks[key, v] == (at.mean(), len(at))
    assert ordered.with_average_rank(df, ["k"], "v").count() == len(rows)


def test_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("g"))
    rows = ordered.global_position(df, [F.col("g").desc(), F.col("id")]).collect()
    expected = sorted(((r.g, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r.g, r.id) for r in sorted(rows, key=lambda r: r.posicion)] == expected
    assert sorted(r.posicion for r in rows) == list(range(1, 1001))
