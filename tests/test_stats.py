import numpy as np
import pytest

from balanza.operators import stats

N = 120


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, 3))
    x[:, 2] = x[:, 0] * 2 + rng.normal(size=N) * 0.3
    y = 1.5 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=N) * (1 + np.abs(x[:, 0]))
    g = np.repeat([0, 1, 2], N // 3)
    rows = [(i, *map(float, x[i]), float(y[i]), int(g[i])) for i in range(N)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, g int"), x, y, g


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])


def test_spearman_matrix(sample):
    df, x, *_ = sample
    for r in stats.spearman_matrix(df, ["a", "b", "c"], ["id"]).collect():
        i, j = "abc".index(r.indicador), "abc".index(r.contra)
        assert i > j and r.rho == pytest.approx(np.corrcoef(ranks(x[:, i]), ranks(x[:, j]))[0, 1])


def test_spearman_with_ties_and_nulls(spark):
    rows = [(1, 1.0, 2.0), (2, 2.0, 2.0), (3, 3.0, None), (4, 4.0, 5.0), (5, 5.0, 1.0), (6, 5.0, 9.0), (7, 7.0, 8.0)]
    df = spark.createDataFrame(rows, "id int, t double, v double")
    r = stats.spearman_with(df, "t", ["v"], ["id"]).first()
    kept = [(t, v) for _, t, v in rows if v is not None]
    rho = np.corrcoef(ranks([t for t, _ in kept]), ranks([v for _, v in kept]))[0, 1]
    assert r.n == 6 and r.rho == pytest.approx(rho) and 0 < r.p_valor < 1
    assert stats.spearman_with(df.where("id <= 4"), "t", ["v"], ["id"]).isEmpty()


def test_vif(sample):
    df, x, *_ = sample
    got = {r.indicador: r.vif for r in stats.vif(df, ["a", "b", "c"]).collect()}
    for i, name in enumerate("abc"):
        others = np.delete(x, i, axis=1)
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[name] == pytest.approx(1 / (1 - (fit @ fit) / (x[:, i] @ x[:, i])))


def test_vif_of_a_repeated_column(spark):
    rows = [(float(i % 7 + 1), float(i % 7 + 1), float(i * i % 11), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {r.indicador: r.vif for r in stats.vif(df, ["a", "b", "c", "d"]).collect()}
    assert got["a"] == got["b"] == float("inf") and 1 <= got["c"] < 100 and got["d"] is None


def test_ols_hc3(sample):
    df, x, y, _ = sample
    design = np.column_stack([np.ones(N), x[:, :2]])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    error = y - design @ beta
    leverage = np.einsum("ij,jk,ik->i", design, inverse, design)
    weighted = design * (error / (1 - leverage))[:, None]
    expected = np.sqrt(np.diag(inverse @ weighted.T @ weighted @ inverse))
    rows = stats.ols_hc3(df, "y", ["a", "b"]).collect()
    assert [r.variable for r in rows] == ["Intercept", "a", "b"]
    assert [r.coeficiente for r in rows] == pytest.approx(list(beta))
    assert [r.error for r in rows] == pytest.approx(list(expected))
    assert rows[0].r2 == pytest.approx(1 - (error @ error) / ((y - y.mean()) ** 2).sum())
    assert rows[1].sig == "***"
    residual = stats.ols_residuals(df, "y", ["a", "b"]).orderBy("id").collect()
    assert [r.residuo for r in residual] == pytest.approx(list(error))


def test_shapiro_known_sample(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(weights)], "id int, v double")
    r = stats.shapiro_wilk(df, "v", ["id"]).first()
    assert r.n == 11 and r.w == pytest.approx(0.79, abs=0.005) and r.p_valor == pytest.approx(0.0067, abs=0.0006)


def test_normality_verdicts(spark):
    rng = np.random.default_rng(2)
    for values, verdict in ((rng.normal(size=300), "NORMAL"), (rng.exponential(size=300), "NO NORMAL")):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
        assert stats.normality(df, "v", ["id"]).first().veredicto == verdict


def test_qq(sample):
    df, _, y, _ = sample
    rows = sorted(stats.qq_pairs(df, "y", ["id"]).collect(), key=lambda r: r.orden)
    assert [r.valor for r in rows] == pytest.approx(sorted(y))
    assert rows[0].teorico == pytest.approx(-rows[-1].teorico)
    assert 0.9 < stats.qq_fit(stats.qq_pairs(df, "y", ["id"])).first().r <= 1


def test_kruskal(spark):
    groups = [[6.4, 6.8, 7.2, 8.3, 8.4, 9.1, 9.4, 9.7], [2.5, 3.7, 4.9, 5.4, 5.9, 8.1, 8.2], [1.3, 4.1, 4.9, 5.2, 5.5, 8.2], [99.0]]
    rows = [(g, float(v)) for g, vs in enumerate(groups) for v in vs]
    r = stats.kruskal(spark.createDataFrame(rows, "cluster int, v double"), ["v"]).first()
    kept = [(g, v) for g, v in rows if g < 3]
    rank = ranks([v for _, v in kept])
    n = len(kept)
    h = 12 / (n * (n + 1)) * sum(rank[[i for i, k in enumerate(kept) if k[0] == g]].sum() ** 2 / len(groups[g]) for g in range(3)) - 3 * (n + 1)
    _, t = np.unique([v for _, v in kept], return_counts=True)
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    assert r.grupos == 3 and r.n == n and r.h == pytest.approx(h) and r.p_valor == pytest.approx(np.exp(-h / 2))


def test_robust_scale_of_a_constant(spark):
    df = spark.createDataFrame([(float(v), 4.0) for v in range(9)], "a double, b double")
    rows = stats.robust_scale(df, ["a", "b"]).collect()
    assert sorted(r.a for r in rows) == pytest.approx([(v - 4) / 4 for v in range(9)]) and {r.b for r in rows} == {0.0}
