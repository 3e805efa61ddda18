"""Models of one short series, run per entity inside Spark tasks."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

HOLT_SCHEMA = (
    "clave string, ultima date, paso int, prediccion double, inferior double, superior double, "
    "alfa double, beta double, metodo string"
)
ADF_SCHEMA = "clave string, n int, estadistico double, p_valor double, rezagos int"

# Response-surface coefficients of the Dickey-Fuller t test with a constant.
DF_SMALL_P = (2.1659, 1.4412, 0.038269)
DF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
DF_SWITCH, DF_MIN, DF_MAX = -1.61, -18.83, 2.74


def _holt_errors(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray):
    """One-step errors as affine functions of the initial level and trend, for many parameters.

    The smoothing recursion is linear in its initial state, so each error is
    ``base + by_level * l0 + by_trend * b0``; running it on the three basis states gives all of them.
    """
    size = len(alpha)
    level, slope = np.zeros((3, size)), np.zeros((3, size))
    level[1], slope[2] = 1.0, 1.0
    errors = np.empty((3, len(y), size))
    for t, value in enumerate(y):
        expected = level + slope
        error = -expected
        error[0] += value
        errors[:, t] = error
        level = expected + alpha * error
        slope = slope + beta * error
    return errors


def _best_states(errors: np.ndarray):
    """Least-squares initial states and their error sum for each parameter column."""
    base, by_level, by_trend = errors
    a, b, c = (np.einsum("ts,ts->s", p, q) for p, q in ((by_level, by_level), (by_level, by_trend), (by_trend, by_trend)))
    u, v = -np.einsum("ts,ts->s", by_level, base), -np.einsum("ts,ts->s", by_trend, base)
    det = a * c - b * b
    det = np.where(np.abs(det) < 1e-12, 1e-12, det)
    l0, b0 = (c * u - b * v) / det, (a * v - b * u) / det
    residual = base + by_level * l0 + by_trend * b0
    return l0, b0, np.einsum("ts,ts->s", residual, residual)


def fit_holt(y: np.ndarray):
    """Parameters with the least one-step error: 0 < beta <= alpha <= 1.

    The initial states have a closed form for given parameters, which leaves a smooth search
    over two numbers: a grid that narrows around its best point.
    """
    centre, width, points = np.array([0.5, 0.5]), 0.5, 17
    best = None
    for _ in range(12):
        a = np.clip(np.linspace(centre[0] - width, centre[0] + width, points), 1e-4, 1.0)
        share = np.clip(np.linspace(centre[1] - width, centre[1] + width, points), 1e-4, 1.0)
        grid_a, grid_share = (g.ravel() for g in np.meshgrid(a, share))
        l0, b0, sse = _best_states(_holt_errors(y, grid_a, grid_a * grid_share))
        i = int(np.argmin(sse))
        if best is None or sse[i] < best[-1]:
            best = (grid_a[i], grid_a[i] * grid_share[i], l0[i], b0[i], sse[i])
            centre = np.array([grid_a[i], grid_share[i]])
        width, points = width * 0.4, 7
    return best


def _holt_path(y, alpha, beta, level, slope):
    errors = np.empty(len(y))
    for t, value in enumerate(y):
        expected = level + slope
        errors[t] = value - expected
        level = expected + alpha * errors[t]
        slope = slope + beta * errors[t]
    return errors, level, slope


def holt_forecaster(steps: int):
    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fecha")
        y = pdf["valor"].to_numpy(float)
        ahead = np.arange(1, steps + 1)
        alpha = beta = None
        if len(y) >= 4:
            alpha, beta, l0, b0, _ = fit_holt(y)
            errors, level, slope = _holt_path(y, alpha, beta, l0, b0)
            point, half, method = level + slope * ahead, 1.96 * errors.std(), "holt"
        else:
            x = np.arange(len(y))
            slope, level = np.polyfit(x, y, 1) if len(y) > 1 else (0.0, y[0])
            point, half, method = level + slope * (len(y) - 1 + ahead), np.nan, "lineal"
        return pd.DataFrame(
            {
                "clave": pdf["clave"].iloc[0], "ultima": pdf["fecha"].iloc[-1], "paso": ahead, "prediccion": point,
                "inferior": point - half, "superior": point + half, "alfa": alpha, "beta": beta, "metodo": method,
            }
        ).astype({"alfa": float, "beta": float}).replace({np.nan: None})

    return forecast


def df_p_value(stat: float) -> float:
    if stat > DF_MAX:
        return 1.0
    if stat < DF_MIN:
        return 0.0
    weights = DF_SMALL_P if stat <= DF_SWITCH else DF_LARGE_P
    z = sum(w * stat**i for i, w in enumerate(weights))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _adf_design(y: np.ndarray, lags: int):
    """Difference on constant, previous level and ``lags`` lagged differences."""
    d = np.diff(y)
    rows = np.arange(lags, len(d))
    columns = [np.ones(len(rows)), y[rows]] + [d[rows - k] for k in range(1, lags + 1)]
    return d[rows], np.column_stack(columns)


def _ols(target, design):
    coefficients, *_ = np.linalg.lstsq(design, target, rcond=None)
    residual = target - design @ coefficients
    return coefficients, float(residual @ residual)


def adf_statistic(y: np.ndarray):
    """(t statistic, lags used), or None when the series is constant or too short."""
    n = len(y)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    if most < 0 or y.max() == y.min():
        return None
    target, design = _adf_design(y, most)
    size = len(target)

    def aic(lags):
        width = lags + 2
        _, sse = _ols(target, design[:, :width])
        return size * (math.log(2 * math.pi) + math.log(max(sse, 1e-300) / size) + 1) + 2 * width

    lags = min(range(most + 1), key=aic)
    target, design = _adf_design(y, lags)
    freedom = len(target) - design.shape[1]
    if freedom <= 0:
        return None
    coefficients, sse = _ols(target, design)
    variance = sse / freedom * np.linalg.pinv(design.T @ design)[1, 1]
    if variance <= 0:
        return None
    return coefficients[1] / math.sqrt(variance), lags


def adf_test(pdf: pd.DataFrame) -> pd.DataFrame:
    y = pdf.sort_values("fecha")["valor"].to_numpy(float)
    found = adf_statistic(y)
    stat, lags = found if found else (None, None)
    return pd.DataFrame(
        {
            "clave": [pdf["clave"].iloc[0]],
            "n": [len(y)],
            "estadistico": pd.Series([stat], dtype=object),
            "p_valor": pd.Series([df_p_value(stat) if found else None], dtype=object),
            "rezagos": pd.Series([lags], dtype=object),
        }
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
