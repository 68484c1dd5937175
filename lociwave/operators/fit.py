"""Curve fits: a small Levenberg-Marquardt in numpy, applied per group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def least_squares(f: Callable[[np.ndarray, np.ndarray], np.ndarray], t: np.ndarray, y: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimises the squared residuals from ``b``; with fewer points than parameters ``b`` comes back, from where nothing is finite unknown ones."""
    if len(t) < len(b):
        return b
    with np.errstate(all="ignore"):
        damp, r = 1e-3, y - f(t, b)
    if not np.isfinite(b).all() or not np.isfinite(r).all():
        return np.full(len(b), np.nan)
    for _ in range(rounds):
        h = 1e-7 * np.maximum(np.abs(b), 1e-7)
        jac = np.stack([(f(t, b + h[k] * (np.arange(len(b)) == k)) - f(t, b - h[k] * (np.arange(len(b)) == k))) / (2 * h[k]) for k in range(len(b))], 1)
        a, g = jac.T @ jac, jac.T @ r
        if not np.isfinite(a).all() or not np.isfinite(g).all():
            break
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-300)), g, rcond=None)[0]
        new = y - f(t, b + step)
        if np.isfinite(new).all() and new @ new <= r @ r:
            done = np.all(np.abs(step) <= 1e-14 * (np.abs(b) + 1e-14))
            b, r, damp = b + step, new, max(damp / 10, 1e-15)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e20:
                break
    return b


def hyperbolic(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (b[0] + b[1] * t)


def exponential(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (b[0] + b[1] * (1 - np.exp(-t / b[2])))


def start_line(t: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Intercept and slope of 1/y on the first points."""
    with np.errstate(all="ignore"):
        t, z = t[:most], 1 / y[:most]
        if len(t) < 2:
            return np.array([z[0], 0.0])
        slope = ((t - t.mean()) * (z - z.mean())).sum() / ((t - t.mean()) ** 2).sum()
        return np.array([z.mean() - slope * t.mean(), slope])


def fit_hyperbolic(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    return least_squares(hyperbolic, t, y, start_line(t, y, 10))


def fit_exponential(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    b = fit_hyperbolic(t[:6], y[:6])
    return least_squares(exponential, t, y, np.array([b[0], b[1] * 100, 100.0]))


FITS = {"hyper": fit_hyperbolic, "exp": fit_exponential}


def fitted(points: DataFrame, keys: list[str], kind: str, start: int, end: int) -> DataFrame:
    """keys, b0, b1, b2 of the points (lag, value) with start <= lag < end; unknown values are left out, no point gives no row, and points that no curve begins at (a value of 0 among the first) give unknown parameters."""
    fields = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lag")
        b = FITS[kind](group["lag"].to_numpy(float), group["value"].to_numpy(float))
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), *[x if np.isfinite(x) else None for x in b], *[None] * (3 - len(b))]], columns=[*keys, "b0", "b1", "b2"])

    rows = points.where(f"lag >= {start} and lag < {end} and value is not null and not isnan(value)").select(*keys, "lag", "value")
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, b0 double, b1 double, b2 double")
