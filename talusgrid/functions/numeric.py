"""Numerical routines for grouped and Arrow functions: a simplex search, Student's t, least squares."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[float], float], start: float, tolerance: float = 1e-5, iterations: int = 100, evaluations: int = 200) -> tuple[float, float, bool]:
    """The minimum of a function of one number by a simplex of two points: place, value, and whether it settled.

    The first step is 5 % of the start (0.00025 at 0).
    """
    simplex = [(start, f(start))]
    other = start * 1.05 if start else 0.00025
    simplex.append((other, f(other)))
    used = 2
    for _ in range(iterations):
        simplex.sort(key=lambda p: p[1])
        (best, fb), (worst, fw) = simplex
        if abs(worst - best) <= tolerance and abs(fw - fb) <= tolerance:
            return best, fb, True
        if used >= evaluations:
            return best, fb, False
        reflected = 2 * best - worst
        fr = f(reflected)
        used += 1
        if fr < fb:
            expanded = 3 * best - 2 * worst
            fe = f(expanded)
            used += 1
            simplex[1] = (expanded, fe) if fe < fr else (reflected, fr)
        else:
            outside = fr < fw
            inner = 1.5 * best - 0.5 * worst if outside else 0.5 * (best + worst)
            fi = f(inner)
            used += 1
            if fi <= (fr if outside else fw):
                simplex[1] = (inner, fi)
            else:
                shrunk = best + 0.5 * (worst - best)
                simplex[1] = (shrunk, f(shrunk))
                used += 1
    simplex.sort(key=lambda p: p[1])
    return (*simplex[0], False)


def nelder_mead_rows(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: float, rows: int, tolerance: float = 1e-5, iterations: int = 100, evaluations: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the minima of many functions of one number: ``nelder_mead`` for each, in step.

    ``f`` has the places and the rows they are for. Rows that settle take no further part.
    """
    every = np.arange(rows)
    best, worst = np.full(rows, start), np.full(rows, start * 1.05 if start else 0.00025)
    fb, fw = f(best, every), f(worst, every)
    used = np.full(rows, 2)
    on = every

    def sort(at: np.ndarray) -> None:
        at = at[fw[at] < fb[at]]
        best[at], worst[at], fb[at], fw[at] = worst[at], best[at], fw[at], fb[at]

    for _ in range(iterations):
        sort(on)
        with np.errstate(invalid="ignore"):
            settled = (np.abs(worst[on] - best[on]) <= tolerance) & (np.abs(fw[on] - fb[on]) <= tolerance)
        on = on[~settled & (used[on] < evaluations)]
        if not len(on):
            break
        reflected = 2 * best[on] - worst[on]
        fr = f(reflected, on)
        used[on] += 1
        better = fr < fb[on]
        at, r, v = on[better], reflected[better], fr[better]
        expanded = 3 * best[at] - 2 * worst[at]
        fe = f(expanded, at)
        used[at] += 1
        far = fe < v
        worst[at], fw[at] = np.where(far, expanded, r), np.where(far, fe, v)
        at, v = on[~better], fr[~better]
        outside = v < fw[at]
        inner = np.where(outside, 1.5 * best[at] - 0.5 * worst[at], 0.5 * (best[at] + worst[at]))
        fi = f(inner, at)
        used[at] += 1
        taken = fi <= np.where(outside, v, fw[at])
        worst[at[taken]], fw[at[taken]] = inner[taken], fi[taken]
        at = at[~taken]
        worst[at] = best[at] + 0.5 * (worst[at] - best[at])
        fw[at] = f(worst[at], at)
        used[at] += 1
    sort(on)
    return best, fb


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    """The chance that Student's t is farther from 0 than ``t``."""
    if freedom <= 0 or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def through_origin(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and residual sum of squares of y = k x; (0, 0) where x is all zero."""
    xx = float(x @ x)
    if xx == 0 or not np.isfinite(xx):
        return 0.0, 0.0
    k = float(x @ y) / xx
    return k, float(((y - k * x) ** 2).sum())


def through_origin_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``through_origin`` of each row."""
    xx, xy = dot_rows(x, x), dot_rows(x, y)
    flat = (xx == 0) | ~np.isfinite(xx)
    with np.errstate(all="ignore"):
        k = np.where(flat, 0.0, xy / xx)
        return k, np.where(flat, 0.0, ((y - k[:, None] * x) ** 2).sum(axis=1))


def dot_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each row of x with that of y."""
    return np.matmul(x[:, None, :], y[:, :, None])[:, 0, 0]
