"""Quadratic surfaces fitted in square windows, valley width over scales, and flexure by Fourier transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators.neighbours import under_kernel

#: Twice pi as the flexure filter has it.
TWO_PI = 2 * 3.141


def inverse_normal(scale: float, dx: float, fix_center: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Inverse normal matrix of a x^2 + b y^2 + c xy + d x + e y (+ f) in the window |x|, |y| <= scale, and its coordinates."""
    n = int(math.floor(scale / dx + 1e-9))
    u = np.arange(-n, n + 1) * dx
    x, y = (g.ravel() for g in np.meshgrid(u, u))
    terms = [x * x, y * y, x * y, x, y] + ([] if fix_center else [np.ones_like(x)])
    a = np.stack(terms, axis=1)
    return np.linalg.inv(a.T @ a), u


def periodic_images(grid: Grid, pad: int) -> Grid:
    """The grid with ``pad`` rows and columns of its other side around it."""
    geo = grid.geo

    def images(c: str, n: int) -> Column:
        here = F.col(c)
        return F.array_compact(F.array(here, F.when(here >= n - pad, here - n), F.when(here < pad, here + n)))

    return Grid(grid.cells.withColumn("row", F.explode(images("row", geo.ny))).withColumn("col", F.explode(images("col", geo.nx))), geo)


def _window_sums(z: np.ndarray, u: np.ndarray, terms: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """For each (px, py) the sum of z x^px y^py over the square window, at places where it fits."""
    n = len(u)
    across = {p: sum(z[:, k : z.shape[1] - n + 1 + k] * u[k] ** p for k in range(n)) for p in {t[0] for t in terms}}
    return [sum(across[px][k : z.shape[0] - n + 1 + k] * u[k] ** py for k in range(n)) for px, py in terms]


def _fit(z: np.ndarray, scale: float, dx: float, fix_center: bool, pad: int) -> list[np.ndarray]:
    """Coefficients of the fit around each inner cell of an array with ``pad`` cells around it."""
    h, u = inverse_normal(scale, dx, fix_center)
    n = len(u) // 2
    part = z[pad - n : z.shape[0] - pad + n, pad - n : z.shape[1] - pad + n]
    inner = z[pad : z.shape[0] - pad, pad : z.shape[1] - pad]
    # y grows to the north, rows to the south
    powers = [(2, 0), (0, 2), (1, 1), (1, 0), (0, 1)] + ([] if fix_center else [(0, 0)])
    ones = [np.multiply.outer(u**py, u**px).sum() for px, py in powers]
    moments = [(m if py % 2 == 0 else -m) - o * inner for m, o, (_, py) in zip(_window_sums(part, u, powers), ones, powers, strict=True)]
    return [sum(h[k, i] * m for i, m in enumerate(moments)) for k in range(len(powers))]


def least_curvature(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return -a - b - np.sqrt((a - b) ** 2 + c**2)


def _by_tile(grid: Grid, pad: int, tile: int, function, schema: str) -> DataFrame:
    """A function of (array with padding, first row, first column) for each tile of the periodic grid."""
    geo = grid.geo
    padded = periodic_images(grid, pad).cells
    reach = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - pad) / tile), F.lit(0)).cast("long"), F.least(F.floor((F.col(c) + pad) / tile), F.lit((n - 1) // tile)).cast("long"))
    dealt = padded.withColumn("tr", F.explode(reach("row", geo.ny))).withColumn("tc", F.explode(reach("col", geo.nx)))

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        h, w = min(tile, geo.ny - r0), min(tile, geo.nx - c0)
        z = np.full((h + 2 * pad, w + 2 * pad), np.nan)
        r, c = cells["row"].to_numpy() - r0 + pad, cells["col"].to_numpy() - c0 + pad
        ok = (r >= 0) & (r < z.shape[0]) & (c >= 0) & (c < z.shape[1])
        z[r[ok], c[ok]] = cells["value"].to_numpy()[ok]
        return function(z, r0, c0)

    return dealt.groupBy("tr", "tc").applyInPandas(run, schema)


def _frame(r0: int, c0: int, **bands: np.ndarray) -> pd.DataFrame:
    shape = next(iter(bands.values())).shape
    r, c = np.indices(shape)
    return pd.DataFrame({"row": r.ravel() + r0, "col": c.ravel() + c0, **{k: v.ravel() for k, v in bands.items()}})


def _nulls(df: DataFrame, *bands: str) -> DataFrame:
    return df.withColumns({b: F.when(~F.isnan(b), F.col(b)) for b in bands})


def quadratic_coefficients(grid: Grid, scale: float, fix_center: bool = False, tile: int = 256) -> Grid:
    """Bands a, b, c, d, e (and f): the quadratic surface fitted to z minus its centre value in each cell's window."""
    dx = grid.geo.dx
    pad = int(math.floor(scale / dx + 1e-9))
    names = ["a", "b", "c", "d", "e"] + ([] if fix_center else ["f"])
    rows = _by_tile(grid, pad, tile, lambda z, r0, c0: _frame(r0, c0, **dict(zip(names, _fit(z, scale, dx, fix_center, pad), strict=True))), "row long, col long, " + ", ".join(f"{n} double" for n in names))
    return Grid(_nulls(rows, *names), grid.geo)


def minimum_curvature(grid: Grid, scale: float, fix_center: bool = False) -> Grid:
    """-a - b - sqrt((a - b)^2 + c^2) of the fit at one scale, all in the JVM: the fit is a weighted sum under the window."""
    dx = grid.geo.dx
    h, u = inverse_normal(scale, dx, fix_center)
    n = len(u) // 2
    offsets, weights = [], []
    for i in range(-n, n + 1):
        for j in range(-n, n + 1):
            x, y = j * dx, -i * dx
            t = np.array([x * x, y * y, x * y, x, y] + ([] if fix_center else [1.0]))
            offsets.append((i, j, 1.0))
            weights.append(h[:3] @ t)
    total = np.sum(weights, axis=0)
    kernel = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    at = (F.col("di") + n) * len(u) + F.col("dj") + n
    sums = under_kernel(grid, offsets, [F.sum(F.col("v") * kernel[at][k]).alias(name) for k, name in enumerate("abc")] + [F.count("*").alias("n")], wrap=True)
    rows = grid.cells.join(sums, ["row", "col"])
    a, b, c = (F.col(name) - F.lit(float(total[k])) * F.col("value") for k, name in enumerate("abc"))
    return Grid(rows.select("row", "col", F.when(F.col("n") == len(offsets), -a - b - F.sqrt((a - b) * (a - b) + c * c)).alias("value")), grid.geo)


def valley_width(elevation: Grid, area: Grid, area_cutoff: float, max_width: float, min_width: float, fix_center: bool = False, normalize: bool = False, tile: int = 256) -> Grid:
    """Bands value (the scale of the strongest concavity) and min_c (its minimum curvature) where the area reaches the cutoff.

    Scales go from min_width in steps of dx; a scale is taken where its curvature, times the
    scale if asked, is below 0 and below those before.
    """
    dx = elevation.geo.dx
    scales = np.arange(min_width, max_width, dx)
    pad = int(math.floor(scales.max() / dx + 1e-9)) if len(scales) else 0

    def run(z: np.ndarray, r0: int, c0: int) -> pd.DataFrame:
        shape = (z.shape[0] - 2 * pad, z.shape[1] - 2 * pad)
        width, best = np.full(shape, np.nan), np.zeros(shape)
        for s in scales:
            c = least_curvature(*_fit(z, s, dx, fix_center, pad)[:3]) * (s if normalize else 1.0)
            better = c < best
            width[better], best[better] = s, c[better]
        return _frame(r0, c0, value=width, min_c=best)

    found = _nulls(_by_tile(elevation, pad, tile, run, "row long, col long, value double, min_c double"), "value", "min_c")
    rows = found.join(area.renamed("area"), ["row", "col"], "left")
    on = F.col("area") >= area_cutoff
    return Grid(rows.select("row", "col", F.when(on, F.col("value")).alias("value"), F.when(on, F.col("min_c")).alias("min_c")), elevation.geo)


def fitted_surface(grid: Grid, x: float, y: float, scale: float, fix_center: bool = False) -> Grid:
    """The surface fitted around the cell of (x, y), evaluated over all cells."""
    row, col = grid.geo.cell(x, y)
    one = quadratic_coefficients(grid, scale, fix_center).at(row, col).join(grid.at(row, col).select(F.col("value").alias("z0")))
    u, v = grid.geo.x() - F.lit(grid.geo.point(row, col)[0]), grid.geo.y() - F.lit(grid.geo.point(row, col)[1])
    k = {n: F.col(f"fit.{n}") for n in "abcde"}
    const = F.col("fit.z0") + (F.lit(0.0) if fix_center else F.col("fit.f"))
    cells = grid.cells.select("row", "col").join(F.broadcast(one.select(F.struct(*"abcde", *([] if fix_center else ["f"]), "z0").alias("fit"))))
    return Grid(cells.select("row", "col", (k["a"] * u * u + k["b"] * v * v + k["c"] * u * v + k["d"] * u + k["e"] * v + const).alias("value")), grid.geo)


def _wavenumbers(n: int, dx: float) -> np.ndarray:
    """Rising and falling wavenumbers of the flexure filter: steps of 1 / (dx n / 2) up to the middle and back."""
    half = (n + 1) // 2
    up = np.arange(half) / (dx * half)
    return np.concatenate([up, up[::-1]])[:n]


def deflection(elevation: Grid, D: float, rho_m: float, rho_c: float, g: float, restored: Grid | None = None) -> Grid:
    """Flexure of a plate of rigidity D under the load of the elevation; that of a restored elevation taken off, if given.

    A row's transform, a column's transform with the filter and back, and the rows' inverse are
    three grouped passes, so that a task holds one line of the grid.
    """
    if restored is not None:
        both = deflection(elevation, D, rho_m, rho_c, g).join(deflection(restored, D, rho_m, rho_c, g), "other")
        return both.map(F.col("value") - F.col("other"))
    geo = elevation.geo
    wx, wy = _wavenumbers(geo.nx, geo.dx), _wavenumbers(geo.ny, geo.dx)

    def forward(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(geo.nx)
        z[cells["col"]] = -cells["value"] * rho_c * g
        f = np.fft.fft(z)
        return pd.DataFrame({"row": key[0], "k": np.arange(geo.nx), "re": f.real, "im": f.imag})

    def filtered(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros(geo.ny, complex)
        f[cells["row"]] = cells["re"].to_numpy() + 1j * cells["im"].to_numpy()
        response = 1 / ((rho_m - rho_c) * g + TWO_PI**4 * D * (wx[key[0]] ** 2 + wy**2) ** 2)
        f = np.fft.ifft(np.fft.fft(f) * response)
        return pd.DataFrame({"row": np.arange(geo.ny), "k": key[0], "re": f.real, "im": f.imag})

    def backward(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros(geo.nx, complex)
        f[cells["k"]] = cells["re"].to_numpy() + 1j * cells["im"].to_numpy()
        return pd.DataFrame({"row": key[0], "col": np.arange(geo.nx), "value": np.fft.ifft(f).real})

    waves = "row long, k long, re double, im double"
    rows = elevation.cells.where("value is not null").select("row", "col", "value").groupBy("row").applyInPandas(forward, waves)
    rows = rows.groupBy("k").applyInPandas(filtered, waves)
    return Grid(rows.groupBy("row").applyInPandas(backward, "row long, col long, value double"), geo)
